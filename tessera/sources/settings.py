"""Settings of the classifier jobs, from the part of YAML that such files use: unknown keys ignored, known ones overridden by name."""

from __future__ import annotations

import dataclasses
import logging
import math
import random
import sys
from datetime import datetime
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Settings:
    output_dir: str = "models/classifier"
    num_train_epochs: int = 10
    weight_decay: float = 0.03
    seed: int = 42
    class_weight_smoothing: float = 0.5
    uncertainty_threshold: float = 0.7
    early_stopping_patience: int = 2
    max_length: int = 512
    features: int = 1 << 14

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a mapping; keys that are no settings are ignored, texts become the type of their default."""
        known = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        return cls(**{k: known[k](v) for k, v in values.items() if k in known})

    @classmethod
    def read(cls, path: str, section: str = "model") -> Settings:
        return cls.of(parse_yaml(Path(path).read_text(encoding="utf-8")).get(section) or {})

    def override(self, **values) -> Settings:
        """With the given values where they name a setting and aren't None (as a sweep or a command line sets them)."""
        names = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in values.items() if k in names and v is not None})


@dataclasses.dataclass(frozen=True)
class Sweep:
    """A search over settings: how many runs, what to maximise or minimise, and the distribution of each parameter."""

    runs: int
    metric: str
    maximise: bool
    parameters: dict[str, dict]

    @classmethod
    def read(cls, path: str) -> Sweep:
        d = parse_yaml(Path(path).read_text(encoding="utf-8"))
        metric = d.get("metric") or {}
        return cls(int(d.get("run_cap", 1)), metric.get("name", ""), metric.get("goal", "maximize") == "maximize", d.get("parameters") or {})

    def draws(self, seed: int) -> list[dict]:
        """The values of each run: listed values, or uniform or log-uniform ones between min and max."""
        rng, out = random.Random(seed), []
        for _ in range(self.runs):
            one = {}
            for name, p in self.parameters.items():
                if "values" in p:
                    one[name] = rng.choice(p["values"])
                elif "value" in p:
                    one[name] = p["value"]
                else:
                    low, high = float(p["min"]), float(p["max"])
                    log = str(p.get("distribution", "")).startswith("log_uniform")
                    one[name] = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
            out.append(one)
        return out


def parse_yaml(text: str) -> dict:
    """Nested maps by indentation, lists in brackets or by dashes, scalars; comments are dropped. No anchors, no block texts."""
    lines = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if line.strip() and not line.lstrip().startswith("#"):
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(i: int, indent: int):
        if lines[i][1].startswith("- "):
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                out.append(scalar(lines[i][1][2:]))
                i += 1
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == indent:
            name, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip():
                out[name.strip()] = scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or (lines[i][0] == indent and lines[i][1].startswith("- "))):
                out[name.strip()], i = block(i, lines[i][0])
            else:
                out[name.strip()] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def scalar(text: str):
    """A number, truth value, list in brackets or text."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        return [scalar(x) for x in t[1:-1].split(",") if x.strip()]
    if t[:1] in "\"'" and t[-1:] == t[:1]:
        return t[1:-1]
    if t in ("true", "false"):
        return t == "true"
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            continue
    return t


def run_name(model: str, job: str = "", at: datetime | None = None) -> str:
    """What a run is called: the last part of the model's name, the job, and the time to the minute."""
    parts = [model.rsplit("/", 1)[-1], job, f"{at or datetime.now():%Y%m%d_%H%M}"]
    return "_".join(p for p in parts if p)


def log_to_stdout(level: int = logging.INFO, quiet: tuple[str, ...] = ("py4j", "pyspark")) -> None:
    """Root logger to standard output; the named libraries only warn."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", stream=sys.stdout)
    for name in quiet:
        logging.getLogger(name).setLevel(logging.WARNING)
