"""Annotators: a registry of providers, bounded labelling row by row with retries, and batch jobs that are submitted, polled and fetched."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, ship, spread
from ..sources.tables import read_json_lines, table_exists, write_json_lines
from . import labels

#: Calls under way at once over the whole cluster, tries per row, and rows between two checkpoints of a streamed job.
AT_ONCE, TRIES, CHECKPOINT_ROWS = 20, 3, 50
LABELS = labels.LABELS
#: Takes prompt, title and abstract, and returns an answer (a mapping) or raises.
Client = Callable[[str, str, str], dict]


@dataclass(frozen=True)
class Provider:
    """How to get at an annotator: which environment variable holds its secret (None: it needs none), and a maker of its client."""

    name: str
    model: str
    secret: str | None
    make: Callable[[str | None], Client]


PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    PROVIDERS[provider.name] = provider


def client(name: str) -> Client:
    """The client of a registered provider. It is made where it is used, so its library and secret are needed only there."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}")
    p = PROVIDERS[name]
    return p.make(secret(p.secret) if p.secret else None)


def secret(variable: str) -> str:
    """A secret from the environment of the process that calls; it never enters a plan."""
    value = os.environ.get(variable)
    if not value:
        raise RuntimeError(f"the environment variable {variable} is not set")
    return value


def keywords(_: str | None = None) -> Client:
    """An offline annotator: POSITIVE where title or abstract speak of a new dataset, UNSURE without an abstract."""

    def ask(prompt: str, title: str, abstract: str) -> dict:
        text = f"{title} {abstract}".lower()
        found = any(f"{a} {b}" in text for a in ("new", "novel") for b in ("dataset", "corpus", "benchmark"))
        return {"reasoning": "", "label": "POSITIVE" if found else "NEGATIVE" if abstract.strip() else "UNSURE", "justification": "keywords"}

    return ask


def unsteady(every: int) -> Callable[[], Client]:
    """Makes keyword annotators that fail the first len(title) % every calls for a title, to try out retries."""

    def make() -> Client:
        ask, calls = keywords(), {}

        def one(prompt: str, title: str, abstract: str) -> dict:
            calls[title, abstract] = n = calls.get((title, abstract), 0) + 1
            if n <= len(title) % every:
                raise ConnectionError("busy")
            calls.pop((title, abstract))
            return ask(prompt, title, abstract)

        return one

    return make


register(Provider("keywords", "rules", None, keywords))


def asked(ask: Client, prompt: str, title: str | None, abstract: str | None, tries: int = TRIES) -> dict:
    """An answer that fits the labels, after so many tries at most; else UNSURE, with the justification API Error."""
    for _ in range(tries):
        try:
            answer = ask(prompt, title or "", abstract or "")
            if answer["label"] in LABELS:
                return answer
        except Exception:  # noqa: BLE001  whatever a client raises, the row must not be lost
            continue
    return {"label": "UNSURE", "justification": "API Error"}


def label_rows(df: DataFrame, provider: str, task: labels.Task, make: Callable[[], Client] | None = None, at_once: int = AT_ONCE, tries: int = TRIES) -> DataFrame:
    """df with ``{provider}_{field}`` of every row, at most about at_once calls under way over the cluster.

    Columns title and abstract are asked for; a row keeps its other columns, so nothing depends on the order of answers.
    """
    workers = max(1, at_once // max(1, df.sparkSession.sparkContext.defaultParallelism))
    make, fields = make or (lambda p=PROVIDERS[provider]: p.make(secret(p.secret) if p.secret else None)), task.columns
    kind = T.StructType([*df.schema.fields, *(T.StructField(f"{provider}_{f.name}", f.dataType) for f in task.schema.fields)])
    prompt = task.prompt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                answers = list(pool.map(lambda r: asked(ask, prompt, r[0], r[1], tries), zip(b["title"], b["abstract"])))
                got = pd.DataFrame({f"{provider}_{f}": pd.Series([a.get(f) for a in answers], dtype=object, index=b.index) for f in fields})
                yield pd.concat([b, got], axis=1)

    return df.mapInPandas(run, kind)


class Service(Protocol):
    """Where batches of request lines are sent to."""

    def submit(self, lines: DataFrame) -> str: ...
    def status(self, job: str) -> str: ...
    def results(self, job: str) -> DataFrame: ...


class FolderService:
    """A service in the shared folder: requests are lines there, and a job is done once its answers are.

    answer: makes the answer lines of the request lines (a column value each); polls: how often a job is reported as
    running before it is worked off.
    """

    def __init__(self, spark: SparkSession, answer: Callable[[DataFrame], DataFrame], polls: int = 1):
        self.spark, self.answer, self.polls, self.asked = spark, answer, polls, {}
        self.root = f"{shared_dir(spark)}/batches"

    def submit(self, lines: DataFrame) -> str:
        job = uuid.uuid4().hex
        write_json_lines(lines, "line", f"{self.root}/{job}/requests")
        return job

    def status(self, job: str) -> str:
        if not table_exists(self.spark, f"{self.root}/{job}/requests"):
            return "UNKNOWN"
        self.asked[job] = self.asked.get(job, 0) + 1
        if self.asked[job] <= self.polls:
            return "RUNNING"
        if not table_exists(self.spark, f"{self.root}/{job}/answers/_SUCCESS"):
            write_json_lines(self.answer(read_json_lines(self.spark, f"{self.root}/{job}/requests")), "value", f"{self.root}/{job}/answers")
        return "SUCCESS"

    def results(self, job: str) -> DataFrame:
        return read_json_lines(self.spark, f"{self.root}/{job}/answers")


def submit(df: DataFrame, provider: str, task: labels.Task, model: str, service: Service, key: str = "bibkey") -> str:
    """Send the request lines of all rows; returns the job's name."""
    return service.submit(labels.requests(df, provider, task, model, key))


def wait(service: Service, job: str, seconds: float = 60, polls: int = 1_440) -> None:
    """Poll until the job is done; raises where it fails or takes too long."""
    for _ in range(polls):
        state = service.status(job)
        if state == "SUCCESS":
            return
        if state != "RUNNING":
            raise RuntimeError(f"batch {job}: {state}")
        time.sleep(seconds)
    raise TimeoutError(f"batch {job} is still running")


def fetch(df: DataFrame, provider: str, service: Service, job: str, task: labels.Task, key: str = "bibkey") -> DataFrame:
    """df with the valid answers of a finished job; rows without one hold nulls. Raises where the job isn't finished."""
    if (state := service.status(job)) != "SUCCESS":
        raise RuntimeError(f"batch {job} is not finished: {state}")
    return labels.merge(df, labels.parse(service.results(job), provider, task.schema), provider, key, task.columns)


def answers(provider: str, ask: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """Work off request lines offline: each is answered by ask(message), in the provider's shape; an error becomes an error line."""
    where = {"mistral": ("custom_id", ("body", "messages", 1, "content")), "google": ("key", ("request", "contents", 0, "parts", 0, "text")), "claude": ("custom_id", ("params", "messages", 0, "content"))}
    name, path = where[provider]

    def one(text: str) -> str:
        line = json.loads(text)
        message = line
        for step in path:
            message = message[step]
        out = {name: line[name]}
        try:
            reply = ask(message)
        except Exception as e:  # noqa: BLE001
            return json.dumps(out | ({"result": {"type": "errored", "error": str(e)}} if provider == "claude" else {"error": str(e)}))
        if provider == "mistral":
            out["response"] = {"body": {"choices": [{"message": {"content": json.dumps(reply)}}]}}
        elif provider == "google":
            out["response"] = {"candidates": [{"content": {"parts": [{"text": json.dumps(reply)}]}}]}
        else:
            out["result"] = {"type": "succeeded", "message": {"content": [{"input": reply}]}}
        return json.dumps(out)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"value": [one(x) for x in b["value"]]})

    return lambda lines: spread(lines).mapInPandas(run, "value string")


def labelled_in_order(df: DataFrame, provider: str, task: labels.Task, *order: str, **how) -> DataFrame:
    """label_rows with the place of each row in an order (idx), by which the result comes sorted."""
    from .sampling import enumerated

    return label_rows(enumerated(df, *order), provider, task, **how).orderBy(F.col("idx"))


ship(__name__)
