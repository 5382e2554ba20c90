"""Problem 4: the language of each document and of each segment of a mixed one, with a confidence.

Method: prediction by partial matching. Per language, variable-order contexts of up to ORDER bytes with escape
probabilities (method C) give the exact code length of a sentence under frozen statistics. The cheapest path over the
sentences, where changing the language costs SWITCH bits, gives the segments; the languages seen with a venue are the
prior of a document's first language.

The models are fitted on a sample of at most about TEXTS different labelled texts and CHARACTERS characters per language,
chosen by hash on the cluster; labels may be wrong, so only those sentences are used that plain byte string frequencies
give to the language of the label, too. Confidence is calibrated on sentences that the models compared have not seen: the
share of the evidence in bits that makes their labels likeliest. All documents are scored whole. The code length
of a place depends on its last ORDER + 1 bytes only, so it is computed once per distinct such string in a batch.

Null and blank texts give no segment. A language without labelled texts is never given. Texts of more than
LONGEST characters are scored, but are no training texts. Of rows with equal keys the one
loaded last counts (ties: the larger hash). Very short texts follow the prior. Null venues give no hint.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, not_blank
from ..session import join_known, materialize, ship, small, spread

ORDER = 4
#: Bound of the training sample: labelled texts per language, and characters used of all of one language's.
TEXTS, CHARACTERS = 1_500, 600_000
#: Longer texts are no training texts (they are scored whole like all others).
LONGEST = 20_000
#: Every so many sentences of the sample one is held out for the calibration of confidence.
HELD_OUT = 5
#: Venues that are broadcast at most.
VENUES = 100_000
#: Bits that a change of language costs.
SWITCH = 14.0
BATCH_BYTES = 1_000_000
#: Two-letter codes by other codes and names.
CODES = {
    "en": "eng english anglais englisch", "fr": "fra fre french francais français", "de": "deu ger german deutsch", "es": "spa spanish espanol español castellano",
    "it": "ita italian italiano", "pt": "por portuguese portugues português", "zh": "zho chi cmn chinese mandarin 中文",
}
#: Labels that say nothing.
UNKNOWN = ("", "unk", "und", "unknown", "undetermined", "mul", "mis", "zxx", "xx", "none", "null", "nan", "na", "n/a", "other", "multilingual", "mixed", "?", "-")
QUOTED = re.compile(r'"[^"\n]{3,300}?"|“[^”\n]{3,300}?”|«[^»\n]{3,300}?»|„[^“”\n]{3,300}?[“”]|「[^」\n]{2,200}?」|《[^》\n]{2,200}?》')
#: Where a sentence ends: a terminator before a blank, Chinese terminators, line ends, and signs that set parts apart.
END = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?…][\"”»)]))[\s​]+|(?<=[。！？；])|(?<=[。！？][”」』])|[\r\n]+|\s+[/|—–•]+\s+|(?:\s*-{3,}\s*)")
MOJIBAKE = re.compile("[ÃÂâ][\u0080-¿€‘-™Œ-ƒˆ˜]")


def code(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null where it names no language."""
    head = F.regexp_replace(F.lower(F.regexp_replace(label, f"[{WHITE}.()\\[\\]]", "")), r"[-_].*$", "")
    known = {x: c for c, names in CODES.items() for x in (c, *names.split())} | dict.fromkeys(UNKNOWN, "")
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.nullif(F.coalesce(F.try_element_at(table, head), head), F.lit(""))


def clean(text: str) -> str:
    """Lower case, one form of each character, digits alike, without tags, quoted titles and damage of encodings."""
    if MOJIBAKE.search(text):
        parts = []
        for w in re.split(r"(\s+)", text):
            try:
                parts.append(w.encode("cp1252").decode("utf-8") if MOJIBAKE.search(w) else w)
            except (UnicodeEncodeError, UnicodeDecodeError):
                parts.append(w)
        text = "".join(parts)
    text = QUOTED.sub(" ", html.unescape(re.sub(r"</?[a-zA-Z][^>]{0,80}>", " ", text)))
    text = re.sub(r"https?://\S+", " ", text)
    text = re.sub(r"[(（]\s*(?:see|cf|after|vgl|siehe|voir|véase|vedi|ver|nach|according to)?\.?\s*[)）]", " ", text, flags=re.I)
    return re.sub(r"[0-9]+", "0", unicodedata.normalize("NFKC", text.replace("​", "").replace("­", "")))


def sentences(text: str) -> list[str]:
    """Sentences in reading order; a heading stands with the sentence after it, a scrap with the one before."""
    out: list[str] = []
    held = ""
    for p in END.split(clean(text)):
        p = (p or "").strip()
        if not p:
            continue
        letters = [c for c in p if c.isalpha()]
        wide = sum("㐀" <= c <= "鿿" for c in letters)
        if len(letters) + 3 * wide < 12 or (not wide and len(p.split()) < 3):
            held = f"{held} {p}".strip()
            continue
        out.append(f"{held} {p}".strip())
        held = ""
    if held:
        if out:
            out[-1] += f" {held}"
        else:
            out.append(held)
    return out


def _keys(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER + 1 bytes at every place, packed; and where each part's places begin."""
    raw = [b" " * ORDER + p.lower().encode("utf-8", "replace") for p in parts]
    c = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    key = np.zeros(len(c), np.uint64)
    for j in range(ORDER + 1):
        key[j:] |= c[: len(c) - j] << np.uint64(8 * j)
    size = np.array([len(r) for r in raw])
    ends = np.cumsum(size)
    use = np.ones(len(c), bool)
    for j in range(ORDER):
        use[ends - size + j] = False
    return key[use], ends - size - ORDER * np.arange(len(raw))


class Model:
    """Frozen context statistics of several languages: by order the sorted strings and their counts, and those of their contexts."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.grams, self.contexts = languages, [], []
        every = np.unique(np.concatenate([k for k, _ in counts])) if counts else np.zeros(0, np.uint64)
        n = np.zeros((len(every), len(languages)), np.float32)
        for i, (k, c) in enumerate(counts):
            n[np.searchsorted(every, k), i] = c
        for order in range(ORDER + 1):
            low, at = np.unique(every & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            g = np.zeros((len(low), len(languages)), np.float32)
            np.add.at(g, at, n)
            context, up = np.unique(low >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((2, len(context), len(languages)), np.float32)
            np.add.at(total, up, g)
            np.add.at(kinds, up, g > 0)
            self.grams.append((low, g))
            self.contexts.append((context, total, kinds))

    @classmethod
    def of(cls, state: dict) -> Model:
        """From a model's __dict__; broadcasts hold plain values, so that executors need not have this package."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> Model:
        languages = sorted(x for x in texts if texts[x])
        return cls(languages, [np.unique(_keys(texts[x])[0], return_counts=True) for x in languages])

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each key given those before, by language."""
        out, done = np.zeros((2, len(key), len(self.languages)), np.float32)
        done = done.astype(bool)
        for order in range(ORDER, -1, -1):
            low, g = self.grams[order]
            context, total, kinds = self.contexts[order]
            k = key & np.uint64((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(low, k), len(low) - 1)
            n = np.where((low[at] == k)[:, None], g[at], 0)
            up = np.minimum(np.searchsorted(context, k >> np.uint64(8)), len(context) - 1)
            known = (context[up] == k >> np.uint64(8))[:, None]
            t, q = np.where(known, total[up], 0), np.where(known, kinds[up], 0)
            hit = (n > 0) & ~done
            escape = (t > 0) & ~hit & ~done
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(hit, np.log2((t + q) / n), 0) + np.where(escape, np.log2((t + q) / q), 0)
            done |= hit
        return out + np.where(done, 0, 8)

    def lengths(self, parts: list[str]) -> np.ndarray:
        """Code length of each part, by language."""
        out, a = np.zeros((len(parts), len(self.languages))), 0
        while a < len(parts):
            b, size = a, 0
            while b < len(parts) and (b == a or size < BATCH_BYTES):
                size += 2 * len(parts[b])
                b += 1
            key, starts = _keys(parts[a:b])
            if len(key):
                distinct, at = np.unique(key, return_inverse=True)
                whole = np.r_[np.zeros((1, len(self.languages))), np.cumsum(self.bits(distinct)[at], axis=0, dtype=np.float64)]
                out[a:b] = whole[np.r_[starts[1:], len(key)]] - whole[starts]
            a = b
        return out


def path(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The cheapest language of each sentence. first: bits of the prior."""
    cost, back = bits[0] + first, []
    for b in bits[1:]:
        best = int(cost.argmin())
        stay = cost <= cost[best] + SWITCH
        back.append(np.where(stay, np.arange(len(cost)), best))
        cost = np.where(stay, cost, cost[best] + SWITCH) + b
    at = [int(cost.argmin())]
    for b in back[::-1]:
        at.append(int(b[at[-1]]))
    return np.array(at[::-1])


def sample(labelled: DataFrame, languages: list[str]) -> dict[str, list[str]]:
    """labelled: text, lang (codes). Different texts of each language, by hash, as sentences; at most about TEXTS and CHARACTERS a language."""
    full = labelled.filter(not_blank("text") & F.col("lang").isin(languages) & (F.length("text") <= LONGEST)).withColumn("h", F.xxhash64("text"))
    counts = full.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()  # one row per language
    limit = F.lit(0)
    for r in sorted(counts, key=lambda r: r["lang"]):
        limit = F.when(F.col("lang") == r["lang"], int(np.ceil(1e9 * min(1, TEXTS / r["n"], CHARACTERS / max(r["size"], 1))))).otherwise(limit)
    # copies count once; of a hash there is one text
    some = full.filter(F.pmod("h", F.lit(1_000_000_000)) < limit).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = some.toPandas().sort_values(["lang", "h"])
    return {x: [p for t in g["text"] for p in sentences(t)] for x, g in rows.groupby("lang")}


def agreeing(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sentences whose byte strings are most frequent, of all languages, in the one of their label.

    Frequencies are not conditional on the context here: strange sentences among a language's texts stay rare in it.
    """
    languages = sorted(texts)
    counts = [np.unique(_keys(texts[x])[0], return_counts=True) for x in languages]
    every = np.unique(np.concatenate([k for k, _ in counts]))
    logs = np.zeros((len(every), len(languages)))
    for i, (k, n) in enumerate(counts):
        logs[np.searchsorted(every, k), i] = n
    logs = np.log((logs + 0.02) / (logs.sum(0) + 0.02 * len(every)))
    out = {}
    for i, x in enumerate(languages):
        key, starts = _keys(texts[x])
        whole = np.r_[np.zeros((1, len(languages))), np.cumsum(logs[np.searchsorted(every, key)], axis=0)]
        best = (whole[np.r_[starts[1:], len(key)]] - whole[starts]).argmax(1)
        out[x] = [p for p, j in zip(texts[x], best) if j == i]
    return {x: p for x, p in out.items() if p}


def fit(labelled: DataFrame, languages: list[str]) -> tuple[Model, float]:
    """The models, and the share of the evidence that counts for confidence."""
    texts = {x: p for x, p in sample(labelled, languages).items() if p}
    for _ in range(2):
        texts = agreeing(texts) if texts else texts
    return Model.fit(texts), calibrated(texts)


def calibrated(texts: dict[str, list[str]]) -> float:
    """The factor of the bits under which the languages of held-out sentences (every HELD_OUT-th) are likeliest; with too few of them one tenth."""
    held = {x: p[::HELD_OUT] for x, p in texts.items()}
    rest = {x: [s for i, s in enumerate(p) if i % HELD_OUT] for x, p in texts.items()}
    model = Model.fit(rest)
    parts = [(s, model.languages.index(x)) for x, p in held.items() if x in model.languages for s in p]
    if len(parts) < 100 or len(model.languages) < 2:
        return 0.1
    bits = model.lengths([s for s, _ in parts])
    own = np.array([i for _, i in parts])
    best, factor = np.inf, 0.1
    for f in np.geomspace(0.005, 1, 60):
        z = -(bits - bits.min(1, keepdims=True)) * f * np.log(2)
        loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(own)), own]).mean()
        if loss < best - 1e-12:
            best, factor = loss, float(f)
    return factor


def venue_counts(df: DataFrame, venues: str, lang: Column, languages: list[str]) -> DataFrame:
    """(v, n, times): how many rows of each language hold a venue, and how many rows at all."""
    rows = df.select(F.explode(F.array_distinct(F.coalesce(F.col(venues), F.array().cast("array<string>")))).alias("v"), lang.alias("l")).filter(F.col("v").isNotNull())
    counts = rows.groupBy("v").agg(F.count("*").alias("times"), *(F.count_if(F.col("l") == x).alias(f"n{i}") for i, x in enumerate(languages)))
    return counts.select("v", F.array(*(f"n{i}" for i in range(len(languages)))).alias("n"), "times")


def hint(n: np.ndarray) -> np.ndarray:
    """Bits of each language by how often each is seen with a venue; none where no language is."""
    return -np.log2((n + 1) / (n.sum() + len(n))) if n.sum() else np.zeros(len(n))


def latest(df: DataFrame, key: str, time: str, *content: str) -> DataFrame:
    """df with one row per key, the one loaded last; only keys that repeat are looked at twice."""
    order = F.struct(F.coalesce(F.col(time), F.lit("1900-01-01").cast("timestamp_ntz")).alias("t"), F.xxhash64(*content).alias("h"))
    rows = df.filter(F.col(key).isNotNull()).withColumn("__o", order)
    last = rows.groupBy(F.col(key).alias("__k")).agg(F.max("__o").alias("__last"), F.count("*").alias("__n")).filter("__n > 1").select("__k", "__last")
    last = materialize(last, "repeated")
    on = [F.col(key) == F.col("__k"), F.col("__o") < F.col("__last")]
    rows = rows.join(F.broadcast(last) if small(last) else last, on, "left_anti")
    # rows equal in time and content are left; they differ in nothing that counts
    again = materialize(rows.groupBy(key, "__o").agg(F.count("*").alias("n")).filter("n > 1").select(key), "again")
    twice = rows.join(F.broadcast(again) if small(again) else again, key, "left_semi").dropDuplicates([key])
    once = rows.join(F.broadcast(again) if small(again) else again, key, "left_anti")
    return once.unionByName(twice).drop("__o")


def with_hints(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with hints, the counts of their venues, by a join on the venue. rows has key, text, label, venues."""
    each = rows.filter(F.size(F.coalesce("venues", F.array())) > 0).select("key", F.explode(F.array_distinct("venues")).alias("v"))
    seen = join_known(each, counts, ["v"], "times", how="inner").groupBy("key").agg(F.collect_list("n").alias("hints"))
    return rows.drop("hints").join(seen, "key", "left").select("key", "text", "label", "venues", "hints")


def segments(df: DataFrame, key: str, text: str, lang: str, labelled: DataFrame, languages: list[str], venues: str | None = None) -> DataFrame:
    """(key, label, n_segs, seg, lang, confidence): one row per longest run of sentences in one language.

    label: code of the language that the row names, null if none. labelled: text, lang (codes).
    """
    model, factor = fit(labelled, languages)
    rows = df.filter(not_blank(text)).select(F.col(key).alias("key"), F.col(text).alias("text"), code(F.col(lang)).alias("label"), (F.col(venues) if venues else F.lit(None).cast("array<string>")).alias("venues"))
    kind, prior = df.schema[key].dataType.simpleString(), {}
    rows = rows.withColumn("hints", F.lit(None).cast("array<array<bigint>>"))
    if venues and model.languages:
        counts = materialize(venue_counts(df, venues, code(F.col(lang)), model.languages), "venues")
        if small(counts, VENUES):
            prior = {r["v"]: np.array(r["n"], float) for r in counts.collect()}  # checked just now
        else:
            rows = with_hints(rows, counts)
    known = df.sparkSession.sparkContext.broadcast((model.__dict__, prior, factor))

    def run(batches):
        state, prior, factor = known.value
        model = Model.of(state)
        flat = np.zeros(len(model.languages))
        for b in batches:
            if not model.languages:
                continue
            parts = [sentences(t) for t in b["text"]]
            bits = model.lengths([p for s in parts for p in s])
            out, at = [], 0
            for k, label, venue, seen, s in zip(b["key"], b["label"], b["venues"], b["hints"], parts):
                own = bits[at : at + len(s)]
                at += len(s)
                if not len(s):
                    continue
                counts = seen if seen is not None else [prior[v] for v in dict.fromkeys(venue if venue is not None else ()) if v in prior]
                first = sum((hint(np.asarray(n, float)) for n in counts), flat)
                way = path(own, np.asarray(first))
                cuts = np.r_[0, np.flatnonzero(np.diff(way)) + 1, len(way)]
                for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                    gap = own[x:y].sum(0) - own[x:y, way[x]].sum()
                    sure = 1 / np.exp2(-np.clip(gap * factor, -30, 1000)).sum()
                    out.append((k, label, len(cuts) - 1, i + 1, model.languages[way[x]], float(sure)))
            yield pd.DataFrame(out, columns=["key", "label", "n_segs", "seg", "lang", "confidence"])

    out = spread(rows, "key").mapInPandas(run, f"key {kind}, label string, n_segs int, seg int, lang string, confidence double")
    return out.withColumnRenamed("key", key)


ship(__name__)
