"""Problem 8: mixing sources to target weights.

Method: soft-membership mixing. A classifier fitted on the labelled table (multinomial naive Bayes over token ids,
counted over all labelled documents) gives unlabelled documents posteriors over the domains; a labelled document
belongs to its own. Projected-gradient least squares then fits nonnegative document rates, capped by the allowed
repeats, whose expected domain token totals match the targets. Documents with the same membership share a rate, so the
labelled ones enter as one group per source, and the unlabelled ones as one group per membership (in steps of
1 / GRAIN). Where these groups are too many for the driver, every round sums over them on the cluster instead, with the
same rounds to the same rest; the sums are rounded (UNIT), so that their order makes no difference.

A source is reported as unreachable where the fitted rates leave its own documents short of its goal, and the sum of its
tokens, all used as often as allowed, is short of it, too.

Sizes are tokens of a public tokenizer; null and empty texts count none, repeated documents count each time. Sources
without a target stay out of the mix but count for its size; targets without documents are reported as unreachable.
Null shares and repeats count as 0; a source named twice among the targets has the sum of its shares. More than
MOST_DOMAINS targets raise an error; the documents' sources may be any number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship, small, spread
from .bpe import PATTERN, VOCABULARY, encode, load, slices

#: A posterior is as sharp as that of so many tokens at most; the tokens of a text aren't independent.
EVIDENCE = 50
#: Memberships are multiples of one over this.
GRAIN = 32
#: Gradient steps at most; whether they were enough is reported. On the cluster, rates are written after so many of them.
ROUNDS, WRITTEN = 2_000, 20
#: The fit has converged when a step moves the domains' totals by at most this part of all goals.
SETTLED = 1e-5
#: The domains' totals are multiples of this part of all goals.
UNIT = 2.0**-26
#: Numbers in the memberships of all groups together up to which they are fitted on the driver.
GROUP_CELLS = 5_000_000
#: Targets are a table of this many rows at most; they and their class statistics go to the driver.
MOST_DOMAINS = 1_000


def _counted(vocabulary, domains: list[str]):
    """Rows of two kinds: each document with its tokens, and their ids where it has no source (kind 0); and per domain and token id how often it occurs (kind 1)."""

    def run(batches):
        import regex

        v, find = vocabulary.value, regex.compile(PATTERN).findall
        at = {x: i for i, x in enumerate(domains)}
        size = _vocabulary_size(v)
        counts = np.zeros((len(domains), size), np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for x, y in slices(np.array([len(t or "") for t in texts], np.int64)):
                ids, n = encode(texts[x:y], v, find)
                part = b.iloc[x:y]
                label = np.repeat([at.get(s, -1) for s in part["source"]], n)
                for k in np.unique(label[label >= 0]):
                    counts[k] += np.bincount(ids[label == k], minlength=size)
                ends = np.cumsum(n)
                own = [ids[e - m : e] if s is None else None for s, e, m in zip(part["source"], ends, n)]
                yield pd.DataFrame({"kind": 0, "doc": part["doc"], "source": part["source"], "k": 0, "n": n, "ids": own})
        k, token = np.nonzero(counts)
        yield pd.DataFrame({"kind": 1, "doc": token.astype(np.int64), "source": None, "k": k, "n": counts[k, token], "ids": None})

    return run


def _vocabulary_size(v: dict[str, np.ndarray]) -> int:
    return int(max(v["to"].max(initial=0), v["bytes"].max())) + 1


def grained(p: np.ndarray) -> np.ndarray:
    """Each row of p in whole steps of one over GRAIN; the rows still sum to one."""
    q = np.rint(p * GRAIN)
    q[np.arange(len(q)), p.argmax(1)] += GRAIN - q.sum(1)
    return q / GRAIN


def _posteriors(model):
    def run(batches):
        logs, prior = model.value
        for b in batches:
            p = np.zeros((len(b), len(prior)))
            for i, ids in enumerate(b["ids"]):
                token, times = np.unique(np.asarray(ids, np.int64), return_counts=True)
                p[i] = logs[:, token] @ times * min(1, EVIDENCE / max(len(ids), 1)) + prior
            p = np.exp(p - p.max(1, keepdims=True))
            yield pd.DataFrame({"doc": b["doc"], "tokens": b["n"], "p": list(grained(p / p.sum(1, keepdims=True)))})

    return run


def stepped(p: np.ndarray, caps: np.ndarray, steps: list[np.ndarray], r: np.ndarray) -> np.ndarray:
    """The rates r of rows of p after further gradient steps; each is projected to [0, cap]."""
    cap = p @ caps
    for s in steps:
        r = np.clip(r - p @ s, 0, cap)
    return r


def rates(p: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each document (row of p) after the gradient steps so far."""
    if not len(p):
        return np.zeros(0)
    p, at = np.unique(p, axis=0, return_inverse=True)
    return stepped(p, caps, steps, np.zeros(len(p)))[at.reshape(-1)]


def fit(hard: np.ndarray, caps: np.ndarray, goal: np.ndarray, soft: DataFrame | None) -> tuple[list[np.ndarray], bool]:
    """The gradient steps, and whether they converged. hard: labelled tokens by domain; caps: repeats; goal: tokens wanted; soft: groups of unlabelled documents (p, tokens).

    Minimises the squared misses of the domains' goals, each weighted by one over the domain's tokens; the step length
    one is safe, as memberships sum to one.
    """
    k = len(hard)
    p, tokens, far = np.eye(k), hard.astype(float), None
    if soft is not None and small(soft, GROUP_CELLS // max(k, 1)):
        got = soft.select("p", "tokens").toPandas()  # checked just now
        p, tokens = np.vstack([p, *got["p"]]), np.r_[tokens, got["tokens"].to_numpy(float)]
    elif soft is not None:
        far = soft.select("p", "tokens", F.lit(0.0).alias("r"))
    pending: list[np.ndarray] = []

    def forward(batches):
        for b in batches:
            q = np.stack(b["p"].to_numpy()) if len(b) else np.zeros((0, k))
            yield b.assign(r=stepped(q, caps, pending, b["r"].to_numpy(float)))

    def total(of: str) -> np.ndarray:
        """Tokens by domain of the far groups under the rates so far (r), or under rate one (tokens)."""
        out = np.zeros(k)
        if far is None:
            return out

        def part(batches):
            sums = np.zeros(k)
            for b in forward(batches) if of == "r" else batches:
                q = np.stack(b["p"].to_numpy()) if len(b) else np.zeros((0, k))
                sums += (b["tokens"].to_numpy(float) * (b["r"].to_numpy(float) if of == "r" else 1)) @ q
            yield pd.DataFrame({"k": np.arange(k), "w": sums})

        for r in far.mapInPandas(part, "k int, w double").groupBy("k").agg(F.sum("w").alias("w")).collect():  # one row a domain
            out[r["k"]] = r["w"]
        return out

    weight = np.maximum(tokens @ p + total("tokens"), 1.0)
    unit = max(UNIT * goal.sum(), 1e-300)
    r, steps, before = np.zeros(len(p)), [], np.full(k, np.inf)
    for _ in range(ROUNDS):
        now = np.rint(((tokens * r) @ p + (total("r") if steps else 0)) / unit) * unit
        if np.abs(now - before).max(initial=0) <= SETTLED * goal.sum():
            return steps, True
        steps.append((now - goal) / weight)
        pending.append(steps[-1])
        r, before = stepped(p, caps, steps[-1:], r), now
        if far is not None and len(pending) == WRITTEN:
            far = materialize(far.mapInPandas(forward, far.schema), "rates")
            pending.clear()
    return steps, False


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", size: float = 0.5, seed: int = 42, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, report). copies: key, source, tokens, rate, copies (how often the document stands in the mix).

    report: a row per target with target_share, max_repeats, tokens, capacity, goal, reachable, converged (whether the
    fit came to rest), mixed_tokens, actual_share.
    docs has key, text and source; targets source, target_share and max_repeats. The mix is ``size`` of all tokens.
    """
    spark = docs.sparkSession
    wanted = targets.filter("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("repeats")).orderBy("source").limit(MOST_DOMAINS + 1).collect()
    if len(wanted) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} sources among the targets")
    domains, share, caps = [r["source"] for r in wanted], np.array([r["share"] for r in wanted], float), np.array([r["repeats"] for r in wanted], float)
    v = spark.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(key).alias("doc"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{key} must be an integer")
    counted = materialize(spread(rows.withColumn("doc", F.col("doc").cast("bigint")), "doc").mapInPandas(_counted(v, domains), "kind int, doc bigint, source string, k int, n bigint, ids array<int>"), "counted")
    each = counted.filter("kind = 0").select("doc", "source", F.col("n").alias("tokens"))
    named = F.broadcast(spark.createDataFrame([(x,) for x in domains], "source string"))  # at most MOST_DOMAINS rows
    sums = {r["source"]: r["tokens"] for r in each.join(named, "source").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    every = each.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    hard, goal = np.array([sums.get(x, 0) for x in domains], float), share * size * every
    soft, steps, settled = None, [], True
    if domains:
        loose = counted.filter("kind = 0 and source is null").select("doc", "n", "ids")
        if hard.sum() and not loose.isEmpty():
            got = counted.filter("kind = 1").groupBy("k", "doc").agg(F.sum("n").alias("n")).toPandas()  # domains times vocabulary at most
            logs = np.zeros((len(domains), _vocabulary_size(v.value)), np.float32)
            logs[got["k"], got["doc"]] = got["n"]
            prior = np.log(np.maximum(hard, 1e-9) / hard.sum())
            logs = np.log((logs + 0.1) / (logs.sum(1, keepdims=True) + 0.1 * logs.shape[1])).astype(np.float32)
            model = spark.sparkContext.broadcast((logs, prior))
            soft = materialize(spread(loose, "doc").mapInPandas(_posteriors(model), "doc bigint, tokens bigint, p array<double>"), "posteriors")
        steps, settled = fit(hard, caps, goal, soft and materialize(soft.groupBy("p").agg(F.sum("tokens").alias("tokens")), "groups"))
    own = rates(np.eye(len(domains)), caps, steps)
    table = spark.createDataFrame([(x, float(r)) for x, r in zip(domains, own)], "source string, rate double")
    labelled = each.filter("source is not null").join(F.broadcast(table), "source", "left").select("doc", "source", "tokens", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    if soft is not None:
        fitted = list(steps)

        def rated(batches):
            for b in batches:
                p = np.stack(b["p"].to_numpy()) if len(b) else np.zeros((0, len(domains)))
                yield b[["doc", "tokens"]].assign(rate=rates(p, caps, fitted), best=[domains[i] for i in p.argmax(1)])

        loose = soft.mapInPandas(rated, "doc bigint, tokens bigint, rate double, best string").select("doc", F.lit(None).cast("string").alias("source"), "tokens", "rate", "best")
    else:
        loose = each.filter("source is null").select("doc", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(None).cast("string").alias("best"))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(2**30)) / F.lit(float(2**30))
    copies = labelled.withColumn("best", F.col("source")).unionByName(loose).withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    copies = materialize(copies.withColumnRenamed("doc", key), "mix")
    got = copies.groupBy(F.col("best").alias("source")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    missed = (hard * own < goal) & (hard * caps < goal)
    base = spark.createDataFrame(
        [(x, float(s), int(c), int(h), int(c * h), float(g), not m, settled) for x, s, c, h, g, m in zip(domains, share, caps, hard, goal, missed)],
        "source string, target_share double, max_repeats int, tokens bigint, capacity bigint, goal double, reachable boolean, converged boolean",
    )
    whole = got.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0)).alias("whole"))  # a single row
    report = base.join(F.broadcast(got.join(named, "source")), "source", "left").crossJoin(F.broadcast(whole))  # of got, rows of targets only
    report = report.select(*base.columns, F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.try_divide(F.coalesce("mixed_tokens", F.lit(0)), "whole").alias("actual_share"))
    return copies.drop("best"), report


ship(__name__)
