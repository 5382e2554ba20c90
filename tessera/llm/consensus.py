"""Problem 6: consensus label, agreement and annotator reliability from several annotators' votes.

Method: latent ability and difficulty. The chance that annotator a labels an item of class z rightly is
sigmoid(ability[a, z] * easiness[item]); gradient expectation-maximisation learns both and the class share jointly.
Abilities depend on the class, as an annotator may lean to one label. Items with the same votes have the same
posterior, easiness and gradients, so the fit runs on the counts of the vote patterns: at most 3 ** annotators rows,
however many items there are.

One vote per annotator and item: the latest usable one (ties: POSITIVE). Null, UNSURE and unknown labels are no votes;
items without votes give no row. A posterior of exactly one half counts as POSITIVE. Null keys are no items. Empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

POSITIVE, NEGATIVE = "POSITIVE", "NEGATIVE"
#: More annotators than this would make the pattern table too large for the driver (3 ** 9 = 19,683 rows).
MOST_ANNOTATORS = 9


def usable(label: Column) -> Column:
    """POSITIVE or NEGATIVE in any spelling, else null."""
    s = F.regexp_replace(F.upper(strip(label.cast("string"))), r"^LABEL\.", "")
    return F.when(s.isin(POSITIVE, NEGATIVE), s)


def votes(tables: list[tuple[DataFrame, str, dict[str, str]]], key: str) -> DataFrame:
    """key and one column per annotator (true: POSITIVE). tables: (df, time column, annotator -> label column)."""
    long = None
    names: list[str] = []
    for df, time, columns in tables:
        names += [a for a in columns if a not in names]
        rows = df.select(F.col(key), F.col(time).alias("__t"), *(usable(F.col(c)).alias(a) for a, c in columns.items()))
        long = rows if long is None else long.unionByName(rows, allowMissingColumns=True)
    if len(names) > MOST_ANNOTATORS:
        raise ValueError(f"at most {MOST_ANNOTATORS} annotators")
    best = lambda a: F.max(F.when(F.col(a).isNotNull(), F.struct(F.coalesce("__t", F.lit(0).cast("timestamp").cast("timestamp_ntz")), F.col(a))))[a] == POSITIVE
    return long.filter(F.col(key).isNotNull()).groupBy(key).agg(*(best(a).alias(a) for a in names))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, steps: int = 4, rate: float = 0.5, spread: float = 0.25) -> dict[str, np.ndarray]:
    """patterns: rows of 1, 0 or -1 (no vote); counts: items with each. spread: prior deviation of log easiness."""
    n, a = patterns.shape
    voted = patterns >= 0
    right = np.stack([patterns == 0, patterns == 1])  # by class: whether the vote is right
    ability, log_easy = np.full((2, a), 1.5), np.zeros(n)
    q = ((patterns == 1).sum(1) + 0.5) / (voted.sum(1) + 1)
    for _ in range(rounds):
        share = np.clip((counts * q).sum() / counts.sum(), 1e-6, 1 - 1e-6)
        post = np.stack([1 - q, q])
        for _ in range(steps):
            easy = np.exp(log_easy)
            x = ability[:, None, :] * easy[None, :, None]
            slope = np.where(voted, right - 1 / (1 + np.exp(-x)), 0.0) * post[:, :, None]
            weight = (counts[None, :, None] * voted * post[:, :, None]).sum(1)
            ability += 2 * rate * ((slope * (counts * easy)[None, :, None]).sum(1) - 0.01 * (ability - 1.5)) / (weight + 1)
            log_easy += rate * ((slope * x).sum((0, 2)) - log_easy / spread**2) / (voted.sum(1) + 1 / spread**2)
        x = ability[:, None, :] * np.exp(log_easy)[None, :, None]
        logs = np.where(voted, -np.logaddexp(0, np.where(right, -x, x)), 0).sum(2)
        q = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - share) / share), -500, 500)))
    return {"posterior": q, "ability": ability, "easiness": np.exp(log_easy), "share": share}


def model(v: DataFrame, key: str) -> tuple[list[str], list[tuple], dict]:
    """The annotators, the vote patterns with their counts, and the fit."""
    names = [c for c in v.columns if c != key]
    rows = v.groupBy(*names).count().filter(F.coalesce(*names).isNotNull()).collect()  # at most 3 ** annotators rows
    rows = sorted(rows, key=lambda r: tuple(-1 if x is None else int(x) for x in r[:-1]))
    p = np.array([[-1 if x is None else int(x) for x in r[:-1]] for r in rows]).reshape(-1, len(names))
    return names, rows, fit(p, np.array([r[-1] for r in rows], float)) if rows else {}


def consensus(v: DataFrame, key: str) -> DataFrame:
    """(key, consensus, posterior, n_votes, agreement, kappa, disputed), one row per item with a usable vote.

    agreement: share of votes equal to the consensus. kappa: pairwise agreement of the item's votes, corrected for the
    agreement expected by chance from the votes' overall shares (null for a single vote). disputed: two votes differ.
    """
    names, rows, m = model(v, key)
    values = [(*r[:-1], float(m["posterior"][i])) for i, r in enumerate(rows)]
    table = v.sparkSession.createDataFrame(values, ", ".join([f"`__{a}` boolean" for a in names] + ["posterior double"]))
    pos = sum(sum(x is True for x in r[:-1]) * r[-1] for r in rows)
    share = pos / max(1, sum(sum(x is not None for x in r[:-1]) * r[-1] for r in rows))
    chance = share**2 + (1 - share) ** 2
    on = [F.col(a).eqNullSafe(F.col(f"__{a}")) for a in names]
    n = sum((F.col(a).isNotNull().cast("int") for a in names), F.lit(0))
    p = sum((F.coalesce(F.col(a), F.lit(False)).cast("int") for a in names), F.lit(0))
    label = F.when(F.col("posterior") >= 0.5, POSITIVE).otherwise(NEGATIVE)
    pairs = F.try_divide(p * (p - 1) + (n - p) * (n - p - 1), n * (n - 1))
    return v.join(F.broadcast(table), on).select(
        key, label.alias("consensus"), "posterior", n.alias("n_votes"),
        F.when(F.col("posterior") >= 0.5, p / n).otherwise((n - p) / n).alias("agreement"),
        F.try_divide(pairs - F.lit(chance), F.lit(1 - chance)).alias("kappa"), ((p > 0) & (p < n)).alias("disputed"),
    )


def annotators(v: DataFrame, key: str) -> DataFrame:
    """(annotator, n_votes, ability_positive, ability_negative, reliability, kappa), one row per annotator.

    reliability: expected share of right votes under the posteriors; kappa: the same corrected for chance. Null for an annotator without votes.
    """
    names, rows, m = model(v, key)
    out = []
    for j, a in enumerate(names):
        n = p = right = truly = 0.0
        for i, r in enumerate(rows):
            if r[j] is not None:
                q = float(m["posterior"][i])
                n, p, right, truly = n + r[-1], p + r[-1] * r[j], right + r[-1] * (q if r[j] else 1 - q), truly + r[-1] * q
        chance = (p * truly + (n - p) * (n - truly)) / n**2 if n else 0.0
        fitted = [float(m["ability"][z][j]) for z in (1, 0)] if n else [None, None]
        out.append((a, int(n), *fitted, right / n if n else None, (right / n - chance) / (1 - chance) if n and chance < 1 else None))
    return v.sparkSession.createDataFrame(out, "annotator string, n_votes bigint, ability_positive double, ability_negative double, reliability double, kappa double")
