"""Problem 1: mapping freely typed values to a canonical list.

Method: a BK-tree over the reference entries (canonical values, their other names, and the beginnings that a cut value
may have) under the unrestricted Damerau-Levenshtein distance, which is a true metric. Pruning by the triangle
inequality returns every entry within the threshold. A reference of up to SHARD entries is one broadcast tree; a larger
one is split into shards, each searched on its own, and the shards' winners merge; both give the same results.

A value may hold words that qualify an entry without changing what it names ("mainly ..."). They are learned from the
distinct values: what stands before or behind an entry spelt out, for LEARNED different entries or more, is a qualifier
on that side.

Only distinct values are searched, and each form of a value only as far as it can still win: an entry that it spells out
bounds the radius. The result is joined back to the rows. Null and blank values and exact entries give
no row. Ties of score go to the smaller canonical value; repeated rows each come out; values without letters are
UNMATCHED. With an empty reference every value is UNMATCHED.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank
from ..session import BROADCAST_ROWS, join_known, materialize, ship, small

UNMATCHED = "UNMATCHED"
#: Entries in one tree; a broadcast reference has no more.
SHARD = 20_000
#: Values of one task, about, and pairs of a form and an entry that are compared at once.
BATCH, PAIRS = 1_000, 20_000
#: Beside how many different entries a word must stand to be a qualifier.
LEARNED = 3
#: Words of a value up to which it may teach qualifiers.
TEACHING = 8


def distances(queries: np.ndarray, lengths: np.ndarray, nodes: np.ndarray, node_lengths: np.ndarray | None = None) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of each padded row of queries (codes) to the same row of nodes, or to the one node given."""
    nodes = nodes if nodes.ndim == 2 else nodes[None, :]
    n, m, k = len(queries), int(lengths.max(initial=0)), nodes.shape[1] if node_lengths is None else int(node_lengths.max(initial=0))
    far = m + k
    d = np.full((n, m + 2, k + 2), far, np.int16)
    d[:, 1:, 1] = np.arange(m + 1)
    d[:, 1, 1:] = np.arange(k + 1)
    rows = np.arange(n)
    last_row = np.zeros((n, k), np.int16)  # last row whose sign equals that of the node's column
    for i in range(1, m + 1):
        a = queries[:, i - 1]
        last_col = np.zeros(n, np.int16)
        for j in range(1, k + 1):
            same = a == nodes[:, j - 1]
            p, q = last_row[:, j - 1], last_col
            swap = d[rows, p, q] + (i - p - 1) + 1 + (j - q - 1)
            d[:, i + 1, j + 1] = np.minimum(np.minimum(d[:, i, j] + ~same, swap), np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1)
            last_col = np.where(same, j, last_col).astype(np.int16)
        last_row = np.where(a[:, None] == nodes[:, :k], i, last_row).astype(np.int16)
    return d[rows, lengths + 1, k + 1 if node_lengths is None else node_lengths + 1]


class Tree:
    """A BK-tree: each child hangs on the edge of its distance to the parent."""

    def __init__(self, entries: list[str]):
        """Groups are split by their distances to their first entry, all of which are computed at once."""
        self.entries = list(dict.fromkeys(entries))
        self.children: list[dict[int, int]] = [{} for _ in self.entries]
        codes, lengths = encode(self.entries)
        stack = [np.arange(len(self.entries))] if self.entries else []
        while stack:
            at, rest = stack[-1][0], stack.pop()[1:]
            if len(rest):
                x = distances(codes[rest], lengths[rest], np.frombuffer(self.entries[at].encode("utf-32-le"), np.uint32))
                for edge in np.unique(x):
                    group = rest[x == edge]
                    self.children[at][int(edge)] = int(group[0])
                    stack.append(group)

    @classmethod
    def of(cls, entries: list[str], children: list[dict[int, int]]) -> Tree:
        out = cls([])
        out.entries, out.children = entries, children
        return out

    def search(self, forms: list[str], most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (entries, forms, distances) of every pair within the form's threshold, level by level.

        self.compared counts the pairs whose distance was needed.
        """
        self.compared = 0
        if not self.entries or not forms:
            return
        codes, lengths = encode(forms)
        own, own_lengths = encode(self.entries)
        count = np.array([len(c) for c in self.children])
        first = np.cumsum(count) - count
        edge, child = (np.array([x for c in self.children for x in z(c)], np.int64) for z in (dict.keys, dict.values))
        reach = np.array([max(c, default=0) for c in self.children])
        node, form = np.zeros(len(forms), np.int64), np.arange(len(forms))
        while len(node):
            # the difference of lengths is a lower bound: beyond the radius and the longest edge nothing is left below
            near = np.abs(lengths[form] - own_lengths[node]) <= most[form] + reach[node]
            node, form = node[near], form[near]
            order = np.lexsort((own_lengths[node], lengths[form]))
            node, form = node[order], form[order]
            x = np.zeros(len(node), np.int64)
            for at in range(0, len(node), PAIRS):
                i, j = form[at : at + PAIRS], node[at : at + PAIRS]
                x[at : at + PAIRS] = distances(codes[i], lengths[i], own[j], own_lengths[j])
            self.compared += len(node)
            t = most[form]
            if (hit := x <= t).any():
                yield node[hit], form[hit], x[hit]
            times = count[node]
            below = np.repeat(first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            of = np.repeat(np.arange(len(node)), times)
            keep = np.abs(x[of] - edge[below]) <= t[of]
            node, form = child[below[keep]], form[of[keep]]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out, lengths


def words(value: str) -> list[str]:
    """Lower-case words without marks, accents, width variants and digits put for letters."""
    v = unicodedata.normalize("NFKD", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKC", value)))
    v = "".join(c for c in v if not unicodedata.combining(c)).casefold()
    found = re.findall(r"[^\W_]+", v)
    letters = str.maketrans("013457", "oieast")
    return [w.translate(letters) if re.search(r"[^\W\d]", w) else w for w in found]


def allowed(length: int) -> int:
    """The threshold of a form so long."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 12 else 3


def forms(value: str, before: set[str], after: set[str], longest: int) -> list[tuple[str, int, float]]:
    """What a value may stand for: (letters, threshold, penalty). before, after: qualifiers; longer forms than longest are near no entry."""
    w = words(value)
    out: dict[str, tuple[int, float]] = {}

    def add(tokens: list[str], penalty: float, tight: int = 0) -> None:
        s = "".join(tokens)
        if s and len(s) <= longest and (t := allowed(len(s) + (len(s) > 4) - tight) - tight) >= 0:
            old = out.get(s, (t, penalty))
            out[s] = (max(old[0], t), min(old[1], penalty))

    add(w, 0)
    turned = re.fullmatch(r"\W*(.+?)\s*(?:,| - |\(|\bof\b)\s*(.+?)\W*", value.replace("_", " "), re.S | re.I)
    orders = [w] + ([words(turned[2]) + words(turned[1])] if turned else [])
    for k, order in enumerate(orders):
        a, b = 0, len(order)
        while a < b - 1 and order[a] in before:
            a += 1
        while b > a + 1 and order[b - 1] in after:
            b -= 1
        add(order, 0.2 * k)
        for x in range(a + 1):
            for y in range(b, len(order) + 1):
                add(order[x:y], 0.2 * k + 0.1 * (x > 0 or y < len(order)))
        for x, y in ((a + 1, b), (a, b - 1)):  # a qualifier that isn't known, or is itself misspelt
            if y > x and sum(map(len, order[x:y])) >= 5:
                add(order[x:y], 4 + 0.2 * k, tight=1)
    return [(s, t, p) for s, (t, p) in out.items()]


#: By field: the tree, and of each of its entries all it may mean: (canonical, penalty, most errors).
Reference = dict[str, tuple[Tree, list[list[tuple[str, float, int]]]]]


def reference(entries: pd.DataFrame) -> Reference:
    out = {}
    for field, group in entries.groupby("field", sort=True):
        meant: dict[str, set[tuple[str, float, int]]] = {}
        for canonical, name in zip(group["canonical"], group["name"]):
            s = "".join(words(name))
            for cut in range(0, 5):
                if cut and len(s) - cut < max(5, 0.6 * len(s)):
                    break
                most = allowed(len(s)) - bool(cut)
                if s and most >= 0:
                    meant.setdefault(s[: len(s) - cut], set()).add((canonical, 0.4 * bool(cut) + 0.05 * cut, most))
        tree = Tree(sorted(meant))
        out[field] = tree, [sorted(meant[e]) for e in tree.entries]
    return out


def match(field: str, values: list[str], ref: Reference, before: set[str], after: set[str]) -> list[tuple[float, str] | None]:
    """The winner (score, canonical) of each value; None: no entry within the threshold."""
    best: list[tuple[float, str] | None] = [None] * len(values)
    if field not in ref:
        return best
    tree, meaning = ref[field]
    if not tree.entries:
        return best
    longest = max(map(len, tree.entries)) + 1 + max(m for e in meaning for _, _, m in e)
    at = {e: i for i, e in enumerate(tree.entries)}
    uses = [(p, i, s, t) for i, v in enumerate(values) for s, t, p in forms(v, before, after, longest)]

    def meet(i: int, entry: int, distance: int, penalty: float) -> None:
        for canonical, extra, most in meaning[entry]:
            if distance <= most:
                score = (round(distance + extra + penalty, 3), canonical)
                if best[i] is None or score < best[i]:
                    best[i] = score

    for p, i, s, _ in uses:
        if s in at:
            meet(i, at[s], 0, p)
    for weak in (False, True):  # forms without an unknown word are given less than those, so they come last and mostly need no search
        radius: dict[str, int] = {}
        holders: dict[str, list[tuple[int, int, float]]] = {}
        for p, i, s, t in uses:
            t = t if best[i] is None else min(t, int(best[i][0] - p + 1e-9))
            if (p >= 4) == weak and t >= 1:
                radius[s] = max(radius.get(s, 0), t)
                holders.setdefault(s, []).append((i, t, p))
        names = list(radius)
        for entries, hits, x in tree.search(names, np.array([radius[s] for s in names], np.int64)):
            for e, h, d in zip(entries.tolist(), hits.tolist(), x.tolist()):
                for i, t, p in holders[names[h]]:
                    if d <= t:
                        meet(i, e, d, p)
    return best


def _winners(values: pd.DataFrame, ref: Reference, before: set[str], after: set[str]) -> pd.DataFrame:
    parts = []
    for field, g in values.groupby("field", sort=False):
        for a in range(0, len(g), 2 * BATCH):
            part = g.iloc[a : a + 2 * BATCH]
            found = match(field, part["value"].tolist(), ref, before, after)
            parts.append(part.assign(score=[f and f[0] for f in found], canonical=[f and f[1] for f in found]))
    out = pd.concat(parts) if parts else values.assign(score=None, canonical=None)
    return out.astype({"score": float})


def _taught(values: pd.DataFrame, ref: Reference) -> pd.DataFrame:
    """(side, word, field, canonical): words that stand before (0) or behind (1) an entry that is spelt out."""
    out = set()
    for field, g in values.groupby("field", sort=False):
        if field not in ref:
            continue
        tree, meaning = ref[field]
        whole = {e: min(m)[0] for e, m in ((e, [(c, x) for c, x, _ in m if not x]) for e, m in zip(tree.entries, meaning)) if m}
        for value in g["value"]:
            w = words(value)
            if not 1 < len(w) <= TEACHING:
                continue
            for x in range(len(w)):
                for y in range(x + 1, len(w) + 1):
                    if y - x < len(w) and (c := whole.get("".join(w[x:y]))):
                        out |= {(0, z, field, c) for z in w[:x]} | {(1, z, field, c) for z in w[y:]}
    return pd.DataFrame(sorted(out), columns=["side", "word", "field", "canonical"])


def qualifiers(taught: DataFrame) -> tuple[set[str], set[str]]:
    """The words that stand before, and those that stand behind LEARNED entries or more. They are words of a language, so few."""
    rows = taught.groupBy("side", "word").agg(F.count_distinct("field", "canonical").alias("n")).filter(F.col("n") >= LEARNED).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} words stand beside {LEARNED} entries")
    return {r["word"] for r in rows if r["side"] == 0}, {r["word"] for r in rows if r["side"] == 1}


def map_values(df: DataFrame, key: str, fields: list[str], canon: DataFrame, shard: int = SHARD) -> DataFrame:
    """(key, field, value, canonical): a row for each value that is neither null nor blank nor itself an entry.

    canon has field, canonical and also_known_as (array, may be null).
    """
    long = df.select(key, F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))).filter(not_blank("value"))
    exact = canon.select("field", F.col("canonical").alias("value")).distinct()
    long = long.join(F.broadcast(exact) if small(exact) else exact, ["field", "value"], "left_anti")
    names = canon.filter("canonical is not null and field is not null").select("field", "canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("also_known_as", F.array().cast("array<string>")))).alias("name")).filter("name is not null").distinct()
    values = materialize(long.groupBy("field", "value").agg(F.count("*").alias("n")), "distinct")
    schema, lesson = "field string, value string, n bigint, score double, canonical string", "side int, word string, field string, canonical string"
    if small(names, shard):
        # plain values in the broadcast, so that executors need not have this package
        ref = df.sparkSession.sparkContext.broadcast({f: (t.entries, t.children, m) for f, (t, m) in reference(names.toPandas()).items()})
        # a number of partitions that AQE leaves as it is: few bytes, but much work
        spread_values = values.repartition(values.count() // BATCH + 1, "value")

        def each(work, *more):
            def run(batches):
                trees = {f: (Tree.of(e, c), m) for f, (e, c, m) in ref.value.items()}
                for b in batches:
                    yield work(b, trees, *more)

            return run

        before, after = qualifiers(spread_values.mapInPandas(each(_taught), lesson))
        best = spread_values.mapInPandas(each(_winners, before, after), schema)
    else:
        shards = -(-names.count() // shard)
        salts = 1 + values.count() // 100_000
        left = values.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = names.withColumn("shard", F.pmod(F.xxhash64("field", "canonical"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt"))
        before, after = qualifiers(met.applyInPandas(lambda v, r: _taught(v, reference(r)), lesson))
        found = met.applyInPandas(lambda v, r: _winners(v[["field", "value", "n"]], reference(r), before, after), schema)
        best = found.groupBy("field", "value").agg(F.max("n").alias("n"), F.min(F.when(F.col("canonical").isNotNull(), F.struct("score", "canonical"))).alias("w")).select("field", "value", "n", "w.score", "w.canonical")
    best = materialize(best.withColumn("canonical", F.coalesce("canonical", F.lit(UNMATCHED))), "values")
    return join_known(long, best, ["field", "value"], "n", how="inner").select(key, "field", "value", "canonical", "score")


ship(__name__)
