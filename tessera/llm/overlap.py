"""Problem 5: the same or nearly the same records across splits.

Method: a suffix array over the partitioned, concatenated texts. Title and abstract of a record are one text of words;
suffixes start where the abstract does and at the minimizers of a window, so that every shared span of WINDOW + 7 words holds a start that both
sides have with the same first eight words. A suffix is held as fingerprints of its blocks of words, sorted by range
over the cluster, equal ones by the signs of their records' titles; neighbouring suffixes of different splits with a
long common prefix are shared spans, which merge into the coverage of a pair of records. Pairs with enough coverage are
checked exactly: titles by edits, and abstracts by how much of each the other one covers with spans of four letters, again
from their sorted suffixes.

Neighbourhoods are short, and runs of like abstracts are long. What they leave out comes from the suffixes of titles: a
pair of the same paper has near titles, which have a part in common at nearly the same place (_cuts), so all pairs of
titles that share a part meet in a run, and none is lost. Under titles that many records hold, all records of one side
meet all of the other in blocks (crowded), and an upper bound of what they have in common leaves most pairs out. Nothing
is capped.

Null titles and abstracts are empty. Where an abstract is blank the title decides: the suffix from its start to its end
sign must be whole in both. A record without a title is never matched by title; null row ids are no records. Exact copies
(after normalisation) within a side are one class, known by a fingerprint of 64 bits (in ten billion records about three
may be mistaken for another); pairs of classes are found, and membership expands them.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship, small, spread

#: Starts are the minimizers of so many consecutive places.
WINDOW = 8
#: Words in the blocks of a suffix key; common prefixes are measured in these steps.
BLOCKS = (4, 4, 8, 16)
#: Share of the shorter record's words that shared spans must cover for the exact check.
COVERAGE = 0.2
#: How many neighbours of the other side a suffix is compared with, above and below.
NEIGHBOURS = 3
#: Rows of one key in a block of a join, about.
SALT_ROWS = 5_000
#: Suffixes in one partition, about.
PART_ROWS = 400_000
#: A title of more records of one side than this is common: its records meet in blocks of about BLOCK_ROWS, or BLOCK_CHARS of abstracts.
COMMON, BLOCK_ROWS, BLOCK_CHARS = 300, 500, 1_000_000
#: Alike: share of common four-letter strings; or the shorter abstract all but whole in the longer one, which has at most a sentence more.
ALIKE, WITHIN, SENTENCE = 0.72, 0.88, 230
#: Letters of abstracts that are compared at once.
BATCH_CHARS = 2_000_000
#: Notes that editions of one paper add to its title.
NOTES = re.compile(r" (?:extended abstract|short paper|long paper|demo paper|full version|extended version|preprint|draft|revised|revised version|camera ready|v ?\d{1,2}|version \d{1,2}|updated)$")
MOJIBAKE = re.compile("[ÃÂâ][\u0080-\u00bf€‘-™Œ-ƒˆ˜]")
#: ASCII letters to lower case, all that is neither letter nor digit to a blank.
PLAIN = str.maketrans({i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)})


def _marks() -> tuple[re.Pattern, re.Pattern]:
    """The combining characters of European scripts, and all others."""
    at = [i for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i)) and not 0x300 <= i <= 0x36F]
    first = [i for i, j in zip(at, [-1, *at]) if i != j + 1]
    last = [i for i, j in zip(at, [*at[1:], -1]) if j != i + 1]
    return re.compile("[\u0300-\u036f]+"), re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(first, last)) + "]+")


MARKS, OTHER_MARKS = _marks()
#: Characters among which other marks are.
BEYOND = re.compile("[\u0483-\u1fff\u20d0-\u20f0\u2cef-\u2dff\u302a-\u302f\u3099\u309a\ua66f-\U0010ffff]")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def normalise(text: str | None) -> str:
    """Words in lower case without accents, signs, markup and damage of encodings, a blank between; Chinese signs are words."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = re.sub(r"</?[a-zA-Z][^>]{0,80}>", " ", text)
    if text.isascii():
        return " ".join(text.translate(PLAIN).split())
    if MOJIBAKE.search(text):
        words = []
        for w in re.split(r"(\s+)", text):
            try:
                words.append(w.encode("cp1252").decode("utf-8") if MOJIBAKE.search(w) else w)
            except (UnicodeEncodeError, UnicodeDecodeError):
                words.append(w)
        text = "".join(words)
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    text = unicodedata.normalize("NFD", text.casefold())
    text = MARKS.sub("", text)
    if BEYOND.search(text):
        text = OTHER_MARKS.sub("", text)
    return " ".join(re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+", text))


def bare(title: str) -> str:
    """A normalised title without the notes of its edition and without blanks."""
    return NOTES.sub("", NOTES.sub("", title)).replace(" ", "")


def edits(size: int) -> int:
    """How many slips a title of so many signs may hold."""
    return 1 if size < 12 else 2


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def signs(titles: list[str]) -> np.ndarray:
    """Sixteen counts of four bits each, how often the title holds a sign of each of sixteen kinds, in Gray code: an edit moves two counts by one at most, and so changes two bits at most."""
    c = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32) % 16
    of = np.repeat(np.arange(len(titles)), [len(t) for t in titles])
    n = np.bincount(of * 16 + c, minlength=16 * len(titles)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
    n ^= n >> np.uint64(1)
    return (n << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)


def near_signs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the signs are near enough for two edits."""
    b = (x ^ y).view(np.uint64)
    # bits set, in pairs, fours and eights, then summed by a multiplication
    b = b - ((b >> np.uint64(1)) & np.uint64(0x5555555555555555))
    b = (b & np.uint64(0x3333333333333333)) + ((b >> np.uint64(2)) & np.uint64(0x3333333333333333))
    with np.errstate(over="ignore"):
        return (((b + (b >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * np.uint64(0x0101010101010101)) >> np.uint64(56) <= 4


def signs_fit(x: str, y: str) -> Column:
    """near_signs as an expression."""
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 4


P = np.uint64(0x9E3779B97F4A7C15)
#: P to the powers from 0 on, and its inverse's; strings are sums of their signs times these, modulo 2 ** 64.
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 2**64)
LONGEST = 1 << 12


def _powers(base: int) -> np.ndarray:
    out = np.full(LONGEST, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE), _powers(INVERSE)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * P
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> np.ndarray:
    """A fingerprint of each word of the texts, whose words stand between single blanks; no text is empty."""
    c = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = c == 32
    starts = np.r_[0, np.flatnonzero(blank) + 1]
    size = np.diff(np.r_[starts, len(c) + 1]) - 1
    at = np.arange(len(c)) - np.repeat(starts, np.r_[size[:-1] + 1, size[-1]])
    with np.errstate(over="ignore"):
        each = np.where(blank, np.uint64(0), (c + np.uint64(1)) * UP[at % LONGEST] + (at // LONGEST).astype(np.uint64))
        return _mixed(np.add.reduceat(each, starts))


#: The word between title and abstract; normalised words hold no such sign.
END = "\x1e"
STEPS = np.r_[0, np.cumsum(BLOCKS)].astype(np.int32)
KEYS = ["k1", "k2", "k3", "k4", "sign"]
#: Kinds of rows of the list: a record, a suffix of its text, a part of its title.
RECORD, SUFFIX, PART = 0, 1, 2
LISTED = "kind tinyint, side tinyint, rep bigint, sign bigint, k1 bigint, k2 int, k3 int, k4 int, pos int, n int, row_id bigint, title bigint, whole bigint, blank boolean"


def _suffixes(rep: np.ndarray, side: np.ndarray, title: list[str], abstract: list[str], sign: np.ndarray) -> dict[str, np.ndarray]:
    """Suffix keys of each record at its minimizers: k1..k4, sign, rep, side, pos, n (words in the record, with the end sign).

    The words of a batch lie in one array, each record followed by enough zeros that no block reaches into the next.
    """
    pad = sum(BLOCKS)
    docs = [f"{t} {END} {a}" if t else f"{END} {a}" for t, a in zip(title, abstract)]
    size = np.array([d.count(" ") + 1 for d in docs], np.int64)
    begin = np.cumsum(size + pad) - (size + pad)
    h = np.zeros(int((size + pad).sum()), np.uint64)
    inside = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    h[inside] = word_hashes(docs)
    with np.errstate(over="ignore"):
        # minimizers: of every WINDOW places of a record the lowest hash of two words, and its first place
        two = np.full(len(h), np.uint64(2**64 - 1))
        two[inside] = ((h[inside] * P) ^ (h[inside + 1] >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
        low = np.lib.stride_tricks.sliding_window_view(two, WINDOW).argmin(1) + np.arange(len(two) - WINDOW + 1)
        whole = inside[inside + WINDOW <= np.repeat(begin + np.maximum(size, WINDOW), size)]
        # the abstract's beginning is always a start, so equal short abstracts have one in common
        at = np.unique(np.r_[begin, begin + [t.count(" ") + 2 if t else 1 for t in title], low[whole]])
        doc = np.searchsorted(begin, at, side="right") - 1
        keys, off = {}, 0
        for number, block in enumerate(BLOCKS):
            k = np.zeros(len(at), np.uint64)
            for j in range(block):
                k = (k ^ h[at + off + j]) * P
                k ^= k >> np.uint64(31)
            keys[f"k{number + 1}"] = k.view(np.int64) if not number else (k >> np.uint64(32)).astype(np.uint32).view(np.int32)
            off += block
    return {"side": side[doc], "rep": rep[doc], "sign": sign[doc], **keys, "pos": (at - begin[doc]).astype(np.int32), "n": size[doc].astype(np.int32)}


def _cuts(size: int) -> tuple[int, list[int]]:
    """The edits allowed in a title of so many signs, and where its parts begin and end: an edit touches at most two parts, so one stays whole."""
    most = edits(size)
    count = 2 * most + 1
    return most, [size * i // count for i in range(count + 1)]


def _places(n: int, side: int) -> np.ndarray:
    """Of a title of n signs the places (name, begin, end) of its parts, or for evaluation of those of any near title of train.

    Looked for is the first whole part. The parts before it took an edit for two of them at least, and these moved it;
    the rest of the difference in length lies behind it.
    """
    out = []
    for size in [n] if side == 0 else range(max(0, n - 2), n + 3):
        most, cut = _cuts(size)
        for i, (x, y) in enumerate(zip(cut, cut[1:])):
            moves = [0] if side == 0 else [m for m in range(-most, most + 1) if max(-(-i // 2), abs(m)) + abs(n - size - m) <= most]
            out += [(5 * size + i, x + m, y + m) for m in moves if x + m >= 0 and y + m <= n]
    return np.array(out, np.int64).reshape(-1, 3).T


def _parts(side: np.ndarray, of: np.ndarray, sign: np.ndarray, titles: list[str]) -> dict[str, np.ndarray]:
    """Keys of titles: of train their parts; of evaluation all places where a near title of train can have its first whole part.

    A part's fingerprint is the difference of two sums over the title's beginnings, moved to the title's start.
    """
    length = np.array([len(t) for t in titles], np.int64)
    c = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(length) - length
    at = np.arange(len(c)) - np.repeat(begin, length)
    rows, keys = [], []
    with np.errstate(over="ignore"):
        upto = np.r_[np.uint64(0), np.cumsum((c + np.uint64(1)) * UP[at % LONGEST])]
        for v, n in np.unique(np.c_[side, length], axis=0):
            own = np.flatnonzero((side == v) & (length == n))
            name, x, y = _places(int(n), int(v))
            h = (upto[begin[own][:, None] + y] - upto[begin[own][:, None] + x]) * DOWN[x % LONGEST]
            keys.append(_mixed(_mixed(h) + name.astype(np.uint64) * P).ravel())
            rows.append(np.repeat(own, len(name)))
    rows, keys = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((rows, np.int64), (keys, np.uint64)))
    return {"side": side[rows], "rep": of[rows], "sign": sign[rows], "k1": keys.view(np.int64)}


def _listed(batches):
    """Rows of LISTED: each record, and of each text and title that the batch holds their suffixes and parts."""
    for b in batches:
        if not b.num_rows:
            continue
        title, abstract = [normalise(x) for x in b.column("title").to_pylist()], [normalise(x) for x in b.column("abstract").to_pylist()]
        side, row = b.column("side").to_numpy(zero_copy_only=False), b.column("row_id").to_numpy(zero_copy_only=False)
        short = [bare(t) for t in title]
        as_long = lambda x: np.array(x, np.uint64).view(np.int64)
        rep = as_long([hashed(f"{t}\x1f{a}") for t, a in zip(title, abstract)])
        of, whole, sign = as_long([hashed(t) for t in short]), as_long([hashed(t.replace(" ", "")) if t else 0 for t in title]), signs(short)
        grams = np.array([max(1, len(a) - 3) for a in abstract], np.int32)
        blank = np.array([not a for a in abstract])
        distinct = lambda at, x: at[np.sort(np.unique(np.c_[side[at], x[at]], axis=0, return_index=True)[1])] if len(at) else at
        once = distinct(np.flatnonzero(~blank), rep)
        named = distinct(once, of)
        pick = lambda x, at: [x[i] for i in at]
        yield _batch(RECORD, {"side": side, "rep": rep, "sign": sign, "n": grams, "row_id": row, "title": of, "whole": whole, "blank": blank})
        if len(once):
            yield _batch(SUFFIX, _suffixes(rep[once], side[once], pick(title, once), pick(abstract, once), sign[once]))
            yield _batch(PART, _parts(side[named], of[named], sign[named], pick(short, named)))


COLUMNS = {c.split()[0]: {"tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in LISTED.split(", ")}


def _batch(kind: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A record batch of LISTED; columns that a kind lacks are null."""
    n = len(columns["rep"])
    columns = columns | {"kind": np.full(n, kind, np.int8)}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in COLUMNS.items()], list(COLUMNS))


def _links(s: pd.DataFrame) -> pd.DataFrame:
    """Of sorted suffixes, each with its nearest neighbours of the other side above and below: (t, e, pos, len, n).

    The nearest on either side counts from a common prefix of one block on, the next ones from two. Records whose titles
    cannot be near are no link.
    """
    side, sign = s["side"].to_numpy(), s["sign"].to_numpy(np.int64)
    k, rep, pos, n = [s[c].to_numpy() for c in KEYS[:4]], s["rep"].to_numpy(), s["pos"].to_numpy(), s["n"].to_numpy()
    out = []
    for other in (0, 1):
        mine, theirs = np.flatnonzero(side != other), np.flatnonzero(side == other)
        at = np.searchsorted(theirs, mine)
        for step in range(NEIGHBOURS):
            for near in (at - 1 - step, at + step):
                ok = (near >= 0) & (near < len(theirs))
                x, y = mine[ok], theirs[near[ok]]
                fit = near_signs(sign[x], sign[y])
                x, y = x[fit], y[fit]
                same, blocks = np.ones(len(x), bool), np.zeros(len(x), int)
                for c in k:
                    same &= c[x] == c[y]
                    blocks += same
                good = blocks > min(step, 1)
                x, y, blocks = x[good], y[good], blocks[good]
                t, e = (x, y) if other else (y, x)
                length = np.minimum(STEPS[blocks], np.minimum(n[t] - pos[t], n[e] - pos[e])).astype(np.int32)
                out.append(pd.DataFrame({"t": rep[t], "e": rep[e], "pos": pos[e], "len": length, "n": np.minimum(n[t], n[e])}))
    return pd.concat(out).drop_duplicates()


LINK = "t bigint, e bigint, pos int, len int, n int"
EDGE = "place int, " + ", ".join(f"{c} {k}" for c, k in (("k1", "bigint"), ("k2", "int"), ("k3", "int"), ("k4", "int"), ("sign", "bigint"), ("rep", "bigint"), ("side", "tinyint"), ("pos", "int"), ("n", "int")))


def _linked(batches):
    """All links inside a partition, then its outermost suffixes of either side (place: the border they lie at)."""
    from pyspark import TaskContext

    here = TaskContext.get().partitionId()
    whole = [b for b in batches if len(b)]
    if whole:
        s = pd.concat(whole, ignore_index=True)
        names = [c.split()[0] for c in f"{LINK}, {EDGE}".split(", ")]
        names = list(dict.fromkeys(names))
        yield _links(s).reindex(columns=names)
        for place, cut in ((here, "head"), (here + 1, "tail")):
            ends = pd.concat([getattr(g, cut)(NEIGHBOURS) for _, g in s.groupby("side")])
            yield ends.assign(place=place).reindex(columns=names)


def shared(suffixes: DataFrame) -> DataFrame:
    """(t, e): pairs of classes whose shared spans cover enough. suffixes: the columns of KEYS, rep, side, pos, n."""
    spark = suffixes.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, suffixes.count() // PART_ROWS + 1)
    ordered = suffixes.select(*KEYS, "rep", "side", "pos", "n").repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS)
    schema = ", ".join(dict.fromkeys(f"{LINK}, {EDGE}".split(", ")))
    found = materialize(ordered.mapInPandas(_linked, schema), "neighbours")
    of = [c.split()[0] for c in EDGE.split(", ")]
    # the last suffixes of a partition and the first of the next meet; a few rows a border
    stitched = found.filter("place is not null").select(*of).groupBy("place").applyInPandas(lambda g: _links(g.sort_values(KEYS)), LINK)
    links = found.filter("place is null").select("t", "e", "pos", "len", "n").unionByName(stitched)
    spans = links.groupBy("t", "e").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["pos"] + s["len"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(acc["end"], s["pos"]))).alias("sum")),
    )["sum"]
    return spans.filter(merged >= COVERAGE * F.col("n")).select("t", "e")


def distance(a: str, b: str, most: int) -> int:
    """Edits (swapped neighbours count one) between a and b, or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    x = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    a, b = a[x:], b[x:]
    y = next((i for i, (p, q) in enumerate(zip(reversed(a), reversed(b))) if p != q), min(len(a), len(b)))
    a, b = a[: len(a) - y], b[: len(b) - y]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def titles_near(title_a: str, title_b: str) -> bool:
    a, b = bare(title_a), bare(title_b)
    if a == b:
        return True
    most = edits(min(len(a), len(b)))
    return distance(a, b, most) <= most


def alike(first: list[str], second: list[str]) -> np.ndarray:
    """Of each pair of abstracts: whether one covers enough of the other with spans of four letters.

    The suffixes of all abstracts lie in one array, sorted by pair and first four letters; in a run, each suffix of one
    side covers one of the other.
    """
    texts = [*first, *second]
    size = np.array([max(1, len(t) - 3) for t in texts], np.int64)
    c = np.frombuffer("".join(t + "\0\0\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum([len(t) + 4 for t in texts]) - np.array([len(t) + 4 for t in texts])
    at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text = np.repeat(np.arange(len(texts)), size)
    pair, side = text % len(first), text >= len(first)
    with np.errstate(over="ignore"):
        key = pair.astype(np.uint64) * P
        for j in range(4):
            key = (key ^ c[at + j]) * P
            key ^= key >> np.uint64(29)
    key = (key & ~np.uint64(1)) | side.astype(np.uint64)
    order = np.argsort(key)
    key, pair = key[order], pair[order]
    run = np.cumsum(np.r_[True, (key[1:] >> np.uint64(1)) != (key[:-1] >> np.uint64(1))]) - 1
    theirs = np.bincount(run, (key & np.uint64(1)).astype(float))
    both = np.minimum(theirs, np.bincount(run) - theirs)
    both = np.bincount(pair[np.r_[0, np.flatnonzero(np.diff(run)) + 1]], both, len(first))
    n, m = size[: len(first)], size[len(first) :]
    return enough(both, n, m)


def enough(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether so many common strings are enough for abstracts of n and m."""
    return (2 * both >= ALIKE * (n + m)) | ((both >= WITHIN * np.minimum(n, m)) & (np.abs(n - m) <= SENTENCE))


def all_alike(first: list[str], second: list[str]) -> np.ndarray:
    """alike(), of BATCH_CHARS at once."""
    ok = np.zeros(len(first), bool)
    size = np.cumsum([len(x) + len(y) for x, y in zip(first, second)]) // BATCH_CHARS
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(size)) + 1) if first else []:
        ok[part] = alike(first[part[0] : part[-1] + 1], second[part[0] : part[-1] + 1])
    return ok


def tallies(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """How many strings of four letters of each text fall into each slot, and how many they are."""
    size = np.array([max(1, len(t) - 3) for t in texts], np.int64)
    c = np.frombuffer("".join(t + "\0\0\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    room = np.array([len(t) + 4 for t in texts], np.int64)
    at = np.repeat(np.cumsum(room) - room, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(4):
            key = (key ^ c[at + j]) * P
            key ^= key >> np.uint64(29)
    slot = np.repeat(np.arange(len(texts)), size) * slots + (key & np.uint64(slots - 1)).astype(np.int64)
    n = np.bincount(slot, minlength=len(texts) * slots).reshape(-1, slots)
    return n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.int64), size


def met(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of the two lists that are alike.

    Strings in common are at most those whose slots are; only pairs for which these would be enough are compared.
    """
    slots = 1 << int(np.clip(np.ceil(np.log2(2 * np.mean([len(t) + 1 for t in (*first, *second)]))), 8, 13))
    (x, n), (y, m) = tallies(first, slots), tallies(second, slots)
    may = [np.flatnonzero(enough(np.minimum(x[i], y).sum(1, dtype=np.int64), n[i], m)) for i in range(len(first))]
    a, b = np.repeat(np.arange(len(first)), [len(z) for z in may]), np.concatenate(may)
    ok = all_alike([first[i] for i in a], [second[i] for i in b])
    return a[ok], b[ok]


def same(title_a: str, abstract_a: str, title_b: str, abstract_b: str) -> bool:
    """Whether two normalised records hold the same paper."""
    if not abstract_a or not abstract_b:
        a = title_a.replace(" ", "")
        return bool(a) and a == title_b.replace(" ", "")
    return titles_near(title_a, title_b) and (abstract_a == abstract_b or bool(alike([abstract_a], [abstract_b])[0]))


def _checked(batches):
    """The pairs (t, e) that are the same paper; both abstracts hold something."""
    for b in batches:
        texts = {c: b[c].tolist() for c in ("t_title", "e_title", "t_abstract", "e_abstract")}
        ok = np.array([titles_near(normalise(x), normalise(y)) for x, y in zip(texts["t_title"], texts["e_title"])], bool)
        at = np.flatnonzero(ok)
        ok[at] = all_alike(*([normalise(texts[c][i]) for i in at] for c in ("t_abstract", "e_abstract")))
        yield b.loc[ok, ["t", "e"]]


def check(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (t, e) of classes that hold the same paper. rows: row_id, side, title, abstract."""
    few = small(pairs)

    def text(name: str, side: int) -> DataFrame:
        one = classes.filter(F.col("side") == side).select(F.col("rep").alias(name), "row_id")
        wanted = one.join(F.broadcast(pairs), name) if few else one.join(pairs, name)
        texts = rows.filter(F.col("side") == side).select("row_id", F.col("title").alias(f"{name}_title"), F.col("abstract").alias(f"{name}_abstract"))
        return texts.join(F.broadcast(wanted) if few else wanted, "row_id").drop("row_id")

    both = text("t", 0).join(text("e", 1), ["t", "e"])
    return both.repartition(max(2 * pairs.sparkSession.sparkContext.defaultParallelism, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "t", "e").mapInPandas(_checked, "t bigint, e bigint")


def salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join, where the rows of a hot key are parted into blocks on either side, and each block meets each."""
    counts = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    hot = materialize(counts.filter(f"l > 0 and r > 0 and (l > {SALT_ROWS} or r > {SALT_ROWS})").select(key, *((F.col(c) / SALT_ROWS + 1).cast("int").alias(c) for c in "lr")), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot) if small(hot) else hot

    def parted(df: DataFrame, mine: str, other: str) -> DataFrame:
        of = lambda c: F.coalesce(F.col(c), F.lit(1))
        own, all_of = F.pmod(F.xxhash64(*df.columns), of(mine)).cast("int"), F.explode(F.sequence(F.lit(0), of(other) - 1))
        return df.join(hot, key, "left").select(*df.columns, own.alias(f"__{mine}"), all_of.alias(f"__{other}"))

    return parted(left, "l", "r").join(parted(right, "r", "l"), [key, "__l", "__r"]).drop("__l", "__r")


def titled(parts: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(t, e): all pairs of classes with abstracts whose titles can be near and whose abstracts' lengths are, too; but for those of common titles, of which there are the pairs (a, b) of titles that can be near."""
    of = lambda df, v, *columns: df.filter(F.col("side") == v).select(*columns)
    shared_parts = salted(of(parts, 0, "k1", F.col("rep").alias("a"), F.col("sign").alias("x")), of(parts, 1, "k1", F.col("rep").alias("b"), F.col("sign").alias("y")), "k1")
    near = materialize(shared_parts.filter(signs_fit("x", "y")).select("a", "b").distinct(), "near")
    full = classes.filter("not blank")
    counts = full.groupBy("title").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    common = materialize(counts.filter(f"n > {COMMON} or m > {COMMON}").select("title"), "common")
    fits = (2 * F.least("n", "m") >= ALIKE * (F.col("n") + F.col("m"))) | (F.abs(F.col("n") - F.col("m")) <= SENTENCE)
    t, e = of(full, 0, F.col("title").alias("a"), F.col("rep").alias("t"), "n"), of(full, 1, F.col("title").alias("b"), F.col("rep").alias("e"), F.col("n").alias("m"))
    join = lambda df, right, on: right.join(F.broadcast(df), on) if small(df) else df.join(right, on)
    if common.isEmpty():
        return join(near, t, "a").join(e, "b").filter(fits).select("t", "e"), None
    common = F.broadcast(common) if small(common) else common
    often = near.join(common.withColumnRenamed("title", "a"), "a", "left_semi").unionByName(near.join(common.withColumnRenamed("title", "b"), "b", "left_semi")).distinct()
    often = materialize(often, "often")
    rare = near.join(often, ["a", "b"], "left_anti")
    return join(materialize(rare, "rare"), t, "a").join(e, "b").filter(fits).select("t", "e"), often


def _plain(batches):
    for b in batches:
        yield b.assign(abstract=[normalise(x) for x in b["abstract"]], head=[normalise(x) for x in b["head"]])


def _crowd(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The pairs (t, e) of two blocks that are the same paper; the records of a block have one title but for notes of editions."""
    if not len(left) or not len(right) or not titles_near(left["head"].iloc[0], right["head"].iloc[0]):
        return pd.DataFrame({"t": np.zeros(0, np.int64), "e": np.zeros(0, np.int64)})
    x, y = met(left["abstract"].tolist(), right["abstract"].tolist())
    return pd.DataFrame({"t": left["t"].to_numpy()[x], "e": right["e"].to_numpy()[y]})


def crowded(often: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (t, e) of classes that hold the same paper, out of all under the pairs (a, b) of titles; each block of one side meets each of the other."""
    full = classes.filter("not blank")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_CHARS)).cast("int")
    count = lambda v, title, name: full.filter(F.col("side") == v).groupBy(F.col("title").alias(title)).agg(blocks.alias(name))
    sized = materialize(often.join(count(0, "a", "l"), "a").join(count(1, "b", "r"), "b"), "blocks")
    held = F.broadcast(sized) if small(sized) else sized

    def side(v: int, title: str, name: str, mine: str, other: str) -> DataFrame:
        own = full.filter(F.col("side") == v).select(F.col("title").alias(title), F.col("rep").alias(name), "row_id").join(held.select(title).distinct(), title, "left_semi")
        texts = rows.filter(F.col("side") == v).select("row_id", F.col("title").alias("head"), "abstract").join(own, "row_id").select(title, name, "head", "abstract")
        texts = materialize(texts.mapInPandas(_plain, f"{title} bigint, {name} bigint, head string, abstract string"), "texts")
        at = texts.join(held, title)
        return at.select("a", "b", name, "head", "abstract", F.pmod(F.xxhash64(name), F.col(mine)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    keys = ["a", "b", "l", "r"]
    return side(0, "a", "t", "l", "r").groupBy(*keys).cogroup(side(1, "b", "e", "r", "l").groupBy(*keys)).applyInPandas(_crowd, "t bigint, e bigint")


def overlaps(train: DataFrame, evaluation: DataFrame, key: str = "row_id") -> DataFrame:
    """(t, e): each pair of a row of train and one of evaluation that hold the same paper. Both have key, title and abstract."""
    of = lambda df, v: df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("row_id"), F.lit(v).cast("tinyint").alias("side"), "title", "abstract")
    rows = of(train, 0).unionByName(of(evaluation, 1))
    listed = materialize(spread(rows, "row_id").mapInArrow(_listed, LISTED), "suffixes")
    records, suffixes, parts = (listed.filter(F.col("kind") == k) for k in (RECORD, SUFFIX, PART))
    one = [F.min(c).alias(c) for c in ("row_id", "n", "title", "whole", "blank")]
    classes = materialize(records.groupBy("side", "rep").agg(*one, F.count("*").alias("copies")), "classes")
    met_by_title, often = titled(parts, classes)
    pairs = materialize(shared(suffixes).unionByName(met_by_title).distinct(), "candidates")
    ends = classes.filter("whole <> 0")
    side = lambda v, name: ends.filter(F.col("side") == v).select(F.col("rep").alias(name), "whole", F.col("blank").alias(f"{name}_blank"))
    t, e = side(0, "t"), side(1, "e")
    by_title = salted(e.filter("e_blank"), t, "whole").select("t", "e").unionByName(salted(e.filter("not e_blank"), t.filter("t_blank"), "whole").select("t", "e"))
    by_text = check(pairs, classes, rows)
    if often is not None:
        by_text = by_text.unionByName(crowded(often, classes, rows)).distinct()
    found = materialize(by_text.unionByName(by_title), "found")
    members = lambda v, name, row: records.filter(F.col("side") == v).select(F.col("rep").alias(name), F.col("row_id").alias(row))
    if small(found):
        half = members(0, "t", "row_t").join(F.broadcast(found), "t")
    else:
        half = salted(found, members(0, "t", "row_t"), "t")
    return salted(half, members(1, "e", "row_e"), "e").select(F.col("row_t").alias("t"), F.col("row_e").alias("e"))


ship(__name__)
