"""Problem 7: byte-level BPE encoding of a whole corpus.

Method: batched numpy merge rounds. The distinct words of a batch lie as byte symbols in one flat array; in each round
every word merges its lowest-ranked pair, whose rank is found by binary search over the sorted pair keys.

Null, empty and blank texts: null and '' give the empty list, blank texts are encoded as they are. Strings that look
like special tokens are ordinary text. Repeated rows and ties need no care: each row is encoded on its own.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread

#: Where the public vocabularies lie; a parameter of every operator that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The public pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text handled at once.
BATCH_CHARS = 4_000_000
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str = VOCABULARY) -> dict[str, np.ndarray]:
    """The vocabulary as arrays of fixed size: ids of single bytes, sorted pair keys, their ranks and merged ids (about 1 MB)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    to = np.array([vocab[a + b] for a, b in merges], np.int32)
    first = np.unique(keys, return_index=True)[1]
    return {"bytes": np.array([vocab[s] for _, s in sorted(byte_symbols().items())], np.int32), "keys": keys[first], "ranks": first.astype(np.int32), "to": to[first]}


def encode_words(words: list[bytes], v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and how many each word has."""
    flat = v["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(flat) > 1:
        key = flat[:-1].astype(np.int64) << 32 | flat[1:]
        at = np.minimum(np.searchsorted(v["keys"], key), len(v["keys"]) - 1)
        rank = np.full(len(flat), NONE)
        rank[:-1] = np.where((v["keys"][at] == key) & (word[:-1] == word[1:]), v["ranks"][at], NONE)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(flat)])
        best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        if (over := best == NONE).any():
            done.append((word[over], flat[over]))
        hit = (rank == best) & ~over
        if not hit.any():
            flat, word = flat[:0], word[:0]
            break
        # in a run of overlapping hits every second one merges, from the left
        idx = np.flatnonzero(hit)
        fresh = np.r_[True, (np.diff(idx) > 1) | (word[idx[1:]] != word[idx[:-1]])]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(idx)), 0))
        idx = idx[(np.arange(len(idx)) - run) % 2 == 0]
        flat[idx] = v["to"][at[idx]]
        keep = ~over
        keep[idx + 1] = False
        flat, word = flat[keep], word[keep]
    done.append((word, flat))
    word, flat = np.concatenate([w for w, _ in done]), np.concatenate([f for _, f in done])
    order = np.argsort(word, kind="stable")
    return flat[order], np.bincount(word, minlength=len(words))


def encode(texts: list[str | None], v: dict[str, np.ndarray], split=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one flat array, and how many each text has."""
    import regex

    find = split or regex.compile(PATTERN).findall
    index: dict[str, int] = {}
    each = [[index.setdefault(w, len(index)) for w in find(t)] if t else [] for t in texts]
    if not index:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    flat, size = encode_words([w.encode("utf-8", "surrogatepass") for w in index], v)
    begin = np.cumsum(size) - size
    w = np.concatenate([np.asarray(e, np.int64) for e in each])
    n = size[w]
    ids = flat[np.repeat(begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    upto = np.r_[0, np.cumsum(n)]
    ends = np.cumsum([len(e) for e in each])
    return ids, np.diff(np.r_[0, upto[ends]])


def slices(lengths: np.ndarray):
    """Consecutive rows of at most BATCH_CHARS characters (a longer text stands alone)."""
    group = np.cumsum(lengths) // BATCH_CHARS
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(lengths)]
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _run(vocabulary, counts: bool):
    def run(batches):
        import regex

        v, find = vocabulary.value, regex.compile(PATTERN).findall
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rest = batch.columns[:-1]
            names = batch.schema.names[:-1]
            for a, b in slices(np.array([len(t or "") for t in texts], np.int64)):
                ids, n = encode(texts[a:b], v, find)
                if counts:
                    out = pa.array(n, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in rest), out], [*names, "__out"])

    return run


def _apply(df: DataFrame, text: str, to: str, path: str, counts: bool, key: str | None) -> DataFrame:
    spark = df.sparkSession
    v = spark.sparkContext.broadcast(load(path))
    keep = [c for c in df.columns if c not in (text, to)]
    kind = "bigint" if counts else "array<int>"
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"__out {kind}"])
    rows = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return (spread(rows, key) if key else rows).mapInArrow(_run(v, counts), schema).withColumnRenamed("__out", to)


def encode_corpus(df: DataFrame, text: str = "text", to: str = "ids", path: str = VOCABULARY, key: str | None = "doc_id") -> DataFrame:
    """df with text replaced by its token ids (array<int>, never null); every other column stays, one row out per row in."""
    return _apply(df, text, to, path, False, key)


def count_tokens(df: DataFrame, text: str = "text", to: str = "tokens", path: str = VOCABULARY, key: str | None = "doc_id") -> DataFrame:
    """As encode_corpus, with the number of tokens in place of the ids (0 for null and empty texts)."""
    return _apply(df, text, to, path, True, key)


ship(__name__)
