"""Problem 2: several values packed in one field.

Method: ordinary characters are masked, so that a field's delimiter skeleton is left; the splitting rule is resolved once
per distinct skeleton (outside the JVM, on few rows), joined back (by broadcast where their number is checked to be
small) and applied by position: a rule names token spans, and the value is the text of those tokens.

Null and blank fields, and fields with fewer than two values, give no row. Empty pieces take no position, repeated
values stay, very long fields are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_known, materialize, ship, small

SPACE = r"\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{feff}"
#: Signs that separate, enclose or number values, wherever they stand.
SIGNS = r""",;|/&+\-'"\[\](){}\\·；，、•`"""
TOKENS = rf"\r\n|[{SPACE}{SIGNS}]|[^{SPACE}{SIGNS}]+"
ALWAYS = ",;|\n\t；，、·•"
#: An even number of backslashes, so that the next one escapes.
EVEN = r"(?<!\\)((?:\\\\)*)"
OPEN = {"[": "]", "(": ")", "{": "}"}
#: Signs in all skeletons together up to which the rules are broadcast.
RULE_CHARS = 16_000_000
#: By kind of field: signs that belong to the value where they touch it on both sides, and whether a blank separates.
KINDS = {"name": ("-/&+'", False), "code": ("-", True)}
#: What a field holds wherever resolve() finds a separator; the second where a blank separates.
MAYBE, PARTED = rf"[{ALWAYS}/&+\r]|[{SPACE}][aA][nN][dD][{SPACE}]|[0-9][.:]?\)", rf"[^{SPACE}][{SPACE}]+[^{SPACE}]"


def skeleton(tokens: Column) -> Column:
    """One sign per token: separators and quotes as they are, blanks as ' ', the word and as A, numbers as N, else w."""

    def sign(t: Column) -> Column:
        return (
            F.when(t.isin("\r\n", "\n", "\r"), "\n").when(t == "\t", "\t")
            .when(t.rlike(rf"^[{SPACE}]$"), " ").when(t.rlike(rf"^[{SIGNS}]$"), t)
            .when(F.lower(t) == "and", "A").when(t.rlike(r"^[0-9]+[.:]?$"), "N").otherwise("w")
        )

    return F.array_join(F.transform(tokens, sign), "")


def resolve(s: str, kind: str) -> list[tuple[int, int, str]]:
    """The spans (first token, number of tokens, escape) of the values in a skeleton. escape: '', 'csv' or 'back'."""
    tight, blank = KINDS[kind]
    lo, hi = 0, len(s)

    def trim(a: int, b: int) -> tuple[int, int]:
        while a < b and s[a] in " \n\t":
            a += 1
        while b > a and s[b - 1] in " \n\t":
            b -= 1
        return a, b

    def closing(a: int, b: int) -> tuple[int, str]:
        """Where the quote opened at a closes (-1: nowhere before b), and which escape it holds."""
        q, i, how = s[a], a + 1, ""
        while i < b:
            if s[i] == "\\" and i + 1 < b:
                i, how = i + 2, "back"
            elif s[i] == q and i + 1 < b and s[i + 1] == q and q == '"':
                i, how = i + 2, "csv"
            elif s[i] == q and not (q == "'" and i + 1 < b and s[i + 1] in "wNA" and s[i - 1] in "wNA"):
                return i, how
            else:
                i += 1
        return -1, ""

    def enclosed(a: int, b: int) -> bool:
        """Whether the bracket at a closes at b - 1."""
        depth, i, start = 0, a, True
        while i < b:
            c = s[i]
            if c in "\"'" and start and (j := closing(i, b)[0]) > 0:
                i, start = j + 1, False
                continue
            depth += (c in OPEN) - (c in "])}")
            if depth == 0:
                return i == b - 1
            start = c in OPEN or c in ALWAYS or (start and c == " ")
            i += 1
        return False

    lo, hi = trim(lo, hi)
    while hi - lo > 1 and s[lo] in OPEN and s[hi - 1] == OPEN[s[lo]] and enclosed(lo, hi):
        lo, hi = trim(lo + 1, hi - 1)
    number = next((n for n in ("(N)", "N)") if s.startswith(n, lo)), "")

    def separator(i: int) -> int:
        """How many tokens the separator at i takes; 0: none there."""
        c = s[i]
        if c in ALWAYS:
            return 1
        before, behind = s[i - 1] if i > lo else " ", s[i + 1] if i + 1 < hi else " "
        if c in "/&+":
            if c not in tight:
                return 1
            a, b = i, i
            while a > lo and s[a - 1] in tight:
                a -= 1
            while b + 1 < hi and s[b + 1] in tight:
                b += 1
            inside = a > lo and b + 1 < hi and s[a - 1] not in " \n\t" + ALWAYS and s[b + 1] not in " \n\t" + ALWAYS
            return 0 if inside else 1
        if c == "A":
            return int(before in " \n\t" and behind in " \n\t" and i > lo and i + 1 < hi)
        if number and s.startswith(number, i) and before in " \n\t":
            return len(number)
        return int(blank and c == " ")

    out: list[tuple[int, int, str]] = []

    def piece(a: int, b: int) -> None:
        a, b = trim(a, b)
        if a < b and s[a] in "-*" and a + 1 < b and s[a + 1] == " ":  # a list mark
            a, b = trim(a + 1, b)
        elif s.startswith("N ", lo) and s.startswith("N ", a) and "\n" in s:
            a, b = trim(a + 1, b)
        how = ""
        if b - a > 1 and s[a] in "\"'`":
            j, esc = closing(a, b)
            if j == b - 1:
                a, b, how = a + 1, b - 1, esc
                a, b = trim(a, b)
        if a < b and s[a:b] not in ("-", "*"):
            out.append((a, b - a, how))

    i = begin = lo
    fresh = True  # nothing of the piece has been read but blanks
    while i < hi:
        if fresh and s[i] in "\"'`":
            j, _ = closing(i, hi)
            k = j + 1
            while 0 < j and k < hi and s[k] == " ":
                k += 1
            if j > 0 and (k >= hi or separator(k) or (blank and k > j + 1)):
                i, fresh = j + 1, False
                continue
        if n := separator(i):
            piece(begin, i)
            i += n
            begin, fresh = i, True
        else:
            fresh = fresh and s[i] in " \n\t-"
            i += 1
    piece(begin, hi)
    return out


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        spans = [[{"at": x, "n": n, "esc": e} for x, n, e in resolve(s, k)] for s, k in zip(b["skeleton"], b["kind"])]
        out = b.assign(spans=spans)
        yield out[[len(x) > 1 for x in spans]]


def split_packed(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, pos, val): one row per value of each field that packs two or more. fields: column -> kind (name, code)."""
    blank = [k for k, (_, parts) in KINDS.items() if parts]
    long = df.select(key, F.inline(F.array(*(
        F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in fields.items()
    )))).filter(F.col("value").rlike(MAYBE) | (F.col("kind").isin(blank) & F.col("value").rlike(PARTED)))
    cut = long.withColumn("tokens", F.regexp_extract_all("value", F.lit(TOKENS), F.lit(0))).withColumn("skeleton", skeleton(F.col("tokens")))
    rules = materialize(
        # few bytes, but work for Python: a number of partitions that AQE leaves as it is
        cut.groupBy("kind", "skeleton").agg(F.count("*").alias("n")).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "kind", "skeleton").mapInPandas(_rules, "kind string, skeleton string, n bigint, spans array<struct<at:int,n:int,esc:string>>"),
        "rules",
    )
    if small(rules) and rules.agg(F.coalesce(F.sum(F.length("skeleton")), F.lit(0))).first()[0] <= RULE_CHARS:
        ruled = cut.join(F.broadcast(rules.drop("n")), ["kind", "skeleton"])
    else:
        ruled = join_known(cut, rules, ["kind", "skeleton"], "n", how="inner")
    raw = F.array_join(F.slice("tokens", F.col("s.at") + 1, F.col("s.n")), "")
    val = (
        F.when(F.col("s.esc") == "csv", F.replace(raw, F.lit('""'), F.lit('"')))
        .when(F.col("s.esc") == "back", F.coalesce(
            F.get_json_object(F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(raw, rf"{EVEN}\\'", "$1'"), rf'{EVEN}"', r'$1\\"'), F.lit('"]')), "$[0]"), F.regexp_replace(raw, r"\\(.)", "$1")))
        .otherwise(raw)
    )
    return ruled.select(key, "field", "tokens", F.posexplode("spans").alias("p", "s")).select(key, "field", (F.col("p") + 1).alias("pos"), val.alias("val"))


ship(__name__)
