"""Catalogue records: typed projection, year and venue filters, venue categories, enrichment, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signals
from ..functions.text import not_blank
from ..session import join_hot

YEARS = (2013, 2026)
# Venue identifiers by category. Papers are kept for all but the journals outside of ACL.
ACL_VENUES = ["aacl", "acl", "arabicnlp", "conll", "eacl", "emnlp", "findings", "iwslt", "naacl", "semeval", "starsem", "wmt"]
NON_ACL_VENUES = ["aimecon", "alta", "amta", "ccl", "clicit", "coling", "eamt", "ijcnlp", "iwsds", "jeptalnrecital", "konvens", "lrec", "mtsummit", "nodalida", "paclic", "ranlp", "rocling", "scil"]
ACL_JOURNALS = ["cl", "tacl"]
NON_ACL_JOURNALS = ["ijclclp", "jlcl", "lilt", "nejlt", "tal"]
CATEGORIES = {"acl_venue": ACL_VENUES, "non_acl_venue": NON_ACL_VENUES, "acl_journal": ACL_JOURNALS, "non_acl_journal": NON_ACL_JOURNALS}
KEPT = [*ACL_VENUES, *NON_ACL_VENUES, *ACL_JOURNALS]


def project(records: DataFrame) -> DataFrame:
    """The typed catalogue record: strings, short year, lists of strings; what a record lacks is null. Deleted records and front matter are left out where flagged."""
    for flag in ("is_deleted", "is_frontmatter"):
        if flag in records.columns:
            records = records.filter(~F.coalesce(F.col(flag), F.lit(False)))
    kinds = {"id": "string", "bibkey": "string", "title": "string", "abstract": "string", "authors": "array<string>", "year": "smallint", "venues": "array<string>", "doi": "string", "url": "string", "language": "string"}

    def field(name: str, kind: str) -> Column:
        if name not in records.columns:
            return F.lit(None).cast(kind)
        t = records.schema[name].dataType
        if kind == "array<string>" and isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return person_names(F.col(name), t.elementType)
        return F.col(name).try_cast(kind)

    return records.select(*(field(c, k).alias(c) for c, k in kinds.items()))


def person_names(people: Column, kind: T.StructType) -> Column:
    """Names, first name first, of a list of people; a person is a struct of first and last, or has such a struct as name. Missing parts are left out."""
    name = lambda p: p["name"] if "name" in kind.fieldNames() else p
    return F.transform(people, lambda p: F.concat_ws(" ", name(p)["first"], name(p)["last"]))


def venue_category(venues: Column) -> Column:
    """Category of the first listed venue that has one, else unknown."""
    table = F.create_map(*(F.lit(x) for kind, names in CATEGORIES.items() for n in names for x in (n, kind)))
    known = F.filter(F.transform(venues, lambda v: F.try_element_at(table, v)), lambda k: k.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))


def clean(papers: DataFrame, first: int = YEARS[0], last: int = YEARS[1]) -> DataFrame:
    """Papers of the years and kept venues, with venue_type. A null year or list is out."""
    kept = F.arrays_overlap("venues", F.array(*map(F.lit, KEPT)))
    return papers.filter(F.col("year").cast("int").between(first, last) & kept).withColumn("venue_type", venue_category(F.col("venues")))


def with_text(papers: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every named column holds more than white space."""
    for c in columns:
        papers = papers.filter(not_blank(c))
    return papers


def enrich(papers: DataFrame, second: DataFrame, key: str, second_key: str, carry: list[str]) -> DataFrame:
    """Left join to a second corpus; a null abstract is filled from it, a blank one is not. Equal second keys multiply rows."""
    s = second.select(F.col(second_key).alias("__key"), F.col("abstract").alias("__abstract"), *carry)
    joined = join_hot(papers.drop(*carry), s, key, "__key")
    return joined.withColumn("abstract", F.coalesce("abstract", "__abstract")).drop("__key", "__abstract")


def score(papers: DataFrame) -> DataFrame:
    """papers with a column per signal category, the totals and the bucket."""
    text = papers.withColumn("__text", F.concat_ws(" ", "title", "abstract")).withColumn("__folded", signals.fold(F.col("__text")))
    scored = text.withColumns(signals.scores(F.col("__text"), F.col("__folded"))).drop("__text", "__folded")
    return scored.withColumns(signals.totals()).withColumn("bucket", signals.bucket())
