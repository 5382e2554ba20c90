"""Queries of the training-data problems; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from ..functions.text import strip
from . import bpe, canonical, consensus, language, mixing, overlap, quota, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fields = ["task_type", "domain", "data_source", "input_type"]
    found = canonical.map_values(read_table(spark, d, "paper_taxonomy"), "rec_id", fields, read_table(spark, d, "canonical_values"))
    return found.select("rec_id", "field", "canonical")


def _bucket_sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = read_table(spark, d, "anthology_enriched_with_bucket", "bibkey", "bucket", "year", "scored_at")
    papers = papers.withColumn("bucket", F.upper(strip("bucket")))
    return quota.sample(papers, "bibkey", ["bucket", "year"], read_table(spark, d, "sample_targets"), latest="scored_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_sample(spark, d)[1].filter("short").select("bucket", "year")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_sample(spark, d)[0]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_sample(spark, d)[1]


LANGUAGES = ["de", "en", "es", "fr", "it", "pt", "zh"]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    papers = read_table(spark, d, "anthology_enriched", "id", "abstract", "language", "venues", "loaded_at")
    labelled = papers.select(F.col("abstract").alias("text"), language.code(F.col("language")).alias("lang")).unionByName(
        read_table(spark, d, "documents").select("text", language.code(F.col("lang")).alias("lang"))
    )
    papers = language.latest(papers, "id", "loaded_at", "abstract", "language")
    return language.segments(papers, "id", "abstract", "language", labelled, LANGUAGES, "venues")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("label").isNull() | (F.col("n_segs") > 1) | (F.col("label") != F.col("lang"))
    return _segments(spark, d).filter(odd).select("id", "seg", "lang")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "val").withColumn("split", F.lit("val")).unionByName(read_table(spark, d, "test").withColumn("split", F.lit("test")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(read_table(spark, d, "train"), _evaluation(spark, d))
    return pairs.select(F.least("t", "e").alias("row_a"), F.greatest("t", "e").alias("row_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluation(spark, d)
    hits = overlap.overlaps(read_table(spark, d, "train"), rows).groupBy(F.col("e").alias("row_id")).agg(F.count("*").alias("n"))
    return rows.select("row_id", "split", "source").join(hits, "row_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs")
    )


def _votes(spark: SparkSession, d: str) -> DataFrame:
    three = {a: f"{a}_label" for a in ("google", "deepseek", "mistral")}
    two = {a: f"{a}_label" for a in ("mistral", "claude")}
    return consensus.votes([(read_table(spark, d, "results_merged"), "merged_at", three), (read_table(spark, d, "merged"), "labelled_at", two)], "bibkey")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_votes(spark, d), "bibkey").filter("disputed").select("bibkey", "consensus")


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_votes(spark, d), "bibkey")


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotators(_votes(spark, d), "bibkey")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(read_table(spark, d, "documents", "doc_id", "text"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_table(spark, d, "documents", "doc_id", "text", "source"), read_table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].filter("not reachable").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang")
    return truncation.find_cut(docs, "doc_id").filter("cut").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang", "source")
    cut = truncation.find_cut(docs, "doc_id", keep=("source",))
    return cut.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_sample, p3_report, p4_found, p4_segments, p5_found, p5_report, p6_found, p6_consensus, p6_annotators, p7_ids, p8_found, p8_mix, p8_shares, p9_found, p9_rates)}


WHITE = r"\s\x1c-\x1f\x{85}\p{Z}"
#: Only what SQL can express on whole tables; the rest is tested against brute force, round trips and held-out accuracy.
#: No case of p8_found is close, so bytes stand for tokens there.
SQL = {
    "p3_found": f"""WITH p AS (SELECT DISTINCT bibkey, upper(regexp_replace(bucket, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')) AS bucket, year FROM anthology_enriched_with_bucket WHERE bibkey IS NOT NULL),
        pool AS (SELECT p.* FROM p JOIN sample_targets USING (bucket, year)), n AS (SELECT count(DISTINCT bibkey) * 0.2::double AS n FROM pool), c AS (SELECT bucket, year, count(*) AS c FROM pool GROUP BY ALL)
        SELECT bucket, year FROM sample_targets LEFT JOIN c USING (bucket, year), n WHERE coalesce(c, 0) < target_share * n OR coalesce(c, 0) < min_rows""",
    "p8_found": """WITH s AS (SELECT source, sum(coalesce(strlen(text), 0)) AS b FROM documents GROUP BY source), n AS (SELECT sum(b) / 2.0::double AS n FROM s)
        SELECT source FROM mix_targets LEFT JOIN s USING (source), n WHERE max_repeats * coalesce(b, 0) < target_share * n""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
