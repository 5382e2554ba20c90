"""Scans and sinks: pruned parquet reads, overwrite sinks, idempotent writes, derived paths, JSON lines."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; only the named columns are read when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, force: bool = True) -> bool:
    """Overwrite a parquet table; with force=False an existing table is kept. Returns whether it wrote."""
    if not force and table_exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def table_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def all_exist(spark: SparkSession, paths: list[str]) -> bool:
    """Whether all outputs of a job are there, so that it can be left out."""
    return all(table_exists(spark, p) for p in paths)


def predictions_path(input_path: str) -> str:
    """``<folder>/<stem>_predictions.parquet`` beside the input."""
    p = PurePosixPath(input_path)
    return str(p.with_name(f"{p.stem}_predictions.parquet"))


def write_json_lines(df: DataFrame, column: str, path: str) -> None:
    """One JSON text per line; the column already holds the JSON."""
    df.select(column).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as column ``value``; blank lines are dropped, malformed ones kept for the parser to count."""
    return spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(path).filter("trim(value) <> ''")
