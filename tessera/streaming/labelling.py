"""Incremental labelling: rows arrive as a stream, each batch is labelled and appended, and a restart goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotators
from ..operators.labels import Task
from ..session import shared_dir

#: Takes a batch and adds the column label; unable to tell, it says UNSURE.
Annotator = Callable[[DataFrame], DataFrame]


def annotator(provider: str, task: Task, **how) -> Annotator:
    """A registered provider as the annotator of a stream, with its retries and its bound on calls; errors become UNSURE."""
    return lambda batch: annotators.label_rows(batch, provider, task, **how).withColumn("label", F.col(f"{provider}_label"))


def run(spark: SparkSession, path: str, annotate: Annotator, target: str | None = None, files: int = 50) -> DataFrame:
    """Label what is at path and isn't yet in target; returns all labelled rows: row_id, label.

    The checkpoint beside the target makes it resumable; each batch is its own folder, written anew if it is retried,
    so no row comes twice. At most ``files`` files are taken at once.
    """
    target = target or f"{shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).select("row_id", "label").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    # a stream reads folders; a single file is the one of that name in its folder
    files_of = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = not files_of.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(files_of).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    stream = reader.option("pathGlobFilter", files_of.getName()).parquet(files_of.getParent().toString()) if single else reader.parquet(path)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("row_id bigint, label string, batch int").parquet(f"{target}/rows").select("row_id", "label")
