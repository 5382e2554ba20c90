"""The jobs from tables to tables: landing, training (also on train and validation together), a sweep, a test pass, inference."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, predictions
from ..operators.learning import LinearClassifier
from ..operators.learning import sweep as search
from ..session import get_session
from ..sources.settings import Settings, Sweep, log_to_stdout, run_name
from ..sources.tables import all_exist, predictions_path, write_table

LOG = logging.getLogger(__name__)


def land(spark: SparkSession, source: str, target: str, force: bool = False) -> bool:
    """Copy a table from any file system that Spark reads to where the other jobs look for it; kept if it is there."""
    return write_table(spark.read.parquet(source), target, force)


def train(spark: SparkSession, data: str, settings: Settings, full: bool = False) -> LinearClassifier:
    """Fit on <data>/train.parquet with early stopping on val.parquet (full: on both, all epochs); save to settings.output_dir."""
    rows, val = _read(spark, data, "train"), _read(spark, data, "val")
    model = LinearClassifier(settings)
    model.train(rows.unionByName(val, allowMissingColumns=True), None) if full else model.train(rows, val)
    model.save(settings.output_dir)
    _log(spark, settings, run_name(settings.output_dir, "full" if full else "train"), [(e, "val_f1", f) for e, f in model.log])
    return model


def sweep(spark: SparkSession, data: str, settings: Settings, what: Sweep) -> LinearClassifier:
    """The best of a search by F1 on val.parquet, saved likewise; the log has a row per run and parameter."""
    model, runs = search(_read(spark, data, "train"), _read(spark, data, "val"), what, settings)
    model.save(settings.output_dir)
    _log(spark, settings, run_name(settings.output_dir, "sweep"), [(i, k, float(v)) for i, (values, f1) in enumerate(runs) for k, v in (values | {what.metric: f1}).items()])
    return model


def test(spark: SparkSession, data: str, settings: Settings, out: str, force: bool = True) -> None:
    """Tables predictions, uncertain, metrics, metrics_by_bucket, confusion and confusion_by_bucket of <data>/test.parquet; without force, kept if all are there."""
    rows = _read(spark, data, "test")
    names = ["predictions", "uncertain", "metrics", "confusion", *(["metrics_by_bucket", "confusion_by_bucket"] if "bucket" in rows.columns else [])]
    if not force and all_exist(spark, [f"{out}/{n}.parquet" for n in names]):
        return
    overall, p = LinearClassifier(settings).load(settings.output_dir).test(rows)
    tables = {"predictions": p, "uncertain": predictions.uncertain(p, settings.uncertainty_threshold), "metrics": overall, "confusion": agreement.confusion(p, "label", "predicted")}
    if "bucket" in p.columns:
        tables |= {"metrics_by_bucket": predictions.metrics(p, ["bucket"]), "confusion_by_bucket": agreement.confusion(p, "label", "predicted", ["bucket"])}
    for name in names:
        write_table(tables[name], f"{out}/{name}.parquet")
    m = overall.first()
    _log(spark, settings, run_name(settings.output_dir, "test"), [(0, f"test_{k}", float(m[k])) for k in ("accuracy", "precision", "recall", "f1")])


def infer(spark: SparkSession, path: str, settings: Settings, out: str | None = None) -> str:
    """Predictions of a table beside it, or at out; returns where."""
    rows, out = spark.read.parquet(path), out or predictions_path(path)
    write_table(LinearClassifier(settings).load(settings.output_dir).predict(rows, ["bibkey"]), out)
    return out


def _read(spark: SparkSession, data: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data}/{name}.parquet")


def _log(spark: SparkSession, settings: Settings, run: str, rows: list[tuple[int, str, float]]) -> None:
    """Append a run's metrics to the table beside the model: run, at, step, metric, value."""
    if rows:
        df = spark.createDataFrame(rows, "step int, metric string, value double").select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), "step", "metric", "value")
        df.write.mode("append").parquet(f"{settings.output_dir.rstrip('/')}-log")
        LOG.info("%s: %s", run, rows)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description="Landing and classifier jobs.")
    parser.add_argument("job", choices=["land", "train", "sweep", "test", "infer"])
    parser.add_argument("data", help="folder of the splits; for infer and land the table")
    parser.add_argument("--config", help="YAML file with a section 'model'")
    parser.add_argument("--sweep", help="YAML file of a search")
    parser.add_argument("--checkpoint", help="where the model is kept")
    parser.add_argument("--full-train", action="store_true", help="train on train and val together")
    parser.add_argument("--epochs", type=int)
    parser.add_argument("--output", help="where tables are written")
    a = parser.parse_args(argv)
    log_to_stdout()
    settings = (Settings.read(a.config) if a.config else Settings()).override(output_dir=a.checkpoint, num_train_epochs=a.epochs)
    spark = get_session()
    if a.job == "land":
        land(spark, a.data, a.output)
    elif a.job == "train":
        train(spark, a.data, settings, a.full_train)
    elif a.job == "sweep":
        sweep(spark, a.data, settings, Sweep.read(a.sweep))
    elif a.job == "test":
        test(spark, a.data, settings, a.output or a.data)
    else:
        infer(spark, a.data, settings, a.output)
