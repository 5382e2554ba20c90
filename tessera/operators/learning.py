"""A text classifier with weighted classes, as the stand-in for a fine-tuned encoder: hashed word features and logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.settings import Settings, Sweep
from . import predictions


class Classifier(Protocol):
    """What a classifier must offer; the jobs know no more of it."""

    def train(self, rows: DataFrame, validation: DataFrame | None) -> None: ...
    def test(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]: ...
    def save(self, path: str) -> None: ...
    def push(self, target: str) -> None: ...


def text_of(df: DataFrame) -> DataFrame:
    """Title and abstract (those that exist) as one text; null is empty."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "abstract") if c in df.columns]
    return df.withColumn("__text", F.concat_ws(" [SEP] ", *parts))


def features(size: int, length: int) -> Pipeline:
    """Words, of which the first ``length`` count (as an encoder cuts its input), hashed into ``size`` weighted features."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="__text", outputCol="__all", pattern=r"[^\p{L}\p{N}]+"),
        SQLTransformer(statement=f"SELECT *, slice(__all, 1, {length}) AS __words FROM __THIS__"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=size),
        IDF(inputCol="__tf", outputCol="__x"),
    ])


def weighted(df: DataFrame, smooth: float = 0.5) -> DataFrame:
    """Rows with a label, with the weight of its class."""
    rows = df.filter(F.col("label").isNotNull())
    return rows.join(F.broadcast(predictions.class_weights(rows, smooth=smooth).select("label", "weight")), "label")  # one row per class


@dataclass
class LinearClassifier:
    """weight_decay is the penalty; an epoch is a step of the optimiser, and the state after it is a checkpoint.

    With validation rows, training stops once F1 on them has not grown for early_stopping_patience checks; the best
    checkpoint is kept (ties: the earlier). log has a row per checkpoint: epoch and F1.
    """

    settings: Settings = field(default_factory=Settings)
    model: PipelineModel | None = None
    best_metric: float | None = None
    log: list[tuple[int, float]] = field(default_factory=list)

    def train(self, rows: DataFrame, validation: DataFrame | None = None) -> None:
        s = self.settings
        order = F.xxhash64(F.lit(s.seed), *rows.columns)
        base = text_of(weighted(rows, s.class_weight_smoothing)).repartition(rows.sparkSession.sparkContext.defaultParallelism, order)
        prepared = features(s.features, s.max_length).fit(base)
        # features are computed once for all checkpoints
        x = materialize(prepared.transform(base).select("label", "weight", "__x"), "features")
        v = materialize(prepared.transform(text_of(validation.filter("label is not null"))).select("label", "__x"), "features") if validation is not None else None
        self.log, self.best_metric, best, since = [], None, None, 0
        for epoch in range(1, s.num_train_epochs + 1) if v is not None else [s.num_train_epochs]:
            step = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="weight", maxIter=epoch, regParam=s.weight_decay, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y").fit(x)
            if v is None:
                best = step
                break
            f1 = predictions.metrics(step.transform(v).select("label", F.col("__y").cast("int").alias("predicted"))).first()["f1"]
            self.log.append((epoch, f1))
            if self.best_metric is None or f1 > self.best_metric:
                self.best_metric, best, since = f1, step, 0
            else:
                since += 1
                if since >= s.early_stopping_patience:
                    break
        self.model = PipelineModel(stages=[*prepared.stages, best])

    def test(self, rows: DataFrame, keep: tuple[str, ...] = ("bibkey", "label", "bucket")) -> tuple[DataFrame, DataFrame]:
        """(metrics, predictions) of labelled rows."""
        rows = rows.filter("label is not null")
        p = materialize(self.predict(rows, [c for c in keep if c in rows.columns]), "predictions")
        return predictions.metrics(p), p

    def predict(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the model must be trained or loaded first")
        return infer(self.model, rows, keep)

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError("the model must be trained first")
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> LinearClassifier:
        self.model = PipelineModel.load(path)
        return self

    def push(self, target: str) -> None:
        """Copy the model to any folder that Spark can write to, in place of a public hub."""
        self.save(target)


def renamed(names: list[str]) -> dict[str, str]:
    """Parameter names of old models by their present names."""
    return {n: n.replace(".gamma", ".weight").replace(".beta", ".bias") for n in names}


def sweep(train: DataFrame, validation: DataFrame, search: Sweep, settings: Settings) -> tuple[LinearClassifier, list[tuple[dict, float]]]:
    """The classifier with the best F1 on the validation rows among the runs of a search, and the log of all runs."""
    best, log = None, []
    for values in search.draws(settings.seed):
        one = LinearClassifier(settings.override(**values))
        one.train(train, validation)
        log.append((values, one.best_metric))
        if best is None or (one.best_metric > best.best_metric) == search.maximise and one.best_metric != best.best_metric:
            best = one
    return best, log


def infer(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns with predicted, confidence and prob_positive."""
    p = vector_to_array("__p")
    out = model.transform(text_of(df)).withColumn("p", p)
    best = F.array_max("p")
    return out.select(*keep, (F.array_position("p", best) - 1).cast("int").alias("predicted"), best.alias("confidence"), F.get("p", F.lit(1)).alias("prob_positive"))
