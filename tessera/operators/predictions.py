"""Classifier outputs: probabilities, predictions, metrics overall and per stratum, class weights, uncertain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7


def softmax(logits: list[Column]) -> Column:
    """Probabilities of each class as an array, stable for large logits."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    e = F.array(*(F.exp(x - top) for x in logits))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def predict(df: DataFrame, logits: list[str], keep: list[str]) -> DataFrame:
    """keep's columns (those that exist) with predicted (ties: the lowest class), confidence and prob_positive."""
    rows = df.select(*(c for c in keep if c in df.columns), softmax([F.col(c).cast("double") for c in logits]).alias("p"))
    best = F.array_max("p")
    return rows.select(*(c for c in rows.columns if c != "p"), (F.array_position("p", best) - 1).cast("int").alias("predicted"), best.alias("confidence"), F.get("p", F.lit(1)).alias("prob_positive"))


def uncertain(predictions: DataFrame, threshold: float = THRESHOLD, key: str = "bibkey") -> DataFrame:
    """Predictions under the threshold, least sure first."""
    return predictions.filter(F.col("confidence") < threshold).orderBy("confidence", key)


def metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of class 1, per stratum if any; a ratio without cases is 0."""
    y, p = F.col("label") == 1, F.col("predicted") == 1
    counts = predictions.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*(by or []), "n", "tp", "fp", "fn", "accuracy", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_weights(df: DataFrame, label: str = "label", smooth: float = 0.5) -> DataFrame:
    """(label, n, weight): inverse frequency, blended with 1 by smooth."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"), F.count("*").alias("classes"))  # a single row
    w = F.lit(smooth) * F.col("whole") / (F.col("classes") * F.col("n")) + F.lit(1 - smooth)
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", w.alias("weight"))


def weighted_cross_entropy(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """(loss): mean of -log p(label) weighted by class."""
    rows = predictions.join(F.broadcast(weights.select("label", "weight")), "label")  # one row per class
    p = F.when(F.col("label") == 1, F.col("prob_positive")).otherwise(1 - F.col("prob_positive"))
    return rows.agg(F.try_divide(F.sum(-F.col("weight") * F.log(p)), F.sum("weight")).alias("loss"))


def best_of(log: DataFrame, what: str, score: str) -> DataFrame:
    """The row of an evaluation log with the highest score (ties: the smallest name)."""
    return log.orderBy(F.desc(score), what).limit(1)
