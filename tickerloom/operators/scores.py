"""Classification metrics and model rankings, all on long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numbers import ratio_or_zero

METRICS = ("accuracy", "precision", "recall", "f1")


def confusion_counts(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero-filled counts tn, fp, fn, tp per group."""
    actual, guess = F.col("true_direction"), F.col("predicted_direction")
    return predictions.groupBy(*keys).agg(
        F.count_if((actual == 0) & (guess == 0)).alias("tn"),
        F.count_if((actual == 0) & (guess == 1)).alias("fp"),
        F.count_if((actual == 1) & (guess == 0)).alias("fn"),
        F.count_if((actual == 1) & (guess == 1)).alias("tp"),
    )


def with_matrix(counts: DataFrame) -> DataFrame:
    """The counts as a 2 x 2 array, rows actual, columns predicted."""
    return counts.withColumn(
        "confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    )


def binary_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 for class 1 per group; 0/0 counts as 0."""
    counts = confusion_counts(predictions, keys)
    tp, hits = F.col("tp"), F.col("tp") + F.col("tn")
    return counts.select(
        *keys, "tn", "fp", "fn", "tp",
        ratio_or_zero(hits, hits + F.col("fp") + F.col("fn")).alias("accuracy"),
        ratio_or_zero(tp, tp + F.col("fp")).alias("precision"),
        ratio_or_zero(tp, tp + F.col("fn")).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    )


def error_by_model(predictions: DataFrame) -> DataFrame:
    """MSE, RMSE and MAE of the 0/1 labels per model."""
    gap = (F.col("true_direction") - F.col("predicted_direction")).cast("double")
    mse = F.avg(gap * gap)
    return predictions.groupBy("model").agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def mean_metrics(metrics: DataFrame, keys: Sequence[str] = ("model", "year")) -> DataFrame:
    """Metric means over the other keys; every company weighs the same."""
    return metrics.groupBy(*keys).agg(*[F.avg(name).alias(name) for name in METRICS])


def metrics_long(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.unpivot(list(keys), list(METRICS), "metric", "value")


def metric_grid(metrics: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """A row for every key combination and every model of the list, metrics null where there are none.

    The model list is exploded per key: no cross join.
    """
    grid = metrics.select(*keys).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return grid.join(metrics.select(*keys, "model", *METRICS), [*keys, "model"], "left")


def best_model(metrics: DataFrame, key: str) -> DataFrame:
    """Model with the highest mean accuracy per ``key`` (year or company); ties to the first name."""
    means = metrics.groupBy(key, "model").agg(F.avg("accuracy").alias("accuracy"))
    best_first = Window.partitionBy(key).orderBy(F.desc("accuracy"), F.asc("model"))
    return (
        means.withColumn("_r", F.row_number().over(best_first)).where("_r = 1")
        .select(key, F.col("model").alias("best_model"), "accuracy")
    )


def best_model_overall(metrics: DataFrame, key: str) -> DataFrame:
    """The model with the highest mean of its means per ``key``: one row."""
    means = metrics.groupBy(key, "model").agg(F.avg("accuracy").alias("accuracy"))
    overall = means.groupBy("model").agg(F.avg("accuracy").alias("accuracy"))
    return overall.orderBy(F.desc("accuracy"), F.asc("model")).limit(1).withColumnRenamed("model", "best_model")


def best_model_share(best: DataFrame) -> DataFrame:
    """How often each model is best, and its share in percent (one decimal)."""
    wins = best.groupBy("best_model").agg(F.count("*").alias("wins"))
    total = wins.agg(F.sum("wins").alias("total")).scalar()
    return wins.withColumn("share_pct", F.round(F.col("wins") * 100.0 / total, 1))


def metrics_per_year(
    predictions: DataFrame, keys: Sequence[str] = ("permco", "model"), year: str = "year", true_per_year: bool = False
) -> DataFrame:
    """Metrics of the whole test set repeated for each test year, or the real ones of each year."""
    if true_per_year:
        return binary_metrics(predictions, [*keys, year])
    return predictions.select(*keys, year).distinct().join(binary_metrics(predictions, keys), list(keys))


def trainable_groups(train: DataFrame, test: DataFrame, keys: Sequence[str] = ("permco",)) -> DataFrame:
    """Keys with rows on both sides."""
    return train.select(*keys).distinct().join(test.select(*keys).distinct(), list(keys))
