"""The pooled pipeline: sparse vectors, published weights, and a class that follows from them."""

import math

import numpy as np
from pyspark.sql import functions as F

from tickerloom.operators import pooled


def rows(spark):
    good, bad = "profit growth record strong", "loss decline weak lawsuit"
    texts = [(i, (good if i % 2 else bad) + f" week{i % 7} report", i % 2) for i in range(80)] + [(100, None, 1), (101, "", 0)]
    return spark.createDataFrame(texts, "id long, text string, label int").repartition(3)


def test_pooled_model_learns_and_scores_as_published(spark):
    frame = rows(spark)
    model = pooled.fit_pooled(frame, "text", "label", buckets=1 << 10)
    found = pooled.predict_pooled(model, frame, "text")
    assert found.columns == ["id", "text", "label", "chance", "predicted_direction"]
    assert found.where("id < 100 and predicted_direction <> label").count() == 0
    weights = pooled.bucket_weights(model)
    entries = pooled.cells(model, frame, "text", ["id"])
    margins = {r.id: r.margin for r in pooled.margins(entries, weights, ["id"], float(model.stages[3].intercept)).collect()}
    chances = {r.id: r.chance for r in found.collect()}
    assert set(chances) - set(margins) == {100, 101}  # texts without a term have no entries
    for key, margin in margins.items():
        assert math.isclose(1 / (1 + math.exp(-margin)), chances[key], abs_tol=1e-9)


def test_weights_of_buckets(spark):
    frame = rows(spark)
    model = pooled.fit_pooled(frame, "text", "label", buckets=1 << 14)
    by = {(r.documents, round(r.idf, 9)) for r in pooled.bucket_weights(model).collect()}
    assert {n for n, _ in by} == {80, 40, 12, 11}  # report, four words a class, week0 to week6
    assert all(math.isclose(idf, math.log(83 / (n + 1)), abs_tol=1e-8) for n, idf in by)
    entries = pooled.cells(model, frame, "text", ["id"])
    assert entries.groupBy("id").agg(F.sum("n").alias("n")).where("n <> 6").count() == 0


def test_models_do_not_depend_on_the_partitioning(spark):
    frame = rows(spark)
    one, two = (pooled.fit_pooled(frame.repartition(n), "text", "label", buckets=256).stages[3] for n in (1, 8))
    np.testing.assert_allclose(one.coefficients.toArray(), two.coefficients.toArray(), atol=1e-6)
