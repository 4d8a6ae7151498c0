"""Fits, folds and training: both ways of fitting agree, and the rules of the folds hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tickerloom.operators import cooccurrence, logistic, sizing, tokens, trainer, vectors
from tickerloom.plans.queries import hashing_encoder
from tickerloom.operators.vectors import hashed_dense


def make_rows(spark, groups, units, per_unit, width=3, seed=0):
    rng = np.random.default_rng(seed)
    records = []
    for g in groups:
        for u in range(units):
            for i in range(per_unit):
                x = rng.normal(size=width)
                y = int(x[0] + 0.5 * rng.normal() + 0.1 * g > 0)
                records.append((g, "m", u, i, y, x.tolist()))
    return spark.createDataFrame(records, "permco long, model string, unit long, id long, label int, features array<double>")


def collected(frame):
    return sorted(tuple(row) for row in frame.collect())


def test_fit_has_no_gradient_left_and_equals_spark_ml(spark):
    rows = make_rows(spark, [1], 1, 300)
    beta = np.array(logistic.fit_groups(rows, ["permco"]).first().beta)
    pdf = rows.toPandas()
    x1 = np.hstack([np.stack(pdf["features"].to_numpy()), np.ones((300, 1))])
    _, grad, _ = logistic.data_terms(x1, pdf["label"].to_numpy(float), beta)
    assert np.abs(grad + np.append(beta[:-1], 0.0)).max() < 1e-6
    ml = LogisticRegression(regParam=1 / 300, standardization=False, tol=1e-12, maxIter=500)
    model = ml.fit(rows.select("label", array_to_vector("features").alias("features")))
    np.testing.assert_allclose(beta, [*model.coefficients, model.intercept], atol=1e-4)


def test_spread_fit_equals_fit_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK_VALUES", 60)  # blocks of 20 rows
    rows = make_rows(spark, [1, 2, 3], 1, 200)
    together = {r.permco: r.beta for r in logistic.fit_groups(rows, ["permco"]).collect()}
    spread = {r.permco: r.beta for r in logistic.fit_groups(rows, ["permco"], max_group_values=300).collect()}
    assert set(together) == set(spread) == {1, 2, 3}
    for key in together:
        np.testing.assert_allclose(together[key], spread[key], atol=1e-7)


@pytest.mark.parametrize("units, folds", [(11, 0), (12, 1), (13, 2)])
def test_number_of_folds(spark, units, folds):
    rows = make_rows(spark, [1], units, 4)
    table = logistic.walk_forward_folds(rows, ["permco"]).collect()
    assert len(table) == folds
    assert all(max(r.train_units) < r.test_unit and len(r.train_units) == 10 for r in table)
    for limit in (10**6, 1):  # in one task, and spread
        predicted = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], max_group_values=limit)
        assert predicted.count() == folds * 4


def test_walk_forward_equals_a_plain_loop(spark):
    rows = make_rows(spark, [1, 2], 7, 12, seed=3)
    found = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], window=3).toPandas()
    pdf, expected = rows.toPandas(), []
    for g, part in pdf.groupby("permco"):
        for u in range(3, 6):
            train, test = part[(part.unit >= u - 3) & (part.unit < u)], part[part.unit == u]
            one = lambda f: np.hstack([np.stack(f["features"].to_numpy()), np.ones((len(f), 1))])
            beta = logistic.fit_in_memory(one(train), train["label"].to_numpy(float)).beta
            for i, p in zip(test["id"], one(test) @ beta > 0):
                expected.append((g, u, i, int(p)))
    assert sorted(zip(found.permco, found.unit, found.id, found.predicted_direction)) == sorted(expected)


def test_spread_walk_forward_equals_grouped(spark):
    rows = make_rows(spark, [1, 2], 6, 30, seed=5).union(make_rows(spark, [3], 6, 5, seed=6))
    # one-class training window for group 3
    rows = rows.withColumn("label", F.when((F.col("permco") == 3) & (F.col("unit") < 4), 1).otherwise(F.col("label")))
    names = ["permco", "model", "id", "unit", "true_direction", "predicted_direction", "one_class"]
    grouped = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], 2)
    mixed = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], 2, max_group_values=300)  # 1 and 2 are large
    spread = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], 2, max_group_values=1)
    assert collected(grouped.select(names)) == collected(mixed.select(names)) == collected(spread.select(names))
    flagged = {r.unit for r in grouped.where("one_class").collect()}
    assert flagged == {2, 3, 4}


def test_models_may_differ_in_width(spark):
    rows = make_rows(spark, [1], 5, 40).unionByName(make_rows(spark, [1], 5, 40, width=6).withColumn("model", F.lit("wide")))
    grouped = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], 2)
    spread = logistic.walk_forward_predict(rows, ["permco", "model"], ["id"], 2, max_group_values=1)
    assert collected(grouped) == collected(spread.select(grouped.columns))
    widths = {r.model: len(r.beta) for r in logistic.fit_groups(rows, ["permco", "model"], max_group_values=1).collect()}
    assert widths == {"m": 4, "wide": 7}
    result = trainer.train_groups(rows, ["permco", "model"], ["unit", "id"])
    predicted = trainer.predict_groups(rows, result, ["permco", "model"])
    right = (F.col("true_direction") == F.col("predicted_direction")).cast("double")
    assert all(r.a > 0.8 for r in predicted.groupBy("model").agg(F.avg(right).alias("a")).collect())
    alone = trainer.train_groups(rows.where("model = 'm'"), ["permco", "model"], ["unit", "id"])
    assert collected(alone.weights) == collected(result.weights.where("model = 'm'"))


def test_training_learns_and_logs(spark):
    rows = make_rows(spark, [1, 2], 1, 120)
    result = trainer.train_groups(rows, ["permco", "model"], ["unit", "id"], epochs=3, batch=8, shards=1)
    predicted = trainer.predict_groups(rows, result, ["permco", "model"])
    accuracy = predicted.agg(F.avg((F.col("true_direction") == F.col("predicted_direction")).cast("double"))).first()[0]
    assert accuracy > 0.8 and len(predicted.first().logits) == 2
    log = trainer.training_log(result, rows, ["permco", "model"]).toPandas()
    assert (log[log.kind == "loss"].groupby(["permco", "epoch"]).size() == 15).all()
    assert len(log[log.kind == "eval_accuracy"]) == 6
    again = trainer.train_groups(rows.repartition(3), ["permco", "model"], ["unit", "id"], epochs=3, batch=8, shards=1)
    assert collected(result.weights) == collected(again.weights)


def plain_training(rows, shards, epochs, batch, rate):
    """Weights after all passes of one group of (shard, {epoch: turn}, features, label)."""
    weights = np.zeros((2, len(rows[0][2]) + 1))
    for epoch in range(1, epochs + 1):
        total, n = 0.0, 0
        for shard in range(shards):
            own = sorted((row for row in rows if row[0] == shard), key=lambda row: row[1][epoch])
            w = weights.copy()
            for start in range(0, len(own), batch):
                part = own[start:start + batch]
                x = np.array([[*row[2], 1.0] for row in part])
                scores = x @ w.T
                chance = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
                chance[np.arange(len(part)), [row[3] for row in part]] -= 1
                w -= rate * chance.T @ x / len(part)
            total, n = total + len(own) * w, n + len(own)
        weights = total / n
    return weights


@pytest.mark.parametrize("shards", [1, 4])
def test_training_follows_one_rule_at_every_size(spark, shards):
    """Weights of a large and a small group equal a plain descent, also when batches of Arrow cut the shards."""
    rows = make_rows(spark, [1], 1, 400).union(make_rows(spark, [2], 1, 50, seed=2)).cache()
    mix = F.xxhash64("unit", "id")
    turns = F.array(*[F.xxhash64(F.lit(e), mix) for e in (1, 2, 3)])
    table = rows.select("permco", F.pmod(mix, F.lit(shards)).alias("s"), turns.alias("t"), "features", "label").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        result = trainer.train_groups(rows, ["permco", "model"], ["unit", "id"], epochs=3, batch=8, shards=shards)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.permco: r.weights for r in result.weights.where("epoch = 3").collect()}
    assert result.log.where("permco = 1").select("shard").distinct().count() == shards
    for group in (1, 2):
        own = [(r.s, dict(enumerate(r.t, 1)), r.features, r.label) for r in table if r.permco == group]
        np.testing.assert_allclose(got[group], plain_training(own, shards, 3, 8, trainer.RATE).ravel(), atol=1e-12)
    assert trainer.predict_groups(rows, result, ["permco", "model"]).count() == 450


def compact_rows(spark, rows):
    """The rows of ``make_rows`` for two models of different width, as compact rows and as wide ones."""
    def widen(df):
        models = F.array(F.struct(F.lit("m").alias("model"), F.col("x").alias("features")),
                         F.struct(F.lit("narrow").alias("model"), F.slice("x", 1, 2).alias("features")))
        return df.withColumn("v", F.explode(models)).select("permco", "v.model", "unit", "id", "label", "v.features")

    narrow = rows.drop("model").withColumnRenamed("features", "x").localCheckpoint()
    return sizing.Compact(narrow, ["permco"], widen, 3), widen(narrow)


@pytest.mark.parametrize("limit", [10**9, 300])
def test_compact_rows_give_the_predictions_of_wide_ones(spark, monkeypatch, limit):
    compact, wide = compact_rows(spark, make_rows(spark, [1, 2, 3], 14, 12).where("permco < 3 or unit < 12"))
    plain = logistic.walk_forward_predict(wide, ["permco", "model"], ["id"], max_group_values=limit)
    for chunk in (1, 10**9):
        monkeypatch.setattr(logistic, "CHUNK_VALUES", chunk)
        found = logistic.walk_forward_predict(compact, ["permco", "model"], ["id"], max_group_values=limit)
        assert found.dtypes == plain.dtypes and collected(found) == collected(plain) and found.count() > 100


@pytest.mark.parametrize("limit", [10**9, 300])
def test_compact_rows_are_trained_and_scored_like_wide_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(trainer, "WHOLE_VALUES", limit)
    compact, wide = compact_rows(spark, make_rows(spark, [1, 2, 3], 2, 40).where("permco < 3 or unit < 1"))
    results = []
    for rows in (compact, wide):
        made = trainer.train_groups(rows, ["permco", "model"], ["unit", "id"], epochs=2, batch=8)
        log = trainer.training_log(made, wide, ["permco", "model"])
        scores = trainer.predict_groups(wide, made, ["permco", "model"])
        results.append([frame.toPandas().pipe(lambda t: t.sort_values([c for c in t.columns if c not in ("logits", "value")])) for frame in (log, scores)])
        assert "BroadcastExchange" not in log._jdf.queryExecution().executedPlan().toString()
    for one, two in zip(*results):
        two = two[one.columns]
        assert len(one) == len(two) > 100
        for name in one:
            if name == "logits":
                np.testing.assert_allclose(np.stack(one[name]), np.stack(two[name]), atol=1e-12)
            elif name == "value":
                np.testing.assert_allclose(one[name].to_numpy(), two[name].to_numpy(), atol=1e-12)
            else:
                assert one[name].fillna(-1).tolist() == two[name].fillna(-1).tolist()


def test_vectors_are_not_shuffled(spark):
    compact, _ = compact_rows(spark, make_rows(spark, [1, 2], 14, 12))
    found = logistic.walk_forward_predict(compact, ["permco", "model"], ["id"])
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanged = [part for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert exchanged and not any("features" in part for part in exchanged)


def test_no_side_of_the_scores_passes_through_the_driver(spark):
    rows = make_rows(spark, [1, 2], 1, 60)
    result = trainer.train_groups(rows, ["permco", "model"], ["unit", "id"], epochs=2, batch=8)
    for found in (trainer.training_log(result, rows, ["permco", "model"]), trainer.predict_groups(rows, result, ["permco", "model"])):
        assert found.count() and "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_folds_fitted_together_are_fitted_as_alone():
    rng = np.random.default_rng(8)
    x1 = np.hstack([rng.normal(size=(300, 6)), np.ones((300, 1))])
    y = (x1[:, 0] + rng.normal(size=300) > 0).astype(float)
    y[100:130], x1[250, 2] = 1.0, np.nan
    spans = [(0, 60), (20, 120), (100, 130), (150, 158), (200, 260), (130, 250), (0, 250)]
    for (start, stop), found in zip(spans, logistic.fit_spans(x1, y, spans)):
        alone = logistic.fit_in_memory(x1[start:stop], y[start:stop])
        assert found.status == alone.status
        if alone.beta is not None:
            np.testing.assert_allclose(found.beta, alone.beta, rtol=1e-6, atol=1e-8)


def test_shards_trained_together_are_trained_as_alone():
    rng = np.random.default_rng(4)
    counts = np.array([1, 8, 21, 3, 16, 40])
    x1 = np.hstack([rng.normal(size=(counts.sum(), 5)), np.ones((counts.sum(), 1))])
    y, start = rng.integers(0, 2, counts.sum()), rng.normal(size=(len(counts), 2, 6))
    weights, losses = trainer._together(x1, y, counts, start, 8, 0.5)
    for i, end in enumerate(np.cumsum(counts).tolist()):
        alone = trainer._Shard(start[i], 8, 0.5)
        alone.take(x1[end - counts[i]:end], y[end - counts[i]:end], last=True)
        np.testing.assert_allclose(weights[i], alone.weights, rtol=1e-12)
        np.testing.assert_allclose(losses[i], alone.losses, rtol=1e-12)


def test_small_groups_take_all_passes_at_once(spark, monkeypatch):
    """One shuffle for all passes of small groups, with the weights and losses of those that are streamed pass by pass."""
    rows = make_rows(spark, [1, 2, 3], 1, 90).union(make_rows(spark, [4], 1, 300, seed=2))
    rows = rows.unionByName(make_rows(spark, [1], 1, 60, width=6).withColumn("model", F.lit("wide"))).cache()
    found, made = [], []
    own = trainer.pin
    monkeypatch.setattr(trainer, "pin", lambda df, label: made.append(label) or own(df, label))
    for values in (10_000, 0, 600):
        monkeypatch.setattr(trainer, "WHOLE_VALUES", values)
        monkeypatch.setattr(trainer, "CHUNK_VALUES", 200)
        made.clear()
        training = trainer.train_groups(rows, ["permco", "model"], ["unit", "id"], epochs=3)
        assert made.count("passes") == (1 if values == 10_000 else 4)
        found.append([{tuple(row[:3]): row.weights for row in training.weights.collect()},
                      {tuple(row[:5]): row.loss for row in training.log.select("permco", "model", "epoch", "shard", "step", "loss").collect()}])
    for other in found[1:]:
        for one, two in zip(found[0], other):
            assert one.keys() == two.keys() and len(one) > 0
            for key in one:
                np.testing.assert_allclose(one[key], two[key], rtol=1e-9, atol=1e-12)


def test_variants_are_the_hashed_vectors(spark):
    from tickerloom.functions.text import bigrams, hashed_vector, tokens
    frame = spark.createDataFrame([(1, "Profit rises, profit falls"), (2, "merger"), (3, ""), (4, None), (5, "a"), (6, "éß öl été profit rises")], "doc long, body string")
    words = tokens(F.col("body"))
    got = vectors.add_variants(frame, "body").withColumns({
        "a": hashed_vector(words, 16), "b": hashed_vector(words, 32), "c": hashed_vector(F.concat(words, bigrams(words)), 32)}).collect()
    for row in got:
        assert [row.uni16_avg_embedding, row.uni32_avg_embedding, row.pair32_avg_embedding] == [row.a, row.b, row.c]


def test_passes_do_not_depend_on_arrow_batches(spark):
    rows = spark.range(400).select(
        (F.col("id") % 7).alias("permco"), "id", (F.xxhash64("id") % 2 != 0).cast("int").alias("label"),
        F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("features"))
    found, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for size in ("3", "10000"):
        spark.conf.set(name, size)
        training = trainer.train_groups(rows, ["permco"], ["id"])
        found.append([{tuple(row[:2]): row.weights for row in training.weights.collect()},
                      {tuple(row[:4]): row.loss for row in training.log.select("permco", "epoch", "shard", "step", "loss").collect()}])
    spark.conf.set(name, before)
    for small, large in zip(*found):
        assert small.keys() == large.keys()
        for key in small:
            np.testing.assert_allclose(small[key], large[key], rtol=1e-9)


def test_user_encoder_equals_hashed_vectors(spark):
    frame = spark.createDataFrame([(1, "Profit rises, profit falls"), (2, "merger talks"), (3, ""), (4, None)], "doc long, body string")
    ours = {r.doc: r.embedding for r in hashed_dense(frame, "body", "doc", 64).collect()}
    theirs = {r.doc: r.embedding for r in vectors.encode_with(frame, "body", hashing_encoder, 2).collect()}
    assert set(ours) == {1, 2} and theirs[3] == [0.0] * 64 and theirs[4] is None
    for doc in ours:
        np.testing.assert_allclose(ours[doc], theirs[doc])


def test_word_vectors_check_the_vocabulary(spark):
    frame = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(20)], "doc long, body string")
    found = vectors.word_vectors(frame, "body", width=4, min_count=1)
    assert found.columns == ["doc", "body", "embedding"] and len(found.first().embedding) == 4
    with pytest.raises(ValueError):
        vectors.word_vectors(frame, "body", min_count=1, max_vocabulary=3)


def test_quasi_newton_equals_newton_on_wide_vectors(spark, monkeypatch):
    rows = make_rows(spark, [1, 2], 1, 400, width=64, seed=9)
    newton = {r.permco: r.beta for r in logistic.fit_groups(rows, ["permco"]).collect()}
    monkeypatch.setattr(logistic, "NEWTON_WIDTH", 63)
    monkeypatch.setattr(logistic, "BLOCK_VALUES", 64 * 100)
    spread = {r.permco: (r.beta, r.status) for r in logistic.fit_groups(rows, ["permco"], max_group_values=1).collect()}
    assert set(spread) == {1, 2}
    for key, (beta, status) in spread.items():
        assert status == logistic.CONVERGED
        np.testing.assert_allclose(beta, newton[key], atol=1e-6)


def test_wide_terms_are_gradients_only(spark):
    """768 features: a problem and task sends rows, loss and gradient, far below a megabyte, and the steps go down."""
    rows = make_rows(spark, [1], 1, 120, width=768, seed=2)
    ready = rows.select("permco", F.lit(0).cast("long").alias("unit"), "label", "features", F.col("id").alias("mix"))
    problems = ready.select("permco").distinct().select("permco", F.lit(0).alias("fold"), F.array(F.lit(0).cast("long")).alias("train_units"), F.lit(768).alias("width"))
    blocks = logistic._to_blocks(ready, ["permco"])
    points = problems.withColumn("fold", F.col("fold").cast("long")).withColumn("beta", F.array_repeat(F.lit(0.0), 769))
    terms = logistic._sum_terms(blocks, points, ["permco"]).first().terms
    assert len(terms) == 2 + 769 and 8 * len(terms) < 1 << 20
    fit = logistic.fit_spread(ready, problems, ["permco"]).first()
    assert fit.status == logistic.CONVERGED
    pdf = rows.toPandas()
    x1 = np.hstack([np.stack(pdf["features"].to_numpy()), np.ones((len(pdf), 1))])
    _, grad, _ = logistic.loss_and_slope(x1, pdf["label"].to_numpy(float), np.array(fit.beta))
    assert np.abs(grad + np.append(fit.beta[:-1], 0.0)).max() < 1e-6


@pytest.mark.parametrize("limit", [10**6, 1])
def test_failed_fits_are_rows_and_stop_nothing(spark, monkeypatch, limit):
    rows = make_rows(spark, [1, 2, 3, 4, 5], 6, 20, seed=5)
    good = {r.permco: r.beta for r in logistic.fit_groups(rows.where("permco = 1"), ["permco"], limit).collect()}
    nan, inf = F.array(F.lit(float("nan")), F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(float("inf")), F.lit(1.0))
    first = (F.col("unit") == 0) & (F.col("id") == 0)
    bad = rows.withColumn(
        "features", F.when((F.col("permco") == 2) & first, nan).when((F.col("permco") == 4) & first, inf)
        .when((F.col("permco") == 5) & first, F.lit(None)).otherwise(F.col("features"))
    ).withColumn("label", F.when(F.col("permco") == 3, 1).otherwise(F.col("label")))
    found = {r.permco: (r.status, r.beta) for r in logistic.fit_groups(bad, ["permco"], limit).collect()}
    assert {k: status for k, (status, _) in found.items()} == {1: "converged", 2: "missing_values", 3: "one_class", 4: "missing_values", 5: "missing_values"}
    np.testing.assert_allclose(found[1][1], good[1], atol=1e-9)
    assert all(found[k][1] is None for k in (2, 3, 4, 5))
    clean = logistic.walk_forward_predict(rows.where("permco = 1"), ["permco", "model"], ["id"], 2, limit)
    walked = logistic.walk_forward_predict(bad, ["permco", "model"], ["id"], 2, limit)
    assert collected(walked.where("permco = 1").select(clean.columns)) == collected(clean)
    states = {(r.permco, r.unit): (r.status, r.some) for r in walked.groupBy("permco", "unit", "status").agg(F.count("predicted_direction").alias("some")).collect()}
    assert all(states[k, 2] == ("missing_values", 0) and states[k, 3] == ("converged", 20) for k in (2, 4, 5))
    assert states[3, 2] == ("one_class", 20)
    monkeypatch.setattr(logistic, "MAX_STEPS", 1)
    short = {r.status for r in logistic.fit_groups(rows, ["permco"], limit).collect()}
    assert short == {"not_converged"}


def test_vectors_from_cooccurrence_equal_the_eigenvectors(spark):
    rng = np.random.default_rng(4)
    topics = [["red", "green", "blue", "paint"], ["bond", "stock", "fund", "price"], ["rain", "snow", "wind", "storm"]]
    texts = [(i, " ".join(rng.choice(topics[i % 3], 12)) + (" the end" if i % 2 else "")) for i in range(90)] + [(100, None), (101, ""), (102, "lonely")]
    frame = spark.createDataFrame(texts, "k long, t string")
    words = cooccurrence.word_counts(frame, "t", 5).select("word")
    weights = cooccurrence.information(cooccurrence.pair_counts(frame, "t"), words)
    found = {n: {r.word: np.array(r.vector) for r in cooccurrence.word_vectors(frame.repartition(n), "t", 3, 5, steps=25).collect()} for n in (1, 8)}
    names = sorted(found[1])
    assert names == sorted([*sum(topics, []), "the", "end"])
    for name in names:
        np.testing.assert_allclose(found[1][name], found[8][name], atol=1e-6)
    matrix = np.zeros((len(names), len(names)))
    for row in weights.collect():
        matrix[names.index(row.a), names.index(row.b)] = row.weight
    np.testing.assert_allclose(matrix, matrix.T)
    values = np.linalg.eigvalsh(matrix)
    wanted = sorted(values, key=lambda x: -abs(x))[:3]
    table = np.stack([found[1][name] for name in names])
    np.testing.assert_allclose(sorted((table**2).sum(axis=0)), sorted(np.abs(wanted)), rtol=1e-4)
    unit = table / np.linalg.norm(table, axis=0)
    np.testing.assert_allclose(np.abs(np.sum(unit * (matrix @ unit), axis=0)), np.abs(wanted), rtol=1e-4)
    near = lambda a, b: found[1][a] @ found[1][b] / np.linalg.norm(found[1][a]) / np.linalg.norm(found[1][b])
    assert near("red", "blue") > 0.9 > near("red", "bond") + 0.4
    vectors_ = spark.createDataFrame([(name, found[1][name].tolist()) for name in names], "word string, vector array<double>")
    means = {r.k: r.embedding for r in cooccurrence.mean_vectors(frame, "t", "k", vectors_).collect()}
    assert set(means) == set(range(90))
    plain = np.mean([found[1][w] for w in texts[1][1].split()], axis=0)
    np.testing.assert_allclose(means[1], plain, atol=1e-9)


def test_sums_of_vectors_are_plain(spark):
    texts = spark.createDataFrame([(1, "one two one"), (2, None), (3, "three"), (4, "two three")], "k long, t string")
    vectors_ = spark.createDataFrame([("one", [1.0, 2.0]), ("two", [3.0, 4.0])], "word string, v array<double>")
    weights = spark.createDataFrame([("one", "two", 0.5), ("two", "one", 0.5), ("two", "two", 2.0)], "a string, b string, weight double")
    step = cooccurrence._step(weights, vectors_, 2)
    assert {r.word: r.z for r in step.collect()} == {"one": [1.5, 2.0], "two": [6.5, 9.0]}
    means = cooccurrence.mean_vectors(texts, "t", "k", vectors_.withColumnRenamed("v", "vector"))
    assert {r.k: r.embedding for r in means.collect()} == {1: [5 / 3, 8 / 3], 4: [3.0, 4.0]}
    for df in (step, means):  # a sum of vector objects sorts its rows beyond 128 keys
        assert "ObjectHashAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_pooled_under_their_mask(spark):
    frame = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "xx"), (3, ""), (4, None), (5, "yy zz")], "k long, t string")
    rows = tokens.token_sequences(frame, "t", "k", max_tokens=2, batch=3)

    def make():
        def encode(batch, mask):
            assert mask.shape == (len(batch), len(batch[0])) and all(len(row) == len(batch[0]) for row in batch)
            assert [[int(bool(word)) for word in row] for row in batch] == mask.tolist()
            return np.array([[(ord(word[0]) if word else -1e9, 1.0) for word in row] for row in batch], float).reshape(*mask.shape, 2)
        return encode

    found = {r.k: (r.n_tokens, r.embedding) for r in vectors.encode_sequences(rows, "k", make).collect()}
    assert found[1] == (5, [99.0, 1.0]) and found[2] == (1, [120.0, 1.0]) and found[5] == (2, [121.5, 1.0])
    assert found[3] == found[4] == (0, None)
