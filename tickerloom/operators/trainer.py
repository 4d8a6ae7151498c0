"""Per-company training by mini-batch gradient descent, with log, scores and evaluation.

A two-class softmax layer over text vectors, trained for a few passes per (company, model).  Every group, whatever its
size, is cut into the same number of shards by a hash of its ids.  In every pass each shard starts from the group's
weights and takes its rows in an order of that pass; the shard results are averaged by rows.  One shard is plain
mini-batch descent.  Groups of up to ``WHOLE_VALUES`` feature values are shuffled once and take all passes in their task, many
groups together.  A shard of a larger one is read as a stream of Arrow batches in each pass, so no group has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickerloom.functions.numbers import argmax, dot
from tickerloom.operators.sizing import Compact, group_numbers, mark_of
from tickerloom.params import EPOCHS, TRAIN_BATCH
from tickerloom.session import pin

RATE = 0.5
SHARDS = 4       # of every group
LOG_STEPS = 10_000
WHOLE_VALUES = 4_000_000  # feature values of the largest group that takes all passes in one task
CHUNK_VALUES = 1_000_000  # feature values of groups trained together


class Training(NamedTuple):
    """``weights`` (keys, epoch, weights) after each pass; ``log`` (keys, epoch, shard, step, loss)."""

    weights: DataFrame
    log: DataFrame


def _step(x1: np.ndarray, y: np.ndarray, weights: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """Weights (2 x (width + 1)) after one mini-batch, and its loss before."""
    scores = x1 @ weights.T
    scores -= scores.max(axis=1, keepdims=True)
    chance = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    every = np.arange(len(y))
    loss = float(-np.log(np.maximum(chance[every, y], 1e-300)).mean())
    chance[every, y] -= 1.0
    return weights - rate * (chance.T @ x1) / len(y), loss


class _Shard:
    """One shard in one pass: first its weights, then its rows in order."""

    def __init__(self, weights: np.ndarray, batch: int, rate: float):
        self.weights, self.batch, self.rate = np.asarray(weights, float).reshape(2, -1), batch, rate
        self.x, self.y = np.empty((0, self.weights.shape[1])), np.empty(0, int)
        self.rows, self.steps, self.losses = 0, 0, []

    def take(self, x1: np.ndarray, labels: np.ndarray, last: bool = False) -> None:
        """Rows that end in a one."""
        if len(labels):
            self.x = np.vstack([self.x, x1])
            self.y = np.concatenate([self.y, labels.astype(int)])
            self.rows += len(labels)
        while len(self.y) >= self.batch or last and len(self.y):
            self.weights, loss = _step(self.x[:self.batch], self.y[:self.batch], self.weights, self.rate)
            self.x, self.y = self.x[self.batch:], self.y[self.batch:]
            self.losses.append(loss)

    def logged(self) -> list:
        first, losses, self.losses = self.steps, self.losses, []
        self.steps += len(losses)
        return [first, losses]


def _together(
    x1: np.ndarray, y: np.ndarray, counts: np.ndarray, weights: np.ndarray, batch: int, rate: float
) -> tuple[np.ndarray, list[np.ndarray]]:
    """One pass of many shards of one width, whose rows stand one after the other: every step is taken for all shards at once.

    Weights (shards x 2 x (width + 1)) after the pass, and the losses of the steps of each shard.
    """
    weights, starts, steps = weights.copy(), np.cumsum(counts) - counts, -(-counts // batch)
    losses = np.zeros((len(counts), int(steps.max(initial=0))))
    places = np.arange(min(batch, int(counts.max(initial=0))))
    for step in range(losses.shape[1]):
        going = np.flatnonzero(steps > step)
        there = step * batch + places < counts[going, None]
        rows = np.where(there, starts[going, None] + step * batch + places, 0)
        x, n = x1[rows], there.sum(axis=1)
        scores = x @ weights[going].transpose(0, 2, 1)
        scores -= scores.max(axis=2, keepdims=True)
        chance = np.exp(scores)
        chance /= chance.sum(axis=2, keepdims=True)
        truth = y[rows][:, :, None] == np.arange(2)
        log = np.log(np.maximum(np.where(truth, chance, 0.0).sum(axis=2), 1e-300))
        losses[going, step] = -np.where(there, log, 0.0).sum(axis=1) / n
        miss = np.where(there[:, :, None], chance - truth, 0.0)
        weights[going] -= rate * (miss.transpose(0, 2, 1) @ x) / n[:, None, None]
    return weights, [found[:n] for found, n in zip(losses, steps.tolist())]


class _Batch:
    """An Arrow batch of starting weights (``is_row`` 0) and the rows that follow them."""

    def __init__(self, table: pa.RecordBatch):
        features = table.column("features")
        self.flat = features.flatten().to_numpy(zero_copy_only=False)
        self.sizes = pc.list_value_length(features).to_numpy(zero_copy_only=False)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.labels = table.column("label").to_numpy(zero_copy_only=False)
        self.heads = np.flatnonzero(table.column("is_row").to_numpy(zero_copy_only=False) == 0)

    def weights(self, head: int) -> np.ndarray:
        return self.flat[self.at[head]:self.at[head] + self.sizes[head]]

    def rows(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The feature rows with a one at the end."""
        if (self.sizes[rows] != width).any():
            raise ValueError("features of one group differ in length")
        return np.hstack([self.flat[self.at[rows][:, None] + np.arange(width)], np.ones((len(rows), 1))])


def _all_passes(table: pa.Table, on: list[str], epochs: int, shards: int, batch: int, rate: float) -> Iterator[tuple]:
    """(rows of the shards' keys, epoch, row counts, weights, losses) of the whole groups of ``table``, each width by itself."""
    column = {name: table.column(name).chunk(0) for name in table.column_names}
    plain = {name: column[name].to_numpy(zero_copy_only=False) for name in ("shard", "mix", "label", *(f"turn{e}" for e in range(1, epochs + 1)))}
    flat, sizes = column["features"].flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column["features"]).to_numpy(zero_copy_only=False)
    first, group = group_numbers([column[name] for name in on])
    if (sizes != sizes[first][group]).any():
        raise ValueError("features of one group differ in length")
    at = np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        x1 = np.hstack([flat[at[rows][:, None] + np.arange(width)], np.ones((len(rows), 1))])
        y = plain["label"][rows].astype(int)
        unit = group[rows] * shards + plain["shard"][rows]
        units, head, counts = np.unique(unit, return_index=True, return_counts=True)
        owner = units // shards
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        members = np.diff(np.append(starts, len(units)))
        share = counts / np.repeat(np.add.reduceat(counts, starts), members)
        weights = np.zeros((len(units), 2, width + 1))
        for epoch in range(1, epochs + 1):
            order = np.lexsort((plain["mix"][rows], plain[f"turn{epoch}"][rows], unit))
            after, losses = _together(x1[order], y[order], counts, weights, batch, rate)
            yield rows[head], epoch, counts, after, losses
            weights = np.repeat(np.add.reduceat(after * share[:, None, None], starts), members, axis=0)


def train_groups(
    rows: DataFrame | Compact, keys: Sequence[str], ids: Sequence[str], epochs: int = EPOCHS, batch: int = TRAIN_BATCH,
    rate: float = RATE, shards: int = SHARDS, mix: Column | None = None, turn: Callable[[int], Column] | None = None,
) -> Training:
    """Train every group of ``rows`` (keys, ids, label 0/1, features), which are read once, and again for large groups.

    The vectors of compact rows are made after the shuffle.
    ``mix`` is a long that names a row: its remainder is the shard.  ``turn`` gives the order of a pass (a long, from the
    column ``mix``).  Both are hashes of the ids unless given.
    """
    on = list(keys)
    mix = F.xxhash64(*ids) if mix is None else mix
    turn = turn or (lambda epoch: F.xxhash64(F.lit(epoch), "mix"))

    def made_ready(wide: DataFrame) -> DataFrame:
        return wide.select(*on, F.pmod(mix, F.lit(shards)).cast("int").alias("shard"), mix.alias("mix"),
                           F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"))

    wide = rows.wide() if isinstance(rows, Compact) else rows
    ready = made_ready(wide)
    schema = T.StructType([
        *[wide.schema[name] for name in on], T.StructField("shard", T.IntegerType()), T.StructField("epoch", T.IntegerType()),
        T.StructField("n_rows", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("first_step", T.LongType()), T.StructField("losses", T.ArrayType(T.DoubleType())),
    ])
    out_type = to_arrow_schema(schema)

    def made(epoch: int, keys_: pa.RecordBatch | pa.Table, rows: list, weights: list, first: list, losses: list) -> pa.RecordBatch:
        n = len(rows)
        columns = [*[keys_.column(name) for name in [*on, "shard"]], [epoch] * n, rows, weights, first, losses]
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) if isinstance(column, list) else column.cast(field.type)
                                           for column, field in zip(columns, out_type)], schema=out_type)

    whole_values, chunk_values = WHOLE_VALUES, CHUNK_VALUES

    def whole_groups(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All passes of the groups; one row of epoch 0 for each group that is too large."""

        def left(table: pa.Table, rows: np.ndarray) -> pa.RecordBatch:
            keys_ = table.select([*on, "shard"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
            return made(0, keys_, [0] * len(rows), [None] * len(rows), [0] * len(rows), [None] * len(rows))

        def trained(table: pa.Table) -> Iterator[pa.RecordBatch]:
            head, group = group_numbers([table.column(name).chunk(0) for name in on])
            lengths = pc.list_value_length(table.column("features")).to_numpy()
            values = np.bincount(group, lengths, len(head))
            if (values > whole_values).any():
                yield left(table, head[values > whole_values])
                table = table.filter(pa.array((values <= whole_values)[group])).combine_chunks()
            if not table.num_rows:
                return
            for chosen, epoch, counts, after, losses in _all_passes(table, on, epochs, shards, batch, rate):
                keys_ = table.select([*on, "shard"]).take(pa.array(chosen)).combine_chunks().to_batches()[0]
                yield made(epoch, keys_, counts.tolist(), list(after.reshape(len(chosen), -1)), [0] * len(chosen), losses)

        def size(parts: list[pa.RecordBatch]) -> int:
            return sum(pc.sum(pc.list_value_length(part.column("features"))).as_py() or 0 for part in parts)

        held, values, skipped = [], 0, None
        for table in tables:
            if skipped is not None:  # the rest of what is too large
                table = table.filter(pc.not_equal(table.column("mark"), skipped))
            if not table.num_rows:
                continue
            held.append(table)
            values += size([table])
            if values < chunk_values:
                continue
            joined = pa.Table.from_batches(held).combine_chunks()
            marks = joined.column("mark").to_numpy()
            cut = int(np.searchsorted(marks, marks[-1]))  # the groups of the last mark may go on
            if cut:
                yield from trained(joined.slice(0, cut))
            held = joined.slice(cut).to_batches()
            values = size(held)
            if values > whole_values:
                found = joined.slice(cut)
                yield left(found, group_numbers([found.column(name).chunk(0) for name in on])[0])
                held, values, skipped = [], 0, int(marks[-1])
        if held:
            yield from trained(pa.Table.from_batches(held).combine_chunks())

    def one_pass(epoch: int):
        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, shard = None, None  # the shard that the batch before left open

            def closed() -> pa.RecordBatch:
                shard.take(shard.x[:0], np.empty(0, int), last=True)
                first, losses = shard.logged()
                return made(epoch, key, [shard.rows], [shard.weights.ravel()], [first], [losses])

            for table in tables:
                if not table.num_rows:
                    continue
                found = _Batch(table)
                ends = np.append(found.heads, table.num_rows)
                if ends[0]:
                    shard.take(found.rows(np.arange(ends[0]), shard.weights.shape[1] - 1), found.labels[:ends[0]])
                if len(found.heads):
                    if shard is not None:
                        yield closed()
                    whole = found.heads[:-1]
                    widths = found.sizes[whole] // 2 - 1
                    for width in np.unique(widths).tolist():
                        chosen = np.flatnonzero(widths == width)
                        counts = ends[chosen + 1] - ends[chosen] - 1
                        rows = np.concatenate([np.arange(ends[i] + 1, ends[i + 1]) for i in chosen.tolist()])
                        start = np.stack([found.weights(head) for head in whole[chosen]]).reshape(len(chosen), 2, width + 1)
                        after, losses = _together(found.rows(rows, width), found.labels[rows].astype(int), counts, start, batch, rate)
                        yield made(epoch, table.take(pa.array(whole[chosen])), counts.tolist(), list(after.reshape(len(chosen), -1)), [0] * len(chosen), losses)
                    last = int(found.heads[-1])
                    key, shard = table.slice(last, 1), _Shard(found.weights(last), batch, rate)
                    rows = np.arange(last + 1, table.num_rows)
                    shard.take(found.rows(rows, shard.weights.shape[1] - 1), found.labels[rows])
                if len(shard.losses) >= LOG_STEPS:
                    first, losses = shard.logged()
                    yield made(epoch, key, [0], [None], [first], [losses])
            if shard is not None:
                yield closed()

        return run

    turns = [turn(epoch).alias(f"turn{epoch}") for epoch in range(1, epochs + 1)]
    if isinstance(rows, Compact):
        feed = made_ready(rows.together()).withColumn("mark", mark_of(rows.by))
    else:
        feed = ready.withColumn("mark", mark_of(on)).repartition(*on).sortWithinPartitions("mark")
    feed = feed.select(*on, "mark", "shard", "mix", *turns, "label", "features")
    log = pin(feed.mapInArrow(whole_groups, schema), "passes")
    large = pin(log.where("epoch = 0").select(*[F.col(name).alias(f"_{name}") for name in on]).distinct(), "large")
    log = log.where("epoch > 0")

    def means(done: DataFrame) -> DataFrame:
        average = vector_to_array(Summarizer.mean(array_to_vector(F.col("weights")), F.col("n_rows").cast("double")))
        return done.where("weights is not null").groupBy(*on, "epoch").agg(average.alias("weights"))

    weights = means(log)
    if not large.isEmpty():
        ready = pin(ready.join(large, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in on], "left_semi"), "large-rows")
        zeros = F.array_repeat(F.lit(0.0), 2 * (F.max(F.size("features")) + 1))
        current = ready.groupBy(*on, "shard").agg(zeros.alias("weights"))
        for epoch in range(1, epochs + 1):
            first = current.select(*on, "shard", F.lit(0).alias("is_row"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("mix"),
                                   F.lit(0).alias("label"), F.col("weights").alias("features"))
            ordered = ready.select(*on, "shard", F.lit(1).alias("is_row"), turn(epoch).alias("turn"), "mix", "label", "features")
            feed = first.unionByName(ordered).repartition(*on, "shard").sortWithinPartitions(*on, "shard", "is_row", "turn", "mix")
            done = pin(feed.mapInArrow(one_pass(epoch), schema), "passes")
            mean = means(done)
            weights, log = weights.unionByName(mean), log.unionByName(done)
            current = done.where("weights is not null").select(*on, "shard").join(mean.drop("epoch"), on)
    steps = log.select(*on, "epoch", "shard", "first_step", F.posexplode("losses").alias("step", "loss"))
    steps = steps.withColumn("step", (F.col("first_step") + F.col("step") + 1).cast("int")).drop("first_step")
    return Training(weights, steps)


def scored(test: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows with ``logits`` (array of two) and the predicted class, for each pass in ``weights``.

    Spark's estimate of the test rows does not know how long their vectors are, and would let it send them all through
    the driver: the hint leaves both sides on the executors, and the vectors unsorted.
    """
    width = F.size("features")

    def score(first: Column) -> Column:
        return dot(F.col("features"), F.slice("weights", first, width)) + F.get("weights", first + width - 1)

    logits = F.array(score(F.lit(1)), score(width + 2))
    return (
        test.join(weights.hint("shuffle_hash"), list(keys)).withColumn("logits", logits)
        .withColumn("predicted_direction", argmax(F.col("logits")))
        .drop("weights")
    )


def predict_groups(test: DataFrame, training: Training, keys: Sequence[str]) -> DataFrame:
    """Scores and classes of the test rows from the last pass; groups without training rows are left out."""
    last = training.weights.groupBy(*keys).agg(F.max_by("weights", "epoch").alias("weights"))
    return scored(test, last, keys).withColumn("true_direction", F.col("label").cast("int")).drop("features", "label")


def training_log(training: Training, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, epoch, shard, step, value): the loss of each step and the test accuracy after each pass."""
    hits = scored(test, training.weights, keys)
    accuracy = hits.groupBy(*keys, "epoch").agg(
        F.avg((F.col("predicted_direction") == F.col("label")).cast("double")).alias("value")
    )
    losses = training.log.select(*keys, F.lit("loss").alias("kind"), "epoch", "shard", "step", F.col("loss").alias("value"))
    return losses.unionByName(accuracy.withColumn("kind", F.lit("eval_accuracy")), allowMissingColumns=True)
