"""Logistic regression per group, and walk-forward folds.

Loss: half the penalty times the squared weights plus the summed log loss; the intercept is not penalised.
A group that fits a task is fitted there by Newton's method.  A larger group stays spread over the
cluster: each step sums terms over blocks of rows, for all large groups and folds at once.  Up to
``NEWTON_WIDTH`` features a step sums gradient and curvature (width squared numbers); wider vectors take a limited-memory
quasi-Newton method, whose steps sum the gradient only and whose state (the last ``MEMORY`` changes of point and
gradient) is a row of a table.  All ways solve the same convex problem to the same tolerance.

Every fit has a status.  A fit that is not possible (one class, missing values) or does not end is a row like the
others and stops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.numbers import dot
from tickerloom.operators.sizing import MAX_GROUP_VALUES, Compact, group_numbers, mark_of, split_by_size, widest
from tickerloom.params import TRAIN_WINDOW
from tickerloom.session import pin

PENALTY = 1.0
TOLERANCE = 1e-9
MAX_STEPS = 100
MAX_QUASI_STEPS = 400
NEWTON_WIDTH = 64
MEMORY = 12
BLOCK_VALUES = 65_536
CHUNK_VALUES = 500_000  # feature values of compact groups that are held together
SPAN_VALUES = 500_000  # padded feature values of the folds of a group that are fitted together
_DOUBLES = T.ArrayType(T.DoubleType())

CONVERGED, ONE_CLASS, MISSING, NOT_CONVERGED = "converged", "one_class", "missing_values", "not_converged"


class Fit(NamedTuple):
    """``beta`` (weights, then the intercept) is None unless ``status`` is CONVERGED or NOT_CONVERGED."""

    beta: np.ndarray | None
    status: str


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _matrix(features: pa.ChunkedArray) -> np.ndarray:
    """Rows of features with a one at the end; missing vectors and entries are NaN."""
    rows = features.combine_chunks()
    flat = rows.flatten()
    width = len(flat) // len(rows) if len(rows) else 0
    if not rows.null_count and not flat.null_count and (np.diff(rows.offsets.to_numpy()) == width).all():
        return _with_one(flat.to_numpy().astype(float).reshape(len(rows), width))
    found = rows.to_pylist()
    width = max((len(row) for row in found if row is not None), default=0)
    nothing = [np.nan] * width
    return _with_one(np.array([nothing if row is None else row for row in found], float).reshape(len(found), width))


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column as doubles, NaN where it is missing."""
    return column.cast(pa.float64()).to_numpy()


def loss_and_slope(x1: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss of some rows, its gradient, and the chance of each row; the first two are additive over rows."""
    margin = x1 @ beta
    chance = 0.5 * (1.0 + np.tanh(0.5 * margin))
    return float(np.sum(np.logaddexp(0.0, margin) - y * margin)), x1.T @ (chance - y), chance


def data_terms(x1: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss of some rows with its gradient and curvature; additive over rows."""
    loss, slope, chance = loss_and_slope(x1, y, beta)
    return loss, slope, (x1.T * (chance * (1.0 - chance))) @ x1


def _solved(curvature: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Newton's step; the gradient itself where the curvature cannot be solved."""
    try:
        return np.linalg.solve(curvature, slope)
    except np.linalg.LinAlgError:
        return slope


class Descent:
    """Point to evaluate next, and the best point so far with its gradient and the step taken from it.

    ``memory`` holds the last changes of point and gradient, one after the other; Newton's method leaves it empty.
    """

    def __init__(self, beta, base=(), slope=(), step=(), memory=(), value=np.inf, scale=1.0, done=False):
        self.beta, self.base, self.slope, self.step = (np.asarray(a, float) for a in (beta, base, slope, step))
        self.memory = np.asarray(memory, float).reshape(-1, 2, len(self.beta))
        self.value, self.scale, self.done = value, scale, done

    def advance(self, loss: float, slope: np.ndarray, hess: np.ndarray | None, n_rows: int, penalty: float) -> None:
        """Take the data terms at ``beta``: accept it and step on, or halve the last step."""
        ridge = np.full(len(self.beta), penalty)
        ridge[-1] = 0.0
        value = loss + 0.5 * float(ridge @ self.beta**2)
        slope = slope + ridge * self.beta
        if not value <= self.value + 1e-12 * abs(self.value) and self.scale > 1e-9 and len(self.base):
            self.scale /= 2.0
            self.beta = self.base + self.scale * self.step
            return
        if hess is None and len(self.base):
            self._remember(self.beta - self.base, slope - self.slope)
        self.base, self.slope, self.value, self.scale = self.beta, slope, value, 1.0
        if np.max(np.abs(slope)) <= TOLERANCE * max(1, n_rows):
            self.done = True
            return
        if hess is None:
            self.step = -self._smoothed(slope)
        else:
            self.step = -_solved(hess + np.diag(ridge) + 1e-12 * np.eye(len(ridge)), slope)
        self.beta = self.base + self.step

    def _remember(self, moved: np.ndarray, changed: np.ndarray) -> None:
        if moved @ changed > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(changed):
            self.memory = np.concatenate([self.memory, [[moved, changed]]])[-MEMORY:]

    def _smoothed(self, slope: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature that the remembered changes imply (two loops)."""
        if not len(self.memory):
            return slope / max(1.0, float(np.linalg.norm(slope)))
        out, parts = slope.copy(), []
        for moved, changed in self.memory[::-1]:
            part = (moved @ out) / (moved @ changed)
            parts.append(part)
            out -= part * changed
        moved, changed = self.memory[-1]
        out *= (moved @ changed) / (changed @ changed)
        for (moved, changed), part in zip(self.memory, parts[::-1]):
            out += moved * (part - (changed @ out) / (moved @ changed))
        return out


def fit_in_memory(x1: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, penalty: float = PENALTY) -> Fit:
    """Fit of rows that end in a one.

    A start close to the solution, such as the fit of a training set that overlaps, saves steps.
    """
    if not (np.isfinite(x1).all() and np.isfinite(y).all()):
        return Fit(None, MISSING)
    if y.min() == y.max():
        return Fit(None, ONE_CLASS)
    state = Descent(np.zeros(x1.shape[1]) if start is None else start)
    for _ in range(MAX_STEPS):
        state.advance(*data_terms(x1, y, state.beta), len(y), penalty)
        if state.done:
            return Fit(state.beta, CONVERGED)
    return Fit(state.base, NOT_CONVERGED)


def fit_spans(x1: np.ndarray, y: np.ndarray, spans: Sequence[tuple[int, int]], penalty: float = PENALTY) -> list[Fit]:
    """The fits of several ranges of rows that end in a one: each step of Newton's method is taken for many ranges at once,
    up to ``SPAN_VALUES`` feature values of them."""
    whole = np.isfinite(x1).all(axis=1) & np.isfinite(y)
    found: list[Fit | None] = [None] * len(spans)
    for i, (start, stop) in enumerate(spans):
        if not whole[start:stop].all():
            found[i] = Fit(None, MISSING)
        elif y[start:stop].min() == y[start:stop].max():
            found[i] = Fit(None, ONE_CLASS)
    left = sorted((i for i in range(len(spans)) if found[i] is None), key=lambda i: spans[i][1] - spans[i][0])
    while left:
        longest = max(1, spans[left[-1]][1] - spans[left[-1]][0])
        chosen = [left.pop() for _ in range(min(len(left), max(1, SPAN_VALUES // (longest * x1.shape[1]))))]
        for i, fit in zip(chosen, _fit_together(x1, y, np.array([spans[i] for i in chosen]), penalty)):
            found[i] = fit
    return found


def _fit_together(x1: np.ndarray, y: np.ndarray, spans: np.ndarray, penalty: float) -> list[Fit]:
    """``Descent`` with Newton's step for several problems of similar length, padded with rows of weight zero."""
    n_rows = spans[:, 1] - spans[:, 0]
    places = np.arange(n_rows.max())
    there = places < n_rows[:, None]
    rows = np.where(there, spans[:, :1] + places, 0)
    x, truth = np.where(there[:, :, None], x1[rows], 0.0), y[rows]
    n, width = len(spans), x1.shape[1]
    ridge = np.full(width, penalty)
    ridge[-1] = 0.0
    beta, base, step = np.zeros((n, width)), np.zeros((n, width)), np.zeros((n, width))
    value, scale, done, begun = np.full(n, np.inf), np.ones(n), np.zeros(n, bool), np.zeros(n, bool)
    every = np.arange(n)  # problems that go on; x, truth and there hold their rows
    for _ in range(MAX_STEPS):
        point = beta[every]
        margin = (x @ point[:, :, None])[:, :, 0]
        chance = 0.5 * (1.0 + np.tanh(0.5 * margin))
        loss = np.where(there, np.logaddexp(0.0, margin) - truth * margin, 0.0).sum(axis=1) + 0.5 * (ridge * point**2).sum(axis=1)
        slope = (x.transpose(0, 2, 1) @ np.where(there, chance - truth, 0.0)[:, :, None])[:, :, 0] + ridge * point
        last = value[every]
        with np.errstate(invalid="ignore"):
            back = ~(loss <= last + 1e-12 * np.abs(last)) & (scale[every] > 1e-9) & begun[every]
        worse = every[back]
        scale[worse] /= 2.0
        beta[worse] = base[worse] + scale[worse, None] * step[worse]
        taken = every[~back]
        base[taken], value[taken], scale[taken], begun[taken] = point[~back], loss[~back], 1.0, True
        ended = ~back & (np.abs(slope).max(axis=1) <= TOLERANCE * np.maximum(1, n_rows[every]))
        done[every[ended]] = True
        on = ~back & ~ended
        moved = every[on]
        if len(moved):
            inner = x[on] * (chance * (1.0 - chance))[on][:, :, None]
            curvature = inner.transpose(0, 2, 1) @ x[on] + np.diag(ridge) + 1e-12 * np.eye(width)
            try:
                step[moved] = -np.linalg.solve(curvature, slope[on][:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                step[moved] = [-_solved(a, b) for a, b in zip(curvature, slope[on])]
            beta[moved] = base[moved] + step[moved]
        if ended.any():
            every, x, truth, there = (part[~ended] for part in (every, x, truth, there))
            if not len(every):
                break
    return [Fit(b, CONVERGED if d else NOT_CONVERGED) for b, d in zip(base, done.tolist())]


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


def _to_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pack rows (keys, unit, label, features, mix) into blocks of one key and unit, of bounded size.

    Range partitioning on (key, unit, row hash) spreads a key of any size evenly.
    """
    schema = T.StructType([
        *_fields(rows, [*keys, "unit"]), T.StructField("xs", _DOUBLES), T.StructField("ys", _DOUBLES)
    ])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby([*keys, "unit"], sort=False):
                per_block = max(1, BLOCK_VALUES // len(part["features"].iloc[0]))
                for i in range(0, len(part), per_block):
                    piece = part.iloc[i:i + per_block]
                    yield pd.DataFrame([
                        [*key, np.concatenate(piece["features"].to_numpy()), piece["label"].to_numpy(float)]
                    ], columns=schema.names)

    spread = rows.repartitionByRange(*keys, "unit", "mix").sortWithinPartitions(*keys, "unit")
    return spread.mapInPandas(pack, schema)


def _sum_terms(blocks: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Data terms of every active problem, summed over the blocks of its training units: rows, loss, gradient and, up to
    NEWTON_WIDTH features, curvature."""
    points = (
        active.select(*keys, F.explode("train_units").alias("unit"), F.struct("fold", "beta").alias("p"))
        .groupBy(*keys, "unit").agg(F.collect_list("p").alias("ps"))
        .select(*keys, "unit", F.col("ps.fold").alias("folds"), F.col("ps.beta").alias("betas"))
    )
    schema = T.StructType([
        *_fields(blocks, keys), T.StructField("fold", T.LongType()), T.StructField("terms", _DOUBLES)
    ])
    newton_width = NEWTON_WIDTH

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[tuple, np.ndarray] = {}
            for row in frame.to_dict("records"):
                y = np.asarray(row["ys"], float)
                x1 = _with_one(np.asarray(row["xs"], float).reshape(len(y), -1))
                for fold, beta in zip(row["folds"], row["betas"]):
                    beta = np.asarray(beta, float)
                    if len(beta) - 1 <= newton_width:
                        loss, slope, hess = data_terms(x1, y, beta)
                    else:
                        (loss, slope, _), hess = loss_and_slope(x1, y, beta), np.empty(0)
                    key = (*(row[k] for k in keys), int(fold))
                    sums[key] = sums.get(key, 0.0) + np.concatenate([[len(y), loss], slope, hess.ravel()])
            yield pd.DataFrame([[*key, terms] for key, terms in sums.items()], columns=schema.names)

    terms = blocks.join(points, [*keys, "unit"]).mapInPandas(partial, schema)
    return terms.groupBy(*keys, "fold").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("terms")))).alias("terms")
    )


def fit_spread(rows: DataFrame, problems: DataFrame, keys: list[str], penalty: float = PENALTY) -> DataFrame:
    """(keys, fold, beta, status) for problems (keys, fold, train_units, width) over rows that stay spread; the rows of a
    problem need both classes and no missing value.

    The state, one row per problem, is written after each step, so a lost executor costs one step.
    """
    blocks = pin(_to_blocks(rows, keys), "blocks")
    nothing = F.array().cast(_DOUBLES)
    state = problems.select(
        *keys, F.col("fold").cast("long").alias("fold"), "train_units", F.array_repeat(F.lit(0.0), F.col("width") + 1).alias("beta"),
        *[nothing.alias(name) for name in ("base", "slope", "step", "memory")], F.lit(float("inf")).alias("value"),
        F.lit(1.0).alias("scale"), F.lit(False).alias("done"), F.lit(0).alias("steps"),
    )
    schema, newton_width = state.schema, NEWTON_WIDTH
    arrays = ("beta", "base", "slope", "step", "memory")

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                terms = np.asarray(row.pop("terms"), float)
                point = Descent(*(np.asarray(row[k], float) for k in arrays), row["value"], row["scale"])
                size = len(point.beta)
                hess = terms[2 + size:].reshape(size, size) if size - 1 <= newton_width else None
                point.advance(terms[1], terms[2:2 + size], hess, terms[0], penalty)
                row.update({k: getattr(point, k).ravel() for k in arrays}, value=point.value, scale=point.scale, done=point.done,
                           steps=row["steps"] + 1)
                out.append(row)
            yield pd.DataFrame(out, columns=schema.names)

    limit = F.when(F.size("beta") - 1 <= newton_width, MAX_STEPS).otherwise(MAX_QUASI_STEPS)
    going = ~F.col("done") & (F.col("steps") < limit)
    state = pin(state, "descent")
    for _ in range(max(MAX_STEPS, MAX_QUASI_STEPS)):
        active = state.where(going)
        if active.isEmpty():
            break
        moved = active.join(_sum_terms(blocks, active, keys), [*keys, "fold"]).mapInPandas(update, schema)
        state = pin(state.where(~going).unionByName(moved), "descent")
    return state.select(*keys, "fold", F.when(F.col("done"), F.col("beta")).otherwise(F.col("base")).alias("beta"),
                        F.when(F.col("done"), CONVERGED).otherwise(NOT_CONVERGED).alias("status"))


def _incomplete() -> Column:
    """The row has no label or a missing or infinite feature."""
    gap = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNull() | F.isnan(F.col("label").cast("double")) | F.coalesce(gap, F.lit(True))


def _status(n: Column, n_up: Column, n_incomplete: Column) -> Column:
    """Why a training set cannot be fitted; null if it can."""
    return F.when(n_incomplete > 0, MISSING).when((n_up == 0) | (n_up == n), ONE_CLASS)


def fit_groups(rows: DataFrame, keys: Sequence[str], max_group_values: int = MAX_GROUP_VALUES) -> DataFrame:
    """(keys, beta, status): one fit per group over all its rows (label, features); beta is null where none is possible."""
    on = list(keys)
    parts = split_by_size(rows, on, max(1, max_group_values // widest(rows, "features")))
    schema = T.StructType([*_fields(rows, on), T.StructField("beta", _DOUBLES), T.StructField("status", T.StringType())])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        found = fit_in_memory(_matrix(table.column("features")), _numbers(table.column("label")))
        keys_ = {name: table.column(name).slice(0, 1) for name in on}
        return pa.table({**keys_, "beta": pa.array([found.beta], pa.list_(pa.float64())), "status": [found.status]})

    fitted = parts.small.select(*on, "label", "features").groupBy(*on).applyInArrow(fit, schema)
    if parts.large is None:
        return fitted
    zero = F.lit(0).cast("long")
    sizes = parts.large.groupBy(*on).agg(
        F.max(F.size("features")).alias("width"),
        _status(F.count("*"), F.sum(F.col("label").cast("long")), F.count_if(_incomplete())).alias("status"))
    sizes = pin(sizes, "sizes")
    spread = parts.large.join(sizes.where("status is null").select(*on), on, "left_semi").select(
        *on, zero.alias("unit"), "label", "features", F.monotonically_increasing_id().alias("mix"))
    problems = sizes.where("status is null").select(*on, zero.alias("fold"), F.array(zero).alias("train_units"), "width")
    failed = sizes.where("status is not null").select(*on, F.lit(None).cast(_DOUBLES).alias("beta"), "status")
    return fitted.unionByName(fit_spread(spread, problems, on).drop("fold")).unionByName(failed)


def walk_forward_folds(rows: DataFrame, keys: Sequence[str], window: int = TRAIN_WINDOW) -> DataFrame:
    """Folds per group: train on ``window`` consecutive distinct units, test on the next; the last unit is
    never tested.  (keys, test_unit, train_units, n_train, n_train_up, n_test), and n_incomplete, the training rows with a
    missing value, where ``rows`` has features.

    Windows run over the distinct units of a group, which the calendar bounds.
    """
    checked = "features" in rows.columns
    gaps = [F.count_if(_incomplete()).alias("n_gaps")] if checked else []
    units = rows.groupBy(*keys, "unit").agg(F.count("*").alias("n_test"), F.sum(F.col("label").cast("long")).alias("n_up"), *gaps)
    along = Window.partitionBy(*keys).orderBy("unit")
    train = along.rowsBetween(-window, -1)
    whole = Window.partitionBy(*keys)
    placed = units.select(
        *keys, F.col("unit").cast("long").alias("test_unit"), "n_test",
        F.collect_list(F.col("unit").cast("long")).over(train).alias("train_units"),
        F.sum("n_test").over(train).alias("n_train"),
        F.sum("n_up").over(train).alias("n_train_up"),
        *([F.sum("n_gaps").over(train).alias("n_incomplete")] if checked else []),
        F.row_number().over(along).alias("_place"),
        F.count("*").over(whole).alias("_units"),
    )
    return placed.where((F.col("_place") > window) & (F.col("_place") < F.col("_units"))).drop("_place", "_units")


def walk_forward_predict(
    rows: DataFrame | Compact, keys: Sequence[str], ids: Sequence[str], window: int = TRAIN_WINDOW,
    max_group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Predictions of each test unit from the fit on the units before it.

    ``rows``: keys, ids (which identify a row of its group), unit (integer), label (0/1), features.  Output:
    keys, ids, unit, true_direction, predicted_direction, one_class, status.  A training set with one class
    predicts that class and sets ``one_class``; one with missing values predicts nothing, and neither is a class predicted
    for a row with missing features.  ``status`` is that of the fold's fit; other folds and groups do not depend on it.
    ``rows`` is read more than once: pass a pinned table.

    Folds are looped inside the group, so a row is shuffled once and not once per fold; the vectors of compact rows are made
    after that shuffle.
    """
    on = list(keys)
    compact = isinstance(rows, Compact)
    if compact:
        parts = split_by_size(rows.rows, rows.by, max(1, max_group_values // rows.width))
    else:
        parts = split_by_size(rows, on, max(1, max_group_values // widest(rows, "features")))
    schema = T.StructType([
        *_fields(rows.wide() if compact else rows, [*on, *ids]), T.StructField("unit", T.LongType()), T.StructField("true_direction", T.IntegerType()),
        T.StructField("predicted_direction", T.IntegerType()), T.StructField("one_class", T.BooleanType()),
        T.StructField("status", T.StringType()),
    ])

    def run(table: pa.Table) -> pa.Table:
        units = table.column("unit").to_numpy()
        order = np.argsort(units, kind="stable")
        units, y, x1 = units[order], _numbers(table.column("label"))[order], _matrix(table.column("features"))[order]
        starts = np.append(np.unique(units, return_index=True)[1], len(units))
        guess, status = np.full(len(units), np.nan), np.full(len(units), "", object)
        whole, folds = np.isfinite(x1).all(axis=1), range(window, len(starts) - 2)
        for i, found in zip(folds, fit_spans(x1, y, [(starts[i - window], starts[i]) for i in folds])):
            test = slice(starts[i], starts[i + 1])
            status[test] = found.status
            if found.status == ONE_CLASS:
                guess[test] = y[starts[i - window]]
            elif found.beta is not None:
                guess[test] = np.where(whole[test], x1[test] @ found.beta > 0, np.nan)
        tested = slice(starts[window], starts[-2]) if len(starts) > window + 2 else slice(0, 0)
        kept = table.select([*on, *ids, "unit"]).take(pa.array(order[tested]))
        whole_numbers = [pa.array(values[tested], pa.float64(), from_pandas=True).cast(pa.int32()) for values in (y, guess)]
        columns = [*kept.columns, *whole_numbers, pa.array(status[tested] == ONE_CLASS), pa.array(status[tested], pa.string())]
        return pa.table(columns, names=schema.names)

    chunk_values = CHUNK_VALUES

    def run_all(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``run`` for each group of rows that stand one after the other by ``mark``, some groups held at a time."""

        def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
            group = group_numbers([table.column(name).chunk(0) for name in on])[1]
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                yield from run(table.take(pa.array(own))).to_batches()

        held, values = [], 0
        for table in tables:
            held.append(table)
            values += len(table.column("features").flatten())
            if values < chunk_values:
                continue
            joined = pa.Table.from_batches(held).combine_chunks()
            marks = joined.column("mark").to_numpy()
            cut = int(np.searchsorted(marks, marks[-1]))  # the groups of the last mark may go on
            if cut:
                yield from each(joined.slice(0, cut).combine_chunks())
            held = joined.slice(cut).to_batches()
            values = sum(len(part.column("features").flatten()) for part in held)
        held = [table for table in held if table.num_rows]
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())

    needed = [*on, *ids, F.col("unit").cast("long").alias("unit"), "label", "features"]
    if compact:
        predicted = rows._replace(rows=parts.small).together().select(*needed, mark_of(rows.by).alias("mark")).mapInArrow(run_all, schema)
    else:
        predicted = parts.small.select(*needed).groupBy(*on).applyInArrow(run, schema)
    if parts.large is None:
        return predicted
    large = pin(rows.widen(parts.large).select(*needed), "large-rows") if compact else parts.large.select(*needed)
    return predicted.unionByName(_predict_spread(large, on, list(ids), window))


def _predict_spread(rows: DataFrame, keys: list[str], ids: list[str], window: int) -> DataFrame:
    folds = walk_forward_folds(rows, keys, window)
    folds = pin(folds.withColumn("failed", _status(F.col("n_train"), F.col("n_train_up"), F.col("n_incomplete"))), "folds")
    widths = rows.groupBy(*keys).agg(F.max(F.size("features")).alias("width"))
    problems = folds.where("failed is null").join(widths, keys).select(*keys, F.col("test_unit").alias("fold"), "train_units", "width")
    training = rows.where(~_incomplete()).select(*keys, "unit", "label", "features", F.xxhash64(*ids).alias("mix"))
    betas = fit_spread(training, problems, keys)
    fitted = folds.join(betas.withColumnRenamed("fold", "test_unit"), [*keys, "test_unit"], "left").select(
        *keys, F.col("test_unit").alias("unit"), "beta", F.coalesce("failed", "status").alias("status"),
        F.when(F.col("failed") == ONE_CLASS, (F.col("n_train_up") > 0).cast("int")).alias("only_class")
    )
    margin = dot(F.col("features"), F.slice("beta", F.lit(1), F.size("features"))) + F.element_at("beta", -1)
    whole = ~F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    guess = F.when(F.col("beta").isNull(), F.col("only_class")).when(whole, (margin > 0).cast("int"))
    return rows.join(fitted, [*keys, "unit"]).select(
        *keys, *ids, "unit", F.col("label").cast("int").alias("true_direction"),
        guess.alias("predicted_direction"), (F.col("status") == ONE_CLASS).alias("one_class"), "status",
    )
