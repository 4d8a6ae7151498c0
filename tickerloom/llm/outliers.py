"""Quality rules: word statistics, and multivariate outliers by the minimum covariance determinant.

Statistics of a text become a vector of transformed numbers.  For each language and source a location and
scatter are fitted by concentration steps: from two robust starts, the rows nearest to the estimate (by
Mahalanobis distance) give the next one, and the start with the smaller determinant wins.  One step is one
aggregation over all rows: rows are counted and summed per group and distance bin, and the nearest share is
made of whole bins, so no group is ever in one task.  In units of a floor per feature no direction of the scatter falls
below one unit, which keeps features that are constant in most texts usable; wider scatter is left as it is.

Groups with fewer than LEAST_ROWS rows are fitted with the other small groups of their language, and then
with all others; with too few rows even so, the base rules alone decide.  Null text has no words and fails the
base rules; null language or source is a group of its own; equal rows get equal verdicts; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common
from tickerloom.session import pin

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SHARE = 0.75       # of the rows that an estimate rests on
LEAST_ROWS = 50
STEPS = 5
REJECT = 1e-4      # share of normal rows beyond the limit

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Smallest standard deviation of each feature, in the order of ``features``: half a unit of a logarithm, 0.4 characters a
# word, and for the share of repeated words what two repeated windows in 120 words make.
FLOORS = [0.5, 0.4, 0.5, 0.5, 0.05]
P = len(FLOORS)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:shift + n - 2] |= twice
    return int(covered.sum())


def statistics_of(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    characters = len(data.decode("utf-8", "replace"))
    blank = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    return len(words), characters - blank, symbols, len(lines) - len(set(lines)), repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) with the word statistics and base_failed of every row."""
    keep = ["doc_id", "lang", "source"]

    def run(batches):
        for batch in common.slices(batches):
            done = [statistics_of(data) for data in batch.column("text").to_pylist()]
            made = [pa.array([row[i] for row in done], pa.int64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in keep], *made], [*keep, *STATISTICS])

    kinds = ", ".join(f"{name} {docs.schema[name].dataType.simpleString()}" for name in keep)
    rows = docs.select(*keep, common.utf8(F.col("text")).alias("text"))
    counted = rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{name} long" for name in STATISTICS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def features() -> list[Column]:
    """The transformed statistics."""
    words, letters = F.col("n_words").cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log1p(words),
        letters / F.greatest(words, F.lit(1.0)),
        F.log(F.col("n_symbols") / letters + 0.002),
        F.log(F.col("n_dup_lines") / F.greatest(words, F.lit(1.0)) + 0.005),
        F.col("n_repeat_words") / F.greatest(words, F.lit(1.0)),
    ]


def chi_square_cdf(x: float, freedom: int) -> float:
    """Lower regularised gamma function by its series."""
    if x <= 0:
        return 0.0
    a, z = freedom / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < share else (low, middle)
    return high


def _distance(x: list[Column], mean: Column, inverse: Column) -> Column:
    centred = [x[i] - mean[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        inner = sum((inverse[i * P + j] * centred[j] * (1.0 if i == j else 2.0) for j in range(i, P)), F.lit(0.0))
        total = total + centred[i] * inner
    return total


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_STATE = "fit string, start int, n long, mean array<double>, inverse array<double>, log_det double"


def floored(cov: np.ndarray) -> np.ndarray:
    """Scatter in units of the floors, no direction below one unit; what lies above stays as it was."""
    units = np.outer(FLOORS, FLOORS)
    values, turns = np.linalg.eigh(cov / units)
    return (turns * np.maximum(values, 1.0)) @ turns.T * units


def _state(key, start, n, mean, cov) -> list:
    cov = floored(cov)
    return [key, start, n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])]


def _moments(frame: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    n = frame["n"].sum()
    mean = np.array([frame[f"s{i}"].sum() for i in range(P)]) / n
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = frame[f"q{i}_{j}"].sum() / n - mean[i] * mean[j]
    return int(n), mean, cov


def _sums(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
            *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in _PAIRS]]


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Estimates (fit, n, mean, inverse, ...) of pinned ``rows`` (fit, x0, x1, ...), one row for each value of fit."""
    x = [F.col(f"x{i}") for i in range(P)]
    cut = chi_square_quantile(share, P)
    consistency = share / chi_square_cdf(cut, P + 2)

    # Start 0: medians and quartile ranges.  Start 1: directions from the median (spatial signs) on the same scale.
    quartiles = [F.percentile_approx(x[i], [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i in range(P)]
    middle = pin(rows.groupBy("fit").agg(*quartiles), "quartiles")
    scale = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    z = [(x[i] - F.col(f"p{i}")[1]) / scale[i] for i in range(P)]
    norm = F.sqrt(sum((z[i] * z[i] for i in range(P)), F.lit(1e-12)))
    signs = rows.join(middle, "fit").groupBy("fit").agg(
        F.count("*").alias("n"), *[F.sum(z[i] * z[j] / (norm * norm)).alias(f"q{i}_{j}") for i, j in _PAIRS],
        *[F.first(F.col(f"p{i}")).alias(f"p{i}") for i in range(P)])

    def starts(batches):
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                quartile = np.array([getattr(row, f"p{i}") for i in range(P)])
                spread = np.maximum((quartile[:, 2] - quartile[:, 0]) / 1.349, FLOORS)
                cov = np.zeros((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = P * getattr(row, f"q{i}_{j}") / row.n
                out.append(_state(row.fit, 0, row.n, quartile[:, 1], np.diag(spread ** 2)))
                out.append(_state(row.fit, 1, row.n, quartile[:, 1], cov * np.outer(spread, spread)))
            yield pd.DataFrame(out, columns=["fit", "start", "n", "mean", "inverse", "log_det"])

    state = pin(signs.mapInPandas(starts, _STATE), "starts")

    def concentrated(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        before = frame["n"].cumsum() - frame["n"]
        nearest = frame[before < share * frame["n"].sum()]
        _, mean, cov = _moments(nearest)
        return pd.DataFrame([_state(key[0], int(key[1]), int(frame["n"].sum()), mean, cov * consistency)],
                            columns=["fit", "start", "n", "mean", "inverse", "log_det"])

    for _ in range(steps):
        near = rows.join(state.drop("n"), "fit")
        bin_ = F.floor(F.log2(_distance(x, F.col("mean"), F.col("inverse")) + 1e-6) * 16).cast("int")
        sums = near.groupBy("fit", "start", bin_.alias("bin")).agg(*_sums(x))
        state = pin(sums.groupBy("fit", "start").applyInPandas(concentrated, _STATE), "step")
    best = F.min_by(F.struct("n", "mean", "inverse"), F.struct("log_det", "start"))
    raw = state.groupBy("fit").agg(best.alias("best")).select("fit", "best.*")

    # Reweighting: the final estimate rests on all rows within the 97.5 % limit of the raw one.
    limit = chi_square_quantile(0.975, P)
    close = rows.join(pin(raw, "raw").drop("n"), "fit").where(_distance(x, F.col("mean"), F.col("inverse")) <= limit)
    final = close.groupBy("fit").agg(*_sums(x))

    def finished(batches):
        for frame in batches:
            out = []
            for _, row in frame.iterrows():
                n, mean, cov = _moments(row.to_frame().T)
                out.append(_state(row["fit"], 0, n, mean, cov * 0.975 / chi_square_cdf(limit, P + 2)))
            yield pd.DataFrame(out, columns=["fit", "start", "n", "mean", "inverse", "log_det"])

    return final.mapInPandas(finished, _STATE).drop("start")


def _fit_keys(rows: DataFrame) -> DataFrame:
    """Name of the estimate for each language and source: its own, its language's remainder, or the rest of all."""
    name = F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")),
                       F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    pair = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST_ROWS
    rest = pair.where(small).groupBy("lang").agg(F.sum("n").alias("rest"))
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    joined = pair.join(rest.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    key = F.when(~small, name).when(F.col("rest") >= LEAST_ROWS, F.concat(lang, F.lit("|*"))).otherwise(F.lit("*|*"))
    return joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), key.alias("fit"))


def judged(docs: DataFrame, share: float = SHARE, reject: float = REJECT) -> DataFrame:
    """(doc_id, lang, source, statistics, base_failed, distance, kept) of every row of ``docs``."""
    counted = pin(statistics(docs), "statistics")
    x = [column.alias(f"x{i}") for i, column in enumerate(features())]
    passed = counted.where("not base_failed")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    keys = pin(_fit_keys(passed), "fit-keys")
    rows = pin(passed.join(keys, same).select("fit", *x), "features")
    estimates = pin(fit(rows, share), "estimates").where(F.col("n") > 2 * P)
    verdicts = keys.join(estimates.select("fit", "mean", "inverse"), "fit", "left").drop("fit")
    spread = _distance(features(), F.col("mean"), F.col("inverse"))
    return (
        counted.join(pin(verdicts, "verdicts"), same, "left")
        .withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(spread, F.lit(0.0)))))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") * F.col("distance") <= chi_square_quantile(1 - reject, P), F.lit(True)))
        .select("doc_id", "lang", "source", *STATISTICS, "base_failed", "distance", "kept")
    )


def kept(docs: DataFrame, share: float = SHARE, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are kept; rows equal in doc_id, text, language and source share a verdict."""
    key = common.unused(docs, "_quality_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text", "lang", "source"))
    verdicts = judged(keyed.select(F.col(key).alias("doc_id"), "text", "lang", "source"), share, reject)
    rejected = pin(verdicts.where("not kept").select(F.col("doc_id").alias(key)).distinct(), "rejected")
    return common.among(keyed, key, rejected, False).select(*docs.columns)
