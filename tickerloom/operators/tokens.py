"""Token counts, top tokens, joined texts and padded token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.text import english_stop_words, tokens
from tickerloom.operators.ordered import positions
from tickerloom.params import ENCODER_BATCH, MAX_TOKENS, NO_HEADLINE, TOP_TOKENS
from tickerloom.session import pin

ALL_TICKERS = "(all)"


def with_headline(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("headline") != NO_HEADLINE)


def token_rows(df: DataFrame, text: str, keys: list[str], stop_words: list[str] | None = None) -> DataFrame:
    """One row per token of the whole text, stop words left out.

    The stop list is a literal of a few hundred words, so the filter stays in the scan stage.
    """
    words = english_stop_words(df.sparkSession) if stop_words is None else stop_words
    rows = df.select(*keys, F.explode(tokens(F.col(text))).alias("token"))
    return rows.where(~F.col("token").isin(words)) if words else rows


def token_counts(df: DataFrame, text: str, key: str, stop_words: list[str] | None = None) -> DataFrame:
    """(key, token, n) per key and, under ``(all)``, over everything.

    The total is summed from the per-key counts: the grouping sets expand counts, not tokens.
    """
    per_key = token_rows(df, text, [key], stop_words).groupBy(key, "token").agg(F.count("*").alias("n"))
    return (
        per_key.groupingSets([[F.col(key), F.col("token")], [F.col("token")]], F.col(key), F.col("token"))
        .agg(F.sum("n").alias("n"), F.grouping(key).alias("_all"))
        .withColumn(key, F.when(F.col("_all") == 1, ALL_TICKERS).otherwise(F.col(key).cast("string")))
        .drop("_all")
    )


def top_tokens(counts: DataFrame, key: str, k: int = TOP_TOKENS) -> DataFrame:
    """The ``k`` most frequent tokens per key; ties by token.

    Spark keeps only ``k`` rows per key and task before the shuffle, so the ``(all)`` group stays small.
    """
    by_count = Window.partitionBy(key).orderBy(F.desc("n"), F.asc("token"))
    return counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)


def document_terms(df: DataFrame, text: str, key: str) -> DataFrame:
    """Sparse document-term counts (key, token, n); never made dense."""
    return token_rows(df, text, [key]).groupBy(key, "token").agg(F.count("*").alias("n"))


def vocabulary(terms: DataFrame, least: int = 1) -> DataFrame:
    """(token, index, documents) of the tokens of ``terms`` (key, token, n) in at least ``least`` texts.

    Indices 0, 1, ... run from the token in most texts down, ties by token; the ranking is by ranges, in no single task.
    """
    counted = terms.groupBy("token").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)
    placed = positions(counted.withColumn("_rare", -F.col("documents")), [], ["_rare", "token"])
    return placed.select("token", (F.col("pos") - 1).alias("index"), "documents")


def document_vectors(terms: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, indices, counts): sparse count vectors over a vocabulary table, indices ascending.

    Tokens outside the vocabulary are left out; a text without any has no row.  A frequent token meets one row of
    ``words``, so an inner join that adaptive execution may split is all it takes.
    """
    found = terms.join(words.select("token", "index"), "token").select(key, F.struct("index", F.col("n").alias("count")).alias("c"))
    cells = found.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cells"))
    return cells.select(key, F.col("cells.index").alias("indices"), F.col("cells.count").alias("counts"))


def joined_text(df: DataFrame, text: str, key: str, order: list[str], rows_per_part: int = 1000) -> DataFrame:
    """All texts of a key joined by spaces, as (key, part, text) in parts of ``rows_per_part`` rows.

    A key with a third of all rows would not fit one cell; its parts, read in order, are the whole text.
    ``order`` must identify a row of its key.
    """
    placed = positions(df.select(key, *dict.fromkeys([*order, text])), [key], order)
    part = F.floor((F.col("pos") - 1) / rows_per_part).cast("int")
    pieces = F.sort_array(F.collect_list(F.struct("pos", F.col(text).alias("t"))))
    return placed.groupBy(key, part.alias("part")).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("text"))


def token_sequences(
    df: DataFrame, text: str, key: str, max_tokens: int = MAX_TOKENS, batch: int = ENCODER_BATCH,
    first_only: bool = False, pad: str = "",
) -> DataFrame:
    """Encoder input: (key, seq_no, batch_no, tokens, mask), at most ``max_tokens`` tokens per row.

    A null text counts as empty, which gives one row without tokens.  A long text gives several rows that together hold all of it; ``first_only`` keeps the first one, the
    plain truncation.  Rows are padded to the longest of their batch, ``batch`` rows in key order.  Batches
    are formed on (key, seq_no, length) alone, which are written once, so the tokens are not sorted.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / max_tokens) - 1, F.lit(0)).cast("int"))
    pieces = F.transform(
        F.array(F.lit(0)) if first_only else starts, lambda i: F.slice("words", i * max_tokens + 1, F.lit(max_tokens))
    )
    words = df.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words"))
    rows = words.select(key, F.posexplode(pieces).alias("seq_no", "tokens"))
    lengths = pin(rows.select(key, "seq_no", F.size("tokens").alias("n_tokens")), "lengths")
    batches = positions(lengths, [], [key, "seq_no"]).withColumn(
        "batch_no", F.floor((F.col("pos") - 1) / batch).cast("long")
    )
    width = F.max("n_tokens").over(Window.partitionBy("batch_no"))
    sized = batches.select(key, "seq_no", "batch_no", "n_tokens", width.alias("width"))
    n_pad = F.col("width") - F.col("n_tokens")
    return rows.join(sized, [key, "seq_no"]).select(
        key, "seq_no", "batch_no", "n_tokens", "width",
        F.concat("tokens", F.array_repeat(F.lit(pad), n_pad)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), n_pad)).alias("mask"),
    )
