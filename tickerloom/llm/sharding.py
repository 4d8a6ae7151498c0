"""Shards that all hold the mixture of the sources.

Rows are put in a seeded order within their source, a row's place there becomes a fraction of the source,
and all rows sorted by that fraction are cut into shards of equal row counts (law ``rows``).  The order
comes from md5, whose values spread evenly, so the leading digits cut rows and sources into buckets of
even size: places are counted per bucket and earlier buckets are added from a table of counts.  No source
and no shard is ever sorted in one task.

A null source is a source of its own; null text has no bytes; equal rows are interchangeable; null and
repeated doc_ids are ordinary rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import utf8
from tickerloom.session import pin

ROW_OVERHEAD = 16
SEED = 17
LEAST_BUCKETS = 1024
ROWS_PER_BUCKET = 20_000


def _places(rows: DataFrame, within: list[str], order: list[str], bucket: str, out: str, total: str | None) -> DataFrame:
    """Place 0, 1, ... of each row in its group along ``order``, of which ``bucket`` is a coarse form."""
    group = Window.partitionBy(*within)
    earlier = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*within, bucket).agg(F.count("*").alias("_n"))
    carried = counts.select(
        *[F.col(name).alias(f"_k_{name}") for name in [*within, bucket]],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(group).alias(total)] if total else []))
    inside = Window.partitionBy(*within, bucket).orderBy(*order)
    same = [F.col(name).eqNullSafe(F.col(f"_k_{name}")) for name in [*within, bucket]]
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1).join(carried, same)
        .withColumn(out, F.col("_place") + F.col("_before"))
        .drop("_place", "_before", *[f"_k_{name}" for name in [*within, bucket]])
    )


def _leading(share: Column, buckets: int) -> Column:
    """Bucket of a share in [0, 1)."""
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")


def interleave(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, place, shard, slot) of every row of ``docs`` (doc_id, text, source)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    narrow = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"))
    rows = pin(narrow.withColumn("_digest", digest), "mixture")
    total = rows.count()
    buckets = max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)
    share = F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double") / float(16 ** 12)
    rows = rows.withColumn("_bucket", _leading(share, buckets))
    ranked = _places(rows, ["source"], ["_digest", "doc_id", "size"], "_bucket", "_rank", "_of")
    fraction = (F.col("_rank") * 2 + 1) / (F.col("_of") * 2)
    mixed = ranked.withColumn("_fraction", fraction).withColumn("_bucket", _leading(F.col("_fraction"), buckets))
    # Everything lies in one group here; the bucket alone is the window key.
    placed = _places(mixed.withColumn("_all", F.lit(0)), ["_all"], ["_fraction", "_digest", "doc_id", "source"], "_bucket", "place", None)
    shard = F.expr(f"(place * {shards}L) div {max(1, total)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
        .select("doc_id", "source", "size", "text_crc32", "place", F.col("shard").cast("int"), "slot")
    )
