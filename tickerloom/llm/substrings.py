"""Bytes covered by long strings that occur elsewhere too: suffixes grouped by minimisers and hashes, cut at the threshold.

Two suffixes fall into one group if their first ``window`` bytes are equal.  Nothing is sorted: instead of the digits of
a radix sort, each pass groups by a hash, refines the groups and drops groups of one, so that only suffixes that still
may have a partner are looked at again.  The hashes are taken so that a whole run of neighbouring suffixes shares most
of them:

1. The minimiser: the gram with the smallest hash among the first ``window`` bytes, and its distance.  Runs of
   suffixes with the same minimiser form one row (about one for 120 bytes).  A gram that occurs once ends its runs.
2. The run: equal runs (all bytes that their windows cover) are repeated as a whole.  One run of each kind goes on,
   and only where a gram has several kinds.
3. Blocks of BLOCK suffixes by distance from the minimiser: the bytes that all windows of a block share, then all
   bytes of the block.
4. Single suffixes, in blocks that agree in the shared bytes but not in all.

Equal groups at the end are the repeated windows.  Every pass counts with partial sums and joins the counts back on
the same key, so a hot gram or passage is never gathered in one task.  Hashes have 64 bits for what only filters, and
two numbers of 64 bits together for what decides.

Null text counts as empty.  Rows equal in doc_id and text are occurrences of their own and have equal results.  An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common, suffixes
from tickerloom.session import pin

WINDOW = 400
BLOCK = 16
SLICE_BYTES = 1 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), common.utf8(F.col("text")).alias("text"))


def _runs(rows: DataFrame, window: int) -> DataFrame:
    """(key, first, n, place, gram, run) of all runs of suffixes with one minimiser."""

    def run(batches):
        for batch in common.slices(batches, SLICE_BYTES):
            keys, texts = np.asarray(batch.column("key")), batch.column("text").to_pylist()
            if sum(map(len, texts)) < 1 << 24:
                found = [(0, suffixes.minimiser_ranges(texts, window))]
            else:  # one very long text: in pieces that overlap by less than a window
                found = [(start, suffixes.minimiser_ranges([texts[0][start:start + (1 << 23) + window - 1]], window))
                         for start in range(0, max(1, len(texts[0]) - window + 1), 1 << 23)]
            for start, ranges in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[ranges.text]), pa.array(ranges.first + start, pa.int32()), pa.array(ranges.count, pa.int32()),
                     pa.array(ranges.place + start, pa.int32()), common.signed(ranges.gram), common.signed(ranges.slice)],
                    ["key", "first", "n", "place", "gram", "run"])

    return rows.select("key", "text").mapInArrow(run, "key long, first int, n int, place int, gram long, run long")


def _refined(texts: DataFrame, wanted: DataFrame, block: int, window: int) -> DataFrame:
    """(id, low, high, place, key, g1, g2, all): the blocks of the wanted runs, joined with their texts by key."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("id", "place", "low", "high")).alias("runs"))  # runs of one text
    both = texts.join(lists, "key").select("key", "text", "runs")

    def run(batches):
        for batch in common.slices(batches, SLICE_BYTES):
            for key, data, column in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("runs")):
                values = column.values
                ids, place, low, high = (np.asarray(values.field(name)) for name in ("id", "place", "low", "high"))
                place, low, high = (part.astype(np.int64) for part in (place, low, high))
                bytes_ = np.frombuffer(data, np.uint8)
                rolling = [suffixes.Rolling(bytes_, 0), suffixes.Rolling(bytes_, 1)]
                owner, number, lo, hi, shared, whole = suffixes.blocks_of(rolling, place, low, high, block, window)
                gram = rolling[0].of(place, place + suffixes.GRAM)[owner]
                same = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + gram
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner]), pa.array(np.full(len(owner), key)), pa.array(place[owner], pa.int32()), pa.array(lo, pa.int32()),
                     pa.array(hi, pa.int32()), common.signed(common.mixed(shared[0] + same)), common.signed(common.mixed(shared[1] ^ same)),
                     common.signed(whole)],
                    ["id", "key", "place", "low", "high", "g1", "g2", "all"])

    made = both.mapInArrow(run, "id long, key long, place int, low int, high int, g1 long, g2 long, all long")
    return pin(made, "digits")


def _covers(rows: DataFrame, window: int) -> DataFrame:
    """(id, start, end) relative to the minimiser."""
    return rows.select("id", (-F.col("high")).alias("start"), (F.lit(window) - F.col("low")).alias("end"))


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose group repeats: those of groups with equal bytes throughout, and those of the others."""
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min("all").alias("least"), F.max("all").alias("most"))
    groups = pin(groups.where("n > 1").select("g1", "g2", (F.col("least") == F.col("most")).alias("alike")), "repeated-digits")
    joined = pin(rows.join(groups, ["g1", "g2"]).select("id", "key", "place", "low", "high", "alike"), "groups")
    return joined.where("alike"), joined.where("not alike")


def covers(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, parts: array of (start, end)) of the rows of ``docs`` (doc_id, key, text) with repeated windows."""
    runs = pin(_runs(docs, window), "runs")
    # Counts are pinned before they are joined, so that both sides of the join are shuffled and a hot gram can be split.
    repeated = pin(runs.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams")
    identity = F.xxhash64("gram", "run")
    runs = pin(runs.join(repeated, "gram").withColumn("id", identity), "repeated-grams")

    kinds = runs.groupBy("gram", "run", "id").agg(
        F.count("*").alias("c"), F.min(F.struct("key", "first", "n", "place")).alias("one"))
    kinds = pin(kinds, "kinds")
    several = pin(kinds.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "several")
    low = F.col("one.place") - F.col("one.first") - F.col("one.n") + 1
    wanted = pin(kinds.join(several, "gram").select(
        "id", "c", F.col("one.key").alias("key"), F.col("one.place").alias("place"), low.alias("low"),
        (F.col("one.place") - F.col("one.first")).alias("high")), "wanted")
    texts = pin(common.among(docs.select("key", "text"), "key", pin(wanted.select("key").distinct(), "keys"), True)
                .groupBy("key").agg(F.first("text").alias("text")), "texts")

    alike, unlike = _shared(_refined(texts, wanted, BLOCK, window))
    single, _ = _shared(_refined(texts, unlike, 1, window))
    whole = kinds.where("c > 1").select(
        "id", (F.col("one.first") - F.col("one.place")).alias("start"),
        (F.col("one.first") + F.col("one.n") - 1 + window - F.col("one.place")).alias("end"))
    parts = _covers(alike, window).unionByName(_covers(single, window)).join(kinds.where("c > 1").select("id"), "id", "left_anti")
    by_run = whole.unionByName(parts).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("parts"))  # window - GRAM + 1 at most
    # Pinned, so that both sides of the join are shuffled and a hot run can be split.  Rows equal in doc_id and text have one
    # key and the same parts, which the set holds once.
    placed = runs.select("id", "key", "place").join(pin(by_run, "by-run"), "id")
    return placed.groupBy("key").agg(F.flatten(F.collect_set(F.transform(
        "parts", lambda p: F.struct((p["start"] + F.col("place")).alias("start"), (p["end"] + F.col("place")).alias("end"))))).alias("parts"))


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row of ``docs`` (doc_id, text).

    ``spans`` are the maximal removed byte ranges, ``kept`` the bytes that are left.
    """
    rows = _keyed(docs)
    found = pin(covers(rows, window), "covers")
    keys = pin(found.select("key"), "covered-keys")

    def run(batches):
        for batch in common.slices(batches, 4 << 20):
            texts, parts = batch.column("text").to_pylist(), batch.column("parts")
            sizes, removed, spans, kept = [], [], [], []
            for i, data in enumerate(texts):
                change = np.zeros(len(data) + 1, np.int64)
                values = parts[i].values
                np.add.at(change, np.asarray(values.field("start")), 1)
                np.add.at(change, np.asarray(values.field("end")), -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = common.among(rows, "key", keys, True).join(found, "key").select("doc_id", "text", "parts").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
    same = common.among(rows, "key", keys, False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.col("text").alias("kept"))
    return changed.unionByName(same)
