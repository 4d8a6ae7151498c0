"""Class-based bigram scores: exchange clustering, class transitions, word emissions.

Units are clustered by exchange.  A word's unit is a slot of its hash (2^SLOT_BITS of them, so a word is alone in its unit
but for collisions) if the slot holds LEAST training tokens or more; rarer words share ENDINGS units by their last two
bytes.  The exchange runs in Spark: a pass over the training texts counts, for every unit, the classes before and after
it; units then move, a quarter of them at a time, to the class that raises the likelihood of the class bigrams most,
against a table of classes that the driver sums up from the moves of all tasks.  A second pass counts the neighbours by
their new classes, and the units move again.  What the driver holds (totals and classes of the slots, the class table)
has a fixed size, whatever the corpus.

A text's probability is the product of P(class | class before) * P(word | class) over its words and its end; both are
smoothed, and unknown words have the share of one unseen word in their class.

Texts are cut into blocks.  A block numbers its own words; the vocabularies of all blocks are summed by word in
Spark, and each block gets the counts and units of its words back.  So texts are never joined with the vocabulary
word by word, and no vocabulary is held in one place.

Null text counts as empty: its end alone is scored.  Rows with a null doc_id are training rows.  Equal rows get equal
scores.  Without training rows all counts are 0.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common
from tickerloom.session import pin

SLOT_BITS = 20
LEAST = 5              # training tokens from which a slot is a unit of its own
ENDINGS = 128          # units of all other words
CLASSES = 48
REFRESHES = 2          # passes that count the neighbours by class
SWEEPS = 3             # sweeps of moves after each of them
PARTS = 4              # of the units, moved one after the other
RANGE = 256            # neighbouring units whose counts travel as one row
MERGED = 256           # tasks whose rows are merged at once
HELD_CELLS = 2_000_000
BLOCK_BYTES = 24 << 20
SLOTS = 1 << SLOT_BITS
UNITS = SLOTS + ENDINGS


class Model(NamedTuple):
    """log10 of transitions (classes and the end, in both directions) and of emission denominators."""

    transition: np.ndarray
    emission: np.ndarray


class Units(dict):
    """Slot of each word (bytes), or its unit if ``often`` tells which slots are units; remembered up to a bound of entries."""

    LIMIT = 400_000

    def __init__(self, often: np.ndarray | None = None):
        self.often = often

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        unit = xxhash.xxh3_64_intdigest(word) >> (64 - SLOT_BITS)
        if self.often is not None and not self.often[unit]:
            unit = SLOTS + zlib.crc32(word[-2:]) % ENDINGS
        self[word] = unit
        return unit

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def slot_totals(training: DataFrame) -> np.ndarray:
    """Training tokens in each slot: one number a slot from each task, summed in Spark; a fixed size."""

    def run(batches):
        slots, total = Units(), np.zeros(SLOTS, np.int64)  # 8 MB
        for batch in common.slices(batches):
            for data in batch.column("text").to_pylist():
                np.add.at(total, slots.of(data.lower().split()), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "n"])

    def packed(batches):
        parts = [(np.asarray(batch.column("slot")), np.asarray(batch.column("n"))) for batch in batches]
        if parts:
            slots, n = (np.concatenate(column) for column in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array([_pack(_packer(), n.astype(np.int64), slots.astype(np.int32))], pa.binary())], ["piece"])

    sums = training.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    total = np.zeros(SLOTS, np.int64)
    for row in sums.mapInArrow(packed, "piece binary").collect():  # arrays of a fixed size together, not a million rows
        n, slots = _unpack(_packer(), row.piece, np.int64, np.int32)
        total[slots] = n
    return total


def _packer() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _pack(codec: pa.Codec, *arrays: np.ndarray) -> bytes:
    """Arrays of bytes, shorts or ints as one compressed piece."""
    data = b"".join(array.tobytes() for array in arrays)
    return len(data).to_bytes(4, "little") + codec.compress(data, asbytes=True)


def _unpack(codec: pa.Codec, piece: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of ``_pack``, all of one length."""
    size = int.from_bytes(piece[:4], "little")
    data = codec.decompress(piece[4:], size, asbytes=True)
    n, at, out = size // sum(np.dtype(kind).itemsize for kind in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # parts are sorted runs, which merge fast
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def neighbours(training: DataFrame, often: np.ndarray, class_of: np.ndarray, sides: int) -> DataFrame:
    """(range, cells): how often each unit of a range stands after (place < ``sides``) and before (from ``sides`` on) each class.

    A text begins after and ends before class 0.  Tasks add up, then rows of one range are merged, some tasks at a time.
    """
    shared = training.sparkSession.sparkContext.broadcast((often, class_of))

    def rows(keys: np.ndarray, counts: np.ndarray, task: int):
        unit, place = keys // (2 * sides), keys % (2 * sides)
        ranges, first = np.unique(unit // RANGE, return_index=True)
        ends = [*first[1:].tolist(), len(keys)]
        codec = _packer()
        cells = [_pack(codec, counts[a:b].astype(np.uint32), (unit[a:b] % RANGE).astype(np.uint8), place[a:b].astype(np.uint8)) for a, b in zip(first.tolist(), ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges.astype(np.int32)), pa.array(np.full(len(ranges), task, np.int32)), pa.array(cells, pa.binary())], ["range", "task", "cells"])

    def run(batches):
        known, label = shared.value
        units, task = Units(known), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in common.slices(batches):
            found = [units.of(data.lower().split()) for data in batch.column("text").to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            lengths = np.array([len(row) for row in found])
            owner = np.repeat(np.arange(len(found)), lengths)
            spread = np.zeros(len(flat) + len(found) + 1, np.int64)
            at = np.arange(len(flat)) + owner + 1
            spread[at] = label[flat]
            keys = np.concatenate([flat * (2 * sides) + spread[at - 1], flat * (2 * sides) + sides + spread[at + 1]])
            held.append(_counted(keys))
            if sum(len(part[0]) for part in held) > HELD_CELLS:
                held = [_summed(*(np.concatenate(column) for column in zip(*held)))]
                if len(held[0][0]) > HELD_CELLS // 2:
                    yield rows(*held[0], task)
                    held = []
        if held:
            yield rows(*_summed(*(np.concatenate(column) for column in zip(*held))), task)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        """The cells of a range, added up."""
        codec = _packer()
        parts = [_unpack(codec, piece.as_py(), np.uint32, np.uint8, np.uint8) for piece in table.column("cells")]
        counts, unit, place = (np.concatenate(column).astype(np.int64) for column in zip(*parts))
        keys, counts = _summed(unit * 256 + place, counts)
        most = np.iinfo(np.uint32).max
        while counts.max(initial=0) > most:      # a larger count travels as several cells
            big = counts > most
            keys, counts = np.concatenate([keys, keys[big]]), np.concatenate([np.where(big, counts - most, counts), np.full(big.sum(), most)])
        piece = _pack(codec, counts.astype(np.uint32), (keys // 256).astype(np.uint8), (keys % 256).astype(np.uint8))
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([piece], pa.binary())})

    counted = training.select("text").mapInArrow(run, "range int, task int, cells binary")
    if training.rdd.getNumPartitions() > MERGED:  # some tasks at a time first, so that no group holds the rows of all of them
        some = F.floor(F.col("task") / MERGED)
        counted = counted.groupBy("range", some.alias("some")).applyInArrow(merged, "range int, cells binary")
    return pin(counted.groupBy("range").applyInArrow(merged, "range int, cells binary"), "neighbours")


def _log_sum(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_moves(unit: np.ndarray, place: np.ndarray, counts: np.ndarray, label: np.ndarray, table: np.ndarray, sides: int) -> np.ndarray:
    """Best class of each unit 0, 1, ... given its cells (sorted by unit), the classes of all and the class table.

    A move gains the change of sum n(c, x) log n(c, x) - 2 n(c) log n(c) over classes c and neighbours x; a unit stays
    unless it gains.
    """
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = table[:, :sides].sum(1)
    own = label[unit]
    n = np.add.reduceat(np.where(place < sides, counts, 0), first)
    # Most cells are one of a few (class, count) pairs: what a pair gains in each class is computed once.
    pairs, which = np.unique(counts.astype(np.int64) * 256 + place, return_inverse=True)
    column = table[:, pairs % 256]
    gained = (_log_sum(column + pairs // 256) - _log_sum(column)).T
    joined = np.add.reduceat(gained[which], first, axis=0).T
    joined -= 2 * (_log_sum(sizes[:, None] + n) - _log_sum(sizes)[:, None])
    left = table[own, place]
    here = label[unit[first]]
    stay = np.add.reduceat(_log_sum(left) - _log_sum(left - counts), first) - 2 * (_log_sum(sizes[here]) - _log_sum(sizes[here] - n))
    gain = joined - stay
    gain[0] = -np.inf
    gain[here, np.arange(len(first))] = 0.0
    best = gain.argmax(0)
    return np.where(gain[best, np.arange(len(first))] > 1e-9, best, here)


def _table(cells: DataFrame, class_of: np.ndarray, sides: int) -> np.ndarray:
    """Class table: occurrences of each class after and before each class."""
    shared = cells.sparkSession.sparkContext.broadcast(class_of)

    def run(batches):
        total, codec = np.zeros((sides, 2 * sides), np.int64), _packer()
        for batch in batches:
            for number, piece in zip(batch.column("range").to_pylist(), batch.column("cells")):
                counts, unit, place = _unpack(codec, piece.as_py(), np.uint32, np.uint8, np.uint8)
                np.add.at(total, (shared.value[number * RANGE + unit.astype(np.int64)], place), counts.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    parts = cells.mapInArrow(run, "t binary").collect()  # one matrix of fixed size from each task of a table of fixed size
    return sum((np.frombuffer(row.t, np.int64).reshape(sides, 2 * sides) for row in parts), np.zeros((sides, 2 * sides), np.int64))


def exchanged(cells: DataFrame, class_of: np.ndarray, sides: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes after sweeps of moves, a part of the units at a time."""
    context = cells.sparkSession.sparkContext
    table = _table(cells, class_of, sides)
    for _ in range(sweeps):
        moves = 0
        for part in range(PARTS):
            shared = context.broadcast((class_of, table.astype(float)))

            def run(batches, part=part, shared=shared):
                (label, known), codec = shared.value, _packer()
                for batch in batches:
                    changed, classes, change = [], [], np.zeros((sides, 2 * sides), np.int64)
                    for number, piece in zip(batch.column("range").to_pylist(), batch.column("cells")):
                        counts, unit, place = (x.astype(np.int64) for x in _unpack(codec, piece.as_py(), np.uint32, np.uint8, np.uint8))
                        mine = np.flatnonzero(unit % PARTS == part)
                        mine = mine[np.argsort(unit[mine], kind="stable")]
                        if not len(mine):
                            continue
                        counts, unit, place = counts[mine], unit[mine], place[mine]
                        own = label[number * RANGE:(number + 1) * RANGE].astype(np.int64)
                        names = np.unique(unit)
                        best = best_moves(unit, place, counts.astype(float), own, known, sides)
                        after = own.copy()
                        after[names] = best
                        moved = after[unit] != own[unit]
                        np.add.at(change, (after[unit][moved], place[moved]), counts[moved])
                        np.add.at(change, (own[unit][moved], place[moved]), -counts[moved])
                        went = names[best != own[names]]
                        changed.append(number * RANGE + went)
                        classes.append(after[went])
                    columns = [np.concatenate([np.empty(0, np.int64), *parts]) for parts in (changed, classes)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in columns] + [pa.array([change.tobytes()], pa.binary())], ["units", "classes", "change"])

            # Moves of a fixed number of units at most; all tasks at once, where an iterator would run them one by one.
            for row in cells.mapInArrow(run, "units binary, classes binary, change binary").collect():
                units = np.frombuffer(row.units, np.int32)
                class_of[units] = np.frombuffer(row.classes, np.int32)
                table = table + np.frombuffer(row.change, np.int64).reshape(sides, 2 * sides)
                moves += len(units)
            shared.destroy()
        if not moves:
            break
    return class_of


def cluster(training: DataFrame, often: np.ndarray, totals: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of every unit, 1 to ``classes``; class 0 is the begin and end of a text.

    Units start in classes by the rank of their slots' totals, endings by their number.
    """
    class_of = np.zeros(UNITS, np.uint8)
    order = np.argsort(-totals, kind="stable")
    class_of[order] = 1 + np.arange(SLOTS) % classes
    class_of[SLOTS:] = 1 + np.arange(ENDINGS) % classes
    for _ in range(REFRESHES):
        cells = neighbours(training, often, class_of, classes + 1)
        class_of = exchanged(cells, class_of.copy(), classes + 1)
    return class_of


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, held_out, words: numbers in the block, packed) and of words (number, word, n) by block."""
    kind = docs.schema["doc_id"].dataType
    schema = f"block long, doc_id {kind.simpleString()}, held_out boolean, words binary, number int, word binary, n long"
    columns = ["block", "doc_id", "held_out", "words", "number", "word", "n"]

    def run(batches):
        part, done, size = TaskContext.get().partitionId() << 32, 0, 0
        codec = _packer()
        numbers: dict[bytes, int] = {}
        totals: list[np.ndarray] = []

        def vocabulary():
            count = len(numbers)
            n = sum((np.pad(total, (0, count - len(total))) for total in totals), np.zeros(count, np.int64))
            words = list(numbers)
            for start in range(0, count, 50_000):
                stop = min(count, start + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(stop - start, part + done)), pa.nulls(stop - start, id_type), pa.nulls(stop - start, pa.bool_()),
                     pa.nulls(stop - start, pa.binary()), pa.array(np.arange(start, stop, dtype=np.int32)),
                     pa.array(words[start:stop], pa.binary()), pa.array(n[start:stop])], columns)

        id_type = pa.int64()
        for batch in common.slices(batches):
            id_type = batch.column("doc_id").type
            rows = []
            for data in batch.column("text").to_pylist():
                number = numbers.setdefault
                rows.append(np.array([number(word, len(numbers)) for word in data.lower().split()], np.int32))
                size += len(data)
            learn = ~np.array(batch.column("held_out").to_pylist(), bool)
            flat = np.concatenate([np.empty(0, np.int32), *(row for row, teaches in zip(rows, learn) if teaches)])
            totals.append(np.bincount(flat, minlength=len(numbers)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part + done)), batch.column("doc_id"), batch.column("held_out"),
                 pa.array([_pack(codec, *_planes(row)) for row in rows], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                 pa.nulls(n, pa.int64())], columns)
            if size >= BLOCK_BYTES:
                yield from vocabulary()
                numbers, totals, size, done = {}, [], 0, done + 1
        yield from vocabulary()

    return pin(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "blocks")


def _planes(row: np.ndarray) -> list[np.ndarray]:
    """The bytes of numbers, lowest first, which pack better apart."""
    return [(row >> shift).astype(np.uint8) for shift in (0, 8, 16, 24)]


def _numbers(codec: pa.Codec, piece: bytes) -> np.ndarray:
    planes = _unpack(codec, piece, np.uint8, np.uint8, np.uint8, np.uint8)
    return sum((plane.astype(np.int32) << shift for plane, shift in zip(planes, (0, 8, 16, 24))), np.zeros(len(planes[0]), np.int32))


def _pair_counts(rows: DataFrame, count: int) -> np.ndarray:
    """Counts of neighbouring classes over all texts of ``rows`` (classes); every text begins after and ends with class 0."""

    def run(batches):
        total = np.zeros(count * count, np.int64)
        for batch in common.list_slices(batches, "classes"):
            column = batch.column("classes")
            lengths = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten(), np.int64)
            spread = np.zeros(len(flat) + len(lengths) + 1, np.int64)
            if len(flat):
                spread[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = flat
            total += np.bincount(spread[:-1] * count + spread[1:], minlength=count * count)
        yield pa.RecordBatch.from_arrays([common.lists(np.array([count * count]), pa.array(total.astype(float)))], ["counts"])

    counted = rows.select("classes").mapInArrow(run, "counts array<double>")
    sums = counted.agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts")).first().counts
    return np.array(sums).reshape(count, count) if sums else np.zeros((count, count))


def scores(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows of ``docs``
    (doc_id, text, held_out); rows that are not held out teach."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "held_out", common.utf8(F.col("text")).alias("text"))
    totals = slot_totals(texts.where("not held_out"))
    often = totals >= LEAST
    class_of = cluster(texts.where("not held_out"), often, totals, classes)

    both = blocks(texts)
    numbered = both.where("word is null").select("block", "doc_id", "held_out", "words")
    vocabulary = both.where("word is not null").select("block", "number", "word", "n")
    counts = pin(_with_units(vocabulary.groupBy("word").agg(F.sum("n").alias("c")), often), "counts")
    known = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = numbered.where("not held_out").count()
    train_tokens, distinct = (known.n or 0) + ends, (known.v or 0) + (ends > 0)
    located = vocabulary.select("block", "number", "word").join(counts, "word").select(
        F.col("block").alias("part"), "number", "c", "unit")

    shared_classes = spark.sparkContext.broadcast(class_of)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        number = np.asarray(right.column("number"))
        c, label = np.zeros(len(number), np.int64), np.zeros(len(number), np.int8)
        c[number], label[number] = np.asarray(right.column("c")), shared_classes.value[np.asarray(right.column("unit"))]
        logs = np.log10(c + 1.0)
        codec = _packer()
        rows = [_numbers(codec, piece.as_py()) for piece in left.column("words")]
        lengths = np.array([len(row) for row in rows])
        flat = np.concatenate([np.empty(0, np.int32), *rows])
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        pa.default_memory_pool().release_unused()
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"),
            "n_known": pa.array(np.bincount(owner, c[flat] > 0, len(lengths)).astype(np.int64)),
            "log_counts": pa.array(np.bincount(owner, logs[flat], len(lengths))),
            "classes": common.lists(lengths, pa.array(label[flat]))})

    sequences = pin(numbered.groupBy("block").cogroup(located.groupBy("part")).applyInArrow(
        placed, f"doc_id {kind}, held_out boolean, n_known long, log_counts double, classes array<tinyint>"), "classes")
    model = _model(_pair_counts(sequences.where("not held_out"), classes + 1), *_class_sizes(counts, class_of, classes + 1))
    shared = spark.sparkContext.broadcast(tuple(model))

    def score(batches):
        transition, emission = shared.value
        for batch in common.list_slices(batches, "classes"):
            column = batch.column("classes")
            lengths = np.diff(np.asarray(column.offsets))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            label = np.asarray(column.flatten(), np.int64)
            spread = np.zeros(len(label) + len(lengths) + 1, np.int64)
            spread[np.arange(len(label)) + owner + 1] = label
            moves = transition[spread[:-1], spread[1:]]
            whose = np.repeat(np.arange(len(lengths)), lengths + 1)
            path = np.bincount(whose, moves, len(lengths))
            emitted = np.bincount(owner, emission[label], len(lengths))
            model_score = path + np.asarray(batch.column("log_counts")) - emitted
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths + 1, pa.int64()), batch.column("n_known"),
                 batch.column("log_counts"), pa.array(model_score)],
                ["doc_id", "held_out", "n_words", "n_known", "log_counts", "score"])

    scored = sequences.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, n_words long, n_known long, log_counts double, score double")
    return scored.select(
        "doc_id", "held_out", F.col("n_words").alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + math.log10(ends + 1) - F.col("n_words") * math.log10(train_tokens + distinct + 1)).alias("base_score"),
        "score")


def _with_units(counts: DataFrame, often: np.ndarray) -> DataFrame:
    """(word, c, unit) of a table of words and counts."""
    shared = counts.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        units = Units(shared.value)
        for batch in batches:
            found = units.of(batch.column("word").to_pylist()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(found)], ["word", "c", "unit"])

    return counts.mapInArrow(run, "word binary, c long, unit int")


def _class_sizes(counts: DataFrame, class_of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of each class."""
    shared = counts.sparkSession.sparkContext.broadcast(class_of)

    def run(batches):
        tokens, types = np.zeros(count), np.zeros(count)
        for batch in batches:
            c, label = np.asarray(batch.column("c")), shared.value[np.asarray(batch.column("unit"))]
            tokens += np.bincount(label, c, count)
            types += np.bincount(label, c > 0, count)
        yield pa.RecordBatch.from_arrays([common.lists(np.array([2 * count]), pa.array(np.concatenate([tokens, types])))], ["n"])

    sums = counts.select("c", "unit").mapInArrow(run, "n array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("n"))).alias("n")).first().n
    sums = np.array(sums) if sums else np.zeros(2 * count)
    return sums[:count], sums[count:]


def _model(table: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> Model:
    """Smoothed probabilities from counts of class pairs (class 0 is the end) and sizes of classes."""
    count = len(table)
    overall = (table.sum(0) + 1) / (table.sum() + count)
    transition = np.log10((table + count * overall) / (table.sum(1, keepdims=True) + count))
    return Model(transition, np.log10(tokens + types + 1))
