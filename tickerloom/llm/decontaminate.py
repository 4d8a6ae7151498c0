"""Benchmark passages in documents, found within a number of word edits.

A document leaks an item of n words if some run of its words, of whatever length, is within floor((1 - similarity) n)
edits of it; a document shorter than the item can be such a run.  Three steps find the runs:

1. The q-gram lemma, without loss: such a run keeps at least n - 1 - 2 edits of the n - 1 word pairs of the item and
   lies in a window of n + edits words, so wider windows with fewer pairs of the item are out.
2. All item-sized windows (n words, and up to the edits fewer or more) with these pairs and the items take the CGK random
   walk (a random bit of step and word decides whether to move on), which turns edits into differing places; repeated
   sampling of places gives the keys under which windows must meet items.  There are so many tables that a pair at the
   limit is met with probability TARGET_RECALL; tests measure it on edited passages.  Pairs that have met leave the walks.
3. The distance with free ends is computed exactly in all windows of the first step, for the pairs that have met.

Words are runs without ASCII white space or punctuation, A-Z lower-cased.  Null and empty texts and items have no
words and never match; equal rows get equal answers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickerloom.llm import common
from tickerloom.session import pin

SIMILARITY = 0.8
TARGET_RECALL = 0.9999
ASSUMED_DIFFERENCE = 0.6  # share of places in which the walks of a window and an item at the limit differ
SAMPLED = 1
TABLES_PER_WALK = 2
BLOCK_WORDS = 1_000_000  # words of items in one broadcast
PAIR_BITS = 20
RUN = 13
WINDOWS_AT_ONCE = 4096

_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
assert len(_CLEAN) == 256 and set(string.punctuation.encode()).isdisjoint(_CLEAN)


def words(data: bytes) -> list[bytes]:
    return data.translate(_CLEAN).split()


def tables(recall: float = TARGET_RECALL, difference: float = ASSUMED_DIFFERENCE, sampled: int = SAMPLED) -> int:
    """Tables so that a pair with this share of differing places meets in one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - difference) ** sampled))


def allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def distances(left: Sequence[int], right: Sequence[int], free: bool) -> list[int]:
    """Edit distance of ``left`` to the words of ``right`` up to each place, by bit-parallel columns (Myers).

    With ``free`` the run that ends at the place may begin anywhere; without, it begins with ``right``.
    """
    places: dict[int, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | 1 << i
    full, top = (1 << len(left)) - 1, 1 << len(left) - 1
    up, down, distance, found = full, 0, len(left), []
    for word in right:
        equal = places.get(word, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(rise & top) - bool(fall & top)
        found.append(distance)
        rise, fall = rise << 1 | (not free), fall << 1
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal
    return found


def edit_distance(left: Sequence[int], right: Sequence[int]) -> int:
    """Levenshtein distance; exact for any lengths."""
    if not len(left) or not len(right):
        return len(left) + len(right)
    return distances(left, right, False)[-1]


def nearest(item: Sequence[int], words: Sequence[int], most: int) -> tuple[int, int, int] | None:
    """(distance, first word, number of words) of the run of ``words`` nearest to ``item`` within ``most`` edits.

    Of equally near runs the one that ends first, and of these the one whose length is nearest to the item's.
    """
    ends = distances(item, words, True)
    distance = min(ends, default=most + 1)
    if distance > most or distance >= len(item):
        return None
    stop = ends.index(distance) + 1
    back = distances(item[::-1], words[max(0, stop - len(item) - distance):stop][::-1], False)
    n = min((abs(n - len(item)), n) for n, found in enumerate(back, 1) if found == distance)[1]
    return distance, stop - n, n


def walk(rows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of word rows (padded with 0): the words seen in 2 x width steps."""
    at = np.zeros(len(rows), np.int64)
    padded = np.hstack([rows, np.zeros((len(rows), 1), rows.dtype)])
    seen, every = np.empty((len(rows), 2 * rows.shape[1]), rows.dtype), np.arange(len(rows))
    for step in range(seen.shape[1]):
        word = padded[every, at]
        seen[:, step] = word
        bit = common.mixed(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 100_003 + step))
        at = np.minimum(at + (bit >> np.uint64(63)).astype(np.int64), rows.shape[1])
    return seen


def walk_keys(rows: np.ndarray, lengths: np.ndarray, n_tables: int, first: int, seed: int = 5):
    """(table, keys of all rows) for the tables of the walk that begins with table ``first``: sampled places of the walk,
    within the steps that the length needs."""
    places = np.random.default_rng(seed).random((n_tables, SAMPLED))
    seen = walk(rows, seed + first)
    for table in range(first, min(first + TABLES_PER_WALK, n_tables)):
        key = lengths.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(table)
        for place in places[table]:
            symbol = seen[np.arange(len(rows)), (place * 2 * lengths).astype(np.int64)]
            key = common.mixed(key + symbol.astype(np.uint64))
        yield table, key


class Index:
    """Items of one block: their words, their word pairs, and the tables of their keys."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float):
        split = [(item_id, words(text)) for item_id, text in items]
        split = [(item_id, found) for item_id, found in split if found]
        self.vocabulary = {word: i for i, word in enumerate(dict.fromkeys(w for _, found in split for w in found), 1)}
        self.ids = [item_id for item_id, _ in split]
        self.items = [[self.vocabulary[word] for word in found] for _, found in split]
        self.lengths = np.array([len(item) for item in self.items], np.int64)
        self.edits = np.array([allowed(n, similarity) for n in self.lengths.tolist()], np.int64)
        self.width = int((self.lengths + self.edits).max(initial=1))
        self.needed = np.maximum(0, self.lengths - 1 - 2 * self.edits)
        # Pairs of all items by slot of their hash, with the items that hold them; equal slots only let more through.
        slots = [np.unique(self.pair_slots(np.array(item))) for item in self.items]
        holder = np.repeat(np.arange(len(slots)), [len(slot) for slot in slots])
        flat = np.concatenate([np.empty(0, np.int64), *slots])
        order = np.argsort(flat, kind="stable")
        self.holders = holder[order]
        self.slot_starts = np.searchsorted(flat[order], np.arange((1 << PAIR_BITS) + 1)).astype(np.int32)
        # Any widened window that has the needed pairs of some item has this many in a row of RUN pairs.
        runs = np.ceil(np.maximum(self.lengths + self.edits - 1, 1) / RUN)
        self.least_in_run = int(np.ceil(self.needed / runs).min(initial=1 << 30))
        rows = np.zeros((len(self.items), self.width), np.int64)
        for row, item in zip(rows, self.items):
            row[:len(item)] = item
        self._known_ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n_tables = tables()
        self.tables = [(np.sort(key), np.argsort(key, kind="stable")) for first in range(0, self.n_tables, TABLES_PER_WALK)
                       for _, key in walk_keys(rows, self.lengths, self.n_tables, first)]

    @staticmethod
    def pair_slots(ids: np.ndarray) -> np.ndarray:
        pair = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64)
        return (common.mixed(pair) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def windows(self, documents: list[np.ndarray]):
        """(document, item, sums) where some widened window has enough word pairs in common with the item; ``sums`` counts
        the document's pairs of the item that end up to each word."""
        ends = np.cumsum([len(ids) + 1 for ids in documents], dtype=np.int64)
        if not len(ends):
            return
        flat = np.zeros(ends[-1], np.int64)  # a 0 after every document
        starts = ends - np.array([len(ids) + 1 for ids in documents])
        for ids, start in zip(documents, starts):
            flat[start:start + len(ids)] = ids
        slots = np.where((flat[:-1] > 0) & (flat[1:] > 0), self.pair_slots(flat), -1)
        held = np.where(slots >= 0, self.slot_starts[slots + 1] - self.slot_starts[slots], 0)
        upto = np.concatenate([[0], np.cumsum(held > 0)])
        dense = np.flatnonzero(upto[RUN:] - upto[:-RUN] >= self.least_in_run) if len(upto) > RUN else np.arange(len(upto))
        # Every document that some word of a dense run lies in, those in the middle of the run too.
        marks = np.zeros(len(documents) + 2, np.int64)
        np.add.at(marks, np.searchsorted(ends, dense, "right"), 1)
        np.add.at(marks, np.minimum(np.searchsorted(ends, dense + RUN - 1, "right"), len(documents)) + 1, -1)
        near = np.flatnonzero(np.cumsum(marks)[:len(documents)] > 0).tolist()
        for place in near if self.least_in_run else range(len(documents)):
            n = len(documents[place])
            own, count = slots[starts[place]:starts[place] + n - 1], held[starts[place]:starts[place] + n - 1]
            at = np.repeat(np.arange(len(own)), count)
            first = np.repeat(self.slot_starts[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(own) else at
            item = self.holders[first + np.arange(len(at))]
            totals = np.bincount(item, minlength=len(self.items))
            for wanted in np.flatnonzero((totals >= self.needed) & (self.lengths - self.edits <= n)).tolist():
                marks = np.zeros(n, np.int64)
                marks[at[item == wanted] + 1] = 1
                sums = np.cumsum(marks)
                if len(self._starts(sums, int(self.lengths[wanted] + self.edits[wanted]), int(self.needed[wanted]))):
                    yield place, wanted, sums

    @staticmethod
    def _starts(sums: np.ndarray, width: int, needed: int) -> np.ndarray:
        """First words of the windows (cut to the document) that hold this many pairs."""
        width = min(width, len(sums))
        return np.flatnonzero(sums[width - 1:] - sums[:len(sums) - width + 1] >= needed)

    def _scan(self, words: np.ndarray, item: int, sums: np.ndarray, most: int) -> tuple[int, int, int] | None:
        """The nearest run within ``most`` edits in all of a document's windows that have the pairs for it."""
        n = int(self.lengths[item])
        width = min(n + most, len(words))
        starts = self._starts(sums, width, max(0, n - 1 - 2 * most))
        if n == 1:  # one word is equal or not
            starts = np.flatnonzero(words == self.items[item][0])[:1]
        if not len(starts):
            return None
        breaks = np.flatnonzero(np.diff(starts) > width)
        best = None
        for first, last in zip(starts[np.concatenate([[0], breaks + 1])].tolist(), starts[np.concatenate([breaks, [-1]])].tolist()):
            found = nearest(self.items[item], words[first:last + width].tolist(), most)
            if found and (best is None or found[0] < best[0]):
                best = found[0], first + found[1], found[2]
        return best

    def _ends(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """For every word number the words of the item before its first place, and those behind its last (a lot if it has none)."""
        if item not in self._known_ends:
            words = np.array(self.items[item])
            before, behind = (np.full(len(self.vocabulary) + 1, 1 << 30) for _ in range(2))
            before[words[::-1]] = np.arange(len(words))[::-1]
            behind[words] = np.arange(len(words))[::-1]
            self._known_ends = {item: (before, behind)}  # pairs come by item
        return self._known_ends[item]

    def _item_sized(self, words: np.ndarray, item: int, sums: np.ndarray):
        """Rows (padded with 0) of the windows that may be within the edits: all windows as long as the item, and shorter and
        longer by up to its edits, but for those that the ends rule out; of equal windows one.

        Some nearest run begins and ends with words that it shares with the item, for an odd word at an end can go at no
        cost.  The words of the item before the first one and behind the last one are then edits, and so is what the run is
        longer than the rest of the item; each of these edits costs one word pair, any other one at most two.
        """
        n, edits, needed = int(self.lengths[item]), int(self.edits[item]), int(self.needed[item])
        known = np.where(words <= len(self.vocabulary), words, 0)  # a number beyond the vocabulary is in no item, as 0 is
        before, behind = (ends[known] for ends in self._ends(item))
        first_words = np.flatnonzero(before <= edits)
        for size in range(max(1, n - edits), min(len(sums), n + edits) + 1):
            starts = first_words[:np.searchsorted(first_words, len(sums) - size, "right")]
            cut = before[starts] + behind[starts + size - 1]
            starts = starts[(cut + np.maximum(0, size - n + cut) <= edits) & (sums[starts + size - 1] - sums[starts] >= needed + (cut if needed else 0))]
            for i in range(0, len(starts), WINDOWS_AT_ONCE):
                rows = np.zeros((len(starts[i:i + WINDOWS_AT_ONCE]), self.width), np.int64)
                rows[:, :size] = words[starts[i:i + WINDOWS_AT_ONCE, None] + np.arange(size)]
                if len(rows):
                    yield np.unique(rows, axis=0) if len(rows) > 64 else rows
            # The same with the words that stand in the place of the item's missing ends, where the walks keep step.
            first, stop = starts - before[starts], starts + size + behind[starts + size - 1]
            for start, end in {(max(0, a), min(len(words), b)) for a, b in zip(first.tolist(), stop.tolist()) if b - a > size}:
                row = np.zeros((1, self.width), np.int64)
                row[0, :end - start] = words[start:end]
                yield row

    def _meet(self, rows: np.ndarray, owner: np.ndarray, items: np.ndarray, found: set[tuple[int, int]]) -> None:
        """Add the (document, item) pairs of which a window and the item have a key in common in some table to ``found``."""
        for first in range(0, self.n_tables, TABLES_PER_WALK):
            if first:
                left = np.array([pair not in found for pair in zip(owner.tolist(), items.tolist())], bool)
                rows, owner, items = rows[left], owner[left], items[left]
            if not len(rows):
                return
            rows = rows[:, :int((self.lengths + self.edits)[items].max())]
            for table, key in walk_keys(rows, self.lengths[items], self.n_tables, first):
                sorted_keys, order = self.tables[table]
                low, high = np.searchsorted(sorted_keys, key, "left"), np.searchsorted(sorted_keys, key, "right")
                for window in np.flatnonzero(high > low).tolist():
                    found.update((int(owner[window]), item) for item in order[low[window]:high[window]].tolist())

    def met(self, documents: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]) -> set[tuple[int, int]]:
        """The (document, item) pairs of which an item-sized window and the item have a key in common in some table."""
        found: set[tuple[int, int]] = set()
        waiting: list[tuple[np.ndarray, int, int]] = []

        def flush() -> None:
            owner, items = (np.concatenate([np.full(len(rows), at[k]) for rows, *at in waiting]) for k in (0, 1))
            self._meet(np.concatenate([rows for rows, *_ in waiting]), owner, items, found)
            waiting.clear()

        n_rows = 0
        for (place, item), sums in sorted(pairs.items(), key=lambda pair: (self.lengths[pair[0][1]], pair[0][1], pair[0][0])):
            for rows in self._item_sized(documents[place], item, sums):
                if (place, item) in found:
                    break
                waiting.append((rows, place, item))
                n_rows += len(rows)
                if n_rows >= WINDOWS_AT_ONCE:
                    flush()
                    n_rows = 0
        if waiting:
            flush()
        return found & pairs.keys()

    def matches(self, documents: list[np.ndarray], similarity: float) -> list[tuple[int, int, int, int]]:
        """(document, item, first word, distance): the nearest, then first, run of each document and item."""
        pairs = {(place, item): sums for place, item, sums in self.windows(documents)}
        if not pairs:
            return []
        best = {pair: self._scan(documents[pair[0]], pair[1], pairs[pair], int(self.edits[pair[1]])) for pair in sorted(self.met(documents, pairs))}
        return [(place, item, found[1], found[0]) for (place, item), found in best.items() if found]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): one row for each row of ``docs`` and item that it leaks.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  The items are broadcast in blocks of bounded
    size, however many there are; every block meets all documents.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select("item_id", common.utf8(F.col("text")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (6 * BLOCK_WORDS)))
    rows = docs.where("text is not null").select("doc_id", common.utf8(F.col("text")).alias("text"))
    doc_kind, item_kind = (frame.schema[name].dataType for frame, name in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = (f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, first_word long, n_words int, distance int")
    item_type = to_arrow_type(item_kind)
    result = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = common.share(spark, Index([tuple(row) for row in part.collect()], similarity))

        def run(batches, shared=shared):
            index = shared()
            known = index.vocabulary.get
            for batch in common.slices(batches):
                documents = []
                for data in batch.column("text").to_pylist():
                    documents.append(np.array([known(word, 0) for word in words(data)], np.int64))
                found = index.matches(documents, similarity)
                doc_ids = batch.column("doc_id").take(pa.array([row[0] for row in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array([index.ids[row[1]] for row in found], item_type),
                     pa.array([row[2] for row in found], pa.int64()),
                     pa.array([len(index.items[row[1]]) for row in found], pa.int32()),
                     pa.array([row[3] for row in found], pa.int32())],
                    ["doc_id", "item_id", "first_word", "n_words", "distance"])

        here = rows.mapInArrow(run, schema)
        result = here if result is None else result.unionByName(here)
    return result


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows with a null doc_id are judged by their text like any other."""
    key = common.unused(docs, "_leak_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, similarity)
    leaking = pin(found.select(F.col("doc_id").alias(key)).distinct(), "leaking")
    return common.among(keyed, key, leaking, False).select(*docs.columns)
