"""Ranked lexical search, reversed: the items are indexed and the documents are streamed through the index.

The inverted index over the terms of the items (a stated query set, in blocks of bounded size) is broadcast.  One pass
over all documents counts their terms (N, L, and df of the terms that the items have).  A second pass streams the term
counts of each document through the index, adds up integer scores and keeps, for each item and task, a heap of the
best documents; heaps are merged in two steps, first within slices of the documents.  No postings of documents are
ever written or shuffled.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased.  Null texts have no
terms; documents and items without terms are in no result.  Rows of items with one item_id (null too) are one item with
the terms of all their texts.  Every row of documents is a document of its own; documents of equal score and id, and
null ids (last), come in any order.  Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import slices
from tickerloom.session import pin

# A-Z become a-z; every other ASCII character that is no letter or digit becomes a blank.
FOLDED = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or 97 <= code <= 122 or 48 <= code <= 57 else 32 for code in range(256))
BLOCK_POSTINGS = 200_000
MERGE_SLICES = 64
LAST = 1 << 63      # sorts null ids behind all others
ROUND_CELLS = 2_000_000

# Fixed values of the score: base and slope of the length share in percent, scale of the saturation, weight of lengths.
BASE_SHARE, LENGTH_SHARE, SCALE, LENGTH_WEIGHT = 10, 90, 1_000_000_000, 8


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct; terms as bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(text))) for text in batch.column("text").to_pylist()]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(terms) for terms in found]))
            column = pa.array([term for terms in found for term in terms], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(rows), column], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(split, f"item_id {kind}, term binary").distinct()


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list, dict[bytes, int], np.ndarray, np.ndarray]]:
    """(item ids, place of each term, ends of the postings of each term, postings) for blocks of ``most`` postings at most.

    Items are read in order of their number through the driver, one block at a time; an item of more than ``most``
    terms is a block of its own.
    """
    pinned = pin(item_terms(items), "items")
    ids: list = []
    postings: dict[bytes, list[int]] = {}
    held = 0
    grouped = pinned.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    for row in grouped.toLocalIterator():
        if ids and held + len(row.terms) > most:
            yield _index(ids, postings)
            ids, postings, held = [], {}, 0
        for term in row.terms:
            postings.setdefault(bytes(term), []).append(len(ids))
        ids.append(row.item_id)
        held += len(row.terms)
    if ids:
        yield _index(ids, postings)


def _index(ids: list, postings: dict[bytes, list[int]]):
    lengths = [len(found) for found in postings.values()]
    return (ids, {term: place for place, term in enumerate(postings)}, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            np.fromiter((item for found in postings.values() for item in found), np.int64, sum(lengths)))


def _counted(rows: DataFrame, places) -> tuple[int, int, dict[int, int]]:
    """N, L and the document counts of the indexed terms: one pass, at most one row a term from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = places.value
        known, held, documents, total = index.keys(), Counter(), 0, 0
        for batch in slices(batches):
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                documents += bool(found)
                total += len(found)
                held.update(known & set(found))
        places_, counts = [-1, -2, *(index[term] for term in held)], [documents, total, *held.values()]
        yield pa.RecordBatch.from_pydict({"place": pa.array(places_, pa.int64()), "n": pa.array(counts, pa.int64())})

    sums = rows.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    by = {row.place: row.n for row in sums.collect()}  # one row for each indexed term of the block
    return by.pop(-1, 0), by.pop(-2, 0), by


def _best(rows: DataFrame, index, weights: np.ndarray, documents: int, total: int, keep: int) -> DataFrame:
    """(item, doc_id, score): the best ``keep`` of every task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ends, postings, weight, n_items = index.value
        known = places.keys()
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        least = np.zeros(n_items, np.int64)          # a score below it does not enter the heap
        round_rows = max(1, ROUND_CELLS // max(1, n_items))
        waiting: list[tuple] = []                    # (doc_id, places, contributions) of some documents

        def settle() -> None:
            found = np.concatenate([row[1] for row in waiting])
            spans = ends[found + 1] - ends[found]
            owner = np.repeat(np.arange(len(waiting)), [len(row[1]) for row in waiting])
            start = np.repeat(ends[found] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans)
            items = postings[np.arange(int(spans.sum())) + start]
            cells = np.zeros(len(waiting) * n_items, np.int64)
            np.add.at(cells, np.repeat(owner * n_items, spans) + items, np.repeat(np.concatenate([row[2] for row in waiting]), spans))
            cells = cells.reshape(len(waiting), n_items)
            for i, item in zip(*np.nonzero((cells > 0) & (cells >= least))):
                heap = heaps[item]
                entry = (int(cells[i, item]), -waiting[i][0])
                if len(heap) < keep:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == keep:
                    least[item] = heap[0][0]
            waiting.clear()

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms_of(text.as_py())
                counts = Counter(words)
                hits = sorted(known & counts.keys())
                if not hits:
                    continue
                length = BASE_SHARE + LENGTH_SHARE * len(words) * documents // total
                found = np.array([places[term] for term in hits])
                times = np.array([counts[term] for term in hits], np.int64)
                waiting.append((LAST if doc_id is None else doc_id, found,
                                weight[found] * (SCALE * times // (1000 * times + LENGTH_WEIGHT * length))))
                if len(waiting) >= round_rows:
                    settle()
        if waiting:
            settle()
        rows_ = [(item, None if -key == LAST else -key, score) for item, heap in enumerate(heaps) for score, key in heap]
        yield pa.RecordBatch.from_pydict({
            "item": pa.array([row[0] for row in rows_], pa.int32()), "doc_id": pa.array([row[1] for row in rows_], pa.int64()),
            "score": pa.array([row[2] for row in rows_], pa.int64())})

    return rows.mapInArrow(search, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, keep: int = 10, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``keep`` best documents (doc_id long, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType
    results = []
    for ids, places, ends, postings in _blocks(items, block_postings):
        known = spark.sparkContext.broadcast(places)
        documents, total, held = _counted(rows, known)
        weights = np.array([
            math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(place, 0) + 1))) for place in range(len(places))], np.int64)
        index = spark.sparkContext.broadcast((places, ends, postings, weights, len(ids)))
        best = pin(_best(rows, index, weights, documents, total, keep), "heaps")
        known.destroy()
        index.destroy()
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        part = Window.partitionBy("item", F.pmod(F.hash("doc_id"), F.lit(MERGE_SLICES))).orderBy(*order)
        whole = Window.partitionBy("item").orderBy(*order)
        merged = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= keep)
        merged = merged.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= keep)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind.simpleString()}")
        results.append(merged.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
