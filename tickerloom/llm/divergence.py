"""Source divergence audit over a quadtree of the group-term count matrix of each language.

Rows of the matrix are the (language, source) groups, and the language itself; columns are the terms that the language
keeps.  Columns are dealt over blocks by a hash of the term and stand in order of their totals inside a block, so zeros
lie together; rows come in bands of 63 groups and the language.  A block of a band is a row of squares of 64 x 64 cells,
each a k2-tree with k = 2: every level has four bits for each nonempty quadrant of the level above, and the cells at the
bottom that are not zero hold their share p.  Two groups are compared by walking their trees down together: where both
quadrants are empty, all cells in them have one value, so the whole quadrant is priced by its width; only quadrants with
a nonzero cell on either side are entered, and their cells are priced one by one.  All pairs of a block are walked in
step, level by level.  A task adds up its blocks before it sends one matrix for each pair of bands.

Shares and distances are integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and floor((p - q)^2 / (p + q)) of two of them,
exact for N up to 9 * 10^15.  Null text, lang and source count as ''.  A group without terms has rows all the same; a
language that keeps no term gives value 0.  Repeated rows count again; doc_id is not read, nor is any other column.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import slices
from tickerloom.session import pin

# A-Z become a-z; every other ASCII character that is no letter becomes a blank.
FOLDED = bytes(code + 32 if 65 <= code <= 90 else code if code >= 128 or 97 <= code <= 122 else 32 for code in range(256))
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
LEVELS = 6
SIDE = 1 << LEVELS          # cells along a square
BAND = SIDE - 1             # groups in a band; the last row is the language
TERMS_PER_BLOCK = 448
HELD_ENTRIES = 400_000      # counts that a task holds before it sends them on
HELD_BANDS = 128            # matrices of 64 x 64 sums that a task holds
STEP_CELLS = 200_000        # pairs of cells walked in step
BROADCAST_ROWS = 200_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, held): occurrences and documents of every term of every group; terms as bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            keys = [key for key, (times, _) in found.items() for _ in range(len(times))]
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([key[0] for key in keys], pa.string()), "source": pa.array([key[1] for key in keys], pa.string()),
                "term": pa.array([term for times, _ in found.values() for term in times], pa.binary()),
                "n": pa.array([n for times, _ in found.values() for n in times.values()], pa.int64()),
                "held": pa.array([held[term] for times, held in found.values() for term in times], pa.int64())})

        for batch in slices(batches, 2 << 20):
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text")):
                words = (text.as_py() or b"").translate(FOLDED).split()
                times, held = found.setdefault((lang, source), (Counter(), Counter()))
                times.update(words)
                held.update(set(words))
            if sum(len(times) for times, _ in found.values()) > HELD_ENTRIES:
                yield rows()
                found.clear()
        yield rows()

    return (
        groups_of(docs).select("lang", "source", F.col("text").cast("binary").alias("text"))
        .mapInArrow(count, "lang string, source string, term binary, n long, held long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    )


def groups_of(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(name), empty).alias(name) for name in ("lang", "source", "text")])


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 * count / size) for count <= size, by three digits at a time so that longs hold it."""
    whole, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        step = rest * 1000
        whole, rest = whole * 1000 + _div(step, size), step % size
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def build(rows: np.ndarray, columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of each level (four for each nonempty node above) and the order of the cells in the bottom level.

    Squares are the roots: node i of the top level is square i, all of which are there.
    """
    squares = int(columns.max()) // SIDE + 1 if len(columns) else 1
    node, levels = columns // SIDE, []
    above = squares
    place = node.copy()
    code = np.zeros(len(rows), np.int64)
    for depth in range(LEVELS - 1, -1, -1):
        quadrant = ((rows >> depth) & 1) * 2 + ((columns >> depth) & 1)
        code = code * 4 + quadrant
        bits = np.zeros(above * 4, bool)
        bits[place * 4 + quadrant] = True
        rank = np.cumsum(bits) - 1
        place = rank[place * 4 + quadrant]
        levels.append(bits)
        above = int(bits.sum())
    return levels, np.argsort(place, kind="stable")


def packed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> bytes:
    """A block of a band as bytes: number of squares and bits of each level, then the values of the bottom cells."""
    levels, order = build(rows, columns)
    head = np.array([len(bits) for bits in levels], np.int32).tobytes()
    return head + b"".join(np.packbits(bits).tobytes() for bits in levels) + values[order].astype(np.int32).tobytes()


def unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Child pointers of each level (-1: an empty quadrant) and the values of the bottom cells."""
    sizes = np.frombuffer(data, np.int32, LEVELS)
    at, levels = sizes.nbytes, []
    for size in sizes:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=int(size)).astype(bool)
        at += (int(size) + 7) // 8
        levels.append(np.where(bits, np.cumsum(bits) - 1, -1))
    return levels, np.frombuffer(data, np.int32, -1, at).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def walk(one, other, zero_one: np.ndarray, zero_other: np.ndarray, width: int, squares: np.ndarray, same: bool):
    """Sums of distances of all pairs (row of ``one``, row of ``other``) over some squares of a block, and the bottom cells
    (row, column, value) in which a row of ``one`` that holds the term stands above the language, the last row of ``other``.

    ``zero_*``: the share of an empty cell of each row, -1 where there is no such row.  ``width``: columns of the block.
    ``same``: pairs with row <= row only; the others are not filled in.
    """
    (levels_one, values_one), (levels_other, values_other) = one, other
    empty = np.zeros((SIDE, SIDE), np.int64)     # empty columns of each pair
    # Nodes walked in step: row ranges a and b, column range c, and the places of both quadrants in their trees (-1: empty).
    c = squares
    a, b = np.zeros_like(c), np.zeros_like(c)
    here, there = (np.where(c * 4 < len(levels[0]), c, -1) for levels in (levels_one, levels_other))
    parts = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)])
    for depth in range(LEVELS):
        size = SIDE >> (depth + 1)
        a, b, c = ((values[:, None] * 2 + parts[:, k]).ravel() for k, values in enumerate((a, b, c)))
        here, there = (
            np.where(node >= 0, levels[depth][np.maximum(node, 0) * 4 + (rows & 1) * 2 + (c & 1)], -1)
            for node, levels, rows in ((np.repeat(here, 8), levels_one, a), (np.repeat(there, 8), levels_other, b)))
        some_one, some_other = ((zero >= 0).reshape(-1, size).any(axis=1) for zero in (zero_one, zero_other))
        wanted = some_one[a] & some_other[b] & (c * size < width)
        if same:
            wanted &= a <= b
        nothing = wanted & (here < 0) & (there < 0)
        priced = np.zeros((SIDE // size, SIDE // size), np.int64)
        np.add.at(priced, (a[nothing], b[nothing]), np.minimum(size, width - c[nothing] * size))
        empty += np.kron(priced, np.ones((size, size), np.int64))
        enter = wanted & ~nothing
        a, b, c, here, there = (values[enter] for values in (a, b, c, here, there))
    sums = empty * distance(np.maximum(zero_one, 1)[:, None], np.maximum(zero_other, 1)[None, :])
    p, q = zero_one[a], zero_other[b]
    p[here >= 0] = values_one[here[here >= 0]]
    q[there >= 0] = values_other[there[there >= 0]]
    value = distance(p, q)
    np.add.at(sums, (a, b), value)
    above = (b == BAND) & (a < BAND) & (here >= 0) & (p > q)
    return sums, (a[above], c[above], value[above])


def _best(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, keep: int) -> np.ndarray:
    """Places of the cells whose value is at least the ``keep``-th largest of their row."""
    order = np.lexsort((-values, rows))
    first = np.searchsorted(rows[order], rows[order])
    last = np.searchsorted(rows[order], rows[order], "right") - 1
    limit = values[order][np.minimum(first + keep - 1, last)]
    return order[values[order] >= limit]


def _walked(units: DataFrame, keep: int) -> DataFrame:
    """Rows (lang, band_a, row_a, band_b, row_b, block, column, value): sums of pairs (block -1), and cells above the language."""
    fields = ["band_a", "row_a", "band_b", "row_b", "block", "column", "value"]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}

        def batch_of(lang: str, *columns) -> pa.RecordBatch:
            n = max(np.size(column) for column in columns)
            arrays = [pa.array(np.broadcast_to(np.asarray(column, np.int64), n)) for column in columns]
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *arrays], ["lang", *fields])

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, band_a, band_b), total in held.items():
                rows_a, rows_b = np.triu_indices(SIDE, 1) if band_a == band_b else np.indices((BAND, BAND)).reshape(2, -1)
                yield batch_of(lang, band_a, rows_a, band_b, rows_b, -1, -1, total[rows_a, rows_b])
            held.clear()

        for batch in batches:
            for unit in batch.to_pylist():
                key = (unit["lang"], unit["band_a"], unit["band_b"])
                same = key[1] == key[2]
                one = unpacked(unit["tree_a"])
                other = one if same else unpacked(unit["tree_b"])
                zeros = [np.array(unit[name], np.int64) for name in ("zeros_a", "zeros_b")]
                if not same:        # a language is compared with the groups of its band only once
                    zeros[0][BAND] = zeros[1][BAND] = -1
                total = held.setdefault(key, np.zeros((SIDE, SIDE), np.int64))
                squares = np.arange((unit["width"] + SIDE - 1) // SIDE)
                step = max(1, STEP_CELLS // (int((zeros[0] >= 0).sum()) * int((zeros[1] >= 0).sum()) * SIDE + 1))
                cells = []
                for start in range(0, len(squares), step):
                    part, above = walk(one, other, *zeros, unit["width"], squares[start:start + step], same)
                    total += part
                    cells.append(above)
                if same and cells:
                    rows, columns, values = (np.concatenate(column) for column in zip(*cells))
                    best = _best(rows, columns, values, keep)
                    if len(best):
                        yield batch_of(key[0], key[1], rows[best], key[1], BAND, unit["block"], columns[best], values[best])
                if len(held) >= HELD_BANDS:
                    yield from sums()
        yield from sums()

    return units.mapInArrow(walked, "lang string, " + ", ".join(f"{name} long" for name in fields))


def _small(table: DataFrame) -> DataFrame:
    """``table``, broadcast if it is known to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, source, other, value) for both orders of all pairs of groups, ``other`` null being the language
    as a whole; and (lang, source, term, value) for terms that a group holds and has a larger share of than its language:
    the ``keep`` of the largest value in every block, more where they tie.
    """
    counts = pin(term_counts(docs), "terms")
    kept = pin(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("held").alias("held"))
        .where(F.col("held") >= least_documents).drop("held"), "kept")
    # One row a language, and one row a group.
    found = pin(groups_of(docs).select("lang", "source").distinct(), "found")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("size"))
    langs = found.select("lang").distinct().join(sizes, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("size", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS_PER_BLOCK)).alias("blocks"))
    langs = pin(langs, "langs")
    dealt = kept.join(_small(langs), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.col("total").desc(), "term")) - 1
    columns = pin(dealt.select("lang", "term", "block", place.alias("column"), share(F.col("total") + 2, F.col("whole")).alias("p")), "columns")
    placed = counts.select("lang", "source", "term", "n").join(columns.select("lang", "term", "block", "column"), ["lang", "term"])
    placed = pin(placed.drop("term"), "cells")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    totals = placed.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = found.join(totals, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.expr("whole").alias("lang_whole"), "v", (F.coalesce("n", F.lit(0)) + 2 * F.col("v")).alias("whole"),
        _div(number, F.lit(BAND)).alias("band"), (number % BAND).cast("long").alias("row"))
    groups = pin(groups, "groups")

    cells = placed.join(_small(groups.select("lang", "source", "band", "row", "whole")), ["lang", "source"]).select(
        "lang", "band", "block", "row", "column", share(F.col("n") + 2, F.col("whole")).alias("p"))
    bands = groups.select("lang", "band").distinct()
    whole = columns.join(_small(bands), "lang").select("lang", "band", "block", F.lit(BAND).cast("long").alias("row"), "column", "p")

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        rows, places, values = (table.column(name).to_numpy() for name in ("row", "column", "p"))
        return pa.table({
            "lang": [key[0].as_py()], "band": [key[1].as_py()], "block": [key[2].as_py()],
            "width": [int(places.max()) + 1], "tree": pa.array([packed(rows, places, values)], pa.binary())})

    schema = "lang string, band long, block long, width long, tree binary"
    trees = cells.unionByName(whole).groupBy("lang", "band", "block").applyInArrow(plant, schema)
    nothing = packed(*[np.empty(0, np.int64)] * 3)
    bare = groups.where("v = 0").select("lang", "band").distinct().select(
        "lang", "band", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("width"), F.lit(nothing).alias("tree"))
    zero = F.when(F.col("v") > 0, share(F.lit(2).cast("long"), F.col("whole"))).otherwise(F.lit(1).cast("long"))
    zeros = groups.groupBy("lang", "band").agg(F.map_from_entries(F.collect_list(F.struct("row", zero.alias("p")))).alias("by_row"))
    zeros = zeros.select("lang", "band", F.transform(F.sequence(F.lit(0), F.lit(BAND)), lambda row: F.when(
        row == BAND, F.lit(1).cast("long")).otherwise(F.coalesce(F.col("by_row")[row.cast("long")], F.lit(-1).cast("long")))).alias("zeros"))
    units = trees.unionByName(bare).join(_small(zeros), ["lang", "band"])
    units = pin(units, "trees")

    one = units.select("lang", "block", "width", *[F.col(name).alias(f"{name}_a") for name in ("band", "tree", "zeros")])
    other = units.select("lang", "block", *[F.col(name).alias(f"{name}_b") for name in ("band", "tree", "zeros")])
    pairs = one.select("*", F.col("band_a").alias("band_b"), F.lit(None).cast("binary").alias("tree_b"), F.col("zeros_a").alias("zeros_b"))
    if groups.where("band > 0").count():
        pairs = pairs.unionByName(one.join(other, ["lang", "block"]).where("band_a < band_b"))
    walked = pin(_walked(pairs, keep), "walked")

    names = groups.select("lang", "band", "row", "source")
    side_a = _small(names.select("lang", F.col("band").alias("band_a"), F.col("row").alias("row_a"), "source"))
    side_b = _small(names.select("lang", F.col("band").alias("band_b"), F.col("row").alias("row_b"), F.col("source").alias("other")))
    sums = walked.where("block = -1").groupBy("lang", "band_a", "row_a", "band_b", "row_b").agg(F.sum("value").alias("value"))
    named = sums.join(side_a, ["lang", "band_a", "row_a"]).join(side_b, ["lang", "band_b", "row_b"], "left")
    named = pin(named.where(F.col("other").isNotNull() | (F.col("row_b") == BAND)).select("lang", "source", "other", "value"), "pairs")
    turned = named.where("other is not null").select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    above = (
        walked.where("block >= 0").join(side_a, ["lang", "band_a", "row_a"]).join(columns.drop("p"), ["lang", "block", "column"])
        .select("lang", "source", F.col("term").cast("string").alias("term"), "value")
    )
    return named.unionByName(turned), above


def report(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, keep: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language (``pair``), and the ``keep`` terms in which a
    group stands out most against its language (``term``); largest values first, then items by their bytes."""
    pairs, terms = audit(docs, least_documents, keep)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    near = pairs.where("other is not null").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    far = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return near.select("*", rank).unionByName(far.select("*", rank).where(F.col("rank") <= keep))
