"""Jaccard join of documents on word shingles, by prefix filters under several global orders.

Two sets with Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 of each, whatever
the order of all tokens is.  Every order here puts frequent tokens last: a table of fixed size counts all shingles
by hash, a token's band grows with the count of its slot, and a hash with the order's own seed decides inside a
band.  A pair is a candidate if it shares a prefix token under every order and its sizes and places allow enough
overlap; candidates are verified on whole sets.

Pairs are formed per prefix token of the first order in two rounds.  In the first, each set meets the most central
set of the token (the one with the fewest rare tokens), which unites groups of copies with one pair for each set.
In the second, tokens whose sets are still in different components give all their pairs across components.  Links
inside a component that was found are not needed to know it, so the components are exact.

Sets are shared by all rows with the same shingles, so exact copies and repeated rows form no pairs.  Null and empty
texts have an empty set, link with nothing and are their own component; with null doc_ids only, a component has a
null id.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common
from tickerloom.llm.components import connected_components
from tickerloom.session import pin

SLOT_BITS = 17
ORDERS = 2
PARITY_WORDS = 16  # numbers of 64 bits for sets of up to 512 tokens; twice as many for each doubling
SKETCH_WORDS = 4   # numbers of the folded parities that every pair meets first


def _hashed(texts: list[bytes], hashes: common.WordHashes, size: int) -> list[np.ndarray]:
    """Shingle hashes of each text, with repeats; the texts of a batch are hashed together."""
    split = [text.lower().split() for text in texts]
    words = hashes.of([word for found in split for word in found])
    runs = common.shingle_hashes(words, size) if len(words) >= size else np.empty(0, np.uint64)
    out, start = [], 0
    for found in split:
        n = len(found)
        out.append(runs[start:start + n - size + 1] if n >= size else common.shingle_hashes(words[start:start + n], size))
        start += n
    return out


def slot_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles of ``docs`` (text as bytes) by the leading bits of their hash; 2^SLOT_BITS numbers."""
    shift = np.uint64(64 - SLOT_BITS)

    def run(batches):
        hashes, total = common.WordHashes(), np.zeros(1 << SLOT_BITS, np.int64)
        for batch in common.slices(batches):
            found = np.concatenate([np.empty(0, np.uint64), *_hashed(batch.column("text").to_pylist(), hashes, size)])
            total += np.bincount((found >> shift).astype(np.int64), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["slot", "n"])

    counts = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << SLOT_BITS, np.int64)
    total[counts["slot"].to_numpy(int)] = counts["n"].to_numpy(int)
    return total


def bands(counts: np.ndarray) -> np.ndarray:
    """Band of each slot: 0 up to what chance gives an average slot, then one more for each doubling of the excess."""
    mean = counts.mean()
    excess = (counts - mean) / (4 * np.sqrt(mean) + 1)
    return np.where(excess > 1, np.floor(np.log2(np.maximum(excess, 1))) + 1, 0).clip(0, 31).astype(np.uint64)


def needed_overlap(left: Column, right: Column, percent: int) -> Column:
    """Least intersection of two sets of these sizes: ceil(t / (1 + t) * sum)."""
    return F.ceil(F.lit(percent) * (left + right) / F.lit(100 + percent) - 1e-9)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, key, n, k1, k2, rare, tokens, others, parity, sketch): key of the row, set size, 128-bit key of the set, number of band-0
    tokens, the prefix under the first order, the prefixes under the other orders cut to 32 bits, the parities, and the parities folded to
    SKETCH_WORDS, of each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), common.utf8(F.col("text")).alias("text"))
    shared = spark.sparkContext.broadcast(bands(slot_counts(rows, size)))
    shift = np.uint64(64 - SLOT_BITS)

    def run(batches):
        hashes = common.WordHashes()
        for batch in common.slices(batches, 1 << 20):
            sets = [np.unique(found) for found in _hashed(batch.column("text").to_pylist(), hashes, size)]
            sizes = np.array([len(found) for found in sets])
            prefix = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
            flat = np.concatenate([np.empty(0, np.uint64), *sets])
            band = shared.value[(flat >> shift).astype(np.int64)]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            chosen = []
            for order in range(ORDERS):
                place = (band << np.uint64(58)) | (common.mixed(flat + np.uint64(0x632BE59BD9B4E019 * (order + 1) % 2 ** 64)) >> np.uint64(6))
                chosen.append([flat[a:b][np.argsort(place[a:b], kind="stable")[:p]] for a, b, p in zip(starts, starts[1:], prefix)])
            keys = [np.frombuffer(hashlib.md5(found.tobytes()).digest(), np.int64) for found in sets]
            rare = [int((band[a:b] == 0).sum()) for a, b in zip(starts, starts[1:])]
            tokens = np.concatenate([np.empty(0, np.uint64), *chosen[0]])
            others = [np.concatenate([found[order] for order in range(1, ORDERS)]) for found in zip(*chosen)] if ORDERS > 1 else chosen[0]
            cut = np.concatenate([np.empty(0, np.uint64), *others]).astype(np.uint32).view(np.int32)
            parity = [parities(found) for found in sets]
            sketch = [folded(row) for row in parity]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array([int(k[0]) for k in keys], pa.int64()),
                 pa.array([int(k[1]) for k in keys], pa.int64()), pa.array(rare, pa.int32()),
                 common.lists(prefix, common.signed(tokens)), common.lists(prefix * (ORDERS - 1), pa.array(cut)),
                 common.lists(np.array([len(row) for row in parity]), pa.array(np.concatenate([np.empty(0, np.int64), *parity]))),
                 common.lists(np.full(len(sketch), SKETCH_WORDS), pa.array(np.concatenate([np.empty(0, np.int64), *sketch])))],
                ["doc_id", "key", "n", "k1", "k2", "rare", "tokens", "others", "parity", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, key long, n long, k1 long, k2 long, rare int, tokens array<long>, others array<int>, "
                                "parity array<long>, sketch array<long>")
    return pin(made.withColumn("node", F.monotonically_increasing_id()), "signatures")


def parities(found: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens of a set in each slot of their hash, packed; two slots or more for each token.

    Halves of a longer row, combined by exclusive or, are the shorter row of the same set.
    """
    slots = 64 * PARITY_WORDS
    while slots < 2 * len(found):
        slots *= 2
    slot = (common.mixed(found + np.uint64(0x1D8E4E27C47D124F)) & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=slots) & 1).astype(np.uint8)).view(np.int64)


def folded(row: np.ndarray) -> np.ndarray:
    """The parities of a set in 64 * SKETCH_WORDS slots."""
    return np.bitwise_xor.reduce(row.reshape(-1, SKETCH_WORDS), axis=0)


def _possible(percent: int) -> Column:
    """Sizes and places in the first order leave room for the overlap that two sets need (columns of a and b)."""
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return room >= needed_overlap(F.col("a_n"), F.col("b_n"), percent)


def _folded(name: str) -> Column:
    half = (F.size(name) / 2).cast("int")
    return F.zip_with(F.slice(name, F.lit(1), half), F.slice(name, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _close(left: Column, right: Column, percent: int) -> Column:
    """Equally long parities differ in no more places than the sets of a and b may: one set's tokens that the other lacks."""
    differing = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(differing, F.lit(0), lambda total, bits: total + bits)
    return differ <= F.col("a_n") + F.col("b_n") - 2 * needed_overlap(F.col("a_n"), F.col("b_n"), percent)


def _sides(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of ``known`` (node, ...) for a and for b."""
    left = known.select([F.col(name).alias("a" if name == "node" else f"a_{name}") for name in known.columns])
    right = known.select([F.col(name).alias("b" if name == "node" else f"b_{name}") for name in known.columns])
    return pairs.join(left, "a").join(right, "b")


def _agreed(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a prefix token under every further order and whose parities allow the similarity.

    All pairs meet the short folded parities first; prefixes and whole parities travel with the pairs that are left.
    """
    near = _sides(pairs, signed.select("node", "n", "sketch")).where(_close(F.col("a_sketch"), F.col("b_sketch"), percent))
    near = pin(near.select("a", "b"), "near")
    width = F.size("others") / (ORDERS - 1)
    columns = [F.slice("others", (width * i + 1).cast("int"), width.cast("int")).alias(f"o{i}") for i in range(ORDERS - 1)]
    found = _sides(near, signed.select("node", "n", "parity", *columns))
    for i in range(ORDERS - 1):
        found = found.where(F.arrays_overlap(f"a_o{i}", f"b_o{i}"))
    # Sizes that may be similar differ by less than a factor of two, so one fold makes the rows equally long.
    one = F.when(F.size("a_parity") > F.size("b_parity"), _folded("a_parity")).otherwise(F.col("a_parity"))
    two = F.when(F.size("b_parity") > F.size("a_parity"), _folded("b_parity")).otherwise(F.col("b_parity"))
    return found.where(_close(one, two, percent)).select("a", "b")


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, compared in full."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = pin(signed.join(nodes, "node").select("node", F.col("key").alias("_key")), "wanted")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_key"), common.utf8(F.col("text")).alias("text"))
    n = wanted.count()
    texts = pin(rows.join(F.broadcast(wanted) if n <= common.BROADCAST_ROWS else wanted, "_key").select("node", "text"), "texts")
    if texts.count() > n:  # rows equal in doc_id and text
        texts = pin(texts.dropDuplicates(["node"]), "one-text-each")
    compared = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
    )

    def run(batches):
        hashes = common.WordHashes()
        for batch in common.slices(batches, 2 << 20, "left", "right"):
            left = [np.unique(found) for found in _hashed(batch.column("left").to_pylist(), hashes, size)]
            right = [np.unique(found) for found in _hashed(batch.column("right").to_pylist(), hashes, size)]
            keep = []
            for x, y in zip(left, right):
                common_size = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common_size >= percent * (len(x) + len(y) - common_size))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pin(compared.mapInArrow(run, "a long, b long"), "links")


def joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, key, is_first) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach; ``n_links`` counts the verified links of the row's set
    to other sets that were needed to find the components; ``is_first`` marks one row of each component (the smallest
    doc_id) and every row with an empty set; ``key`` is a hash of doc_id and text.
    """
    signed = signatures(docs, size, percent)
    classes = pin(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("node").alias("rep")), "classes")
    members = pin(signed.select("node", "doc_id", "key", "n", "k1", "k2").join(classes, ["k1", "k2"], "left"), "members")
    reps = members.where("node = rep").select("node")

    # Prefix tokens in more than one set.  The place is the number of earlier tokens.
    prefix = signed.where("n > 0").select("node", "rare", "n", F.posexplode("tokens").alias("at", "token"))
    packed = prefix.select("token", "node", F.struct("n", "at", "rare").alias("info"))
    # Counts are pinned before they are joined, so that both sides of the join are shuffled and a hot token can be split.
    shared = pin(prefix.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "shared")
    repeated = packed.join(shared, "token").join(reps, "node").select("token", "node", "info.*")
    repeated = pin(repeated, "repeated")

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    leaders = repeated.groupBy("token").agg(
        F.min_by(F.struct("node", "n", "at"), F.struct("rare", "node")).alias("l"), F.count("*").alias("c")).where("c > 1")
    leaders = pin(leaders, "leaders")
    left = repeated.select("token", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"))
    central = leaders.select("token", F.col("l.node").alias("b"), F.col("l.n").alias("b_n"), F.col("l.at").alias("b_at"))
    first = pin(pairs_of(left.join(central, "token").where(F.col("a") != F.col("b")).where(_possible(percent))), "first-pairs")
    links = _verified(pin(_agreed(first, signed, percent), "candidates"), signed, docs, size, percent)
    labels = connected_components(links)

    labelled = repeated.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    mixed = pin(mixed, "mixed")
    open_rows = pin(labelled.join(mixed, "token"), "open")
    one = open_rows.select("token", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.col("label").alias("a_label"))
    two = open_rows.select("token", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("label").alias("b_label"))
    across = one.join(two, "token").where("a_label < b_label").where(_possible(percent))
    second = pin(_agreed(pairs_of(across).join(first, ["a", "b"], "left_anti"), signed, percent), "candidates")
    more = _verified(second, signed, docs, size, percent)
    links = links.unionByName(more)
    labels = connected_components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    placed = (
        members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    placed = pin(placed.select("doc_id", "key", "node", "n", "label", "n_links"), "placed")
    first = F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    smallest = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest"), first.alias("first"))
    smallest = pin(smallest, "smallest")
    return placed.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "key", F.coalesce(F.col("node") == F.col("first"), F.lit(True)).alias("is_first"))


def representatives(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of ``docs`` for each group, the one with the smallest doc_id; rows with an empty set all stay."""
    groups = joined(docs.select("doc_id", "text"), size, percent)
    key = common.unused(docs, "_row_key")
    rows = groups.groupBy(F.col("key").alias(key)).agg(F.max("is_first").alias("first"), F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    rows = pin(rows.where("not first or (n > 1 and size > 0)"), "repeated-rows")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    one_each = common.among(keyed, key, rows.where("not first").select(key), False)
    twice = rows.where("first").select(key)
    if not twice.isEmpty():  # rows equal in doc_id and text
        one_each = common.among(one_each, key, twice, False).unionByName(
            common.among(one_each, key, twice, True).dropDuplicates([key]))
    return one_each.select(*docs.columns)
