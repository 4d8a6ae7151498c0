"""Merkle fingerprints of documents: sentences under paragraphs under sections under one root.

A text is cut into leaves: up to ``LEAF`` code points without an end mark or line end, with the marks, blanks and line
ends that follow.  Cuts by length begin anew at each sentence.  A leaf with a line end closes its paragraph; the paragraph also closes
its section if an empty line follows or the leaf's digest begins with 0 or 1, so borders depend on the content and an
edit moves none but those beside it.  The digest of a node is the SHA-256 of the digests of its children; equal roots
mean equal texts, and two trees are compared branch by branch: equal sections are skipped, equal paragraphs of the other
sections too, and what is left are the edits.

All of it is DataFrame functions.  Null text counts as empty; the empty text has a root of its own (no leaf).  Repeated
rows are equal in every column; null and repeated doc_ids are ordinary rows.  An empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import pin

LEAF = 32
ENDS = ",.!?。！？"
LEAVES = rf"[^{ENDS}\n]{{1,{LEAF}}}[{ENDS}]{{0,20}}[ \n]{{0,20}}|[{ENDS}\n][{ENDS} \n]{{0,200}}"
HEX = 32            # hex digits kept of the digest of a leaf
COPIES_PER_ROW = 10_000


def _leaf(piece: Column) -> Column:
    """Digest, length in three digits, and the border that the leaf closes: , leaf  ; paragraph  | section."""
    parts = F.struct(
        F.substring(F.sha2(piece, 256), 1, HEX).alias("digest"), F.char_length(piece).alias("size"),
        piece.contains("\n").alias("line"), piece.contains("\n\n").alias("gap"))

    def joined(leaf: Column) -> Column:
        wide = leaf["gap"] | leaf["digest"].startswith("0") | leaf["digest"].startswith("1")
        border = F.when(~leaf["line"], ",").when(wide, "|").otherwise(";")
        return F.concat(leaf["digest"], F.lpad(leaf["size"].cast("string"), 3, "0"), border)

    return F.element_at(F.transform(F.array(parts), joined), 1)


def with_leaves(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the leaves of a text (never null) in order, each as ``_leaf`` writes it."""
    return df.withColumn(name, F.transform(F.regexp_extract_all(text, F.lit(LEAVES), F.lit(0)), _leaf))


def _sections(leaves: Column) -> Column:
    """The leaves of each section as one string, paragraphs apart by ``;``."""
    return F.filter(F.split(F.array_join(leaves, ""), r"\|"), lambda section: section != "")


def _paragraphs(section: Column) -> Column:
    return F.filter(F.split(section, ";"), lambda paragraph: paragraph != "")


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def root(leaves: Column) -> Column:
    """Digest of the whole tree over ``leaves``."""
    return _digest(F.transform(
        _sections(leaves), lambda section: _digest(F.transform(_paragraphs(section), lambda paragraph: F.sha2(paragraph, 256)))))


def codes(leaves: Column) -> Column:
    """Distinct leaves as longs: 48 bits of the digest, then the length in 8 bits."""
    return F.array_distinct(F.transform(
        leaves, lambda leaf: F.conv(F.substring(leaf, 1, 12), 16, 10).cast("long") * 256 + F.substring(leaf, HEX + 1, 3).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Code points in the distinct leaves that two trees share, as a share of those in either; 1 for two empty texts."""

    def size(leaves: Column) -> Column:
        return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, leaf: total + leaf % 256)

    either = size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(size(F.array_intersect(a, b)) / either)


def tree(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections): each section with its digest and its paragraphs (digest, start, size in code points)."""
    leaves = with_leaves(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), F.col("_text"), "_leaves")
    size = lambda paragraph: F.aggregate(
        F.filter(F.split(paragraph, ","), lambda leaf: leaf != ""), F.lit(0),
        lambda total, leaf: total + F.substring(leaf, HEX + 1, 3).cast("int"))
    sized = F.transform(_sections(F.col("_leaves")), lambda section: F.transform(
        _paragraphs(section), lambda paragraph: F.struct(F.sha2(paragraph, 256).alias("digest"), size(paragraph).alias("size"))))

    def total(paragraphs: Column) -> Column:
        return F.aggregate(paragraphs, F.lit(0), lambda n, paragraph: n + paragraph["size"])

    start = leaves.withColumn("_sized", sized).withColumn("_sizes", F.transform("_sized", total))
    # Starts: running sums of sizes, one step a node, kept in the accumulator beside the list built so far.
    ahead = F.aggregate(
        "_sizes", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")))["starts"]

    def placed(section: Column, i: Column) -> Column:
        paragraphs = F.aggregate(
            section,
            F.struct(F.get("_starts", i).alias("at"),
                     F.array().cast("array<struct<digest:string,start:int,size:int>>").alias("list")),
            lambda state, p: F.struct(
                (state["at"] + p["size"]).alias("at"),
                F.concat(state["list"], F.array(F.struct(p["digest"].alias("digest"), state["at"].alias("start"), p["size"].alias("size"))))
                .alias("list")))["list"]
        return F.struct(_digest(F.transform(section, lambda p: p["digest"])).alias("digest"), paragraphs.alias("paragraphs"))

    return start.withColumn("_starts", ahead).select(
        "doc_id", root(F.col("_leaves")).alias("root"), F.transform("_sized", placed).alias("sections"))


def edits(a: Column, b: Column) -> Column:
    """Paragraphs (start, size) of the sections ``a`` that tree ``b`` lacks; branches with equal digests are not entered."""

    def digests(nodes: Column) -> Column:
        return F.transform(nodes, lambda node: node["digest"])

    def open_(one: Column, other: Column) -> Column:
        return F.flatten(F.transform(
            F.filter(one, lambda section: ~F.array_contains(digests(other), section["digest"])), lambda section: section["paragraphs"]))

    there = digests(open_(b, a))
    return F.transform(
        F.filter(open_(a, b), lambda paragraph: ~F.array_contains(there, paragraph["digest"])),
        lambda paragraph: F.struct(paragraph["start"].alias("start"), paragraph["size"].alias("size")))


def _neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, key, size, ...) with ``before`` (key, size): the row before by doc_id (nulls first) and key, in a circle.

    Rows are range-partitioned and pinned; inside a partition the row before is found by a window, and the last row of
    each partition, one row for each, is handed on to the next one that is not empty.
    """
    rows = pin(keys.repartitionByRange("doc_id", "key").withColumn("bucket", F.spark_partition_id()), "order")
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    last = rows.groupBy("bucket").agg(F.max_by(F.struct("key", "size"), F.struct("doc_id", "key")).alias("end"))
    # One row a partition.  The first one takes the end of the last one.
    circle = Window.orderBy("bucket")
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = last.select("bucket", F.coalesce(F.lag("end").over(circle), F.last("end").over(whole)).alias("handed"))
    found = rows.withColumn("before", F.lag(F.struct("key", "size")).over(inside)).join(ends, "bucket")
    return found.withColumn("before", F.coalesce("before", "handed")).drop("bucket", "handed")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness; see ``op13`` in queries.py.

    The edited text has its last quarter replaced by as much of the head of the next document (ascending doc_id, nulls
    first, rows of one doc_id by a digest of the row; the last is followed by the first).  Equal rows follow each other,
    so all but one of them are followed by their own text: they travel as one row with a count and are multiplied at the end.
    Only the head that the row before needs is sent to it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text).cast("binary")))
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"))
    distinct = (
        rows.select("doc_id", "key", F.char_length("text").cast("long").alias("size"))
        .groupBy("doc_id", "key", "size").agg(F.count("*").alias("copies"))
    )
    order = pin(_neighbours(distinct), "neighbours")
    # One text for each key: reduced in the map tasks, and shuffled once for both sides of the join below.
    known = rows.select("key", "text").dropDuplicates(["key"]).join(order, "key")
    known = with_leaves(known, F.col("text"), "leaves").withColumn("codes", codes(F.col("leaves")))
    quarter = F.floor(F.col("size") / 4).cast("int")
    head = known.select(
        F.col("before.key").alias("key"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("before.size") / 4).cast("int")).alias("head"),
        F.col("codes").alias("next_codes"))
    # One row followed by the next text, and for repeated rows one more that stands for all followed by their own.
    turns = F.when(F.col("copies") > 1, F.array(F.lit(1).cast("long"), F.col("copies") - 1)).otherwise(F.array(F.lit(1).cast("long")))
    both = known.select("key", "doc_id", "text", "size", "leaves", "codes", F.posexplode(turns).alias("turn", "times")).join(head, "key")
    both = both.withColumn("head", F.when(F.col("turn") == 0, F.col("head")).otherwise(F.substring(F.col("text"), F.lit(1), quarter)))
    both = both.withColumn("next_codes", F.when(F.col("turn") == 0, F.col("next_codes")).otherwise(F.col("codes")))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("size") - quarter).cast("int")), F.col("head")))
    both = with_leaves(both, F.col("edited"), "edited_leaves").withColumn("edited_codes", codes(F.col("edited_leaves")))
    done = both.select(
        "doc_id", F.col("size").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        root(F.col("leaves")).alias("fingerprint"), root(F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
        F.size("leaves").cast("long").alias("n_leaves"), "times")
    # Copies come back in parts, dealt over the cluster, so that no task writes all rows of a large group.
    parts = done.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES_PER_ROW).cast("long"))))
    spread = parts.hint("rebalance")
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.col("times") - F.col("part"), F.lit(COPIES_PER_ROW).cast("long")))
    return spread.withColumn("copy", F.explode(copies)).drop("copy", "part", "times")
