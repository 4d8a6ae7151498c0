"""Divergence audit, reversed search and Merkle fingerprints against plain versions and their SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import divergence, fingerprints, oracles, queries, search
from tests.compare import _bag, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, key string, rank int, item string, p long"


def words(rng, n):
    return " ".join("w" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in np.minimum(rng.zipf(1.4, n), 99))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(260):  # more than one band of sources in one language
        out.append((i, words(rng, int(rng.integers(0, 60))), "en" if i < 230 else "fr", f"s{i % 70}"))
    out += [(1000, None, "en", None), (1001, "", None, "s1"), (1002, "12 -- 34", "xx", "s1"), (1003, "only once", "xx", "s2"),
            (1004, "ÉCOLE École wak WAK", "fr", "s1"), (1005, "ÉCOLE wak", "fr", "s2"), (None, "wak wal", "en", "s3"), (None, "wak wal", "en", "s3"),
            (1006, "wak wal " * 3000, "en", "s0"), (1006, "wak wal " * 3000, "en", "s0"), (1007, "no퟿space" * 4000, "fr", "s9")]
    out += [(1100 + i, "the same row", "de", "copies") for i in range(40)] + [(1200, "the same row", "de", "copies")] * 30
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(*row, None, "t", "k", 1, "i", 2) for row in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audited(rows, least, keep):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = Counter()
    for lang, source in groups:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        v = len(kept)

        def shares(names):
            n = sum((counts[lang, name] for name in names), Counter())
            size = sum(n[t] for t in kept)
            return [1 + (10**9 * (n[t] + 2)) // (size + 2 * v) for t in kept], n

        mine, n = shares([source])
        pairs, terms = [], []
        for other in {s for g, s in groups if g == lang} - {source}:
            theirs, _ = shares([other])
            pairs.append((-sum((p - q) ** 2 // (p + q) for p, q in zip(mine, theirs)), other))
        whole, _ = shares([s for g, s in groups if g == lang])
        terms = [(-((p - q) ** 2 // (p + q)), t) for t, p, q in zip(kept, mine, whole) if n[t] and p > q]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))
            for rank, (value, item) in enumerate(found if part == "pair" else found[:keep], 1):
                out[lang, source, part, item, -value, rank] += 1
    return out


@pytest.mark.parametrize("least, keep", [(2, 3), (10, 10), (1000, 10)])
def test_divergence_equals_a_plain_version(docs, rows, least, keep):
    done = divergence.report(docs, least, keep)
    assert done.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, done.collect())) == audited(rows, least, keep)


def test_divergence_in_many_blocks(monkeypatch, docs, rows):
    monkeypatch.setattr(divergence, "TERMS_PER_BLOCK", 7)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 50)
    monkeypatch.setattr(divergence, "STEP_CELLS", 1)
    assert Counter(map(tuple, divergence.report(docs, 2, 5).collect())) == audited(rows, 2, 5)


def test_divergence_of_nothing(spark):
    assert divergence.report(empty(spark)).count() == 0


def test_trees_hold_their_cells():
    rng = np.random.default_rng(4)
    for width in (1, 63, 64, 65, 300):
        table = np.where(rng.random((divergence.SIDE, width)) < rng.choice([0.02, 0.6]), rng.integers(1, 10**9, (divergence.SIDE, width)), 0)
        table[divergence.BAND] = 5
        rows_, columns = np.nonzero(table)
        mixed = rng.permutation(len(rows_))
        tree = divergence.unpacked(divergence.packed(rows_[mixed], columns[mixed], table[rows_, columns][mixed]))
        assert sorted(tree[1]) == sorted(table[table > 0])
        zeros = rng.integers(1, 100, divergence.SIDE)
        squares = np.arange((width + 63) // 64)
        sums, _ = divergence.walk(tree, tree, zeros, zeros, width, squares, True)
        dense = np.where(table > 0, table, zeros[:, None])
        for a, b in ((0, 1), (3, 40), (62, 63), (5, 5)):
            assert sums[a, b] == divergence.distance(dense[a], dense[b]).sum()


def test_shares_are_exact(spark):
    cases = [(2, 3), (10**14, 10**14 + 1), (9 * 10**15 - 1, 9 * 10**15), (1, 7 * 10**15)]
    done = spark.createDataFrame(cases, "a long, b long").select("a", "b", divergence.share(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(row.p == 1 + 10**9 * row.a // row.b for row in done)


def searched(rows, items, keep):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))

    counts = [(doc_id, Counter(terms(text))) for doc_id, text, *_ in rows]
    counts = [(doc_id, found) for doc_id, found in counts if found]
    n, total = len(counts), sum(sum(found.values()) for _, found in counts)
    held = Counter(term for _, found in counts for term in found)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = Counter()
    for item, these in wanted.items():
        scored = []
        for doc_id, found in counts:
            m = 100 - 90 + (90 * sum(found.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * found[t]) // (1000 * found[t] + 8 * m))
                        for t in these if t in found)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:keep], 1):
            out[item, rank, doc_id, -score] += 1
    return out


ITEMS = [(0, "wak wal WAM"), (1, None), (2, ""), (3, "École the same ROW"), (4, "nothing here at all zzz"), (5, "wak"), (5, "wbk the"), (None, "wal row"), (7, "- 12 34")]


@pytest.mark.parametrize("kind, block", [("long", 200_000), ("int", 3), ("string", 1)])
def test_search_equals_a_plain_version(spark, docs, rows, kind, block):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string").withColumn("item_id", F.col("item_id").cast(kind))
    done = search.ranked(docs, items, 10, block).collect()
    plain = searched(rows, ITEMS, 10)
    name = (lambda i: None if i is None else str(i)) if kind == "string" else (lambda i: i)
    assert Counter(map(tuple, done)) == Counter({(name(i), *rest): n for (i, *rest), n in plain.items()})


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(empty(spark), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(docs, items.where("item_id = 1")).count() == 0


def test_heaps_keep_the_best_of_many_rounds(monkeypatch, spark, docs, rows):
    monkeypatch.setattr(search, "ROUND_CELLS", 1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(map(tuple, search.ranked(docs, items, 4).collect())) == searched(rows, ITEMS, 4)


def plain_leaves(text):
    out = []
    for piece in re.findall(fingerprints.LEAVES, text):
        digest = hashlib.sha256(piece.encode()).hexdigest()[:fingerprints.HEX]
        border = "," if "\n" not in piece else "|" if "\n\n" in piece or digest[0] in "01" else ";"
        out.append((piece, digest, border))
    assert "".join(piece for piece, *_ in out) == text
    return out


def plain_root(text):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    body = "".join(f"{d}{len(piece):03d}{border}" for piece, d, border in plain_leaves(text))
    return digest("".join(digest("".join(digest(p) for p in s.split(";") if p)) for s in body.split("|") if s))


def plain_likeness(a, b):
    a, b = ({(d[:12], len(piece)) for piece, d, _ in plain_leaves(text)} for text in (a, b))
    either = sum(n for _, n in a | b)
    return sum(n for _, n in a & b) / either if either else 1.0


def fingerprinted(rows):
    texts = [(doc_id, text or "") for doc_id, text, *_ in rows]
    key = lambda row: (row[0] is not None, row[0] or 0, hashlib.md5(f"{'-' if row[0] is None else row[0]}:{row[1]}".encode()).digest())
    texts.sort(key=key)
    out = Counter()
    for i, (doc_id, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        out[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_root(text), plain_root(edited),
            plain_likeness(text, edited), plain_likeness(text, after), len(plain_leaves(text))] += 1
    return out


def test_fingerprints_equal_a_plain_version(monkeypatch, docs, rows):
    monkeypatch.setattr(fingerprints, "COPIES_PER_ROW", 7)
    more = [(2000, "One line.\nTwo lines!\n\nNext part; and more.\n" * 30 + "😀 end。次の文。" * 20, "a", "b"), (2001, "\n\n\n", "a", "b"), (2002, "...", "a", "b")]
    both = docs.unionByName(docs.sparkSession.createDataFrame([(*row, None, "t", "k", 1, "i", 2) for row in more], SCHEMA))
    assert Counter(map(tuple, fingerprints.compared(both).collect())) == fingerprinted(rows + more)


def test_fingerprints_of_few_rows(spark, docs):
    assert fingerprints.compared(empty(spark)).count() == 0
    assert fingerprints.tree(empty(spark)).count() == 0
    one = [(7, "Alone. Here.", None, None)]
    frame = spark.createDataFrame(one, "doc_id long, text string, lang string, source string")
    assert Counter(map(tuple, fingerprints.compared(frame).collect())) == fingerprinted(one)


def test_branches_locate_edits(spark):
    rng = np.random.default_rng(5)
    lines = [words(rng, 12) + ".\n" for _ in range(60)]
    changed = list(lines)
    changed[20], changed[41] = "another line here.\n", changed[41].replace("w", "v", 1)
    start = [len("".join(lines[:i])) for i in range(60)]
    frame = spark.createDataFrame([(1, "".join(lines)), (2, "".join(changed)), (3, "".join(lines))], "doc_id long, text string")
    trees = fingerprints.tree(frame)
    by = {row.doc_id: row for row in trees.collect()}
    assert by[1].root == by[3].root == plain_root("".join(lines)) and by[1].root != by[2].root
    found = [(p.start, p.size) for s in by[1].sections for p in s.paragraphs]
    assert found == list(zip(start, map(len, lines)))
    a, b = trees.where("doc_id = 1").select(F.col("sections").alias("a")), trees.where("doc_id = 2").select(F.col("sections").alias("b"))
    spans = a.join(b).select(fingerprints.edits(F.col("a"), F.col("b")).alias("e")).first().e
    assert [(e.start, e.size) for e in spans] == [(start[i], len(lines[i])) for i in (20, 41)]


def test_fingerprints_run_no_python(spark):
    plan = fingerprints.compared(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    result = connect(FOLDER).execute(queries.ORACLES[name])
    theirs = _bag([d[0] for d in result.description], result.fetchall())
    assert _bag(frame.columns, frame.collect()) == theirs
    assert isinstance(result, duckdb.DuckDBPyConnection)
