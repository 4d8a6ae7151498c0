"""Every text operator against a plain version on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tickerloom.llm import (bytepair, classes, common, components, decontaminate, jaccard, language, outliers, personal, queries,
                            sentences, sharding, substrings)

RNG = np.random.default_rng(3)
COMMON = ["the", "of", "and", "to", "in", "a"]
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n string, place string, token string, spans string"


def prose(n, seed):
    rng = np.random.default_rng(seed)
    words = [COMMON[rng.integers(6)] if rng.random() < 0.4 else "".join(rng.choice(list("abcdeilnorst"), rng.integers(3, 9))) for _ in range(n)]
    out = []
    for i, word in enumerate(words):
        out.append(word + (". " if i % 11 == 10 else " "))
    return "".join(out).strip()


PASSAGE = prose(90, 999)
ITEM = prose(30, 555)


def corpus():
    rows = []

    def add(doc_id, text, lang="en", source="s0"):
        rows.append((doc_id, text, lang, source, len(text) if text is not None else None, "x", "y", "z", "t", "u"))

    for i in range(40):
        add(i, prose(60 + 7 * i, i), "en" if i % 3 else "fr", f"s{i % 4}" if i % 2 else "s0")
    base = prose(300, 77)
    for i in range(12):  # near copies and copies
        words = base.split(" ")
        for j in range(i % 5):
            words[(37 * j + i) % len(words)] = f"edit{i}x{j}"
        add(100 + i, " ".join(words))
    add(200, base, None, None)
    add(200, base, None, None)
    add(None, base)
    add(None, prose(80, 5))
    add(300, None)
    add(301, "")
    add(302, " \n\t ")
    add(303, "one")
    add(304, "one two")
    add(305, "ONE two")
    for i in range(5):
        add(400 + i, prose(40, 800 + i) + " " + PASSAGE + " " + prose(30, 900 + i))
    add(410, prose(50, 61) + " " + ITEM + " " + prose(50, 62))
    words = ITEM.split()
    words[4], words[19] = "changed", "other"
    add(411, prose(50, 63) + " " + " ".join(words) + " " + prose(50, 64))
    add(500, "Write a.b@mail.example.com or +1 (974) 555-3436 twice, (974) 555-3436 here; 10.0.0.255 and 10.0.0.256 4111 1111 1111 1111 4111111111111112")
    add(501, "### $$$ " * 400 + prose(60, 65))
    add(502, "word " * 200)
    add(503, "é" * 3000 + "😀   ñ" + "ab" * 4000)
    add(504, prose(20_000, 66))
    add(505, "привет как дела " * 30, "ru")
    add(506, "12 34 -- !!")
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_follow_the_mixture(spark, docs, rows):
    placed = sharding.interleave(docs, 7).collect()
    assert len(placed) == len(rows)
    by = defaultdict(list)
    for row in placed:
        by[row.shard].append(row)
    counts = [len(by[i]) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(row.slot for row in found) == list(range(len(found))) for found in by.values())
    sizes = Counter((row.size, row.text_crc32) for row in placed)
    assert sizes == Counter((len((text or "").encode()) + 16, zlib.crc32((text or "").encode())) for _, text, *_ in rows)
    total = Counter(row.source for row in placed)
    for found in by.values():
        for source, n in Counter(row.source for row in found).items():
            assert abs(n - total[source] / 7) <= 2
    assert sharding.interleave(empty(spark), 7).count() == 0


def test_shards_repeat(docs):
    one, two = (sorted(map(str, sharding.interleave(docs, 5).select("doc_id", "shard", "slot", "size").collect())) for _ in range(2))
    assert one == two


def test_byte_pairs_equal_the_public_library(spark, docs, rows):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.read_ranks(VOCABULARY), special_tokens={})
    done = bytepair.encode_decode(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    wanted = Counter((d, np.array(other.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in rows)
    assert Counter((row.doc_id, bytes(row.ids), bytes(row.decoded)) for row in done) == wanted
    back = bytepair.decode(bytepair.encode_decode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, *_ in rows)
    assert bytepair.encode_decode(empty(spark), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_and_verdicts(spark, docs, rows):
    done = outliers.judged(docs).collect()
    got = Counter((row.doc_id, *[row[name] for name in outliers.STATISTICS]) for row in done)
    assert got == Counter((d, *plain_statistics(t)) for d, t, *_ in rows)
    for row in done:
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert not (row.kept and row.base_failed)
    kept = {row.doc_id: row.kept for row in done}
    assert not kept[501] and not kept[502] and all(kept[i] for i in range(40))
    assert outliers.judged(empty(spark)).count() == 0


def test_robust_fit_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, outliers.P)) * 2
    x[:300] += 12
    frame = spark.createDataFrame([("g", *map(float, row)) for row in x], ["fit", *[f"x{i}" for i in range(outliers.P)]])
    found = outliers.fit(frame).collect()
    assert len(found) == 1
    assert np.abs(np.array(found[0]["mean"])).max() < 0.3  # the plain mean is off by 1.8


def test_class_scores(spark, docs, rows):
    table = docs.select("doc_id", "text", common.held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    done = classes.scores(table).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for d, t, *_ in rows:
        if not held(d):
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    wanted = []
    for d, t, *_ in rows:
        words = (t or "").encode().lower().split()
        score = sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in words) + np.log10((ends + 1) / (total + kinds + 1))
        wanted.append((str(d), held(d), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total, round(score, 4)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in done]
    assert Counter(got) == Counter(wanted)
    assert all(row.score < 0 for row in done)
    assert classes.scores(empty(spark).select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


def plain_value(table, sides):
    log = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    return log(table).sum() - 2 * log(table[:, :sides].sum(1)).sum()


def test_moves_gain_what_the_likelihood_gains():
    """Against the likelihood of the class bigrams computed anew for every possible move."""
    rng = np.random.default_rng(6)
    sides, units = 5, 12
    cells = rng.integers(0, 4, (units, 2 * sides)) * (rng.random((units, 2 * sides)) < 0.6)
    cells[:, sides] += cells[:, :sides].sum(1) - cells[:, sides:].sum(1) + 20   # as many neighbours after as before
    cells[:, 0] += 20
    label = rng.integers(1, sides, units)
    table = np.zeros((sides, 2 * sides))
    np.add.at(table, label, cells)
    unit, place = np.nonzero(cells)
    best = classes.best_moves(unit, place, cells[unit, place].astype(float), label, table, sides)
    for u in range(units):
        values = {}
        for c in range(1, sides):
            moved = table.copy()
            moved[label[u]] -= cells[u]
            moved[c] += cells[u]
            values[c] = plain_value(moved, sides)
        assert np.isclose(values[int(best[u])], max(values.values()))
        assert best[u] == label[u] or values[int(best[u])] > values[int(label[u])]


def test_exchange_separates_two_kinds_of_words(spark, monkeypatch):
    """Words that only follow words of the other kind end in classes of their own, all of them clustered by themselves."""
    rng = np.random.default_rng(3)
    a, b = [f"aa{i}x" for i in range(40)], [f"bb{i}x" for i in range(40)]
    texts = [(i, " ".join(w for _ in range(25) for w in (a[rng.integers(40)], b[rng.integers(40)]))) for i in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    totals = classes.slot_totals(rows)
    assert totals.sum() == 60 * 50 and (totals > 0).sum() == 80
    often = totals >= classes.LEAST
    for merged in (classes.MERGED, 1):
        monkeypatch.setattr(classes, "MERGED", merged)
        label = classes.cluster(rows.repartition(3), often, totals, 2)
        units = classes.Units(often)
        kinds = [{int(label[units[word.encode()]]) for word in words} for words in (a, b)]
        assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]


def test_class_scores_equal_a_plain_model(docs, rows):
    """Scores from the same classes, with all probabilities counted in plain loops."""
    kept = {}
    original = classes.cluster

    def remember(*args):
        kept["often"], kept["label"] = args[1], original(*args)
        return kept["label"]

    table = docs.select("doc_id", "text", common.held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(classes, "cluster", remember)
        done = classes.scores(table, 6).collect()
    units = classes.Units(kept["often"])
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, pairs = Counter(), Counter()
    split = [(d, (t or "").encode().lower().split()) for d, t, *_ in rows]
    label = lambda word: int(kept["label"][units[word]])
    for d, words in split:
        if not held(d):
            counts.update(words)
            path = [0, *map(label, words), 0]
            pairs.update(zip(path, path[1:]))
    sides = 7
    before, after, total = Counter(), Counter(), sum(pairs.values())
    for (x, y), n in pairs.items():
        before[x] += n
        after[y] += n
    tokens, types = Counter(), Counter()
    for word, n in counts.items():
        tokens[label(word)] += n
        types[label(word)] += 1
    wanted = Counter()
    for d, words in split:
        path = [0, *map(label, words), 0]
        value = sum(np.log10((pairs[x, y] + sides * (after[y] + 1) / (total + sides)) / (before[x] + sides)) for x, y in zip(path, path[1:]))
        value += sum(np.log10((counts[word] + 1) / (tokens[label(word)] + types[label(word)] + 1)) for word in words)
        wanted[str(d), round(value, 4)] += 1
    assert Counter((str(row.doc_id), round(row.score, 4)) for row in done) == wanted


def test_class_probabilities_sum_to_one(spark):
    table = np.array([[0, 5, 2], [4, 1, 3], [3, 2, 6.0]])
    overall = (table.sum(0) + 1) / (table.sum() + 3)
    transition = (table + 3 * overall) / (table.sum(1, keepdims=True) + 3)
    assert np.allclose(transition.sum(1), 1)


def plain_removal(rows, window):
    seen = Counter(data[i:i + window] for _, data in rows for i in range(len(data) - window + 1))
    out = []
    for d, data in rows:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if seen[data[i:i + window]] > 1:
                gone[i:i + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))).reshape(-1, 2)
        out.append((d, len(data), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def test_repeated_bytes_are_removed(spark, docs, rows):
    left = substrings.without_repeats(docs, window=400).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), F.sha2("kept", 256))
    assert Counter(map(tuple, left.collect())) == plain_removal([(d, (t or "").encode()) for d, t, *_ in rows], 400)
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_repeated_bytes_with_many_overlaps(spark):
    rng = np.random.default_rng(5)
    source = "".join(rng.choice(list("ab"), 3000))
    texts = [(i, source[a:a + n] + "".join(rng.choice(list("cd"), 50)) + source[b:b + m])
             for i, (a, n, b, m) in enumerate(zip(rng.integers(0, 1500, 60), rng.integers(300, 900, 60), rng.integers(0, 1500, 60), rng.integers(300, 500, 60)))]
    left = substrings.without_repeats(spark.createDataFrame(texts, "doc_id long, text string"), window=400)
    got = left.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == plain_removal([(d, t.encode()) for d, t in texts], 400)


def test_leaks_are_found(spark, docs, rows):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, prose(25, 4321))], "item_id long, text string")
    found = {(row.doc_id, row.item_id): row.distance for row in decontaminate.leaks(docs, items).collect()}
    assert found == {(410, 1): 0, (411, 1): 2}
    cleaned = decontaminate.clean(docs, items)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows) - 2
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        previous, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (a != b))
    return row[-1]


def test_edit_distance_is_exact():
    for _ in range(300):
        x, y = (RNG.integers(0, 4, RNG.integers(0, 12)).tolist() for _ in range(2))
        assert decontaminate.edit_distance(x, y) == plain_distance(x, y)


def test_recall_of_edited_items():
    items = [(i, prose(int(RNG.integers(14, 60)), 7000 + i).encode()) for i in range(60)]
    index = decontaminate.Index(items, 0.8)
    documents, wanted = [], set()
    for place, item in enumerate(index.items):
        words, n = list(item), len(item)
        for _ in range(decontaminate.allowed(n, 0.8)):
            words[int(RNG.integers(n))] = 0
        documents.append(np.array([0] * 40 + words + [0] * 40, np.int64))
        wanted.add((place, place))
    found = {(place, item) for place, item, _, _ in index.matches(documents, 0.8)}
    assert len(found & wanted) >= 0.95 * len(wanted)


def test_items_with_dropped_and_inserted_words_are_found():
    """Against plain free-end distances: every leak at the limit, whatever the edits, and short documents."""
    rng = np.random.default_rng(12)
    items = [(i, prose(int(rng.integers(10, 60)), 9000 + i).encode()) for i in range(40)]
    index = decontaminate.Index(items, 0.8)
    for kind in ("drop", "insert", "mix"):
        documents = []
        for place, item in enumerate(index.items):
            words = list(item)
            for edit in range(decontaminate.allowed(len(item), 0.8)):
                at = int(rng.integers(len(words)))
                if kind == "drop" or kind == "mix" and edit % 3 == 0:
                    del words[at]
                elif kind == "insert" or edit % 3 == 1:
                    words.insert(at, 0)
                else:
                    words[at] = 0
            around = [0] * (30 * (place % 2))  # every other document holds nothing else
            documents.append(np.array(around + words + around, np.int64))
        found = {(place, item): distance for place, item, _, distance in index.matches(documents, 0.8)}
        for place, item in enumerate(index.items):
            row = [0] * (len(documents[place]) + 1)
            for i, word in enumerate(item, 1):
                previous, row[0] = row[0], i
                for j, other in enumerate(documents[place].tolist(), 1):
                    previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (word != other))
            assert found[place, place] == min(row)


def test_leaks_beside_windows_with_more_pairs_are_found():
    """Swapped halves hold more word pairs than a run at the limit, and a one-word item may stand anywhere."""
    items = [(i, prose(20 + i % 7, 12_000 + i).encode()) for i in range(20)] + [(20, b"single")]
    index = decontaminate.Index(items, 0.8)
    documents, single = [], index.items[20]
    for item in index.items[:20]:
        half, edited = len(item) // 2, list(item)
        for k in range(decontaminate.allowed(len(item), 0.8)):
            edited[2 + 4 * k] = 0
        swapped = [*item[half:], *item[:half]]
        documents.append(np.array([*swapped, *[0] * 40, *edited, *[0] * 40, *swapped, *[0] * 40, *swapped, 0, *single, 0, 0], np.int64))
    found = {(place, item) for place, item, _, _ in index.matches(documents, 0.8)}
    assert found >= {(i, i) for i in range(20)} | {(i, 20) for i in range(20)}


def test_sentence_spans(spark, docs, rows):
    unique = sorted({(d is None, d or 0, t or "") for d, t, *_ in rows})
    keyed = {}
    for _, d, t in unique:
        keyed[(d, t)] = sentences.sentences(t.encode())
    done = sentences.without_repeats(docs).collect()
    assert len(done) == len(rows)
    by_id = {row.doc_id: row for row in done}
    assert by_id[400].n_removed == 0 and all(by_id[i].n_removed >= 6 for i in range(401, 405))
    assert PASSAGE[30:-90] in by_id[400].text and PASSAGE[60:-160] not in by_id[403].text
    assert by_id[300].text is None and by_id[301].text == ""
    assert all(by_id[i].n_removed == 0 for i in range(40))
    assert sentences.without_repeats(empty(spark)).count() == 0


def test_passages_of_long_lines_are_found_behind_any_prefix(spark):
    """A passage of 70 words without punctuation behind 0 to 39 other words, and one of a script without spaces."""
    make = lambda n, seed: prose(n, seed).replace(".", "")
    passage = make(70, 4242)
    unspaced = "".join(chr(0x4E00 + 37 * i) + ("。" if i % 9 == 8 else "") for i in range(72))
    texts = [(i, f"{make(i, 6000 + i)} {passage} {make(30, 6100 + i)}") for i in range(40)]
    texts += [(100, "甲乙。" + unspaced + "丙。"), (101, "丁戊己庚。" + unspaced + "辛壬。")]
    done = {row.doc_id: row for row in sentences.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(passage in done[i].text for i in (0,)) and all(done[i].n_removed >= 2 for i in range(1, 40))
    assert all(len(done[i].text) < len(texts[i][1]) - len(passage) // 2 for i in range(1, 40))
    assert done[100].text == texts[40][1] and done[101].text == "丁戊己庚。辛壬。"
    for _, text in texts:
        found = sentences.sentences(text.encode())
        assert b"".join(text.encode()[a:b] for a, b, _ in found) == text.encode()


def test_spans_are_the_shortest():
    for _ in range(200):
        counts = RNG.integers(1, 12, RNG.integers(0, 15)).tolist()
        n, wanted = len(counts), set()
        for i in range(n):
            wanted |= {(i, j) for j in range(i + 1, n) if sum(counts[i:j + 1]) >= sentences.LEAST_WORDS and (j == i + 1 or sum(counts[i:j]) < sentences.LEAST_WORDS)}
            wanted |= {(j, i) for j in range(i) if sum(counts[j:i + 1]) >= sentences.LEAST_WORDS and (j == i - 1 or sum(counts[j + 1:i + 1]) < sentences.LEAST_WORDS)}
        assert sentences.spans(counts) == sorted(wanted)


def plain_groups(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * len(x | sets[j]):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i in range(len(sets)):
        ids[root(i)].append(rows[i][0])
    least = {i: min((d for d in found if d is not None), default=None) for i, found in ids.items()}
    return Counter((rows[i][0], len(x), least[root(i)] if x else rows[i][0]) for i, x in enumerate(sets))


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, docs, rows, size, percent):
    got = jaccard.joined(docs, size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_groups(rows, size, percent)
    assert jaccard.joined(empty(spark), size, percent).count() == 0


def test_jaccard_groups_of_a_dense_crowd(spark):
    """Copies that are linked only by way of others, and texts on both sides of the limit."""
    words = prose(200, 31).split()
    texts = []
    for i in range(60):
        own = list(words)
        for j in range(i % 12):
            own[(17 * j + 3 * i) % 200] = f"w{i % 7}x{j}"
        texts.append((i, " ".join(own[: 200 - i % 5])))
    got = jaccard.joined(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_groups(texts, 3, 90)


def test_candidates_that_share_an_id_are_compared_by_their_own_texts(spark):
    """Pairs a little below the limit (190 of 212 shingles) under one id or none, and rows repeated whole."""
    texts = []
    for i in range(4):
        words = [f"w{i}x{j}" for j in range(203)]
        other = list(words)
        for at in (50, 100, 150, 201):
            other[at] = f"other{i}x{at}"
        texts += [(i if i % 2 else None, " ".join(found)) for found in (words, other, words)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    signed = jaccard.signatures(frame, 3, 90)
    every = signed.alias("x").join(signed.alias("y"), F.expr("x.node < y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), "x.k1", F.col("y.k1").alias("other"))
    links = [tuple(row) for row in jaccard._verified(every.select("a", "b"), signed, frame, 3, 90).collect()]
    assert sorted(links) == sorted((row.a, row.b) for row in every.where("k1 = other").collect())


def test_parity_rows_fold():
    for n in (10, 400, 700, 3000):
        found = np.unique(RNG.integers(0, 2 ** 63, n).astype(np.uint64))
        row = jaccard.parities(found)
        assert len(row) * 64 >= 2 * len(found)
        other = np.unique(np.concatenate([found[5:], RNG.integers(0, 2 ** 63, 5).astype(np.uint64)]))
        differ = int(sum(bin(int(x) & (2 ** 64 - 1)).count("1") for x in row ^ jaccard.parities(other))) if len(jaccard.parities(other)) == len(row) else 0
        assert differ <= len(np.setxor1d(found, other))
        short = jaccard.folded(row) ^ jaccard.folded(jaccard.parities(other))
        assert len(short) == jaccard.SKETCH_WORDS
        assert sum(bin(int(x) & (2 ** 64 - 1)).count("1") for x in short) <= len(np.setxor1d(found, other))


def test_one_row_for_each_group(docs, rows):
    kept = jaccard.representatives(docs, 3, 90)
    groups = plain_groups(rows, 3, 90)
    wanted = {component for (d, n, component) in groups if n}
    got = [row.doc_id for row in kept.collect()]
    assert kept.columns == docs.columns
    filled = [d for d in got if d is not None and d not in (300, 301, 302)]
    assert sorted(filled) == sorted(d for d in wanted if d is not None)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(1, 2)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 1: 1, 2: 1}


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda span: (span[1], personal.KINDS.index(span[0])))


def test_base_spans_equal_the_patterns():
    parts = ["1", "25", "255", "300", ".", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "4111111111111111", "\n", "é"]
    for _ in range(3000):
        text = "".join(RNG.choice(parts, RNG.integers(0, 25)))
        assert personal.base_spans(text) == plain_spans(text)
    assert personal.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_personal_data(spark, docs, rows):
    model = personal.train(docs)
    found = {row.doc_id: row.spans for row in personal.find(docs, model).collect()}
    text = dict((d, t) for d, t, *_ in rows)
    base = [(s.kind, s.start, s.end) for s in found[500] if s.base]
    assert base == plain_spans(text[500])
    added = [text[500][s.start:s.end] for s in found[500] if not s.base]
    assert added and all("974" in part or "555" in part for part in added)  # the number without its country code
    assert all(not spans for d, spans in found.items() if d not in (500,))
    clean = personal.redacted(docs, model)
    assert clean.schema == docs.schema and clean.count() == len(rows)
    changed = {row.doc_id: row for row in clean.collect()}
    assert "@" not in changed[500].text and "<email>" in changed[500].text and changed[500].n_chars == len(changed[500].text)
    assert personal.find(empty(spark), model).count() == 0
    assert personal.train(empty(spark)).shapes.shape == model.shapes.shape


def test_similar_numbers_and_overlapping_spans(spark, docs):
    model = personal.train(docs)
    for one, two in (("+1 974 555 3436", "974-555-3436"), ("+1-974-555-3436", "974 555 3436"), ("+1 (974) 555-3436", "9745553436")):
        text = f"{one} {'word ' * 50}{two} and 5553437 or 2016-01-04 more"
        added = personal.added_spans(text, personal.base_spans(text), model)
        assert [(kind, text[start:end]) for kind, start, end in added] == [("phone", two)]
    mixed = docs.limit(1).withColumn("text", F.lit("write +49 30 12345678.foo@bar.com now"))
    assert [row.text for row in personal.redacted(mixed, model).collect()] == ["write <phone> now"]


def test_messages_reach_distant_tokens():
    text = "+1 (974) 555-3436 " + "word " * 500 + "(974) 555-3436"
    base = personal.base_spans(text)
    shapes = np.zeros((personal.SHAPES, 5)) + np.log(0.2)
    agree = np.log(np.eye(5) * 4 + 0.2)
    added = personal.added_spans(text, base, personal.Model(shapes, agree, agree))
    assert added and added[0][0] == "phone" and added[0][1] > 2000


def test_language(spark, docs, rows):
    rng = np.random.default_rng(8)
    letters = {"en": list("abcdefgh"), "fr": list("éèàçijkl"), "ru": list("абвгдежз")}
    make = lambda lang, n: " ".join("".join(rng.choice(letters[lang], 5)) for _ in range(n))
    table = [(i, make(lang, 60), lang) for i, lang in enumerate(["en", "fr", "ru"] * 20)]
    mixed = [(900, make("en", 40) + " " + make("fr", 25), None), (901, None, "en"), (902, "12 !!", None), (903, make("ru", 3), None)]
    frame = spark.createDataFrame(table + mixed, "doc_id long, text string, lang string")
    model = language.train(frame)
    done = {row.doc_id: row for row in language.identify(frame, model).collect()}
    assert all(done[i].lang_pred == lang for i, _, lang in table)
    assert [(s.lang, s.first_word, s.last_word) for s in done[900].spans] == [("en", 0, 39), ("fr", 40, 64)]
    assert (done[901].lang_pred, done[902].lang_pred, done[903].lang_pred) == ("und", "und", "ru")
    assert all(0 <= row.score <= 1 for row in done.values())
    nothing = language.train(frame.limit(0))
    assert {row.lang_pred for row in language.identify(frame, nothing).collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0
    assert len(language.identify(docs, model).collect()) == len(rows)


def test_paths_are_the_best():
    for _ in range(100):
        table, penalty = RNG.normal(size=(12, 3)) * 3, 2.0
        sequences = [RNG.integers(0, 12, n) for n in (0, 1, 3, 6)]
        for sequence, path in zip(sequences, language.best_paths(sequences, table, penalty)):
            def value(labels):
                return table[sequence, labels].sum() - penalty * np.count_nonzero(np.diff(labels))
            every = np.array(np.meshgrid(*[range(3)] * len(sequence))).reshape(len(sequence), -1).T if len(sequence) else np.empty((1, 0), int)
            assert len(path) == len(sequence) and np.isclose(value(path.astype(int)), max(value(labels) for labels in every))
            if len(sequence):
                label = language.stays(table[sequence], penalty)
                if label >= 0:
                    assert np.isclose(value(np.full(len(sequence), label)), value(path.astype(int)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_table(spark, name):
    folder = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{folder}/documents.parquet").count()
    done = queries.QUERIES[name](spark, folder)
    assert done.count() == total or name in ("op6_decontamination", "op11_divergence", "op12_reversed_search")


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_sentence_spans_equal_a_plain_version(docs, rows):
    """All spans of all distinct rows, grouped by their words in one dictionary."""
    unique = {(d, t or "") for d, t, *_ in rows}
    cut = {row: sentences.sentences(row[1].encode()) for row in unique}
    places = defaultdict(list)
    for row, found in cut.items():
        for first, last in sentences.spans([len(words) for _, _, words in found]):
            places[tuple(tuple(words) for _, _, words in found[first:last + 1])].append(((row[0] is None, row[0] or 0, first), row, first, last))
    covered = defaultdict(set)
    for group in places.values():
        leader = min(group)
        for _, row, first, last in group:
            if (row, first) != (leader[1], leader[2]):
                covered[row] |= set(range(first, last + 1))
    wanted = Counter()
    for d, t, *_ in rows:
        found, gone = cut[d, t or ""], covered[d, t or ""]
        left = b"".join((t or "").encode()[a:b] for i, (a, b, _) in enumerate(found) if i not in gone) if gone else (t or "").encode()
        wanted[d, len(found), len(gone), None if t is None else left.decode()] += 1
    assert Counter(map(tuple, sentences.without_repeats(docs).collect())) == wanted
    assert sum(n for (_, _, gone, _), n in wanted.items() if gone) >= 10


def test_leaks_between_others_in_a_batch_are_found():
    index = decontaminate.Index([(7, b"one two three four five")], 0.8)
    texts = [["zz"], "one two three four five".split(), ["qq"], "aa bb cc".split()]
    known = lambda words: np.array([index.vocabulary.get(word.encode(), 0) for word in words], np.int64)
    assert [match[:2] for match in index.matches([known(words) for words in texts], 0.8)] == [(1, 0)]


def test_batches_find_what_a_plain_scan_finds():
    """Random small batches over few words: every (document, item) that the first step lets through is one that its documents
    alone let through, and leaks without edits are found whatever stands around them."""
    rng = np.random.default_rng(21)
    for _ in range(60):
        items = [(i, b" ".join(b"w%d" % word for word in rng.integers(0, 40, rng.integers(5, 30)))) for i in range(4)]
        index = decontaminate.Index(items, 0.8)
        documents = []
        for _ in range(int(rng.integers(1, 8))):
            words = rng.integers(0, 40, rng.integers(0, 12)).tolist()
            if rng.random() < 0.5:
                words += index.items[int(rng.integers(4))] + rng.integers(0, 40, rng.integers(0, 12)).tolist()
            documents.append(np.array(words, np.int64))
        together = {(place, item) for place, item, _ in index.windows(documents)}
        assert together == {(place, item) for place, words in enumerate(documents) for _, item, _ in index.windows([words])}
        found = {(place, item): distance for place, item, _, distance in index.matches(documents, 0.8)}
        for place, words in enumerate(documents):
            for item, wanted in enumerate(index.items):
                if any(words[i:i + len(wanted)].tolist() == wanted for i in range(len(words))):
                    assert found[place, item] == 0


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_item_ids_keep_their_type(spark, docs, kind):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    found = decontaminate.leaks(docs, items)
    assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert {row.doc_id for row in found.collect()} == {410, 411} and {str(row.item_id) for row in found.collect()} == {"1"}


def test_columns_with_names_used_inside_survive(spark, docs):
    """Filters keep whatever other columns a table has, whatever their names."""
    names = ["_quality_key", "_row_key", "_LEAK_KEY", "distance", "kept", "node", "key", "component_id", "fit", "x0"]
    some = docs.where("doc_id < 40 or doc_id in (200, 300, 410, 501)")
    wide = some.select("*", *[F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(name) for name in names if name not in docs.columns])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for filtered, plain in ((outliers.kept(wide), outliers.kept(some)), (jaccard.representatives(wide, 5, 80), jaccard.representatives(some, 5, 80)),
                            (decontaminate.clean(wide, items), decontaminate.clean(some, items))):
        assert filtered.columns == wide.columns
        kept = filtered.collect()
        assert Counter(row.doc_id for row in kept) == Counter(row.doc_id for row in plain.collect())
        assert all(row[name] == f"{name}{row.doc_id}" for row in kept for name in names)


def test_texts_of_many_megabytes(spark):
    """One text of 18 MB beside a part of it and a copy: every operator gives it a whole result."""
    part = prose(4000, 31)
    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("abcdeilnorst"), 8)) for _ in range(5000)]
    drawn = [words[i] + (". " if i % 9 == 0 else " ") for i in rng.integers(0, 5000, 2_000_000)]
    long = "".join(drawn) + part
    assert len(long) > 17 << 20
    frame = spark.createDataFrame([(1, long, "en", "a"), (2, part, "en", "a"), (3, long, "en", "b")], "doc_id long, text string, lang string, source string")
    groups = {row.doc_id: row.component_id for row in jaccard.joined(frame, 3, 90).collect()}
    assert groups == {1: 1, 2: 2, 3: 1}
    left = {row.doc_id: row.n_removed for row in substrings.without_repeats(frame, window=400).collect()}
    assert left[1] == left[3] == len(long) and left[2] == len(part)
    spans = {row.doc_id: (row.n_removed, row.n_sentences) for row in sentences.without_repeats(frame).collect()}
    assert spans[1][0] == 0 and spans[3] == (spans[1][1], spans[1][1]) and spans[2][0] >= spans[2][1] - 2
    counts = {row.doc_id: row.n_words for row in outliers.statistics(frame).collect()}
    assert counts == {1: 2_004_000, 2: 4000, 3: 2_004_000}
    item = spark.createDataFrame([(5, " ".join(part.split()[-40:]))], "item_id long, text string")
    assert {row.doc_id for row in decontaminate.leaks(frame, item).collect()} == {1, 2, 3}
    tokens = classes.scores(frame.select("doc_id", "text", F.lit(False).alias("held_out"))).collect()
    assert {row.doc_id: row.n_tokens for row in tokens} == {1: 2_004_001, 2: 4001, 3: 2_004_001}


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.sql.session.timeZone", "UTC").getOrCreate()
from tickerloom.llm import queries
counts = {{name: queries.QUERIES[name](spark, {folder!r}).count() for name in {names!r}}}
spark.stop()
print("COUNTS", counts)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Workers that start in another folder, without the repository on their path, run operators that share objects."""
    names = ["op2_byte_bpe", "op6_decontamination", "op9_personal_data", "op10_language_spans"]
    root = str(Path(__file__).resolve().parents[2])
    code = ELSEWHERE.format(root=root, folder="/root/testdata/sf0.001", names=names)
    environment = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert "COUNTS" in done.stdout, done.stderr[-2000:]
    assert all(f"'{name}': " in done.stdout for name in names)
