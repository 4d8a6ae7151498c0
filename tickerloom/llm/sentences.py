"""Repeated runs of sentences: every span of several consecutive sentences is hashed and joined over all documents.

A text is cut into sentences at line ends, after . ! ? before white space, and after the sentence ends of other scripts.
A sentence of more than PIECE_WORDS words is cut where the hash of the last PAIR words says so, whatever stands before
them, and after MOST_WORDS words at the latest: a passage inside long lines without punctuation is cut at the same
places in all of them.  A character of a script without spaces counts as a word.  From every sentence the shortest span of at least two sentences and LEAST_WORDS words is taken forwards and backwards.  Of equal spans the
first one, by doc_id and place, stays; sentences that any other one covers are removed.

Words are compared without regard to the case of A-Z and to white space.  Null text has no sentence and stays null;
rows equal in doc_id and text are one document and share its result; a null doc_id comes last in the order; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common
from tickerloom.session import pin

LEAST_SENTENCES = 2
LEAST_WORDS = 13
PIECE_WORDS = 25
PAIR = 2
ONE_IN = 8       # places between words of a long sentence that are cuts
MOST_WORDS = 50  # of a piece

_ENDS = "。｡．！？‼⁇⁈⁉؟۔।॥։።፧။។᠃᠉"
_LINE_ENDS = "\u0085\u2028\u2029"
_CLOSING = "」』”’）】》〉"
_BORDER = re.compile(
    rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\n+|(?:" + b"|".join(map(str.encode, _ENDS + _LINE_ENDS)) + rb")+(?:" + b"|".join(map(str.encode, _CLOSING))
    + rb")*[ \t\r\x0b\x0c]*")
_PLAIN_BORDER = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\n+")
_OTHER_ENDS = re.compile(rb"[\xd8\xdb\xe0-\xe3\xef]|\xc2\x85")  # what the ends of other scripts can begin with
_UNSPACED = re.compile(rb"[\xe3-\xe9]")  # first bytes of kana and ideographs, U+3000 to U+9FFF
_WORD = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|[^\x20\x09-\x0D\xe3-\xe9]+")


def pieces(words: list[bytes]) -> list[int]:
    """Numbers of the words that begin a piece of a long sentence, without the first."""
    cuts, last = [], 0
    for i in range(1, len(words)):
        if i >= PAIR and xxhash.xxh3_64_intdigest(b" ".join(words[i - PAIR:i])) % ONE_IN == 0 or i - last == MOST_WORDS:
            cuts.append(i)
            last = i
    return cuts


def sentences(data: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, lower-cased words) of the sentences; ends include the white space that follows."""
    found, start = [], 0
    spaced, lower = not _UNSPACED.search(data), data.lower()
    borders = (_BORDER if _OTHER_ENDS.search(data) else _PLAIN_BORDER).finditer(data)
    for border in [*(match.end() for match in borders), len(data)]:
        part = lower[start:border]
        words = part.split() if spaced else _WORD.findall(part)
        if len(words) > PIECE_WORDS:
            numbers = [0, *pieces(words), len(words)]
            places = [match.start() for match in _WORD.finditer(data, start, border)]
            cuts = [start, *(places[i] for i in numbers[1:-1]), border]
            found += [(a, b, words[i:j]) for a, b, i, j in zip(cuts, cuts[1:], numbers, numbers[1:])]
        elif words:
            found.append((start, border, words))
        elif found:  # white space belongs to the sentence before
            found[-1] = (found[-1][0], border, found[-1][2])
        start = border
    return found


def spans(counts: list[int]) -> list[tuple[int, int]]:
    """First and last sentence of the shortest spans that begin or end at each sentence, without repeats."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    first = np.arange(n)
    last = np.maximum(np.searchsorted(upto, upto[:-1] + LEAST_WORDS, "left") - 1, first + LEAST_SENTENCES - 1)
    begin = np.minimum(np.searchsorted(upto, upto[1:] - LEAST_WORDS, "right") - 1, first - LEAST_SENTENCES + 1)
    ahead, back = last < n, begin >= 0
    back &= upto[1:] >= LEAST_WORDS
    return sorted(set(zip(first[ahead].tolist(), last[ahead].tolist())) | set(zip(begin[back].tolist(), first[back].tolist())))


def _spans(rows: DataFrame) -> DataFrame:
    """(key, doc_id, first, last, h1, h2) of all spans."""

    def run(batches):
        for batch in common.slices(batches, 4 << 20):
            owner, first, last, hashes = [], [], [], []
            for i, data in enumerate(batch.column("text").to_pylist()):
                found = sentences(data)
                marks = [xxhash.xxh3_128_digest(b" ".join(words)) for _, _, words in found]
                for a, b in spans([len(words) for _, _, words in found]):
                    owner.append(i)
                    first.append(a)
                    last.append(b)
                    hashes.append(xxhash.xxh3_128_digest(b"".join(marks[a:b + 1])))
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            place = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(place), batch.column("doc_id").take(place), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                 pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["key", "doc_id", "first", "last", "h1", "h2"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key long, doc_id {kind}, first int, last int, h1 long, h2 long")


def repeated(rows: DataFrame) -> DataFrame:
    """(key, spans: array of (first, last)) of the spans that are not the first of their kind."""
    found = pin(_spans(rows.select("key", "doc_id", "text")), "spans")
    order = F.struct(F.col("doc_id").isNull().alias("last_id"), "doc_id", "key", "first", "last")
    groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(order).alias("leader")).where("n > 1").drop("n")
    groups = pin(groups, "repeated-spans")  # so that both sides of the join are shuffled and a hot span can be split
    later = found.join(groups, ["h1", "h2"]).where((F.col("key") != F.col("leader.key")) | (F.col("first") != F.col("leader.first")))
    return later.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))  # spans of one text


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), common.utf8(F.col("text")).alias("text"), F.col("text").isNull().alias("no_text"))
    covered = pin(repeated(rows), "covered")
    keys = pin(covered.select("key"), "covered-keys")

    def run(batches):
        for batch in common.slices(batches, 4 << 20):
            total, removed, texts = [], [], []
            for data, gone, missing in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("no_text").to_pylist()):
                found = sentences(data)
                total.append(len(found))
                if not gone:
                    removed.append(0)
                    texts.append(None if missing else data)
                    continue
                change = np.zeros(len(found) + 1, np.int64)
                for span in gone:
                    change[span["first"]] += 1
                    change[span["last"] + 1] -= 1
                out = np.cumsum(change)[:-1] > 0
                removed.append(int(out.sum()))
                texts.append(b"".join([data[a:b] for (a, b, _), drop in zip(found, out) if not drop]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"])

    changed = common.among(rows, "key", keys, True).join(covered, "key")
    same = common.among(rows, "key", keys, False).withColumn("spans", F.lit(None).cast(covered.schema["spans"].dataType))
    both = changed.select("doc_id", "text", "no_text", "spans").unionByName(same.select("doc_id", "text", "no_text", "spans"))
    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_sentences long, n_removed long, text string")
