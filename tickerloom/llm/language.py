"""Language of texts that may change language: script ranges, word scores, Viterbi with a switching penalty.

The model holds, per language, log probabilities of hashed letter trigrams of words and the share of its
letters in each script.  A word is scored by the languages that use its script; the best path over all
words of a text, where each change of language costs a penalty, labels spans.  The document gets the
language with the most letters; its score is that language's share of the letters.

Null text or text without letters gives ``und`` with score 0 and no span; rows without text or language
teach nothing; equal rows get equal answers; an empty table gives no rows; with nothing learned every
text is ``und``.  Letters of a script that no learned language uses are scored by all languages.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common

FEATURES = 1 << 14
PENALTY = 8.0
LEAST_SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
MAX_LANGUAGES = 2_000

# First code points of Unicode script ranges, and the script from there on (fixed values, coarse).
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200,
                 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50,
                 0xFE70, 0xFF00, 0x20000]
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Indic", "Thai", "Other", "Georgian",
           "Hangul", "Other", "Latin", "Greek", "Other", "Hiragana", "Katakana", "Other", "Han", "Hangul", "Other", "Han",
           "Latin", "Hebrew", "Arabic", "Arabic", "Other", "Han"]
SCRIPT_NAMES = sorted(set(SCRIPTS))

class Model(NamedTuple):
    """Languages, log probabilities (features x languages), and which script each language uses (scripts x languages)."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


class Alphabet:
    """Tables over all code points: is it a letter, and of which script."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        numbers = np.array([SCRIPT_NAMES.index(name) for name in SCRIPTS], np.uint8)
        self.script = numbers[np.searchsorted(SCRIPT_STARTS, np.arange(0x110000), "right") - 1]

    def trigrams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, feature, script), one entry for each letter of the lower-cased words: the trigram around it.

        What is no letter counts as a border.
        """
        text = b"\n".join(words).decode("utf-8", "replace").lower()
        points = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32)
        is_letter = self.letter[points]
        letters = np.where(is_letter, points, 0).astype(np.uint64)
        at = np.flatnonzero(is_letter)
        word = (np.cumsum(points == 10) - 1)[at]
        hashed = common.mixed((letters[at - 1] << np.uint64(42)) ^ (letters[at] << np.uint64(21)) ^ letters[at + 1])
        return word, (hashed % np.uint64(FEATURES)).astype(np.int64), self.script[points[at]]


def _counted(batches):
    """Counts (lang, kind, key, n) of the rows of one task; words are counted before they are cut up."""
    alphabet = Alphabet()
    words: dict[str, Counter] = {}
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}

    def spend():
        for lang, counter in words.items():
            word, feature, script = alphabet.trigrams(list(counter))
            n = np.fromiter(counter.values(), np.int64, len(counter))[word]
            grams[lang] = grams.get(lang, 0) + np.bincount(feature, n, FEATURES).astype(np.int64)
            scripts[lang] = scripts.get(lang, 0) + np.bincount(script, n, len(SCRIPT_NAMES)).astype(np.int64)
        words.clear()

    for batch in common.slices(batches, 4 << 20):
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(data.split())
        if sum(map(len, words.values())) > 300_000:
            spend()
    spend()
    for lang in grams:
        for kind, total in (("gram", grams[lang]), ("script", scripts[lang])):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array([kind] * len(used), pa.string()),
                 pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["lang", "kind", "key", "n"])


def train(labelled: DataFrame) -> Model:
    """Model of all rows of ``labelled`` (text, lang); its size depends on the number of languages only."""
    rows = labelled.where("lang is not null and text is not null").select("lang", common.utf8(F.col("text")).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, kind string, key int, n long")
    table = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is meant for at most {MAX_LANGUAGES}")
    at = {lang: i for i, lang in enumerate(languages)}
    grams, scripts = np.zeros((FEATURES, len(at))), np.zeros((len(SCRIPT_NAMES), len(at)))
    for lang, kind, key, n in table.itertuples(index=False):
        (grams if kind == "gram" else scripts)[key, at[lang]] += n
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * FEATURES))
    uses = scripts >= LEAST_SCRIPT_SHARE * scripts.sum(0)
    return Model(languages, scores.astype(np.float32), uses)


class Scorer:
    """Scores of words, remembered up to a bound; broadcast whole, so that a reused worker keeps what it knows."""

    LIMIT = 250_000

    def __init__(self, model: Model):
        self.model, self.places = model, None

    def __getstate__(self):
        return self.model

    def __setstate__(self, model):
        self.__init__(model)

    def rows(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the rows of its words in ``table`` and ``letters``."""
        if self.places is None:
            self.alphabet = Alphabet()
        if self.places is None or len(self.places) > self.LIMIT:
            self.places: dict[bytes, int] = {}
            self.table = np.empty((0, len(self.model.languages)))
            self.letters = np.empty(0, np.int64)
        split = [text.split() for text in texts]
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        new.difference_update(self.places)
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)) for words in split]

    def learn(self, words: list[bytes]) -> None:
        word, feature, script = self.alphabet.trigrams(words)
        n, count = len(words), len(self.model.languages)
        score = np.empty((n, count))
        for i in range(count):
            score[:, i] = np.bincount(word, self.model.scores[feature, i], n)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        used = np.ones((n, count), bool)
        used[word[first]] = self.model.uses[script[first]]
        used[~used.any(1)] = True
        if count:
            score = np.where(used, score, score.min(1, keepdims=True) - 4 * PENALTY)
        self.places.update(zip(words, range(len(self.table), len(self.table) + n)))
        self.table = np.concatenate([self.table, score])
        self.letters = np.concatenate([self.letters, np.bincount(word, minlength=n)])


def stays(scores: np.ndarray, penalty: float) -> int:
    """The language of a text whose best path never changes, else -1.

    That holds if no other language gains more than half the penalty on the best one over any run of words: a path of
    m parts in other languages costs m - 1 changes at least, which is half of m or more, and one part alone gains nothing.
    """
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    lowest = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0)
    return best if (gain - lowest).max() <= penalty / 2 else -1


def best_paths(sequences: list[np.ndarray], table: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Viterbi paths of all sequences of score rows at once: step t works on every sequence longer than t."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return [np.empty(0, np.int16) for _ in sequences]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
    starts = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(starts[-1], np.int64)
    for rank, i in enumerate(order):
        flat[starts[:lengths[rank]] + rank] = sequences[i]
    stay = np.empty((starts[-1], table.shape[1]), bool)
    came = np.empty(starts[-1], np.int16)
    best = np.empty((len(order), table.shape[1]), np.float64)
    for t in range(steps):
        n = active[t]
        here = slice(starts[t], starts[t] + n)
        now = table[flat[here]]
        if t:
            before = best[:n]
            top = before.argmax(1)
            switched = before[np.arange(n), top][:, None] - penalty
            stay[here] = before >= switched
            came[here] = top
            now = np.maximum(before, switched) + now
        best[:n] = now
    label = best.argmax(1).astype(np.int16)
    paths = np.empty(starts[-1], np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        here = slice(starts[t], starts[t] + n)
        now = label[:n]
        paths[here] = now
        if t:
            label[:n] = np.where(stay[here][np.arange(n), now], now, came[here])
    result = [None] * len(sequences)
    for rank, i in enumerate(order):
        result[i] = paths[starts[:lengths[rank]] + rank]
    return result


def _labelled(scorer: Scorer, penalty: float, texts: list[bytes]):
    model, count = scorer.model, len(scorer.model.languages)
    if not count:
        yield from ((UNDETERMINED, 0.0, []) for _ in texts)
        return
    sequences = scorer.rows(texts)
    constant = [stays(scorer.table[sequence], penalty) if len(sequence) else 0 for sequence in sequences]
    mixed = [i for i, label in enumerate(constant) if label < 0]
    paths = dict(zip(mixed, best_paths([sequences[i] for i in mixed], scorer.table, penalty)))
    for i, sequence in enumerate(sequences):
        weight = scorer.letters[sequence]
        total = int(weight.sum())
        if not total:
            yield UNDETERMINED, 0.0, []
        elif i not in paths:
            lang = model.languages[constant[i]]
            yield lang, 1.0, [{"lang": lang, "first_word": 0, "last_word": len(sequence) - 1}]
        else:
            path = paths[i]
            share = np.bincount(path, weight, count)
            winner = int(share.argmax())
            firsts = np.flatnonzero(np.diff(path, prepend=-1))
            lasts = np.append(firsts[1:], len(path)) - 1
            spans = [{"lang": model.languages[path[a]], "first_word": int(a), "last_word": int(b)} for a, b in zip(firsts, lasts)]
            yield model.languages[winner], float(share[winner] / total), spans


SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())])


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans hold the words first_word..last_word of one language."""
    shared = common.share(docs.sparkSession, Scorer(model))  # languages x 2^14 numbers

    def run(batches):
        scorer = shared()
        for batch in common.slices(batches):
            done = list(_labelled(scorer, penalty, batch.column("text").to_pylist()))
            columns = [pa.array([row[i] for row in done], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.list_(SPAN)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select("doc_id", common.utf8(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,first_word:int,last_word:int>>")
