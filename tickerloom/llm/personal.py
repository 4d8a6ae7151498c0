"""Personal data: patterns with checks, and a skip-chain conditional random field that adds what the patterns miss.

Base spans come from one pattern for each kind (email, ip, card, phone).  The field has a node for every token with a
digit or an @; neighbours are joined by chain edges, and tokens of the same normal form, however distant, by skip edges
from one occurrence to the next.  Skip edges also lead from the tokens of a phone or card span to tokens, alone or in a
row, whose digits are SIMILAR or more digits of the span in a row, however either is cut into tokens.  Tokens in base
spans are observed; loopy message passing carries their labels along the edges.  A token gets a label if its belief is
high enough and a base span of that label holds the same normal form or such digits: a phone number that appears once
with and once without its country code, for example.

Potentials are trained piecewise from counts over all documents, with the base spans as labels: labels by hashed token
shape, by neighbouring label, and by the label at the other end of a skip edge.  The model has a fixed size.

Null and empty texts have no spans; equal rows give equal spans; an empty table gives no rows; other columns are not
read.  All scans are linear in the text, also for very long runs of one character class.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
SHAPES = 4096
BELIEF = 0.9
ROUNDS = 12
SIMILAR = 7       # digits in a row that a token and a base span share
MOST_DIGITS = 19  # of a phone or card span

# The given patterns, written so that each scan is linear: fixed values.
_LOCAL_PART = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_TELLING = bytes(sorted(set(range(256)) - set(b"0123456789@")))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    spans, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_PART:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            spans.append(("email", start, match.end()))
        floor = match.end() if match else at + 1
        at = text.find("@", floor)
    return spans


def _addresses(text: str) -> list[Span]:
    spans = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, start = run.group().split("."), run.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in four):
                spans.append(("ip", start, end))
            start = end + 1
    return spans


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns that pass their checks, by start and kind."""
    spans = _emails(text) + _addresses(text)
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = "".join(_DIGIT.findall(match.group()))
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *match.span()))
    for match in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(match.group())) <= 15:
            spans.append(("phone", *match.span()))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def shape(token: str) -> int:
    """Hashed form of a token: runs of digits by length, runs of letters, other characters."""
    form, i = [], 0
    while i < len(token) and len(form) < 16:
        j = i
        while j < len(token) and token[j].isdigit():
            j += 1
        if j > i:
            form.append(str(min(j - i, 20)))
        elif token[i].isalpha():
            while j < len(token) and token[j].isalpha():
                j += 1
            form.append("a")
        else:
            j = i + 1
            form.append(token[i])
        i = j
    return zlib.crc32(":".join(form).encode()) % SHAPES


def normal_form(token: str) -> str:
    """What similar tokens have in common: the digits if there are six or more, else the lower-cased core."""
    digits = "".join(_DIGIT.findall(token))
    if len(digits) >= 6:
        return digits
    core = re.sub(r"^\W+|\W+$", "", token.lower())
    return core if len(core) >= 3 else ""


class Graph(NamedTuple):
    """Nodes (start, end, shape, base label or 0) and edges (left, right) of one text; ``similar`` has the label of the base
    span that holds a node's digits, or 0."""

    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    groups: np.ndarray
    similar: np.ndarray


def similar_rows(digits: list[str], free: list[bool], follows: list[bool], known: dict[str, int]) -> list[tuple[int, int, int]]:
    """(first, past the last, value in ``known``) of the longest rows of free neighbouring nodes whose joined digits are known."""
    rows, first = [], 0
    while first < len(digits):
        joined, stop, best = "", first, None
        while stop < len(digits) and free[stop] and digits[stop] and (stop == first or follows[stop]) and len(joined) + len(digits[stop]) <= MOST_DIGITS:
            joined += digits[stop]
            stop += 1
            if joined in known:
                best = first, stop, known[joined]
        if best:
            rows.append(best)
        first = best[1] if best else first + 1
    return rows


def graph(text: str, spans: list[Span]) -> Graph | None:
    starts, ends, shapes, observed, forms, chain = [], [], [], [], [], []
    covered = sorted((start, end, LABELS.index(kind)) for kind, start, end in spans)
    inner: dict[int, list[int]] = {}  # nodes of each span
    next_span, word, before = 0, -1, -2
    for match in _TOKEN.finditer(text):
        word += 1
        token = match.group()
        if not _DIGIT.search(token) and "@" not in token:
            continue
        while next_span < len(covered) and covered[next_span][1] <= match.start():
            next_span += 1
        inside = next_span < len(covered) and covered[next_span][0] < match.end()
        if before == word - 1:
            chain.append((len(starts) - 1, len(starts)))
        before = word
        if inside:
            inner.setdefault(next_span, []).append(len(starts))
        starts.append(match.start())
        ends.append(match.end())
        shapes.append(shape(token))
        observed.append(covered[next_span][2] if inside else 0)
        forms.append(normal_form(token))
    if not starts:
        return None
    last: dict[str, int] = {}
    numbers: dict[str, int] = {}
    skip, groups = [], []
    for i, form in enumerate(forms):
        groups.append(numbers.setdefault(form, len(numbers)) if form else -1)
        if form and last.setdefault(form, i) != i:
            skip.append((last[form], i))
        last[form] = i
    similar = np.zeros(len(starts), np.int64)
    known: dict[str, int] = {}
    for span in inner:
        start, end, label = covered[span]
        digits = "".join(_DIGIT.findall(text[start:end])) if LABELS[label] in ("phone", "card") else ""
        for size in range(SIMILAR, len(digits) + 1):
            for first in range(len(digits) - size + 1):
                known.setdefault(digits[first:first + size], span)
    if known:
        linked = set(skip)
        following = {right for _, right in chain}
        digits = ["".join(_DIGIT.findall(text[start:end])) if not seen else "" for start, end, seen in zip(starts, ends, observed)]
        for first, stop, span in similar_rows(digits, [not seen for seen in observed], [i in following for i in range(len(starts))], known):
            similar[first:stop] = covered[span][2]
            edges = [(min(i, j), max(i, j)) for i in range(first, stop) for j in inner[span]]
            skip += [edge for edge in edges if edge not in linked]
    array = lambda rows: np.array(rows, np.int64).reshape(-1, 2)
    return Graph(*(np.array(column, np.int64) for column in (starts, ends, shapes, observed)), array(chain), array(skip), np.array(groups), similar)


class Model(NamedTuple):
    """Log potentials: labels by shape, and by the other label on chain and skip edges."""

    shapes: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _candidates(batch) -> list[tuple[int, str]]:
    """Places and texts of the rows with a digit or an @."""
    return [(i, data.decode("utf-8", "replace")) for i, data in enumerate(batch.column("text").to_pylist())
            if data.translate(None, _TELLING)]


def train(docs: DataFrame) -> Model:
    """Potentials from all rows of ``docs``; counts of fixed number reach the driver."""
    n = len(LABELS)

    def run(batches):
        shapes, chain, skip = np.zeros((SHAPES, n), np.int64), np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        for batch in common.slices(batches):
            for _, text in _candidates(batch):
                found = graph(text, base_spans(text))
                if found is None:
                    continue
                # A token outside the spans that looks like one inside is not known to be something else: it teaches nothing.
                seen = np.unique(found.groups[found.observed > 0])
                sure = (found.observed > 0) | ~np.isin(found.groups, seen[seen >= 0]) & (found.similar == 0)
                np.add.at(shapes, (found.shapes[sure], found.observed[sure]), 1)
                for table, edges in ((chain, found.chain), (skip, found.skip)):
                    edges = edges[sure[edges].all(1)]
                    np.add.at(table, (found.observed[edges[:, 0]], found.observed[edges[:, 1]]), 1)
        for kind, table in (("shape", shapes), ("chain", chain), ("skip", skip)):
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(table.ravel()[used])], ["kind", "cell", "n"])

    rows = docs.select(common.utf8(F.col("text")).alias("text"))
    counts = rows.mapInArrow(run, "kind string, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    tables = {"shape": np.zeros(SHAPES * n), "chain": np.zeros(n * n), "skip": np.zeros(n * n)}
    for kind, cell, count in counts.itertuples(index=False):
        tables[kind][cell] += count
    by_shape = tables["shape"].reshape(SHAPES, n) + np.array([1.0, *[0.1] * len(KINDS)])
    shapes = np.log(by_shape / by_shape.sum(1, keepdims=True))

    def association(cells: np.ndarray) -> np.ndarray:
        joint = cells.reshape(n, n) + 0.1 + 2 * np.eye(n)
        joint = (joint + joint.T) / joint.sum() / 2
        return np.log(joint / np.outer(joint.sum(0), joint.sum(1)))

    return Model(shapes, association(tables["chain"]), association(tables["skip"]))


def beliefs(found: Graph, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of the nodes by loopy message passing (all messages at once, damped by half)."""
    n, count = len(found.starts), len(LABELS)
    own = model.shapes[found.shapes].copy()
    fixed = found.observed > 0
    own[fixed] = -30.0
    own[fixed, found.observed[fixed]] = 0.0
    edges = np.concatenate([found.chain, found.skip])
    potentials = np.concatenate([np.repeat(model.chain[None], len(found.chain), 0), np.repeat(model.skip[None], len(found.skip), 0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potentials = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    half = len(edges)
    reverse = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    messages = np.zeros((2 * half, count))
    for _ in range(rounds if half else 0):
        total = own.copy()
        np.add.at(total, target, messages)
        outgoing = (total[source] - messages[reverse])[:, :, None] + potentials
        top = outgoing.max(1, keepdims=True)
        new = np.log(np.exp(outgoing - top).sum(1)) + top[:, 0]
        messages = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
    total = own
    np.add.at(total, target, messages)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def added_spans(text: str, spans: list[Span], model: Model) -> list[Span]:
    """Spans of tokens outside the base spans that the field labels, neighbours of one label together."""
    if not spans:
        return []
    found = graph(text, spans)
    if found is None or not len(found.skip):
        return []
    chances = beliefs(found, model)
    label = chances.argmax(1)
    backed = {(int(group), int(seen)) for group, seen in zip(found.groups, found.observed) if seen and group >= 0}
    joined = {int(right) for _, right in found.chain}
    out: list[list] = []
    last = -2
    for i in range(len(label)):
        kind = int(label[i])
        if found.observed[i] or not kind or chances[i, kind] < BELIEF:
            continue
        if found.similar[i] != kind and (int(found.groups[i]), kind) not in backed:
            continue
        start, end = int(found.starts[i]), int(found.ends[i])
        if last == i - 1 and i in joined and out[-1][0] == LABELS[kind]:
            out[-1][2] = end
        else:
            out.append([LABELS[kind], start, end])
        last = i
    return [tuple(span) for span in out]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
SPAN_DDL = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every row: code point ranges, end exclusive, by start and kind."""
    shared = common.share(docs.sparkSession, model)

    def run(batches):
        known_model = shared()
        for batch in common.slices(batches):
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, text in _candidates(batch):
                base = base_spans(text)
                known = set(base)
                rows[i] = [{"kind": kind, "start": start, "end": end, "base": (kind, start, end) in known}
                           for kind, start, end in in_order(base + added_spans(text, base, known_model))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(SPAN))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.utf8(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, spans {SPAN_DDL}")


def as_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; n_chars follows where it exists.

    Overlapping spans are replaced together, by the kind of the first one.  Null texts stay null; rows without spans are unchanged.
    """
    shared = common.share(docs.sparkSession, model)
    columns = docs.columns

    def run(batches):
        known_model = shared()
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            for i, data in enumerate(texts):
                if not data or not _DIGIT.search(data) and "@" not in data:
                    continue
                base = base_spans(data)
                parts, at = [], 0
                for kind, start, end in in_order(base + added_spans(data, base, known_model)):
                    if start >= at:
                        parts += [data[at:start], f"<{kind}>"]
                    at = max(at, end)
                texts[i] = "".join([*parts, data[at:]])
            arrays = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in columns else out
