"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every byte stands for one printable character, every vocabulary entry becomes a piece of such characters
with the negative rank as score, and normalisation is the identity.  Merging the pair of the highest score
first is then merging by the lowest rank.  Texts are split by the vocabulary's pattern, each match is
encoded by itself, and ids are decoded through the inverse of the byte mapping.

Null text counts as empty (no ids); equal rows give equal results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import common

# Bytes stand for the characters from U+0100 on: letters without any special meaning in the model.
FIRST_CHARACTER = 0x100
CACHE_ENTRIES = 180_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: bytes, non-negative integer or 32-bit float."""
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def as_characters(data: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + byte) for byte in data)


def as_bytes(piece: str) -> bytes:
    return bytes(ord(character) - FIRST_CHARACTER for character in piece)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank table whose ranks are 0, 1, 2, ...; the unknown piece comes last.

    Field numbers are those of the public sentencepiece_model.proto (fixed values).
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    missing = [byte for byte in range(256) if bytes([byte]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, as_characters(token).encode()) + _field(2, -float(rank)) + _field(3, normal))
        for token, rank in sorted(ranks.items(), key=lambda item: item[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    n = len(ranks)
    trainer = _field(3, bpe) + _field(4, n + 1) + _field(40, n)
    trainer += b"".join(_varint(number << 3) + b"\xff" * 9 + b"\x01" for number in (41, 42, 43))  # no <s>, </s>, <pad>
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one process; broadcast whole, so that a reused worker keeps what it knows.

    Ids of matches are remembered in two generations of bounded size; the unknown matches of a batch are encoded together.
    """

    def __init__(self, model: bytes, pattern: str):
        self.recipe = model, pattern
        self.split = None

    def __getstate__(self):
        return self.recipe

    def __setstate__(self, recipe):
        self.__init__(*recipe)

    def start(self) -> Codec:
        if self.split is None:
            model, pattern = self.recipe
            self.split = regex.compile(pattern).findall
            self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.unknown = self.model.get_piece_size() - 1
            self.inverse = [as_bytes(self.model.id_to_piece(i)) for i in range(self.unknown)]
            self.whole = {piece: i for i, piece in enumerate(self.inverse)}
            self.packed = [struct.pack("<I", i) for i in range(self.unknown)]
            self.byte_map = {i: FIRST_CHARACTER + i for i in range(256)}
            self.known: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
        return self

    def learn(self, matches: set[str]) -> None:
        """Ids of matches that are not known; a match that is a token itself is that token."""
        merged, parts = [], []
        for match in matches:
            data = match.encode()
            whole = self.whole.get(data)
            if whole is not None:
                self.known[match] = self.packed[whole]
            else:
                merged.append(match)
                parts.append(data.decode("latin-1").translate(self.byte_map))
        if merged:
            ids = self.model.encode(parts, num_threads=1)
            self.known.update(zip(merged, [struct.pack(f"<{len(row)}I", *row) for row in ids], strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self.split(text) for text in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        new: set[str] = set().union(*split)
        new.difference_update(self.known)
        if self.older:
            again = new.intersection(self.older)
            self.known.update((match, self.older[match]) for match in again)
            new -= again
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, matches)) for matches in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.inverse.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, column: str, made: dict[str, str], work) -> DataFrame:
    """doc_id and the columns that ``work(codec, values)`` makes of a column, in Arrow batches."""
    model = Codec(serialise(read_ranks(vocabulary)), pattern)
    shared = common.share(docs.sparkSession, model)  # one vocabulary: fixed size

    def run(batches):
        codec = shared().start()
        for batch in common.slices(batches, 2 << 20, column):
            done = work(codec, batch.column(column).to_pylist())
            arrays = [pa.array(values, pa.int64() if kind == "long" else pa.binary()) for values, kind in zip(done, made.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *made])

    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), **made}
    return docs.select("doc_id", column).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit integers, and the bytes they decode to."""

    def work(codec: Codec, texts: list[str | None]):
        ids = codec.encode_all([text or "" for text in texts])
        return [len(row) // 4 for row in ids], ids, [codec.decode(row) for row in ids]

    return _mapped(docs, vocabulary, pattern, "text", {"n_tokens": "long", "ids": "binary", "decoded": "binary"}, work)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); invalid UTF-8 is replaced, null ids give an empty text."""

    def work(codec: Codec, ids: list[bytes | None]):
        return ([codec.decode(row or b"") for row in ids],)

    rows = _mapped(encoded, vocabulary, pattern, "ids", {"data": "binary"}, work)
    return rows.select("doc_id", F.decode("data", "utf-8").alias("text"))


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
