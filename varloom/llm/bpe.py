"""Byte-level BPE by a sentencepiece model made from a rank file.

The model holds every byte sequence of the vocabulary spelt in printable
characters (one per byte), scored by its negative rank, so the best-scored merge
is the lowest rank and ties go to the leftmost pair, as in the rank-based
encoder.  Normalisation is the identity: no dummy prefix, no space handling.
Texts are cut into pre-tokens first; each is encoded on its own.

Nulls count as empty text; an empty text has no ids.  Lone surrogates cannot
occur in Spark strings.  Rows are encoded independently, so repeated rows, ties
and extra columns have no influence.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import slices

#: Pre-tokens whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Byte sequences of a ``base64 rank`` file in rank order."""
    found: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if parts := line.split():
                found[int(parts[1])] = base64.b64decode(parts[0])
    tokens = [found[i] for i in range(len(found))]
    if missing := 256 - sum(len(t) == 1 for t in tokens):
        raise ValueError(f"the vocabulary lacks {missing} single bytes")
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for byte in range(256):
        if byte in plain:
            out.append(chr(byte))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model file of a vocabulary in rank order; ids are ranks."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, normal))
    out += _block(1, _block(1, b"<unk>") + _number(3, unknown))
    out += _block(2, _number(3, bpe) + _number(4, len(tokens) + 1))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one worker; ids travel as little-endian 32-bit integers."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spell = str.maketrans({chr(i): c for i, c in enumerate(byte_characters())})
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(pieces)
        spelt = [p.encode().decode("latin-1").translate(self.spell) for p in fresh]
        for piece, ids in zip(fresh, self.processor.encode(spelt, num_threads=1), strict=True):
            self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        pieces = self.find(text)
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            self._learn(set(pieces))
            return b"".join([known[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


#: The codec of this worker process, kept between tasks.
_own: dict[str, Codec] = {}


def _shared(spark, vocabulary: str, pattern: str):
    tokens = read_ranks(vocabulary)
    model = serialise_model(tokens)
    name = hashlib.sha256(model + pattern.encode()).hexdigest()
    # of the vocabulary's size, whatever the corpus holds
    parts = spark.sparkContext.broadcast((tokens, model, pattern))

    def codec() -> Codec:
        if name not in _own:
            _own.clear()
            _own[name] = Codec(*parts.value)
        return _own[name]

    return codec


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as ``array<int>`` in ``ids`` (replacing a column of that name)."""
    codec = _shared(docs.sparkSession, vocabulary, pattern)
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c != ids])
    schema = kept.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in slices(batches, text, 8 << 20):
            lists = [np.frombuffer(own.encode(t or ""), dtype="<i4") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, type=pa.list_(pa.int32()))], names=[*batch.schema.names, ids]
            )

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that each id list stands for in ``decoded``; null ids give empty bytes."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kept = encoded.select([F.col(f"`{c}`") for c in encoded.columns if c != decoded])
    schema = kept.withColumn(decoded, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = tokens.value
        for batch in batches:
            data = [b"".join([spelt[i] for i in x or ()]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(data, type=pa.binary())], names=[*batch.schema.names, decoded]
            )

    return kept.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, text): the number of ids, and digests of the ids and of the bytes decoded from them.

    One pass encodes and decodes, so no id list leaves the worker.
    """
    codec = _shared(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in slices(batches, "text", 8 << 20):
            counts, of_ids, of_text = [], [], []
            for t in batch.column("text").to_pylist():
                ids = own.encode(t or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
