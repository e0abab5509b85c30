"""Encoding of a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is written straight from the vocabulary: each token's
bytes are mapped to visible characters, its rank becomes its id, and its
negative rank its score, so that the merge with the lowest rank wins. No text is
normalised. Texts are first split into pre-tokens by the vocabulary's own
pattern; the model encodes the distinct pre-tokens of a batch and the documents
are put together from them. ``decode`` is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"

# Fixed value: the pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens kept by a worker between batches.
CACHE_SIZE = 1 << 18


def byte_alphabet() -> list[str]:
    """A visible character for each byte: printable ones stay, the rest follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(shifted)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks."""
    alphabet = byte_alphabet()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(alphabet[b] for b in token).encode()
        pieces[rank] = _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
    unknown = _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)
    bpe = 2
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, len(pieces))
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_field(1, p) for p in [*pieces, unknown]) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with a base64 token and a rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes batches of texts; one for each worker and vocabulary."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(PATTERN).findall
        self.visible = dict(enumerate(byte_alphabet()))
        self.tokens = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offset at which each begins and the last ends."""
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_SIZE:
            self.known = {}
        known = self.known
        new = list({p for part in parts for p in part if p not in known})
        if new:
            # latin-1 gives each byte its own character, which translate then makes visible
            mapped = [p.encode().decode("latin-1").translate(self.visible) for p in new]
            known.update(zip(new, self.model.encode(mapped, out_type=int, num_threads=1)))
        flat: list[int] = []
        offsets = [0]
        for part in parts:
            for p in part:
                flat += known[p]
            offsets.append(len(flat))
        return np.array(flat, dtype=np.int32), np.array(offsets, dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        return b"".join(self.tokens[i] for i in ids).decode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids) for each row of ``documents``; other columns are not read.

    ``ids`` is an empty list for '' and for null. Strings of special tokens are
    ordinary text. Repeated rows come out as often as they go in, an empty table
    gives an empty table, and ids may be null.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                flat, offsets = own.encode_batch(piece.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), ids], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, text) of encoded rows; the inverse of ``encode_corpus`` but for null, which comes back as ''."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)
