"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

The vocabulary has a rank for each byte sequence. Each byte is mapped to one
code point, each sequence becomes a piece with the score minus its rank, and
normalisation is the identity, so sentencepiece's highest-score-first merging is
byte-level BPE's lowest-rank-first merging. Texts are cut into pre-tokens, each
encoded by itself; ids are decoded by the inverse mapping of ids to bytes.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Bytes of distinct pre-tokens whose ids a task remembers; beyond that it starts anew.
CACHE_BYTES = 4 << 20
#: Code point of byte 0; byte b is FIRST + b.
FIRST = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    """``path`` has a base64 byte sequence and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    return "".join(chr(FIRST + b) for b in data)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The model file: piece 0 is the unknown piece, piece 1 + r has rank r.

    Ranks must be 0 to n - 1 and include each single byte, or else a byte could
    not be encoded: ValueError.
    """
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in ordered] != list(range(len(ordered))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n - 1 and include every byte")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    normal, unknown, bpe = 1, 2, 2
    trainer = _field(3, bpe) + _field(4, len(ordered) + 1)
    trainer += _field(40, 0) + b"".join(_field(i, -1) for i in (41, 42, 43))  # ids of unk, bos, eos, pad
    identity = _field(1, b"identity") + b"".join(_field(i, 0) for i in (3, 4, 5))  # no prefix, trimming, escaping
    return (
        piece("<unk>", 0.0, unknown)
        + b"".join(piece(mapped(x), -float(r), normal) for r, x in enumerate(ordered))
        + _field(2, trainer)
        + _field(3, identity)
    )


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.whole = ranks
        self.bytes_of = sorted(ranks, key=ranks.get)
        self.chars = {b: FIRST + b for b in range(256)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def learn(self, tokens: set[str]) -> None:
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        tokens = [t for t in tokens if t not in self.known]
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        self.size += sum(map(len, raw))
        rest = []
        for t, b in zip(tokens, raw, strict=True):
            if (r := self.whole.get(b)) is not None:  # a pre-token that is a vocabulary entry is one id
                self.known[t] = (r,)
            else:
                rest.append((t, b.decode("latin-1").translate(self.chars)))
        if rest:
            for (t, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
                self.known[t] = tuple(i - 1 for i in ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.split(t) for t in texts]
        self.learn(set().union(*map(set, cut)) if cut else set())
        find = self.known.__getitem__
        return [list(chain.from_iterable(map(find, tokens))) for tokens in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def bpe_roundtrip(
    docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (binary, the ids decoded) to each row.

    ``vocab_path`` must be readable on every worker. A null text counts as empty
    and gives no ids and empty bytes. Rows that repeat and null ids of documents
    need nothing special: each row is encoded by itself, in one narrow pass.
    """

    def make():
        c = Codec(read_ranks(vocab_path), pattern)

        def run(texts):
            ids = c.encode([t or "" for t in texts])
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
            return {
                "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat).cast(pa.list_(pa.int32())),
                "decoded": [c.decode(x) for x in ids],
            }

        return run

    return map_text(docs, make, "ids array<int>, decoded binary", text_col, keep)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
