"""Byte-level BPE on sentencepiece: a BPE model is serialised straight from a vocabulary of ranks.

Every byte becomes one printable character, every vocabulary entry a piece of such characters whose score is the
negative rank, and the normaliser is the identity. The library then merges the best-ranked pair first, as rank-based
byte-level BPE does. Texts are cut into pre-tokens by the vocabulary's pattern; each is encoded on its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker's memory of encoded pre-tokens is emptied at this many.
CACHE_LIMIT = 200_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[bytes], list[int]]:
    """A sentencepiece model of the ranks; the bytes and the id of each of its pieces (the unknown piece comes last)."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, the first is {missing[0]}")
    letters = byte_characters()
    entries = sorted(ranks.items(), key=lambda x: x[1])
    body = bytearray()
    for piece, rank in entries:
        text = "".join(letters[b] for b in piece).encode()
        body += _message(1, _message(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1))
    body += _message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(entries) + 1) + _number(40, len(entries)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(body) + _message(2, trainer) + _message(3, normaliser), [p for p, _ in entries], [r for _, r in entries]


class ByteBpe:
    """Encodes and decodes whole texts; ids are the vocabulary's ranks."""

    def __init__(self, raw: bytes, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(raw)
        model, pieces, ids = serialise(ranks)
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._ids = np.array(ids, "<u4")
        self._bytes = dict(zip(ids, pieces, strict=True))
        self._whole = {"".join(map(byte_characters().__getitem__, p)): r for p, r in ranks.items()}
        self._letters = {b: c for b, c in enumerate(byte_characters())}
        self._cut = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        mapped = [x.encode().decode("latin-1").translate(self._letters) for x in tokens]
        for token, text, pieces in zip(tokens, mapped, self._sp.encode(mapped, num_threads=1), strict=True):
            # A pre-token that is itself an entry is that entry, even where no merges lead to it.
            ids = self._ids[pieces] if len(pieces) == 1 or text not in self._whole else np.array([self._whole[text]], "<u4")
            self._known[token] = ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self._cut(text)
        known = self._known
        if new := [x for x in set(tokens) if x not in known]:
            if len(known) + len(new) > CACHE_LIMIT:
                known.clear()
                new = list(set(tokens))
            self._learn(new)
        return b"".join(map(known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _worker(key: tuple[str, str], shared) -> ByteBpe:
    return ByteBpe(shared.value, key[1])


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """Of (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, on demand, ``ids`` (binary, 4 bytes each).

    One row per input row, repeated rows included. Null text counts as empty: no tokens, digests of nothing. A null
    doc_id is kept. Text is encoded whole, whatever its length; other columns are ignored. An empty table gives no rows.
    ``vocabulary`` is the path of a rank file; its bytes (fixed size, under 1 MB) are broadcast.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(raw), (hashlib.sha256(raw).hexdigest(), pattern)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(key, shared)
        for batch in batches:
            out: list[list] = [[], [], []]
            kept = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                for column, x in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()), strict=True):
                    column.append(x)
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
