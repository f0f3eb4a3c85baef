"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut by the vocabulary's pattern. A pre-token that is itself in the vocabulary is
resolved by a minimal perfect hash (one hash, one displacement, one comparison). Any other
one is merged: its bytes form a linked list, a heap holds the mergeable neighbours by rank
and place, and each merge relinks two nodes and pushes at most two new pairs.

Defined results: null or empty text has no ids. Control strings of the vocabulary are
ordinary text. A pre-token of any length is merged whole, in n log n steps. Repeated rows
are encoded each on its own. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm.shared import id_and_text, pieces

PIECE_CHARS = 1 << 20
#: Bytes that a Python worker spends on words it remembers; it starts anew beyond.
MEMO_BYTES = 96 << 20
MEMO_TOKEN_CHARS = 64


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from lines of base64 and rank."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not 0 to {len(found) - 1}")
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one small integer for each bucket.

    Buckets are placed from the largest to the smallest. A bucket of several keys tries
    displacements until all its keys fall on free slots; a bucket of one key stores its
    slot directly, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append((h, i))
        self.shift = [0] * self.buckets
        self.value = [-1] * n
        free = [True] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in order:
            if len(members[b]) < 2:
                break
            d = 1
            while True:
                slots = [self.slot(h, d) for h, _ in members[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, members[b], strict=True):
                free[s], self.value[s] = False, i
        rest = iter([s for s in range(n) if free[s]])
        for b in order:
            if len(members[b]) == 1:
                s = next(rest)
                self.shift[b], self.value[s] = -s - 1, members[b][0][1]

    def slot(self, h: int, d: int) -> int:
        x = (h ^ d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) % self.n

    def candidate(self, key: bytes) -> int:
        """The only index that ``key`` can have; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.value[-d - 1 if d < 0 else self.slot(h, d)]


class Bpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        self._prepare()

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "hash": self.hash}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def _prepare(self) -> None:
        self.cut = regex.compile(self.pattern).findall
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.single = [self.rank.get(bytes([b]), -1) for b in range(256)]
        self.memo = _Memo(self)

    def lookup(self, piece: bytes) -> int:
        """The id of a whole pre-token, or -1."""
        i = self.hash.candidate(piece)
        return i if i >= 0 and self.tokens[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary: lowest rank first, leftmost of equals."""
        n = len(piece)
        rank = self.rank.get
        end = list(range(1, n + 1))  # where the part that begins here ends
        begin = list(range(-1, n))  # where the part left of the one that begins here begins
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of its two parts has been merged meanwhile
            alive[j] = False
            end[i] = stop
            if stop < n:
                begin[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            left = begin[i]
            if left >= 0 and (r := rank(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(self.single[piece[i]] if end[i] == i + 1 else self.rank[piece[i : end[i]]])
            i = end[i]
        return out

    def ids_of(self, piece: bytes) -> list[int]:
        whole = self.lookup(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class _Memo(dict):
    """Packed ids by pre-token, for those a worker has met before."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.size = 0

    def __missing__(self, token: str) -> bytes:
        ids = self.bpe.ids_of(token.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= MEMO_TOKEN_CHARS:
            # two objects with their heads, and their place in the table
            self.size += 220 + 2 * len(token) + len(packed)
            if self.size > MEMO_BYTES:
                self.clear()
                self.size = 0
            self[token] = packed
        return packed


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def share(spark: SparkSession, path: str, pattern: str):
    """The tokenizer as a broadcast; its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(tokenizer(path, pattern))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in pieces(batch, PIECE_CHARS, column):
        yield part, [t or "" for t in part.column(column).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    bpe = share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in texts_of(batch):
                ids = [bpe.value.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary) to the rows of ``encode``."""
    bpe = share(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in _slices(batch, at):
                raw = [bpe.value.decode(x or b"") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"]
                )

    schema = f"{encoded.schema.simpleString()[7:-1]},decoded:binary"
    return encoded.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, path: str, pattern: str, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids``.

    Encodes, decodes what came out, and hashes both in one Python worker, which holds one
    tokenizer and sends no text back.
    """
    bpe = share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in texts_of(batch):
                ids, decoded = [], []
                for t in texts:
                    ids.append(bpe.value.encode(t))
                    decoded.append(sha256(bpe.value.decode(ids[-1])))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array(list(map(sha256, ids)), pa.string()),
                    "decoded_sha256": pa.array(decoded, pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return id_and_text(docs, doc_id, text).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, at: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of rows that carry ``ids`` and ``decoded``."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
