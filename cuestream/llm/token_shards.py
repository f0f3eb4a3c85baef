"""Token ids in training order, as fixed-stride shards.

Documents are tokenised and cut into sequences of at most ``length`` tokens, which are
numbered in the order in which the tokenised table was written (it is kept, so a resumed
job numbers alike). A keyed Feistel network with cycle-walking permutes the numbers 0 to
n - 1, which gives every sequence a global slot without a sort or a shuffle buffer. Range
partitions of slots then write shards: one row per shard, whose block holds its sequences
one after another, each padded to the same stride. Slot s is at byte
``(s % per_shard) * stride`` of shard ``s // per_shard``, so a reader can start at any slot.

Defined results: null or empty texts have no tokens and no sequence. Repeated rows are
sequences of their own. Text in the vocabulary's control strings is ordinary text. An empty
table gives no shard. A long document is as many sequences as it needs. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm.byte_bpe import Bpe, read_ranks
from cuestream.llm.shared import exists, id_and_text, keep, pieces

LENGTH = 512
PER_SHARD = 1024
PIECE_BYTES = 2 << 20
#: Shards that one task writes.
SHARDS_PER_TASK = 16
ROUNDS = 6


# ---------------------------------------------------------------- permutation


@dataclass(frozen=True)
class Permutation:
    """Keyed permutation of 0 to n - 1: a balanced Feistel network on the next even number of bits.

    A value that leaves the range is sent through again until it is inside (cycle-walking);
    the domain is under four times the range, so that takes under four rounds on average.
    """

    n: int
    key: int

    @property
    def half(self) -> int:
        return max(1, -(-max(1, (self.n - 1).bit_length()) // 2))

    def _keys(self) -> list[np.uint64]:
        raw = hashlib.sha256(f"{self.key}".encode()).digest() + hashlib.sha256(f"{self.key}/2".encode()).digest()
        return [np.uint64(int.from_bytes(raw[8 * r : 8 * r + 8], "little")) for r in range(ROUNDS)]

    def _scramble(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ self._scramble(right, key)
        return left << bits | right

    def _swap(self, x: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        return (x & mask) << bits | x >> bits

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, dtype=np.uint64))
        while (far := out >= np.uint64(self.n)).any():
            out[far] = step(out[far])
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        keys = self._keys()
        return self._walk(x, lambda v: self._network(v, keys))

    def backward(self, x: np.ndarray) -> np.ndarray:
        keys = self._keys()[::-1]
        return self._walk(x, lambda v: self._swap(self._network(self._swap(v), keys)))


# ---------------------------------------------------------------- sequences


@lru_cache(maxsize=2)
def _encoding(tokens: tuple[bytes, ...], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@lru_cache(maxsize=2)
def _own_encoder(tokens: tuple[bytes, ...], pattern: str) -> Bpe:
    return Bpe(list(tokens), pattern)


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binaries over one buffer of bytes."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, one after another, and the size of each value."""
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def sequences(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, part, n_tokens, ids): the tokens of each text in pieces of at most ``length``.

    The library gives up on very long runs of blanks; operator 3 encodes such a text.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(tuple(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, kind = _encoding(tokens.value, pattern), np.dtype(dtype_for(len(tokens.value)))

        def encode(t: str) -> np.ndarray:
            try:
                return encoding.encode_to_numpy(t, disallowed_special=())
            except ValueError:
                return np.frombuffer(_own_encoder(tokens.value, pattern).encode(t), "<u4")

        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                flat = [encode(t) for t in part.column("text").to_pylist()]
                sizes = np.array([len(f) for f in flat], np.int64)
                count = -(-sizes // length)
                doc = np.repeat(np.arange(len(flat)), count)
                which = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                starts = np.repeat(np.cumsum(sizes) - sizes, count) + which * length
                edges = np.append(starts, sizes.sum())
                data = np.concatenate([*flat, np.empty(0, np.uint32)]).astype(kind).view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc, pa.int64())),
                        pa.array(which, pa.int64()),
                        pa.array(np.diff(edges), pa.int64()),
                        binary_array(data, edges * kind.itemsize),
                    ],
                    ["doc_id", "part", "n_tokens", "ids"],
                )

    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, part long, n_tokens long, ids binary")


def _numbered(kept: DataFrame) -> tuple[dict[int, int], int]:
    """First number of each written partition, and how many sequences there are."""
    rows = kept.groupBy(F.shiftright("mark", 33).alias("task")).count().orderBy("task").collect()
    first, total = {}, 0
    for r in rows:  # a row per task that wrote
        first[r["task"]] = total
        total += r["count"]
    return first, total


SHARDS = (
    "shard long, first_slot long, n_sequences long, stride long, id_bytes long, "
    "doc_ids array<long>, parts array<long>, n_tokens array<long>, block binary"
)


def materialise(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: int = 0,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    target: str | None = None,
    tokenised: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all shards below ``target`` (default: a new path in the shared folder) and read them back.

    A shard row has ``block`` and, in slot order, the document, part and number of tokens of
    each of its sequences, and ``id_bytes``, the width of an id. Every shard but the last has
    ``per_shard`` sequences. With ``tokenised``, a path, a job that is started again goes on
    from the numbered sequences that an earlier one finished there.
    """
    spark = docs.sparkSession
    id_bytes = np.dtype(dtype_for(len(read_ranks(path)))).itemsize
    stride = length * id_bytes
    columns = "doc_id long, part long, n_tokens long, ids binary, mark long"
    if tokenised and exists(spark, f"{tokenised}/_SUCCESS"):
        kept = spark.read.schema(columns).parquet(tokenised)
    else:
        cut = sequences(docs, path, pattern, length, doc_id, text)
        kept = keep(cut.withColumn("mark", F.monotonically_increasing_id()), "sequences", tokenised)
    first, total = _numbered(kept)
    starts = spark.sparkContext.broadcast(first)
    order = Permutation(max(1, total), key)
    rest = ("doc_id", "part", "n_tokens", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy()
            task, where = np.unique(marks >> 33, return_inverse=True)
            start = np.array([starts.value[t] for t in task.tolist()], dtype=np.int64)[where] if len(marks) else marks
            slots = order.forward(start + (marks & ((1 << 33) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *[batch.column(c) for c in rest]], ["slot", *rest])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shards = batch.column("slot").to_numpy() // per_shard
            edges = [*np.flatnonzero(np.diff(shards, prepend=-1)).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                if now != shards[a]:
                    if held:
                        yield _shard(now, held, per_shard, stride, id_bytes)
                    now, held = int(shards[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield _shard(now, held, per_shard, stride, id_bytes)

    placed = kept.mapInArrow(place, "slot long, doc_id long, part long, n_tokens long, ids binary")
    per_task = per_shard * SHARDS_PER_TASK
    tasks = max(1, math.ceil(total / per_task))
    # slots are dense, so equal ranges of them are equal partitions
    ranged = placed.repartitionById(tasks, F.floor(F.col("slot") / per_task).cast("int")).sortWithinPartitions("slot")
    return keep(ranged.mapInArrow(write, SHARDS), "shards", target)


def _shard(shard: int, held: list[pa.RecordBatch], per_shard: int, stride: int, id_bytes: int) -> pa.RecordBatch:
    blocks = []
    for batch in held:
        data, sizes = bytes_of(batch.column("ids"))
        block = np.zeros((len(sizes), stride), np.uint8)
        block[np.arange(stride) < sizes[:, None]] = data
        blocks.append(block.tobytes())
    n = sum(b.num_rows for b in held)
    lists = [pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "part", "n_tokens")]
    numbers = {"shard": shard, "first_slot": shard * per_shard, "n_sequences": n, "stride": stride, "id_bytes": id_bytes}
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array([v], pa.int64()) for v in numbers.values()],
            *[pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in lists],
            pa.array([b"".join(blocks)], pa.binary()),
        ],
        [*numbers, "doc_ids", "parts", "n_tokens", "block"],
    )


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def read_slots(shards: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """Rows (slot, shard, doc_id, part, n_tokens, ids) from slot ``first`` on, cut out of the blocks by stride.

    The bounds reach the scan as a range of shards, so a resumed reader opens only what is left.
    """
    end = None if count is None else first + count
    some = shards.filter(F.col("first_slot") + F.col("n_sequences") > first)
    some = some if end is None else some.filter(F.col("first_slot") < end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, n, stride, width = (batch.column(c)[row].as_py() for c in ("first_slot", "n_sequences", "stride", "id_bytes"))
                a, b = max(0, first - at), n if end is None else min(n, end - at)
                lists = [batch.column(c)[row].values.slice(a, b - a) for c in ("doc_ids", "parts", "n_tokens")]
                block = np.frombuffer(batch.column("block")[row].as_buffer(), np.uint8).reshape(n, stride)[a:b]
                sizes = lists[2].to_numpy() * width
                data = block[np.arange(stride) < sizes[:, None]]
                shard = np.full(b - a, batch.column("shard")[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at + a, at + b, dtype=np.int64)),
                        pa.array(shard),
                        *lists,
                        binary_array(data, np.concatenate(([0], np.cumsum(sizes)))),
                    ],
                    ["slot", "shard", "doc_id", "part", "n_tokens", "ids"],
                )

    return some.mapInArrow(run, "slot long, shard long, doc_id long, part long, n_tokens long, ids binary")
