"""Exact removal of repeated substrings by a distributed, common-prefix-aware suffix sort.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (in a
document of smaller id, or earlier in the same one). Texts are compared as UTF-8 bytes.

1. Suffixes are sampled at minimisers: of every window of LENGTH bytes, the place with the
   smallest hash of GRAM bytes. Equal windows have their minimiser at the same offset, so
   every window belongs to one sampled suffix, and two windows can only be equal if those
   suffixes share their first GRAM bytes. Suffixes whose GRAM hash occurs once are dropped.
2. Tasks sort their remaining suffixes (hash, then text to the end of the last window they
   stand for) into runs and send each range of a run as front-coded block: shared prefix
   length and rest.
3. A range's runs are merged by a loser tree. A match of two suffixes is decided by their
   known common prefixes where those differ, and else compares on from where they end.
4. The prefixes shared by neighbours tell for every window length right of the sample which
   suffixes agree; the bytes left of it are refined byte by byte. The earliest window of
   each class stays, all others are marked in a 64-bit mask of the suffix.

Defined results: null or empty text has no bytes; texts under LENGTH bytes lose nothing. A
document id names one text: rows that repeat id and text get the same result each; a row without an id loses nothing. Columns
of any other name are not read. An empty table gives an empty result. Long texts are worked
off in overlapping stretches. Texts of one repeated byte have a suffix at each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import id_and_text, keep, pieces, utf8

LENGTH = 100
GRAM = 37
OFFSETS = LENGTH - GRAM + 1  # 64: the minimisers of a window, and the bits of a mask
STRETCH = 1 << 20
PLACE_BITS = 21
PIECE_BYTES = 2 << 20
RUN = 60_000
RANGE = 60_000
FACTOR = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- samples


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM bytes in a row."""
    out, done, step, width, factor = None, 0, raw.astype(np.uint64) + np.uint64(1), 1, FACTOR
    while width <= GRAM:
        if GRAM & width:
            part = step[done : len(raw) - GRAM + done + 1]
            out = part if out is None else out * np.uint64(pow(FACTOR, width, 1 << 64)) + part
            done += width
        if 2 * width <= GRAM:
            step = step[:-width] * np.uint64(factor) + step[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def samples(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sampled suffix: its place, first and last window start that it stands for, and its hash."""
    found = []
    for at in range(0, max(1, len(text) - LENGTH + 1), STRETCH):
        raw = np.frombuffer(text, np.uint8)[at : at + STRETCH + LENGTH - 1]
        if len(raw) < LENGTH:
            continue
        h = gram_hashes(raw)
        place = np.arange(len(h), dtype=np.uint64)
        least = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | place  # ties go to the left
        width = 1
        while width < OFFSETS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        mins = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.diff(mins, prepend=-1))
        last = np.append(edges[1:], len(mins)) - 1
        where = mins[edges]
        # the least of many hashes is small; spread again, they cut into equal ranges
        spread = (h[where] ^ (h[where] >> np.uint64(33))) * np.uint64(0xD6E8FEB86659FD93)
        found.append((where + at, edges + at, last + at, spread ^ (spread >> np.uint64(32))))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, place) of sampled suffixes whose hash occurs more than once.

    A hash that occurs twice within a piece of the input is known to repeat: its places are
    dealt at random, and one row without a document tells the other pieces of it. A hot
    hash thus has a row per piece in its task.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                ids, places, hashes = [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
                    at, _, _, h = samples(text)
                    ids.append(np.full(len(at), doc, np.int64))
                    places.append(at)
                    hashes.append(h.view(np.int64))
                h, doc, place = (np.concatenate(x) for x in (hashes, ids, places))
                _, first, where, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = count[where] > 1
                tell = h[first[count > 1]]
                anywhere = (doc * np.int64(-7046029254386353131)) ^ (place * np.int64(-4658895280553007687))
                none = np.full(len(tell), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.where(known, anywhere, h), tell])),
                        pa.array(np.concatenate([doc, none]), mask=np.concatenate([np.zeros(len(doc), bool), np.ones(len(tell), bool)])),
                        pa.array(np.concatenate([place, none])),
                        pa.array(np.concatenate([known, np.zeros(len(tell), bool)])),
                    ],
                    ["h", "doc_id", "place", "known"],
                )

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # last row so far; known if one like it came before
        for batch in batches:
            h, place, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "place", "known"))
            if not len(h):
                continue
            named = np.asarray(batch.column("doc_id").is_valid())
            doc = batch.column("doc_id").fill_null(-1).to_numpy()
            if held is not None:
                h, doc, place, known, named = (np.concatenate(([held[i]], x)) for i, x in enumerate((h, doc, place, known, named)))
            same = h[1:] == h[:-1]
            hit = known | np.concatenate(([False], same)) | np.concatenate((same, [False]))
            held = (h[-1], doc[-1], place[-1], bool(hit[-1]), bool(named[-1]))
            hit[-1] = False
            hit &= named
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(place[hit])], ["doc_id", "place"])
        if held is not None and held[3] and held[4]:
            yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64())], ["doc_id", "place"])

    rows = docs.mapInArrow(sample, "h long, doc_id long, place long, known boolean")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(several, "doc_id long, place long")


# ---------------------------------------------------------------- runs


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


class Run:
    """Sorted suffixes as front-coded block: shared prefix lengths and rests, and what belongs to each suffix."""

    FIELDS = (("lcp", np.uint8), ("size", np.uint8), ("near", np.uint8), ("far", np.uint8), ("doc", np.int64), ("place", np.int64))

    @staticmethod
    def pack(keys: list[bytes], lefts: list[bytes], near, far, doc, place) -> bytes:
        lcp = [0, *(shared(a, b, 0) for a, b in zip(keys, keys[1:], strict=False))]
        parts = [np.array([len(keys)], np.int64).tobytes()]
        values = {"lcp": lcp, "size": [len(k) for k in keys], "near": near, "far": far, "doc": doc, "place": place}
        parts += [np.asarray(values[name], kind).tobytes() for name, kind in Run.FIELDS]
        parts += [k[n:] for k, n in zip(keys, lcp, strict=True)]
        parts += lefts  # as long as ``far`` says
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    def __init__(self, packed: bytes):
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n = self.n = int(np.frombuffer(raw, np.int64, 1)[0])
        at = 8
        for name, kind in Run.FIELDS:
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.keys, key = [], b""
        for lcp, size in zip(self.lcp.tolist(), self.size.tolist(), strict=True):
            key = key[:lcp] + raw[at : at + size - lcp]
            at += size - lcp
            self.keys.append(key)
        self.left = []
        for far in self.far.tolist():
            self.left.append(raw[at : at + far])
            at += far


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the suffix before) in sorted order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    keys = [r.keys for r in runs] + [[] for _ in range(size - len(runs))]
    lcps = [r.lcp.tolist() for r in runs] + [[] for _ in range(size - len(runs))]
    # a finished run has a negative prefix and loses to all
    now = [0 if keys[i] else -1 for i in range(size)]
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps the prefix it shares with the winner."""
        if now[a] != now[b]:
            return (a, b) if now[a] > now[b] else (b, a)
        if now[a] < 0:
            return a, b
        x, y = keys[a][at[a]], keys[b][at[b]]
        n = shared(x, y, now[a])
        if (x[n:] <= y[n:]) if n < len(x) and n < len(y) else len(x) <= len(y):
            now[b] = n
            return a, b
        now[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while now[winner] >= 0:
        yield winner, at[winner], now[winner]
        at[winner] += 1
        now[winner] = lcps[winner][at[winner]] if at[winner] < len(keys[winner]) else -1
        node = (winner + size) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def later_windows(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, mask): bit l of a mask says that the window l bytes left of the place starts earlier elsewhere."""
    first = np.cumsum([0, *(r.n for r in runs)])
    order, lcp = [], []
    for run, at, n in merge(runs):
        order.append(first[run] + at)
        lcp.append(n)
    order, lcp = np.array(order, np.int64), np.array(lcp, np.int64)
    doc, place, near, far = (np.concatenate([getattr(r, f) for r in runs])[order] for f in ("doc", "place", "near", "far"))
    lefts = [x for r in runs for x in r.left]
    left = np.frombuffer(b"".join(lefts[i][::-1].ljust(OFFSETS, b"\0") for i in order.tolist()), np.uint8).reshape(-1, OFFSETS)
    earlier = np.lexsort((place, doc))
    doc, place, near, far, left = (x[earlier] for x in (doc, place, near, far, left))
    rank = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))))
    mask = np.zeros(len(doc), np.uint64)
    side = np.zeros(len(doc), np.int64)
    for back in range(OFFSETS):
        if back:
            some = np.flatnonzero(far >= back)
            side[some] = np.unique(side[some] * 256 + left[some, back - 1], return_inverse=True)[1]
        some = np.flatnonzero((near <= back) & (back <= far))
        if len(some) < 2:
            continue
        # suffixes of one number agree in all bytes right of the place that this window covers
        group = np.cumsum(lcp < 8 + LENGTH - back)[earlier]
        _, start, where = np.unique(group[some] * len(doc) + side[some], return_index=True, return_inverse=True)
        late = rank[some] > rank[some[start[where]]]
        mask[some[late]] |= np.uint64(1 << back)
    hit = mask != 0
    return doc[hit], place[hit], mask[hit]


def _runs(candidates: DataFrame, ranges: int) -> DataFrame:
    """``candidates``: doc_id, text, places. Sorted runs of suffixes, cut at equal ranges of their hash."""
    width = (1 << 64) // ranges + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                rows = zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), part.column("places"), strict=True)
                for doc, text, places in rows:
                    at, lo, hi, h = samples(text)
                    hit = np.isin(at, places.values.to_numpy())
                    big = h[hit].astype(">u8").tobytes()
                    for k, (a, p, q) in enumerate(zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True)):
                        held.append((big[8 * k : 8 * k + 8] + text[a : q + LENGTH], text[p:a], a - q, a - p, doc, a))
                    if len(held) >= RUN:
                        yield _blocks(held, width)
                        held = []
        if held:
            yield _blocks(held, width)

    return candidates.mapInArrow(run, "part long, block binary")


def _blocks(held: list[tuple], width: int) -> pa.RecordBatch:
    """A run in blocks by range. Of suffixes alike in all their windows only the earliest goes
    on; the others are known to be late and leave as a block of masks (a negative range)."""
    held.sort()
    kept, late = [], []
    for r in held:
        if kept and r[:4] == kept[-1][:4]:
            if r[4:] != kept[-1][4:]:
                mask = ((1 << r[3] - r[2] + 1) - 1) << r[2]
                late.append((*r[4:], mask - (1 << 64) if mask >> 63 else mask))
        else:
            kept.append(r)
    parts = [int.from_bytes(r[0][:8]) // width for r in kept]
    edges = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
    names, blocks = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        names.append(parts[a])
        blocks.append(Run.pack(*[list(x) for x in zip(*kept[a:b], strict=True)]))
    if late:
        names.append(-1 - (late[0][0] * 31 + late[0][1]) % (1 << 40))
        blocks.append(np.array(late, np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blocks, pa.binary())], ["part", "block"])


def _merged(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if part < 0:
                    rows = np.frombuffer(block, np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["doc_id", "place", "mask"])
                    continue
                if part != now:
                    if held:
                        yield _mask_rows(held)
                    now, held = part, []
                held.append(Run(block))
        if held:
            yield _mask_rows(held)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, "doc_id long, place long, mask long")


def _mask_rows(runs: list[Run]) -> pa.RecordBatch:
    doc, place, mask = later_windows(runs)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(place), pa.array(mask.view(np.int64))], ["doc_id", "place", "mask"]
    )


# ---------------------------------------------------------------- whole operator


def cut(text: bytes, places: np.ndarray, masks: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    change = np.zeros(len(text) + 1, np.int32)
    bits = masks.view(np.uint64)
    for back in range(OFFSETS):
        start = places[(bits >> np.uint64(back) & np.uint64(1)).astype(bool)] - back
        start = start[(start >= 0) & (start + LENGTH <= len(text))]
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary: what is left of the text)."""
    slim = id_and_text(docs, doc_id, text)
    repeated = _repeated(slim.filter("doc_id is not null")).groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    repeated = keep(repeated, "repeated")
    total = repeated.agg(F.sum(F.size("places"))).first()[0] or 0
    named = repeated.select(F.col("doc_id").alias("of"), "places")
    candidates = slim.join(named, F.col("doc_id") == F.col("of")).select("doc_id", "text", "places")
    masks = _merged(_runs(candidates, max(1, -(-total // RANGE))))
    masks = masks.groupBy("doc_id").agg(F.collect_list(F.struct("place", "mask")).alias("late"))
    masks = keep(masks.select(F.col("doc_id").alias("of"), "late.place", "late.mask"), "masks")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                texts, out = utf8(part.column("text")), []
                for t, place, mask in zip(texts, part.column("place"), part.column("mask"), strict=True):
                    if place.is_valid:
                        out.append(cut(t, place.values.to_numpy(), mask.values.to_numpy()))
                    else:
                        out.append(cut(t, none, none) if not t else (0, 0, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.int64()),
                        pa.array([o[2] for o in out], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = slim.join(masks, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "place", "mask")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
