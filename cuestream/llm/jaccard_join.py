"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Documents with one set are a class of copies and take
part once. Classes that share a band of MinHash values meet in a bucket; inside, MinHash
values are compared a few at a time, a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below ``tolerance``, and what remains is
verified on the whole sets. A pair counts in the first bucket that it shares.

Buckets are cut into blocks, and each pair of blocks is a task's work, so no bucket meets in
one task. A task returns one row per class that has links there: how many documents it
links to, and the class its local component is named after. Pairs never become rows; the
components are joined over those stars.

Bands are four values long and 25 in number: two sets of similarity 0.8 share none with
probability 2e-6, and more similar ones still less.

Defined results: null texts, and texts without a word, have no shingle, no link, and are
their own class. A text of one to four words has one shingle, all its words. Rows repeated
in the input are copies of each other. Similarity exactly at the threshold is a link. Class
ids are the smallest document id of the class; an empty table gives an empty result. Long
texts are whole sets. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import id_and_text, keep, pieces, utf8

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 4
TOLERANCE = 1e-6
BLOCK = 512
STEP = 10
PIECE_BYTES = 2 << 20
MEMO = 400_000
_rng = np.random.default_rng(20)
TIMES = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
BAND_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


_WORD_HASH = _WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * FACTOR + mix(h[j : len(h) - k + j + 1])
    return np.unique(mix(out))


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values (top 32 bits) of a non-empty set."""
    best = np.full(len(TIMES), ~np.uint64(0))
    for i in range(0, len(values), 4096):
        best = np.minimum(best, (TIMES[:, None] * values[None, i : i + 4096] + PLUS[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    part = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(BAND_SALT, part.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * FACTOR + part[:, :, r])
    return key.view(np.int64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


SETS = "doc_id long, row long, n_shingles long, f1 long, f2 long, bands array<long>"


def describe(docs: DataFrame) -> DataFrame:
    """Per row: the size and fingerprint of its set, and its band keys. ``docs`` has doc_id, row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                sets = [shingles(t) for t in utf8(part.column("text"))]
                prints = [fingerprint(s) if len(s) else (0, 0) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [[]] * len(sets)
                if full:
                    keys = band_keys(np.stack([signature(sets[i]) for i in full]))
                    for i, row in zip(full, keys, strict=True):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row", "n_shingles", "f1", "f2", "bands"],
                )

    return docs.mapInArrow(run, SETS)


# ---------------------------------------------------------------- inside a bucket


def least_matches(threshold: float, tolerance: float, compared: int) -> int:
    """Fewest matching MinHash values of ``compared`` with which a pair stays in the race.

    With a uniform prior the similarity has a beta posterior; the chance that it reaches the
    threshold is a sum of binomial terms.
    """
    n, chance = compared + 1, 0.0
    for m in range(compared + 1):
        chance += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if chance >= tolerance:
            return m
    return compared


CUTS = {n: least_matches(THRESHOLD, TOLERANCE, n) for n in range(STEP, BANDS * ROWS + 1, STEP)}


def pairs_in_race(left: np.ndarray, right: np.ndarray, open_pairs: np.ndarray, cuts: dict[int, int]) -> np.ndarray:
    """Open pairs (mask) of two blocks of signatures that survive every comparison."""
    count = np.zeros(open_pairs.shape, np.uint8)
    a = b = None
    for at in range(0, left.shape[1], STEP):
        if a is None and open_pairs.sum() * 8 < open_pairs.size:
            a, b = np.nonzero(open_pairs)
            count = count[a, b]
        if a is not None:
            count = count + (left[a, at : at + STEP] == right[b, at : at + STEP]).sum(axis=1, dtype=np.uint8)
            stay = count >= cuts[at + STEP]
            a, b, count = a[stay], b[stay], count[stay]
        else:
            for j in range(at, at + STEP):
                count += left[:, j][:, None] == right[:, j][None, :]
            open_pairs = open_pairs & (count >= cuts[at + STEP])
    if a is None:
        a, b = np.nonzero(open_pairs)
    return np.stack([a, b], axis=1)


def verified(pairs: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Those pairs whose whole sets reach the threshold; pairs are sorted by their left member."""
    if not len(pairs):
        return pairs
    good = np.zeros(len(pairs), bool)
    sizes = np.array([len(s) for s in right])
    num, den = threshold.numerator, threshold.denominator
    edges = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
    for at, end in zip(edges, [*edges[1:], len(pairs)], strict=True):
        mine = left[pairs[at, 0]]
        others = pairs[at:end, 1]
        for i in range(0, len(others), 64):
            part = others[i : i + 64]
            flat = np.concatenate([right[k] for k in part])
            found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            starts = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
            common = np.add.reduceat(found.astype(np.int64), starts)
            good[at + i : at + i + len(part)] = common * (num + den) >= num * (len(mine) + sizes[part])
    return pairs[good]


class Bucket:
    """Members of one pair of blocks of a bucket; ``same`` if it is a block with itself."""

    def __init__(self, band: int, same: bool):
        self.band, self.same = band, same
        self.rows: dict[tuple[int, int], tuple] = {}

    def add(self, node: int, side: int, weight: int, sig: bytes, values: bytes, kept: bytes) -> None:
        self.rows[(side, node)] = (node, weight, np.frombuffer(sig, np.uint32), np.frombuffer(values, np.uint64), np.frombuffer(kept, np.int64))

    def links(self, threshold: Fraction, cuts: dict[int, int]) -> list[tuple[int, int, int]]:
        """(node, documents it links to here, node its component is named after)."""
        sides = [[v for (side, _), v in sorted(self.rows.items(), key=lambda x: x[0]) if side == s] for s in (0, 1)]
        left, right = sides[0], sides[0] if self.same else sides[1]
        if not left or not right:
            return []
        open_pairs = np.ones((len(left), len(right)), bool)
        if self.same:
            open_pairs = np.triu(open_pairs, 1)
        lk, rk = np.stack([v[4] for v in left]), np.stack([v[4] for v in right])
        for j in range(self.band):  # a pair that shares an earlier bucket was counted there
            open_pairs &= (lk[:, j][:, None] != rk[:, j][None, :]) | (lk[:, j] == 0)[:, None]
        pairs = pairs_in_race(np.stack([v[2] for v in left]), np.stack([v[2] for v in right]), open_pairs, cuts)
        pairs = verified(pairs, [v[3] for v in left], [v[3] for v in right], threshold)
        count: dict[int, int] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, k in pairs.tolist():
            (a, wa), (b, wb) = left[i][:2], right[k][:2]
            count[a] = count.get(a, 0) + wb
            count[b] = count.get(b, 0) + wa
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [(node, n, root(node)) for node, n in count.items()]


def _match(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``rows``: key, lo, hi, side, band, node, weight, sig, values, kept; sorted runs are streamed."""
    exact = Fraction(str(threshold))
    cuts = {n: least_matches(threshold, tolerance, n) for n in range(STEP, BANDS * ROWS + 1, STEP)}
    names = ("key", "lo", "hi", "side", "band", "node", "weight", "sig", "values", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, None
        for batch in batches:
            out = []
            for key, lo, hi, side, band, *member in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if now != (key, lo, hi):
                    if bucket is not None:
                        out += bucket.links(exact, cuts)
                    now, bucket = (key, lo, hi), Bucket(band, lo == hi)
                node, weight, sig, values, kept = member
                bucket.add(node, side, weight, sig, values, kept)
            yield _link_rows(out)
        if bucket is not None:
            yield _link_rows(bucket.links(exact, cuts))

    sorted_rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return sorted_rows.select(*names).mapInArrow(run, "node long, links long, head long")


def _link_rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["node", "links", "head"]
    )


# ---------------------------------------------------------------- whole join


def components(edges: DataFrame) -> DataFrame:
    """(node, center) of every node on an edge (a, b): stars are joined until nothing changes.

    Large star and small star in turn: every node hangs itself and its neighbours on the
    smallest node it sees, which halves distances; a round is two aggregations and joins.
    """
    edges = keep(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
        edges = keep(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    centers = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("center"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("center")).unionByName(centers)


def join(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, copy_of, n_links, n_shingles.

    ``n_links`` is the number of other rows whose set is similar enough, copies included;
    ``copy_of`` the smallest id with the same set; ``class_id`` the smallest id that can be
    reached over links.
    """
    found = _classified(docs, doc_id, text, threshold, tolerance, block)
    return found.select("doc_id", "class_id", "copy_of", "n_links", "n_shingles")


def _classified(docs: DataFrame, doc_id: str, text: str, threshold: float, tolerance: float, block: int) -> DataFrame:
    """The rows of ``join`` with ``row``, the hash of their text, and ``center``, which tells classes apart (null: alone)."""
    slim = id_and_text(docs, doc_id, text).withColumn("row", F.xxhash64("text"))
    sets = keep(describe(slim), "sets")
    classes = sets.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # a number of its own for each class; the fingerprint has 128 bits
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    same = [F.col("s.f1") == F.col("c.f1"), F.col("s.f2") == F.col("c.f2"), F.col("s.doc_id") == F.col("c.rep")]
    reps = sets.alias("s").join(classes.alias("c"), same).select("c.node", "s.bands").dropDuplicates(["node"])
    banded = reps.select("node", F.posexplode("bands").alias("band", "key"))
    met = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2")
    )
    # buckets of the same members are one bucket
    buckets = met.filter("n > 1").groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n")
    members = banded.join(buckets, "key").groupBy("node").agg(F.collect_list(F.struct("band", "key", "n")).alias("buckets"))
    chosen = classes.join(members, "node").select("node", "f1", "f2", "rep", "weight", "buckets")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                sets = [shingles(t) for t in utf8(part.column("text"))]
                want = zip(part.column("f1").to_pylist(), part.column("f2").to_pylist(), strict=True)
                # another text under the same document id is another class
                at = [i for i, (s, w) in enumerate(zip(sets, want, strict=True)) if len(s) and fingerprint(s) == w]
                kept = []
                for i in at:
                    row = np.zeros(BANDS, np.int64)
                    for b in part.column("buckets")[i].as_py():
                        row[b["band"]] = b["key"]
                    kept.append(row.tobytes())
                take = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        take.column("node"),
                        take.column("weight"),
                        take.column("buckets"),
                        pa.array([signature(sets[i]).tobytes() for i in at], pa.binary()),
                        pa.array([sets[i].tobytes() for i in at], pa.binary()),
                        pa.array(kept, pa.binary()),
                    ],
                    ["node", "weight", "buckets", "sig", "values", "kept"],
                )

    texts = slim.join(chosen, F.col("doc_id") == F.col("rep")).select("node", "f1", "f2", "weight", "buckets", "text")
    loaded = texts.mapInArrow(
        load,
        "node long, weight long, buckets array<struct<band:int,key:long,n:long>>, sig binary, values binary, kept binary",
    )
    blocks = F.ceil(F.col("b.n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", "b.key"), blocks).cast("int")
    dealt = (
        loaded.select("node", "weight", "sig", "values", "kept", F.explode("buckets").alias("b"))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    rows = dealt.select(
        F.col("b.key").alias("key"),
        F.least("mine", "other").alias("lo"),
        F.greatest("mine", "other").alias("hi"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        F.col("b.band").alias("band"),
        "node",
        "weight",
        "sig",
        "values",
        "kept",
    )
    found = keep(_match(rows, threshold, tolerance), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    centers = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))

    named = classes.join(centers, "node").select("node", "rep", "center")
    first = named.groupBy("center").agg(F.min("rep").alias("class_id"))
    linked = named.join(first, "center").select("node", "class_id", "center").join(links, "node", "left")
    info = classes.join(linked, "node", "left").select(
        F.col("f1").alias("k1"),
        F.col("f2").alias("k2"),
        "rep",
        "weight",
        F.coalesce("center", "node").alias("center"),
        F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    on = [F.col("f1") == F.col("k1"), F.col("f2") == F.col("k2"), F.col("n_shingles") > 0]
    return sets.join(info, on, "left").select(
        "doc_id",
        "row",
        "center",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("copy_of"),
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` without those that are not the first of their class.

    First is the smallest id, and of several texts under it the one of the smallest hash; rows
    that repeat its id and text stay with it. A row without an id stays, as it cannot be told
    from others.
    """
    rows = keep(_classified(docs, doc_id, text, threshold, tolerance, block).filter("center is not null and doc_id is not null"), "classified")
    first = rows.groupBy(F.col("center").alias("of")).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    later = rows.join(first, F.col("center") == F.col("of")).filter(F.struct("doc_id", "row") != F.col("first"))
    gone = keep(later.select(F.col("doc_id").alias("drop_id"), F.col("row").alias("drop_row")).distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    mine = F.coalesce(F.col(f"d.`{text}`"), F.lit(""))
    same = (F.col(f"d.`{doc_id}`").cast("long") == F.col("drop_id")) & (F.xxhash64(mine) == F.col("drop_row"))
    return packed.join(gone, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
