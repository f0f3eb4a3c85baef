"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A text is lower-cased in A-Z and cut into words (ASCII digits and letters, and anything
outside ASCII). An item is covered by its windows of ``n`` words; an item with fewer
words is one window of its own length. Training windows are hashed in one pass, looked
up in the broadcast set, and every hit is verified word by word.

The set is bounded: items are dealt into as many blocks as it takes to keep a block under
``block_words`` benchmark words, and each block scans the documents once. A block of more
words than that can only be one item longer than the bound.

Defined results: null or empty texts have no words and are clean; an item without words
has no window and occurs nowhere; items with equal texts all count; several rows with one
item id are one item; an item without an id marks words like any other and is left out of
the lists of items; rows repeated in ``docs`` are judged each on its own. Empty tables
give empty or clean results. Texts of any length are scanned whole. Only the named columns
are read, so extra columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import keep, pieces, utf8

WINDOW = 10
BLOCK_WORDS = 4_000_000
PIECE_BYTES = 4 << 20
SCHEMA = "row_no long, doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
#: What bytes become before splitting: letters lower-cased, everything else in ASCII but digits blank.
FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
FACTOR = 0x9E3779B97F4A7C15
BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``n`` values, by doubling."""
    out, done, step, width, factor = None, 0, values, 1, FACTOR
    while width <= n:
        if n & width:
            part = step[done : len(values) - n + done + 1]
            with np.errstate(over="ignore"):
                out = part if out is None else out * np.uint64(pow(FACTOR, width, 1 << 64)) + part
            done += width
        if 2 * width <= n:
            with np.errstate(over="ignore"):
                step = step[:-width] * np.uint64(factor) + step[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return out


class NGramSet:
    """The windows of a block of items, by length: a bitmap, their hashes, and the words to verify."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(dict)
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            k = min(n, len(seq))
            for i in range(len(seq) - k + 1 if k else 0):
                found = self.windows[k].setdefault(tuple(seq[i : i + k]), set())
                if item is not None:
                    found.add(item)
        rng = np.random.default_rng(7)
        self.value = rng.integers(1, 1 << 63, len(self.ids) + 1, dtype=np.uint64)
        self.hashes, self.bitmap = {}, {}
        for k, found in self.windows.items():
            flat = np.array(list(found), dtype=np.int64).reshape(-1)
            hashes = window_hashes(self.value[flat], k)[::k] if k > 1 else self.value[flat]
            bitmap = np.zeros(1 << BITS, dtype=bool)
            bitmap[hashes >> np.uint64(64 - BITS)] = True
            self.hashes[k], self.bitmap[k] = np.sort(hashes), bitmap

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """Per text: its number of words, the hit mask over them, and the items found, sorted."""
        get, flat, starts = self.ids.get, [], [0]
        for text in texts:
            flat.extend(map(get, words_of(text)))
            flat.append(None)  # no window crosses from one text into the next
            starts.append(len(flat))
        ids = np.array([x or 0 for x in flat], dtype=np.int64)
        del flat
        mask, found = np.zeros(len(ids), dtype=bool), defaultdict(set)
        values = self.value[ids]
        for k, windows in self.windows.items():
            if len(ids) < k:
                continue
            hashes = window_hashes(values, k)
            at = np.flatnonzero(self.bitmap[k][hashes >> np.uint64(64 - BITS)])
            known = self.hashes[k]
            at = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]
            for i, text_no in zip(at.tolist(), (np.searchsorted(starts, at, side="right") - 1).tolist(), strict=True):
                items = windows.get(tuple(ids[i : i + k].tolist()))
                if items is not None:
                    mask[i : i + k] = True
                    found[text_no] |= items
        for j in range(len(texts)):
            yield starts[j + 1] - starts[j] - 1, mask[starts[j] : starts[j + 1] - 1], sorted(found[j]) if j in found else []


def runs(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


class Blocks:
    """The items of a benchmark, a block at a time; several rows may be in the driver only as far as one block goes."""

    def __init__(self, bench: DataFrame, item_id: str, text: str, block_words: int):
        self.items = bench.select(
            F.col(f"`{item_id}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
        )
        # two bytes a word at least
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(1, -(-total // (2 * block_words)))

    def __iter__(self) -> Iterator[list[tuple[str | None, bytes]]]:
        for b in range(self.count):
            rows = self.items if self.count == 1 else self.items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == b)
            yield [(r["item"], r["text"].encode()) for r in rows.toLocalIterator()]


def find_hits(
    docs: DataFrame,
    bench: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, ``spans`` of hit words (first and last index), item ids found.

    One scan without a shuffle while the benchmark fits a block. With more blocks the
    scans meet by row in one aggregation, whose groups have a row per block.
    """
    spark = docs.sparkSession
    several = None
    slim = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    blocks = Blocks(bench, item_id, item_text, block_words)
    if blocks.count > 1:
        slim = keep(slim, "numbered")  # the row numbers of all scans must agree
    scans = []
    for items in blocks:
        grams = spark.sparkContext.broadcast(NGramSet(items, n))

        def scan(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, PIECE_BYTES):
                    got = list(grams.value.scan(utf8(batch.column("text"))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row_no"),
                            batch.column("doc_id"),
                            pa.array([g[0] for g in got], pa.int64()),
                            pa.array([runs(g[1]) for g in got], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                            pa.array([g[2] for g in got], pa.list_(pa.string())),
                        ],
                        ["row_no", "doc_id", "n_words", "spans", "items"],
                    )

        scans.append(slim.mapInArrow(scan, SCHEMA))
    if len(scans) == 1:
        return scans[0].drop("row_no")
    for one in scans:
        several = one if several is None else several.unionByName(one)
    grouped = several.groupBy("row_no", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.drop("row_no")


def count_hit_words(spans: str = "spans"):
    """Words inside at least one span; spans of several blocks may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))

    def add(acc, s):
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(s["first"] - 1, acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["last"]).alias("upto"),
        )

    return F.aggregate(F.col(spans), start, add, lambda acc: acc["n"])


def clean_documents(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with their own columns."""
    return _with_hits(docs, bench, text, **how).filter(F.size("h.spans") == 0).select("d.*")


def clean_spans(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All rows of ``docs``; of each run of hit words, the text from its first to its last byte is cut out."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, cut_words)

    got = _with_hits(docs, bench, text, **how)
    plain = F.col(f"d.`{text}`")
    new = F.when(F.size("h.spans") == 0, plain).otherwise(cut(plain, F.col("h.spans")))
    return got.select(*[new.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def cut_words(text: str | None, spans) -> str | None:
    """The text without the words of the spans and what lies between them."""
    if text is None or not len(spans):
        return text
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    out, at = [], 0
    for s in spans:
        out.append(raw[at : edges[2 * s["first"]]])
        at = int(edges[2 * s["last"] + 1])
    return b"".join([*out, raw[max(at, 0) :]]).decode()


def _with_hits(docs: DataFrame, bench: DataFrame, text: str, **how) -> DataFrame:
    """Rows as struct ``d`` beside their hits ``h``, matched inside the scan and so without a join; one pass per block."""
    spark = docs.sparkSession
    blocks = Blocks(bench, how.get("item_id", "item_id"), how.get("item_text", "text"), how.get("block_words", BLOCK_WORDS))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    empty = F.array().cast("array<struct<first:long,last:long>>")
    packed = packed.withColumn("s", empty)
    for k, items in enumerate(blocks):
        if k:
            packed = keep(packed, "hits")  # so that a task holds the windows of one block
        grams = spark.sparkContext.broadcast(NGramSet(items, how.get("n", WINDOW)))

        @F.pandas_udf("array<struct<first:long,last:long>>")
        def spans(texts, grams=grams):
            import pandas as pd

            out, part, size = [], [], 0
            for t in [*texts, None]:
                if part and (t is None or size + len(t) > PIECE_BYTES):
                    out += [runs(g[1]) for g in grams.value.scan(part)]
                    part, size = [], 0
                if t is not None:
                    part.append(t.encode())
                    size += len(t)
            return pd.Series(out, dtype=object)

        packed = packed.withColumn("s", F.array_sort(F.concat("s", spans("t"))))
    return packed.select("d", F.struct(_merged("s").alias("spans")).alias("h"))


def _merged(spans: str):
    """Overlapping runs of several blocks as one."""

    def add(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["first"] <= F.get(acc, F.size(acc) - 1)["last"] + 1)
        return F.when(
            joins,
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.col(spans), F.array().cast("array<struct<first:long,last:long>>"), add)
