"""Substring dedup by relative Lempel-Ziv parsing: words that an earlier document has in the same sequence.

A word goes if it lies in a window of ``WINDOW`` words that also starts in a document of
smaller id. Documents are factored greedily against reference text of earlier documents;
each factor is as long as the match, and where it ends the parse takes up again so far back
that windows across the factor's end are looked up as well. All windows of a factor of at
least ``WINDOW`` words are repeated.

The reference is dealt into blocks by content. Of every window the place with the smallest
hash of ``GRAM`` words is its anchor, so equal windows have equal anchors at equal offsets,
and the windows around one anchor are one phrase of at most ``2 * WINDOW - GRAM`` words. A
phrase need only meet the block that indexes its anchor's hash; no other block can hold a
factor of it.

1. A pass over the texts lists anchor hashes; aggregation keeps those of several documents.
2. Phrases with such an anchor are cut out of the texts. Phrases alike within a task leave it
   once, for the smallest document; the others are known to be repeated as a whole. Where an
   anchor is in more than ``HOT`` documents, its phrases are cut into single windows, which
   are dealt by their own hash, so that one frequent group of words does not meet in one task.
3. A block works through its phrases by anchor and document: it parses the phrases of a
   document against the reference, then adds those stretches that no factor covered. So it
   keeps every window once, and its index goes with the anchor.
4. Factors come back to their document as ranges of windows and are cut out.

Defined results: null or empty text has no words; a text of fewer than ``WINDOW`` words loses
none. What repeats only inside one document stays. Rows that share a document id are not
earlier than each other, whether their texts are equal or not; a row without an id loses
nothing and is no reference. An empty table gives an empty result. Long texts are worked off
in overlapping stretches. Words are compared as bytes, whole. Only the named columns are
read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import keep, pieces, utf8

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1  # places that the anchor of a window can have
HOT = 1000
STRETCH = 1 << 20
PIECE_BYTES = 2 << 20
MEMO = 400_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


_WORD_HASH = _WordHash()


def stretches(text: bytes, size: int = STRETCH) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of stretches that share ``WINDOW - 1`` words, so each window is in one."""
    first, held, at = 0, [], 0
    while True:
        end = at + size
        while end < len(text) and text[end : end + 1].split():
            end += 1
        words = held + text[at:end].split()
        yield first, words
        if end >= len(text):
            return
        held = words[-(WINDOW - 1) :]
        first += len(words) - len(held)
        at = end


class Anchored:
    """The anchors of several stretches of words at once.

    ``hash``, ``lo`` and ``hi``: anchor hash, first and last window start of each phrase, as
    places in ``words``; the phrases of stretch k are those from ``edges[k]`` to ``edges[k + 1]``.
    """

    def __init__(self, parts: list[list[bytes]]):
        self.words = [w for p in parts for w in p]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        n = len(self.words) - WINDOW + 1
        if n < 1:
            self.hash, self.lo, self.hi = (np.empty(0, np.int64) for _ in range(3))
            self.edges = np.zeros(len(parts) + 1, np.int64)
            return
        h = np.fromiter(map(_WORD_HASH.__getitem__, self.words), np.uint64, len(self.words))
        gram = np.zeros(len(h) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            gram = gram * FACTOR + h[j : len(h) - GRAM + 1 + j]
        gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(29)
        bits = np.uint64(len(gram).bit_length())
        least = gram >> bits << bits | np.arange(len(gram), dtype=np.uint64)  # ties go to the left
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
        where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])  # no window runs on into the next stretch
        first = np.flatnonzero(np.diff(where[at], prepend=-1))
        self.lo, self.hi = at[first], at[np.append(first[1:], len(at)) - 1] if len(first) else at[first]
        self.hash = gram[where[self.lo]].view(np.int64)
        self.edges = np.searchsorted(self.lo, np.append(self.starts, len(self.words)))


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), t.alias("text"))


def _grouped(part: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """Document ids (or places in ``part`` without that column), first word numbers, and words of the stretches of a
    piece, so many at a time that they are about as long as one."""
    docs, firsts, parts, size = [], [], [], 0
    names = part.column("doc_id").to_pylist()
    for name, text in zip(names, utf8(part.column("text")), strict=True):
        for first, words in stretches(text):
            docs.append(name)
            firsts.append(first)
            parts.append(words)
            size += min(len(text), STRETCH)
            if size >= PIECE_BYTES:
                yield docs, firsts, parts
                docs, firsts, parts, size = [], [], [], 0
    if docs:
        yield docs, firsts, parts


def _listed(docs: DataFrame) -> DataFrame:
    """(h, doc_id) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                for docs, _, parts in _grouped(part):
                    found = Anchored(parts)
                    ids = np.repeat(np.array(docs, np.int64), np.diff(found.edges))
                    yield pa.RecordBatch.from_arrays([pa.array(found.hash), pa.array(ids)], ["h", "doc_id"])

    return docs.mapInArrow(run, "h long, doc_id long")


def shared_anchors(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, hashes, hot): of each document its anchors that other documents have too, and which of them are frequent."""
    listed = keep(_listed(docs), "anchors")
    spread = listed.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    # n counts places, so it is at least the number of documents
    several = spread.filter("least < most").select(F.col("h").alias("g"), (F.col("n") > hot).alias("hot"))
    # written, so that the join has plain exchanges, which adaptive execution splits for a frequent anchor
    several = keep(several, "several")
    met = keep(listed.join(several, F.col("h") == F.col("g")).select("doc_id", "h", "hot"), "met")
    # the anchors of one document
    return met.groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("hashes"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot")
    )


# ---------------------------------------------------------------- phrases

PHRASES = "key long, doc_id long, row long, first long, more array<long>, n long, words binary"
RUN_BYTES = 64 << 20


def merged(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(doc, row, first, last) with neighbouring ranges of a text as one."""
    out: list[tuple[int, int, int, int]] = []
    for doc, row, first, last in sorted(ranges):
        if out and out[-1][:2] == (doc, row) and first <= out[-1][3] + 1:
            out[-1] = (doc, row, out[-1][2], max(last, out[-1][3]))
        else:
            out.append((doc, row, first, last))
    return out


class Held:
    """Phrases of a run by key and words, each with its places in the smallest document that has it.

    Places in other documents are ``late``: the phrase is known to be repeated there.
    """

    def __init__(self, late: list[tuple[int, int, int, int]]):
        self.known: dict[tuple[int, bytes], tuple[int, int, list[tuple[int, int]]]] = {}
        self.late, self.size = late, 0

    def add(self, key: int, words: bytes, n: int, doc: int, places: list[tuple[int, int]]) -> None:
        self.size += 120
        old = self.known.get((key, words))
        if old is None:
            self.known[(key, words)] = (doc, n, places)
            self.size += len(words) + 350
        elif old[0] == doc:
            old[2].extend(places)
        elif old[0] < doc:
            self.late.extend((doc, row, first, first + n - 1) for row, first in places)
        else:
            self.late.extend((old[0], row, first, first + n - 1) for row, first in old[2])
            self.known[(key, words)] = (doc, n, places)

    def rows(self) -> Iterator[tuple]:
        """One per text and phrase: its first place there, and more places if there are any."""
        for (key, words), (doc, n, places) in self.known.items():
            if len(places) == 1:
                yield key, doc, *places[0], None, n, words
                continue
            by_row: dict[int, list[int]] = {}
            for row, first in places:
                by_row.setdefault(row, []).append(first)
            for row, (first, *more) in by_row.items():
                yield key, doc, row, first, more, n, words


def _windows(held: Held, late: list) -> Held:
    """The phrases of frequent anchors as single windows, each by its own hash."""
    out = Held(late)
    for (_, words), (doc, n, places) in held.known.items():
        split = words.split()
        for w in range(n):
            window = b" ".join(split[w : w + WINDOW])
            key = xxhash.xxh3_64_intdigest(window)
            out.add(key - (1 << 64) if key >> 63 else key, window, 1, doc, [(row, first + w) for row, first in places])
    return out


def _phrases(candidates: DataFrame) -> DataFrame:
    """``candidates``: doc_id, row, text, hashes, hot. Phrases by key; a null key tells of windows known to be repeated."""

    def emit(plain: Held, frequent: Held, late: list) -> Iterator[pa.RecordBatch]:
        out = [*plain.rows(), *_windows(frequent, late).rows()]
        out += [(None, doc, row, first, None, last - first + 1, b"") for doc, row, first, last in merged(late)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        names = [f.split()[0] for f in PHRASES.split(", ")]
        for at in range(0, len(out), 20_000):
            some = out[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*some, strict=True), kinds, strict=True)], names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late: list[tuple[int, int, int, int]] = []
        plain, frequent = Held(late), Held(late)
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                docs, names = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
                known, hot = part.column("hashes"), part.column("hot")
                numbered = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column("text")], ["doc_id", "text"])
                for at, firsts, parts in _grouped(numbered):
                    found = Anchored(parts)
                    base = np.array(firsts) - found.starts
                    for k, i in enumerate(at):
                        a, b = found.edges[k], found.edges[k + 1]
                        h = found.hash[a:b]
                        for held, listed in ((plain, known[i]), (frequent, hot[i])):
                            if not len(listed.values):
                                continue
                            hit = np.flatnonzero(np.isin(h, listed.values.to_numpy())) + a
                            lo, hi = found.lo[hit], found.hi[hit]
                            for key, p, q, first in zip(found.hash[hit].tolist(), lo.tolist(), hi.tolist(), (lo + base[k]).tolist(), strict=True):
                                held.add(key, b" ".join(found.words[p : q + WINDOW]), q - p + 1, docs[i], [(names[i], first)])
                if plain.size + frequent.size + 120 * len(late) > RUN_BYTES:
                    yield from emit(plain, frequent, late)
                    late = []
                    plain, frequent = Held(late), Held(late)
        yield from emit(plain, frequent, late)

    return candidates.mapInArrow(run, PHRASES)


# ---------------------------------------------------------------- parsing


class Reference:
    """Text of earlier documents around one anchor, with the places at which each window begins."""

    def __init__(self):
        self.words: list[bytes] = []
        self.starts: dict[tuple[bytes, ...], list[int]] = {}

    def factors(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first, end) of each factor of at least WINDOW words, in a greedy parse from the left."""
        i = 0
        while i + WINDOW <= len(words):
            seeds = self.starts.get(tuple(words[i : i + WINDOW]))
            if seeds is None:
                i += 1
                continue
            best = WINDOW
            for s in seeds:
                n = WINDOW
                while i + n < len(words) and s + n < len(self.words) and self.words[s + n] == words[i + n]:
                    n += 1
                best = max(best, n)
            yield i, i + best
            i += best - WINDOW + 1  # the first window that crosses the factor's end

    def add(self, words: list[bytes], covered: list[tuple[int, int]]) -> None:
        """Index what no factor covered: the windows that start outside of all factors' windows."""
        known = np.zeros(len(words) - WINDOW + 1, bool)
        for a, b in covered:
            known[a : b - WINDOW + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([1], known.view(np.int8), [1]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            base = len(self.words)
            part = words[a : b + WINDOW - 1]
            self.words += [*part, b""]  # no match runs on into the next stretch
            for k in range(b - a):
                self.starts.setdefault(tuple(part[k : k + WINDOW]), []).append(base + k)


def _parsed(phrases: DataFrame) -> DataFrame:
    """(doc_id, row, first, last): repeated windows by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of one anchor: phrases of earlier documents, those of them that are not indexed yet, and those of the present one
        now, doc_now, earlier, pending, waiting, reference = None, None, set(), [], [], None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("key", "doc_id", "row", "first", "more", "n", "words")]
            for key, doc, row, first, more, n, raw in zip(*columns, strict=True):
                if key is None:
                    out.append((doc, row, first, first + n - 1))
                    continue
                if key != now:
                    now, doc_now, earlier, pending, waiting, reference = key, doc, set(), [], [], None
                elif doc != doc_now:
                    earlier.update(waiting)
                    pending += waiting
                    doc_now, waiting = doc, []
                if raw in earlier:
                    # one factor covers the phrase, and there is nothing new in it
                    factors = ((0, n + WINDOW - 1),)
                else:
                    waiting.append(raw)
                    if not earlier:
                        continue
                    reference = reference or Reference()
                    for known in pending:
                        words = known.split()
                        reference.add(words, list(reference.factors(words)))
                    pending = []
                    factors = reference.factors(raw.split())
                for a, b in factors:
                    out.append((doc, row, first + a, first + b - WINDOW))
                    out.extend((doc, row, at + a, at + b - WINDOW) for at in more or ())
            out = merged(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "row", "first", "last"])

    # windows known to be repeated need no partner, so they stay spread
    key = F.coalesce("key", F.xxhash64("doc_id", "row", "first"))
    dealt = phrases.repartition(key).sortWithinPartitions("key", "doc_id", "row")
    return dealt.mapInArrow(run, "doc_id long, row long, first long, last long")


# ---------------------------------------------------------------- whole operator


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and ``kept`` (binary: the words that stay, joined by one space)."""
    slim = _slim(docs, doc_id, text)
    named = slim.filter("doc_id is not null")
    shared = keep(shared_anchors(named, hot), "shared").withColumnRenamed("doc_id", "of")
    row = F.xxhash64("text").alias("row")
    candidates = named.join(shared, F.col("doc_id") == F.col("of")).select("doc_id", row, "text", "hashes", "hot")
    repeated = _parsed(_phrases(candidates))
    # the windows of one document
    repeated = repeated.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("w"))
    repeated = keep(repeated.select(F.col("doc_id").alias("of"), F.col("row").alias("at"), "w.first", "w.last"), "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                sizes, removed, kept = [], [], []
                for t, first, last in zip(utf8(part.column("text")), part.column("first"), part.column("last"), strict=True):
                    words = t.split()
                    sizes.append(len(words))
                    if first.is_valid:
                        change = np.bincount(first.values.to_numpy(), minlength=len(words) + 1)
                        change = change - np.bincount(last.values.to_numpy() + WINDOW, minlength=len(words) + 1)
                        gone = np.cumsum(change[:-1]) > 0
                        removed.append(int(gone.sum()))
                        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    mine = (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("at"))
    joined = slim.join(repeated, mine, "left").select("doc_id", "text", "first", "last")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
