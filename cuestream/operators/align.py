"""Global alignment of token sequences, and its use on whole corpora through blocking."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X

#: Bits of a group of packed tokens, whose edit distances to another token advance together.
GROUP_BITS = 1 << 14
#: Table cells held at a time: similarities that are kept, and moves of the alignment.
CELLS = 1 << 20
#: Aligned places in a result batch.
BATCH_ROWS = 50_000
#: Words of 64 rows that advance together, and words that a table of places may have.
LANES = 1 << 13
PLACES = 1 << 23
#: Characters of the pairs whose edit distances are found together.
PILE_CHARS = 1 << 18
ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int32)


class _Packed:
    """Tokens side by side in one integer, whole bytes each; a clear bit above a token stops its carry."""

    def __init__(self, tokens: list[str]):
        self.size = np.array([len(t) for t in tokens])
        room = self.size // 8 + 1
        self.at = np.r_[0, np.cumsum(room[:-1])]
        self.bytes = int(room.sum())
        inside = np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        place = np.repeat(self.at * 8, self.size) + inside
        self.full = self._number(place)
        self.first = self._number(self.at * 8)
        chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        order = np.argsort(chars, kind="stable")
        found, starts = np.unique(chars[order], return_index=True)
        self.where = {chr(c): self._number(q) for c, q in zip(found.tolist(), np.split(place[order], starts[1:]), strict=True)}

    def _number(self, places: np.ndarray) -> int:
        bits = np.zeros(self.bytes * 8, dtype=np.uint8)
        bits[places] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def distances(self, token: str) -> np.ndarray:
        """Levenshtein distance of ``token`` to each of the tokens, a column of all their tables as bits at a time."""
        full, first, where = self.full, self.first, self.where
        up, down = full, 0
        for c in token:
            same = where.get(c, 0)
            across = (((same & up) + up) ^ up) | same
            rise, fall = down | (full & ~(across | up)), up & across
            rise, fall = ((rise << 1) & full) | first, (fall << 1) & full
            level = same | down
            up, down = fall | (full & ~(level | rise)), rise & level
        count = [np.add.reduceat(ONES[np.frombuffer(x.to_bytes(self.bytes, "little"), dtype=np.uint8)], self.at) for x in (up, down)]
        return len(token) + count[0] - count[1]


def _distances(tokens: list[str], short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs of ``tokens``; the first of a pair is not longer, and neither is empty.

    The tables of many pairs advance together. The longer token stands upright, 64 rows to a
    word; a word is a column behind the one above it, so that its carry is known by then.
    """
    size = np.array([len(t) for t in tokens])
    words = (size + 63) // 64
    chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alphabet, codes = np.unique(chars, return_inverse=True)
    kinds = len(alphabet) + 1
    out = np.empty(len(short), dtype=np.int64)
    if int(words.sum()) * kinds > PLACES:
        for k in np.unique(long):
            mine = np.flatnonzero(long == k)
            packed = _Packed([tokens[k]])
            out[mine] = [packed.distances(tokens[i])[0] for i in short[mine]]
        return out
    starts = np.cumsum(size) - size
    inside = np.arange(len(chars)) - np.repeat(starts, size)
    first_word = np.cumsum(words) - words
    # where each character stands in each word, without one for what is not in the text yet
    where = np.zeros(int(words.sum()) * kinds, dtype=np.uint64)
    at = (np.repeat(first_word, size) + inside // 64) * kinds + codes + 1
    np.bitwise_or.at(where, at, np.uint64(1) << (inside % 64).astype(np.uint64))
    below = np.where(words * 64 == size, ~np.uint64(0), (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
    lead = int(words.max())
    room = size + lead
    text_at = np.cumsum(room) - room + lead
    text = np.zeros(int(room.sum()) + lead + int(size.max()) + 1, dtype=np.int64)
    text[np.repeat(text_at, size) + inside] = codes + 1
    order = np.argsort(size[short], kind="stable")
    edges = np.cumsum(words[long[order]])
    begin = 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + LANES, side="right")))
        pairs = order[begin:end]
        a, b = short[pairs], long[pairs]
        n = words[b]
        head = np.cumsum(n) - n
        depth = np.arange(int(n.sum())) - np.repeat(head, n)
        base = (np.repeat(first_word[b], n) + depth) * kinds
        point = np.repeat(text_at[a], n) - depth
        last = np.repeat(size[a], n) + depth - 1
        mask = np.full(len(depth), ~np.uint64(0))
        mask[head + n - 1] = below[b]
        count = np.zeros(len(depth), dtype=np.int64)
        done = np.argsort(last, kind="stable")
        steps = int(last.max()) + 1
        border = np.searchsorted(last[done], np.arange(steps + 1))
        top, not_top = np.zeros(len(depth), dtype=np.uint64), np.full(len(depth), ~np.uint64(0))
        top[head], not_top[head] = 1, 0
        up, down = np.full(len(depth), ~np.uint64(0)), np.zeros(len(depth), dtype=np.uint64)
        carry_up, carry_down = top.copy(), np.zeros(len(depth), dtype=np.uint64)
        same, across, rise, spare = (np.empty(len(depth), dtype=np.uint64) for _ in range(4))
        now, one, high = np.empty(len(depth), dtype=np.int64), np.uint64(1), np.uint64(63)
        alive = np.searchsorted(np.maximum.accumulate(last[head + n - 1]), np.arange(steps))
        lanes, off = [base, point, top, not_top, up, down, carry_up, carry_down, same, across, rise, spare, now], 0
        for step in range(steps):
            if step % 8 == 0 and head[alive[step]] > off:  # texts get longer, so pairs that are done come first
                lanes = [x[head[alive[step]] - off :] for x in lanes]
                base, point, top, not_top, up, down, carry_up, carry_down, same, across, rise, spare, now = lanes
                off = head[alive[step]]
            np.take(text[step:], point, out=now, mode="clip")
            np.add(base, now, out=now)
            np.take(where, now, out=same, mode="clip")
            np.bitwise_or(same, down, out=spare)
            np.bitwise_or(same, carry_down, out=same)
            np.bitwise_and(same, up, out=across)
            np.add(across, up, out=across)
            np.bitwise_xor(across, up, out=across)
            np.bitwise_or(across, same, out=across)
            np.bitwise_or(across, up, out=rise)
            np.invert(rise, out=rise)
            np.bitwise_or(rise, down, out=rise)
            np.bitwise_and(up, across, out=across)  # falls, from here on
            np.left_shift(rise, one, out=same)
            np.bitwise_or(same, carry_up, out=same)
            np.left_shift(across, one, out=down)
            np.bitwise_or(down, carry_down, out=down)
            np.right_shift(rise[:-1], high, out=carry_up[1:])
            np.bitwise_or(carry_up, top, out=carry_up)
            np.right_shift(across[:-1], high, out=carry_down[1:])
            np.bitwise_and(carry_down, not_top, out=carry_down)
            np.bitwise_or(spare, same, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, down, out=up)
            np.bitwise_and(same, spare, out=down)
            if border[step] < border[step + 1]:
                i = done[border[step] : border[step + 1]]
                m = mask[i]
                count[i] = np.bitwise_count(up[i - off] & m).astype(np.int64) - np.bitwise_count(down[i - off] & m)
        out[pairs] = size[a] + np.add.reduceat(count, head)
        begin = end
    return out


class _Similarities:
    """Similarities of a token to all of a list: 1 - edits / length of the longer one, 0 if just one is empty.

    Lengths are counted in characters; edits in characters, or with ``unit`` of "bytes" in
    bytes of UTF-8, as some SQL engines do.
    """

    def __init__(self, right: list[str], unit: str = "characters"):
        if unit not in ("characters", "bytes"):
            raise ValueError(f"unknown unit {unit}")
        self.unit = unit
        self.names = sorted(set(right), key=lambda t: (len(t), t))
        at = {t: k for k, t in enumerate(self.names)}
        self.where = np.array([at[t] for t in right])
        self.size = np.array([len(t) for t in self.names])
        self.empty = int(bool(self.names) and not self.names[0])
        self.groups: list[_Packed] | None = None
        self.known: dict[str, np.ndarray] = {}

    def _units(self, token: str) -> str:
        return token if self.unit == "characters" else token.encode().decode("latin-1")

    def _edits(self, token: str) -> np.ndarray:
        """Edits between ``token`` and each of the names that are not empty."""
        if self.groups is None:
            units = [self._units(t) for t in self.names[self.empty :]]
            self.groups, start, bits = [], 0, 0
            for k, t in enumerate(units):
                bits += len(t) + 8
                if bits > GROUP_BITS or k == len(units) - 1:
                    self.groups.append(_Packed(units[start : k + 1]))
                    start, bits = k + 1, 0
        return np.concatenate([np.zeros(0), *[g.distances(self._units(token)) for g in self.groups]])

    def names_row(self, token: str, edits: np.ndarray | None = None) -> np.ndarray:
        if not token:
            return (self.size == 0).astype(float)
        edits = np.r_[np.zeros(self.empty), self._edits(token) if edits is None else edits]
        row = np.maximum(0.0, 1.0 - edits / np.maximum(self.size, len(token)))
        row[: self.empty] = 0.0
        return row

    def row(self, token: str) -> np.ndarray:
        """Similarities to the whole list; rows of distinct tokens are kept while there is room."""
        got = self.known.get(token)
        if got is None:
            got = self.names_row(token)[self.where]
            if (len(self.known) + 1) * len(self.where) <= CELLS:
                self.known[token] = got
        return got


def _prepare(tables: list[tuple[_Similarities, list[str]]]) -> None:
    """Rows of similarities of the left tokens of several tables, whose edits are counted together, once for two tokens."""
    names: list[str] = []
    short, long, jobs = [], [], []
    for similar, left in tables:
        lefts, rights = sorted(set(left) - {""}), similar.names[similar.empty :]
        if not lefts or not rights or len(lefts) * len(similar.where) > CELLS:
            continue
        units = {t: similar._units(t) for t in {*lefts, *rights}}
        tokens = sorted(units, key=lambda t: (len(units[t]), t))
        at = {t: k for k, t in enumerate(tokens)}
        a, b = np.array([at[t] for t in lefts]), np.array([at[t] for t in rights])
        need = np.zeros((len(tokens), len(tokens)), dtype=bool)
        need[np.minimum(a[:, None], b), np.maximum(a[:, None], b)] = True
        np.fill_diagonal(need, False)
        i, j = np.nonzero(need)
        short.append(i + len(names))
        long.append(j + len(names))
        jobs.append((similar, lefts, a, b, i, j))
        names += [units[t] for t in tokens]
    if not jobs:
        return
    found = _distances(names, np.concatenate(short), np.concatenate(long))
    begin = 0
    for similar, lefts, a, b, i, j in jobs:
        edits = np.zeros((max(a.max(), b.max()) + 1,) * 2)
        edits[i, j] = edits[j, i] = found[begin : begin + len(i)]
        begin += len(i)
        for t, k in zip(lefts, a.tolist(), strict=True):
            similar.known[t] = similar.names_row(t, edits[k, b])[similar.where]


def align_many(pairs: Iterable[tuple[list[str], list[str]]], unit: str = "characters") -> Iterator[list[tuple[int, int, float]]]:
    """``align_tokens`` of each pair, in order; similarities of small pairs are found for several at once."""
    pile: list[tuple[_Similarities, list[str], list[str]]] = []
    held = cells = 0

    def done() -> Iterator[list[tuple[int, int, float]]]:
        _prepare([(similar, left) for similar, left, _ in pile])
        while pile:
            similar, left, right = pile.pop(0)
            yield align_tokens(left, right, unit=unit, similar=similar)

    for left, right in pairs:
        pile.append((_Similarities(right, unit), left, right))
        held += sum(map(len, left)) + sum(map(len, right))
        cells += len(left) * len(right)
        if held >= PILE_CHARS or cells >= CELLS:
            yield from done()
            held = cells = 0
    yield from done()


def token_similarity(left: list[str], right: list[str], unit: str = "characters") -> np.ndarray:
    """Similarity of every pair of two token lists."""
    similar = _Similarities(right, unit)
    return np.array([similar.row(t) for t in left]).reshape(len(left), len(right))


def align_tokens(
    left: list[str], right: list[str], match: float = 2.0, gap: float = -1.0, unit: str = "characters", similar: _Similarities | None = None
) -> list[tuple[int, int, float]]:
    """Needleman-Wunsch pairs (left index or -1, right index or -1, similarity), in order.

    Small tables of moves are kept whole. Of larger ones, scores are kept of every so many
    rows, and the moves between two of them are computed again on the way back, so memory is
    about 2 sqrt(rows) rows. Ties prefer the diagonal, then skipping a left token.
    """
    n, m = len(left), len(right)
    if not n or not m:
        return [(i, -1, 0.0) for i in range(n)] + [(-1, j, 0.0) for j in range(m)]
    if similar is None:
        similar = _Similarities(right, unit)
        _prepare([(similar, left)])
    steps = np.arange(m + 1) * gap

    def advance(i: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sim = similar.row(left[i])
        diag = score[:-1] + np.where(sim >= 0.5, sim * match, sim * match - (1 - sim) * match)
        up = score[1:] + gap
        new = np.empty(m + 1)
        new[0] = (i + 1) * gap
        np.maximum(diag, up, out=new[1:])
        new -= steps
        np.maximum.accumulate(new, out=new)
        new += steps
        return new, diag, up

    size = max(math.isqrt(n - 1) + 1, min(n, CELLS // m))
    starts = range(0, n, size)
    kept = [steps.copy()]
    for start in starts[:-1]:
        score = kept[-1]
        for i in range(start, start + size):
            score, _, _ = advance(i, score)
        kept.append(score)
    out: list[tuple[int, int, float]] = []
    j = m
    for start, score in zip(reversed(starts), reversed(kept), strict=True):
        end = min(start + size, n)
        moves = np.empty((end - start, m), dtype=np.int8)
        for i in range(start, end):
            score, diag, up = advance(i, score)
            moves[i - start] = np.where(np.abs(score[1:] - diag) < 1e-9, 0, np.where(np.abs(score[1:] - up) < 1e-9, 1, 2))
        i = end
        while i > start:
            move = moves[i - 1 - start, j - 1] if j else 1
            if move == 0:
                out.append((i - 1, j - 1, float(similar.row(left[i - 1])[j - 1])))
                i, j = i - 1, j - 1
            elif move == 1:
                out.append((i - 1, -1, 0.0))
                i -= 1
            else:
                out.append((-1, j - 1, 0.0))
                j -= 1
    out += [(-1, k, 0.0) for k in range(j - 1, -1, -1)]
    return out[::-1]


def dealt(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs dealt over all cores: the work of a pair is far more than its bytes, by which Spark would merge them into few tasks."""
    spark = pairs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(tasks, *keys)


def align_pairs(pairs: DataFrame, keys: Sequence[str], left: str, right: str, unit: str = "characters") -> DataFrame:
    """Align the two token arrays of each row; one output row per aligned position.

    Every pair is one row, so Spark spreads pairs over tasks and no grouping is needed.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(pdf: pd.DataFrame, at: list[int], got: list[np.ndarray]) -> pd.DataFrame:
            size = [len(g) for g in got]
            out = pd.DataFrame(np.concatenate(got), columns=["left_idx", "right_idx", "score"])
            out = out.astype({"left_idx": "int64", "right_idx": "int64"})
            named = {k: np.repeat(pdf[k].iloc[at].to_numpy(), size) for k in keys}
            return out.assign(**named, pos=np.concatenate([np.arange(n) for n in size]))

        for pdf in batches:
            at: list[int] = []
            found: list[np.ndarray] = []
            held = 0
            for i, got in enumerate(align_many(((list(a), list(b)) for a, b in zip(pdf[left], pdf[right], strict=True)), unit)):
                if got:
                    at.append(i)
                    found.append(np.array(got))
                    held += len(got)
                if held >= BATCH_ROWS:
                    yield joined(pdf, at, found)
                    at, found, held = [], [], 0
            if found:
                yield joined(pdf, at, found)

    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return dealt(pairs.select(*keys, left, right), keys).mapInPandas(
        run, f"left_idx bigint, right_idx bigint, score double, {fields}, pos bigint"
    )


def align(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_token: str, right_token: str, order: str = "idx", unit: str = "characters"
) -> DataFrame:
    """Align two token tables per key, with caller-chosen key and token columns."""
    def packed(df: DataFrame, token: str, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(order, F.col(token).alias("t"))))
        return df.groupBy(*keys).agg(F.transform(items, lambda x: x["t"]).alias(name))

    both = packed(left, left_token, "_l").join(packed(right, right_token, "_r"), list(keys), "full")
    empty = F.array().cast("array<string>")
    both = both.withColumns({"_l": F.coalesce("_l", empty), "_r": F.coalesce("_r", empty)})
    return align_pairs(both, keys, "_l", "_r", unit)


def alignment_score(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean similarity over aligned positions per key."""
    return pairs.groupBy(*keys).agg((F.sum("score") / F.count(F.lit(1))).alias("score"))


def windows(tokens: Column, size: int) -> Column:
    """All runs of ``size`` tokens, joined; none if there are fewer."""
    n = F.size(tokens)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(size)), " "))


def shingles(tokens: Column, size: int) -> Column:
    """Distinct windows; a text of fewer tokens is one shingle."""
    whole = F.when((F.size(tokens) > 0) & (F.size(tokens) < size), F.array(F.array_join(tokens, " ")))
    return F.coalesce(whole, F.array_distinct(windows(tokens, size)))


def candidate_pairs(left: DataFrame, right: DataFrame, size: int = 5, min_shared: int = 1) -> DataFrame:
    """Pairs ``(left_id, right_id)`` that share word shingles.

    Both sides are reduced to distinct (id, shingle hash) rows and meet in one
    equi join. A shingle common to many documents is a hot key only on the left:
    the right side holds a shingle once per item, so output grows linearly.
    """
    def hashed(df: DataFrame, ident: str) -> DataFrame:
        return df.select(F.col(ident), F.explode(shingles(F.col("tokens"), size)).alias("s")).select(ident, F.xxhash64("s").alias("h"))

    shared = hashed(left, "left_id").join(hashed(right, "right_id"), "h").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") >= min_shared)


def align_corpus(left: DataFrame, right: DataFrame, size: int = 5, accept: float = 0.4, unit: str = "characters") -> DataFrame:
    """Align every blocked pair of two text tables and keep word pairs above the threshold.

    ``left(left_id, text)``, ``right(right_id, text)``.
    """
    lt = left.select("left_id", F.split(X.norm_match("text"), " ").alias("tokens"))
    rt = right.select("right_id", F.split(X.norm_match("text"), " ").alias("tokens"))
    pairs = candidate_pairs(lt, rt, size)
    rows = pairs.join(lt.withColumnRenamed("tokens", "_l"), "left_id").join(rt.withColumnRenamed("tokens", "_r"), "right_id")
    aligned = align_pairs(rows, ["left_id", "right_id"], "_l", "_r", unit)
    return aligned.filter(F.col("score") >= accept)
