"""Gated recurrent language model over words, trained and applied in numpy inside Spark tasks.

Words of the model's own vocabulary are the most frequent ones; every other word is one
``unknown`` word, whose probability is shared out by smoothed counts. The output softmax is
factored: first the class of a word, then the word within its class. Training cuts texts
into windows and propagates back through one window at a time, with the state carried from
window to window. Scoring carries the state through the whole document as well, so a score
is the log-likelihood of the complete text.

Training is data-parallel: every training document is dealt to one round (by a hash of the id)
and there to one of the round's replicas, whose number grows with the tokens of the corpus; each
streams its documents through its own copy of the network, and the copies are averaged, in groups
first, so that the driver gets about the square root of their number.

Counts cover all training tokens. A word held by at least one in ``head`` tokens is in the
broadcast table, which therefore has at most ``head`` entries beside the end; all other words meet their
counts in a join, after each text has summed its own repeats.

Defined results: a null or empty text is one end token. Without training texts every token
of the empty count table has base score 0, and the model is at its untrained start. Repeated rows are counted and scored each
on its own. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import keep, pieces

HEAD = 1 << 18
PIECE_BYTES = 6 << 20
COUNT_BYTES = 16 << 20
REPLICA_TOKENS = 4_000_000
WAITING = 1 << 21  # words of texts that wait for others to be trained beside
SCORED_AT_ONCE = 8192
LOG10 = math.log(10.0)


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts of a column, one after another, and how many each has; as ``tokens_of`` for each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    found = lists.flatten().cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    real = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0  # not so at blank ends of a text
    upto = np.concatenate(([0], np.cumsum(real)))[lists.offsets.to_numpy()]
    return found.filter(pa.array(real)), np.diff(upto)


def numbers_of(found: pa.Array, words: pa.Array) -> np.ndarray:
    """Place of each word in ``words``, -1 if it has none."""
    return pc.fill_null(pc.index_in(found, value_set=words.cast(found.type)), -1).to_numpy(zero_copy_only=False)


def with_ends(numbers: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words of texts, and sizes, with the end after each text."""
    sizes = sizes + 1
    ends = np.cumsum(sizes) - 1
    out = np.full(len(numbers) + len(sizes), end, numbers.dtype)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = numbers
    return out, sizes


# ---------------------------------------------------------------- counts


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (token binary, n): words of all texts; an empty token counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            for part in pieces(batch, COUNT_BYTES):
                counts = pc.value_counts(words_of(part.column("text"))[0])
                yield _pairs(counts.field("values"), counts.field("counts"))
                ends += part.num_rows
        yield _pairs([b""], [ends])

    slim = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _pairs(tokens, numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tokens).cast(pa.binary()), pa.array(numbers, pa.int64())], ["token", "n"])


# ---------------------------------------------------------------- network


@dataclass(frozen=True)
class Shape:
    hidden: int = 16
    words: int = 2048  # the model's vocabulary, end and unknown included
    classes: int = 32
    window: int = 24
    lanes: int = 256
    rate: float = 0.01
    rounds: int = 2
    seed: int = 5


class GatedNet:
    """Embedding, one gated recurrent layer, and a softmax over classes and then words of a class."""

    def __init__(self, n_words: int, shape: Shape = Shape()):
        self.shape = shape
        h = shape.hidden
        self.classes = max(1, min(shape.classes, n_words))
        self.per = -(-n_words // self.classes)
        rng = np.random.default_rng(shape.seed)
        real = np.arange(self.classes * self.per).reshape(self.classes, self.per) < n_words
        self.mask = np.where(real, 0, -1e9).astype(np.float32)
        self.w = {
            "embed": rng.normal(0, 0.3, (self.classes * self.per + 1, h)),  # the last row starts a text
            "x": rng.normal(0, h**-0.5, (h, 3 * h)),
            "h": rng.normal(0, h**-0.5, (h, 3 * h)),
            "b": np.zeros(3 * h),
            "class": rng.normal(0, 0.1, (h, self.classes)),
            "class_b": np.zeros(self.classes),
            "word": rng.normal(0, 0.1, (self.classes, h, self.per)),
            "word_b": np.zeros((self.classes, self.per)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def start_from(self, counts: list[int]) -> GatedNet:
        """Output biases at the log frequencies, so that training begins at the unigram model."""
        n = np.zeros(self.classes * self.per)
        n[: len(counts)] = np.array(counts, dtype=float) + 0.5
        n = n.reshape(self.classes, self.per)
        self.w["class_b"] = np.log(np.maximum(n.sum(1), 1e-9) / max(n.sum(), 1e-9)).astype(np.float32)
        self.w["word_b"] = np.log(np.maximum(n, 1e-9) / np.maximum(n.sum(1, keepdims=True), 1e-9)).astype(np.float32)
        return self

    def copy(self) -> GatedNet:
        out = object.__new__(GatedNet)
        out.__dict__.update(self.__dict__, w={k: v.copy() for k, v in self.w.items()})
        return out

    def run(self, words: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """Hidden states before each word. words, fresh: (lanes, steps); fresh marks the first word of a text.

        ``words`` holds the input of each step: the word before the predicted one.
        """
        out, last = self.forward(words, fresh, state.T)
        return out.transpose(2, 0, 1), last.T

    def forward(self, words: np.ndarray, fresh: np.ndarray, state: np.ndarray, trace: dict | None = None):
        """``run`` with steps in front and lanes last, (steps, hidden, lanes), so that the parts of a step lie in one piece.

        ``trace`` takes what the way back needs.
        """
        w, h = self.w, self.shape.hidden
        lanes, steps = words.shape
        # the logistic function takes the exponential of -x, the tangent that of 2x
        sign = np.repeat(np.array([-1, 2], w["x"].dtype), (2 * h, h))
        taken = w["embed"].take(words.T, axis=0)
        parts = np.matmul((w["x"] * sign).T, taken.transpose(0, 2, 1))
        parts += (w["b"] * sign)[:, None]
        inner = np.ascontiguousarray((w["h"] * sign).T)
        out = np.empty((steps, h, lanes), parts.dtype)
        state = state.astype(parts.dtype)
        before, back = (np.empty_like(out), np.empty_like(parts)) if trace is not None else (None, None)
        room = np.empty_like(parts[0])
        starts = fresh.any(axis=0).tolist()
        with np.errstate(over="ignore"):
            for t in range(steps):
                if starts[t]:
                    state = state * ~fresh[:, t]
                if trace is not None:
                    before[t], room = state, back[t]
                np.matmul(inner, state, out=room)
                g, c, rc = parts[t, : 2 * h], parts[t, 2 * h :], room[2 * h :]
                # logistic function and tangent by exponentials, which numpy has in vector form
                g += room[: 2 * h]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c += rc * g[h:]
                np.exp(c, out=c)
                c += 1
                np.divide(-2, c, out=c)
                c += 1
                state = np.subtract(state, c, out=out[t])
                state *= g[:h]
                state += c
        if trace is not None:
            trace.update(before=before, z=parts[:, :h], g=parts[:, h : 2 * h], c=parts[:, 2 * h :], rc=back[:, 2 * h :], taken=taken)
        return out, state

    def log_probs(self, hidden: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target word; with ``grads``, also the gradient of their negative sum.

        Rows are worked off by class. States lie between -1 and 1, so exponents are bounded by
        the weights; they are clipped all the same.
        """
        w, h = self.w, hidden.shape[1]
        order = np.argsort(target.astype(np.min_scalar_type(self.mask.size)), kind="stable")
        target = target[order]
        cls = target // self.per
        edges = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        # a last column of ones carries the biases
        rows = np.ones((len(order), h + 1), hidden.dtype)
        rows[:, :h] = hidden.take(order, axis=0)
        by_class = np.empty((self.classes, h + 1), hidden.dtype)
        by_class[:, :h], by_class[:, h] = w["class"].T, w["class_b"]
        by_word = np.empty((self.classes, self.per, h + 1), hidden.dtype)
        by_word[:, :, :h], by_word[:, :, h] = w["word"].transpose(0, 2, 1), w["word_b"] + self.mask
        ones = np.ones(max(self.classes, self.per), hidden.dtype)
        reach = max(1, float(np.abs(rows).max(initial=0)))

        def scores(weights: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
            """Exponentials of each choice, and their sum for each row into ``out``."""
            x = weights @ rows.T
            if clip:
                np.minimum(x, 60, out=x)
            np.exp(x, out=x)
            np.matmul(ones[: len(x)], x, out=out)
            return x

        def chosen(weights: np.ndarray) -> np.ndarray:
            found = np.einsum("ij,ij->i", rows, weights)
            return np.minimum(found, 60) if clip else found

        clip = any((np.abs(x[..., :h]).sum(-1) + x[..., h]).max() * reach > 60 for x in (by_class, by_word))
        total = np.empty((2, len(rows)), rows.dtype)
        x = scores(by_class, rows, total[0])
        mine = by_class.take(cls, axis=0), by_word.reshape(-1, h + 1).take(target, axis=0)
        dh = None
        if grads is not None:
            share = np.reciprocal(total[0])[:, None]
            more = x @ (rows * share)
            # the gradient of a choice is its share, less one for the target
            there = np.flatnonzero(np.diff(edges))
            if len(there):
                more[there] -= np.add.reduceat(rows, np.array(edges)[there], axis=0)
            grads["class"] += more[:, :h].T
            grads["class_b"] += more[:, h]
            dh = x.T @ by_class[:, :h]
            dh *= share
            dh -= mine[0][:, :h]
            dh -= mine[1][:, :h]
            more = np.zeros(by_word.shape, by_word.dtype)
        for c in range(self.classes):
            if edges[c] == edges[c + 1]:
                continue
            part = slice(edges[c], edges[c + 1])
            x = scores(by_word[c], rows[part], total[1, part])
            if grads is not None:
                share = np.reciprocal(total[1, part])[:, None]
                np.matmul(x, rows[part] * share, out=more[c])
                back = x.T @ by_word[c, :, :h]
                back *= share
                dh[part] += back
        logp = chosen(mine[0]) + chosen(mine[1]) - np.log(total).sum(0)
        out = np.empty_like(logp)
        out[order] = logp
        if dh is None:
            return out, None
        first = firsts(target)
        more.reshape(-1, h + 1)[target[first]] -= np.add.reduceat(rows, first, axis=0) if len(first) else 0
        grads["word"] += more[:, :, :h].transpose(0, 2, 1)
        grads["word_b"] += more[:, :, h]
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def step(self, words, fresh, target, real, state, grads: dict | None = None):
        """Gradients of one window, back through its steps only; the state goes on to the next window.

        They are added to ``grads``, arrays as those of the weights, if given.
        """
        w, h = self.w, self.shape.hidden
        trace: dict = {}
        out, last = self.forward(words, fresh, state.T, trace)
        grads = {k: np.zeros_like(v) for k, v in w.items()} if grads is None else grads
        hidden = np.ascontiguousarray(out.transpose(0, 2, 1)).reshape(-1, h)
        flat, goal = real.T.reshape(-1), target.T.reshape(-1)
        if flat.all():
            logp, dh = self.log_probs(hidden, goal, grads)
        else:
            logp, some = self.log_probs(hidden[flat], goal[flat], grads)
            dh = np.zeros_like(hidden)
            dh[flat] = some
        steps, lanes = len(out), out.shape[2]
        dh = np.ascontiguousarray(dh.reshape(steps, lanes, h).transpose(0, 2, 1))
        before, z, g, c, rc = (trace[k] for k in ("before", "z", "g", "c", "rc"))
        # what a step's gradient is multiplied by on its way to each part; rc was taken twice
        to_z, to_c, to_g = (before - c) * z * (1 - z), (1 - z) * (1 - c * c), rc * g * (1 - g)
        to_g *= 0.5
        dr, dc = np.empty((steps, 3 * h, lanes), out.dtype), np.empty_like(out)
        after, inner = np.zeros_like(out[0]), w["h"]
        starts = fresh.any(axis=0).tolist()
        for t in range(steps - 1, -1, -1):
            d, r = dh[t], dr[t]
            d += after
            np.multiply(d, to_c[t], out=dc[t])
            np.multiply(d, to_z[t], out=r[:h])
            np.multiply(dc[t], to_g[t], out=r[h : 2 * h])
            np.multiply(dc[t], g[t], out=r[2 * h :])
            d *= z[t]
            np.matmul(inner, r, out=after)
            after += d
            if starts[t]:
                after *= ~fresh[:, t]
        grads["h"] += np.matmul(before, dr.transpose(0, 2, 1)).sum(0)
        dr[:, 2 * h :] = dc
        dx = dr.transpose(0, 2, 1)
        grads["x"] += np.matmul(trace["taken"].transpose(0, 2, 1), dx).sum(0)
        grads["b"] += dr.sum(axis=(0, 2))
        flat_words = words.T.reshape(-1).astype(np.min_scalar_type(len(w["embed"])))
        order = np.argsort(flat_words, kind="stable")
        sorted_words = flat_words[order]
        first = firsts(sorted_words)
        to_words = np.matmul(dx, w["x"].T).reshape(-1, h)
        grads["embed"][sorted_words[first]] += np.add.reduceat(to_words.take(order, axis=0), first, axis=0)
        return grads, logp, last.T


def firsts(x: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


class Trainer:
    """Adam over windows of lanes; each lane reads texts one after another.

    Once half of the lanes have no text left, the others wait, with their states, for the
    texts read next; ``finish`` reads what is left. So windows are full but for the last.
    """

    def __init__(self, net: GatedNet):
        self.net, self.t = net, 0
        # all weights lie in one array, and the parts of the network are views of it
        self.flat = np.concatenate([x.reshape(-1) for x in net.w.values()])
        self.grad, self.m, self.v, self.room = (np.zeros_like(self.flat) for _ in range(4))
        net.w, self.grads = self.views(self.flat), self.views(self.grad)
        self.waiting: tuple[Runs, np.ndarray] | None = None

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([x.size for x in self.net.w.values()])[:-1]
        return {k: part.reshape(x.shape) for (k, x), part in zip(self.net.w.items(), np.split(flat, ends), strict=True)}

    def texts(self, texts: list[np.ndarray]) -> int:
        flat, sizes = joined(texts)
        return self.read(flat, sizes) + self.finish()

    def read(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Words of texts, one after another; returns the number of words learned from."""
        return self.windows(Runs.of(flat, sizes, len(self.net.w["embed"]) - 1), False)

    def finish(self) -> int:
        return self.windows(None, True) if self.waiting else 0

    def windows(self, runs: Runs | None, last: bool) -> int:
        s, net = self.net.shape, self.net
        held, states = self.waiting or (None, np.zeros((0, s.hidden), np.float32))
        lanes = Lanes(runs, s.lanes, held)
        state = np.zeros((len(lanes.length), s.hidden), np.float32)
        state[: len(states)] = states
        state, at, seen, self.waiting = state[lanes.order], 0, 0, None
        while n := lanes.busy(at):
            if not last and 2 * n < s.lanes and lanes.left(at) <= WAITING:
                self.waiting = lanes.rest(at), state[:n]
                break
            words, fresh, target, real, _ = lanes.window(at, s.window)
            self.grad[:] = 0
            _, logp, state = net.step(words, fresh, target, real, state[:n], self.grads)
            self.update(s.lanes * s.window)  # windows of few lanes weigh less
            seen, at = seen + len(logp), at + s.window
        return seen

    def update(self, n: int) -> None:
        self.t += 1
        g, room = self.grad, self.room
        norm = math.sqrt(float(g @ g)) / n
        scale = min(1.0, 1.0 / max(norm, 1e-9)) / n
        rate, spread = self.net.shape.rate / (1 - 0.9**self.t), 1 / math.sqrt(1 - 0.99**self.t)
        self.m *= np.float32(0.9)
        np.multiply(g, np.float32(0.1 * scale), out=room)
        self.m += room
        g *= g
        g *= np.float32(0.01 * scale * scale)
        self.v *= np.float32(0.99)
        self.v += g
        np.sqrt(self.v, out=g)
        g *= np.float32(spread)
        g += np.float32(1e-6)
        np.divide(self.m, g, out=g)
        g *= np.float32(rate)
        self.flat -= g


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *texts]).astype(np.int32), np.array([len(t) for t in texts], np.int64)


@dataclass
class Runs:
    """Runs of steps, one after another: the input of each step, the word after it, and where a text begins."""

    words: np.ndarray
    target: np.ndarray
    fresh: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray, start: int) -> Runs:
        """One run per text."""
        flat = flat.astype(np.int32, copy=False)
        fresh = np.zeros(len(flat), bool)
        fresh[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        words = np.empty_like(flat)
        words[1:] = flat[:-1]
        words[fresh] = start
        return cls(words, flat, fresh, sizes)


class Lanes:
    """Runs on lanes: the longest first, each on the lane that is shortest so far; long lanes come first.

    Run ``k`` of ``held`` is the first of lane ``k``. Steps are kept lane after lane without padding;
    ``order`` has the lane that came to each place, ``texts`` the runs in the order of their steps
    (those of ``held`` are counted first).
    """

    def __init__(self, runs: Runs | None, lanes: int, held: Runs | None = None):
        both = [x for x in (held, runs) if x is not None]
        words, target, fresh, sizes = (np.concatenate([getattr(x, k) for x in both]) for k in ("words", "target", "fresh", "sizes"))
        known = len(held.sizes) if held is not None else 0
        lanes = max(1, known, min(lanes, len(sizes)))
        length, lane = [*sizes[:known].tolist(), *[0] * (lanes - known)], np.arange(len(sizes))
        heap = [(used, k) for k, used in enumerate(length)]
        heapq.heapify(heap)
        longest = known + np.argsort(-sizes[known:], kind="stable")
        for i, n in zip(longest.tolist(), sizes[longest].tolist(), strict=True):
            used, k = heap[0]
            lane[i] = k
            length[k] = used + n
            heapq.heapreplace(heap, (used + n, k))
        length = np.array(length, np.int64)
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.first = np.cumsum(self.length) - self.length
        place = np.empty_like(self.order)
        place[self.order] = np.arange(lanes)
        dealt = np.concatenate((np.arange(known), longest))
        self.texts = dealt[np.argsort(place[lane[dealt]], kind="stable")]
        self.sizes = sizes[self.texts]
        begin = (np.cumsum(sizes) - sizes)[self.texts] - (np.cumsum(self.sizes) - self.sizes)
        take = np.repeat(begin, self.sizes) + np.arange(len(target))
        self.words, self.target, self.fresh = words[take], target[take], fresh[take]

    def busy(self, at: int) -> int:
        """How many lanes have a step ``at``; they are the first ones."""
        return int(np.searchsorted(-self.length, -at))

    def left(self, at: int) -> int:
        return int(np.maximum(self.length - at, 0).sum())

    def rest(self, at: int) -> Runs:
        """What the lanes have from ``at`` on, one run each."""
        n = self.busy(at)
        cuts = [slice(a + at, a + m) for a, m in zip(self.first[:n].tolist(), self.length[:n].tolist(), strict=True)]
        return Runs(*(np.concatenate([x[c] for c in cuts]) for x in (self.words, self.target, self.fresh)), self.length[:n] - at)

    def window(self, at: int, steps: int):
        """Steps from ``at`` on, of the lanes that have one: inputs, first-word marks, targets, which are real, and their places."""
        n = self.busy(at)
        upto = at + np.arange(min(steps, int(self.length[0]) - at))
        real = upto < self.length[:n, None]
        places = np.minimum(self.first[:n, None] + upto, len(self.target) - 1)
        return self.words[places], self.fresh[places], self.target[places], real, places


def lay_out(texts: list[np.ndarray], lanes: int, start: int):
    """Texts on lanes, as one window: inputs, first-word marks, targets, which steps are real, and their places."""
    return Lanes(Runs.of(*joined(texts), start), lanes).window(0, sum(map(len, texts)))


def score_texts(net: GatedNet, texts: list[np.ndarray], lanes: int = 256) -> np.ndarray:
    """Natural log-likelihood of each text, the state carried from its first word to its end."""
    return score_words(net, *joined(texts), lanes) if texts else np.zeros(0)


def score_words(net: GatedNet, flat: np.ndarray, sizes: np.ndarray, lanes: int = 256) -> np.ndarray:
    """``score_texts`` of texts that lie one after another."""
    h = net.shape.hidden
    rows = Lanes(Runs.of(flat, sizes, len(net.w["embed"]) - 1), lanes)
    state, logp, at = np.zeros((h, len(rows.length)), np.float32), np.zeros(len(flat)), 0
    while n := rows.busy(at):
        # the fewer lanes, the more steps
        words, fresh, target, real, places = rows.window(at, max(32, SCORED_AT_ONCE // n))
        out, state = net.forward(words, fresh, state[:, :n])
        flat_real = real.T.reshape(-1)
        hidden = np.ascontiguousarray(out.transpose(0, 2, 1)).reshape(-1, h)[flat_real]
        logp[places.T.reshape(-1)[flat_real]], _ = net.log_probs(hidden, target.T.reshape(-1)[flat_real])
        at += words.shape[1]
    sums = np.concatenate(([0.0], np.cumsum(logp)))
    ends = np.cumsum(rows.sizes)
    out = np.empty(len(sizes))
    out[rows.texts] = sums[ends] - sums[ends - rows.sizes]
    return out


# ---------------------------------------------------------------- corpus level


@dataclass
class Vocabulary:
    """What tasks need of the counts: the head words, the model's words, and the totals."""

    counts: dict[bytes, int]
    ids: dict[bytes, int]
    unknown: int
    total: int
    distinct: int
    outside_total: int
    outside_distinct: int

    def model_words(self) -> Vocabulary:
        """Just what turns texts into the model's numbers."""
        return replace(self, counts={})

    def base(self, n: float) -> float:
        return math.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def outside(self, n: float) -> float:
        """log10 probability of a word among those the model does not know."""
        return math.log10((n + 0.5) / (self.outside_total + 0.5 * (self.outside_distinct + 1)))


def vocabulary(counts: DataFrame, shape: Shape = Shape(), head: int = HEAD) -> Vocabulary:
    """``counts`` as of ``count_tokens``; collects the end and words with at least total / head tokens."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.filter((F.col("n") * F.lit(head) >= F.lit(total)) | (F.length("token") == 0)).select("token", "n").toArrow()
    known = dict(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist(), strict=True))
    ends = known.get(b"", 0)
    inner = [t for t, _ in sorted(known.items(), key=lambda x: (-x[1], x[0])) if t != b""][: shape.words - 2]
    used = ends + sum(known[t] for t in inner)
    ids = {b"": 0}
    order = sorted([(b"", ends), *[(t, known[t]) for t in inner], (None, total - used)], key=lambda x: -x[1])
    ids = {t: i for i, (t, _) in enumerate(order)}
    unknown = ids.pop(None)
    here = len(inner) + (ends > 0)
    return Vocabulary(known, ids, unknown, total, distinct, total - used, distinct - here)


def model_counts(v: Vocabulary) -> list[int]:
    out = [0] * (len(v.ids) + 1)
    for t, i in v.ids.items():
        out[i] = v.counts.get(t, 0)
    out[v.unknown] = v.outside_total
    return out


def text_ids(v: Vocabulary, tokens: list[bytes]) -> np.ndarray:
    get, unknown = v.ids.get, v.unknown
    return np.array([*[get(t, unknown) for t in tokens], v.ids[b""]], dtype=np.int64)


def model_words(v: Vocabulary) -> pa.Array:
    """The model's words by number; that of the unknown is one no text holds."""
    words = [b" "] * (len(v.ids) + 1)
    for t, i in v.ids.items():
        words[i] = t
    return pa.array(words, pa.binary())


def piece_ids(v: Vocabulary, words: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The model's numbers of texts, one after another, and their sizes; as ``text_ids`` for each. words: as of ``model_words``."""
    found, sizes = words_of(column)
    numbers = numbers_of(found, words)
    return with_ends(np.where(numbers < 0, v.unknown, numbers), sizes, v.ids[b""])


COPIES = "replica long, seen long, weights binary"


def _copy_row(replica: int, seen: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([replica], pa.int64()), pa.array([seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["replica", "seen", "weights"]
    )


class HeadTable:
    """Words of the broadcast head by place, and what each adds to the sums of a text.

    The end of a text has place 0; the last place, also -1, is that of words outside the head, which add nothing here.
    """

    def __init__(self, v: Vocabulary):
        words = [b"", *(w for w in v.counts if w != b"")]
        self.words = pa.array(words, pa.binary())
        counts = [v.counts.get(w, 0) for w in words]
        self.base = np.array([*map(v.base, counts), 0.0])
        self.more = np.array([*(0.0 if w in v.ids else v.outside(n) for w, n in zip(words, counts, strict=True)), 0.0])
        self.known = np.array([*(int(n > 0) for n in counts), 0], np.int64)
        self.model_id = np.array([*(v.ids.get(w, v.unknown) for w in words), v.unknown], np.int32)


def _left(found: pa.Array, sizes: np.ndarray, places: np.ndarray) -> pa.ListArray:
    """Per text, the words of place -1 with their number."""
    at = np.flatnonzero(places < 0)
    of = np.repeat(np.arange(len(sizes)), sizes)[at]
    rows = pa.table({"of": of, "token": found.take(pa.array(at)).cast(pa.binary())}).group_by(["of", "token"], use_threads=False)
    rows = rows.aggregate([([], "count_all")]).combine_chunks()
    of = rows.column("of").to_numpy()
    order = pa.array(np.argsort(of, kind="stable"))
    upto = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(sizes)))))
    token, n = (pa.concat_arrays(rows.column(k).chunks).take(order) if rows.num_rows else pa.array([], kind)
                for k, kind in (("token", pa.binary()), ("count_all", pa.int64())))
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([token, n], ["token", "n"]))


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the tokens of all copies, and the sum of their weights times tokens, in order of the copies."""
    first, seen, total = -1, 0, 0.0
    for batch in batches:
        for k, n, w in zip(*[batch.column(c) for c in ("replica", "seen", "weights")], strict=True):
            first = k.as_py() if first < 0 else first
            seen += n.as_py()
            total = total + np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n.as_py()
    if seen:
        yield _copy_row(first, seen, total)


def train(
    docs: DataFrame,
    v: Vocabulary,
    shape: Shape = Shape(),
    share: int = 1,
    replicas: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> GatedNet:
    """Train once on each document, averaged over ``replicas`` tasks per round; ``trained`` of the result counts the tokens.

    Without ``replicas`` there is one for each ``REPLICA_TOKENS`` of a round, and six at least. A ``share``
    above 1 asks for a sample, one document in ``share``.
    """
    spark = docs.sparkSession
    replicas = replicas or max(6, math.ceil(v.total / (share * shape.rounds * REPLICA_TOKENS)))
    groups = math.isqrt(replicas - 1) + 1
    net = GatedNet(len(v.ids) + 1, shape).start_from(model_counts(v))
    words = spark.sparkContext.broadcast(v.model_words())
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    net.trained = 0
    deal = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(share * shape.rounds))
    for k in range(shape.rounds):
        model = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            # a copy: a later task of the same worker process is handed the same object
            trainer, known, seen = Trainer(model.value.copy()), model_words(words.value), 0
            for batch in batches:
                for part in pieces(batch, PIECE_BYTES):
                    seen += trainer.read(*piece_ids(words.value, known, part.column("text")))
            seen += trainer.finish()
            if seen:
                flat = np.concatenate([x.reshape(-1) for x in trainer.net.w.values()]).astype(np.float32)
                yield _copy_row(TaskContext.get().partitionId(), seen, flat)

        # in order of a hash, so that a task that is run again, or another run, trains the same network
        mark = F.xxhash64("doc_id", "text")
        part = slim.filter(deal == k).repartition(replicas, mark).sortWithinPartitions(mark, "doc_id")
        trained = part.mapInArrow(run, COPIES).repartition(groups, "replica").sortWithinPartitions("replica")
        rows = sorted(trained.mapInArrow(_weighted, COPIES).collect(), key=lambda r: r["replica"])
        total = sum(r["seen"] for r in rows)
        net.trained += total
        if not total:
            continue
        mean = sum(np.frombuffer(r["weights"], np.float64) for r in rows) / total
        at, fresh = 0, {}
        for name, x in net.w.items():
            fresh[name] = mean[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        net.w = fresh
    return net


SCORED = (
    "row_no long, doc_id long, n_tokens long, n_known long, base_score double, score double, "
    "rare array<struct<token:binary,n:long>>"
)


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, net: GatedNet, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score and score (log10 probabilities).

    One scan scores the words of the broadcast head and runs the network; words outside
    the head leave it with their number per text and meet their counts in a join.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((HeadTable(v), net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, net = model.value
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                found, counts = words_of(part.column("text"))
                places = numbers_of(found, head.words)
                left = _left(found, counts, places)
                flat, sizes = with_ends(places, counts, 0)
                edges = np.cumsum(sizes) - sizes
                model_score = score_words(net, head.model_id[flat], sizes) / LOG10
                base, more, hits = (np.add.reduceat(x[flat], edges) for x in (head.base, head.more, head.known))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_no"),
                        part.column("doc_id"),
                        pa.array(sizes),
                        pa.array(hits),
                        pa.array(base),
                        pa.array(model_score + more),
                        left,
                    ],
                    ["row_no", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    slim = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    first = keep(slim.mapInArrow(run, SCORED), "scored")
    rare = first.select("row_no", F.explode("rare").alias("r")).select("row_no", "r.token", "r.n")
    tail = counts.filter(F.col("n") * F.lit(HEAD) < F.lit(v.total)).select("token", F.col("n").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0))

    def log_share(total: int, distinct: int) -> Column:
        return F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))

    met = rare.join(tail, "token", "left").select(
        "row_no",
        (F.col("n") * log_share(v.total, v.distinct)).alias("base_more"),
        (F.col("n") * log_share(v.outside_total, v.outside_distinct)).alias("score_more"),
        F.when(c > 0, F.col("n")).otherwise(0).alias("known_more"),
    )
    sums = met.groupBy("row_no").agg(F.sum("base_more").alias("b"), F.sum("score_more").alias("s"), F.sum("known_more").alias("k"))
    zero = F.lit(0.0)
    return first.join(sums, "row_no", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
