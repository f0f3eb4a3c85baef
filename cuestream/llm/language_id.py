"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter
keeps its maximum over the window, and a softmax over those maxima gives the language. The
network is trained in numpy on a bounded sample of labelled rows (``per_language`` texts of
each language, chosen by a hash of the id) and applied to every window of every text.

Defined results: a null text, and a text without a letter, is ``und`` with score 0. With no
labelled text to learn from, every text is ``und``. A text shorter than a window is padded.
Ties between languages go to the first in sorted order. Repeated rows are predicted each on
its own. Only the named columns are read. A long text is cut into windows that are worked
off in bounded batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import pieces

WINDOW = 256
UNKNOWN = "und"
PER_LANGUAGE = 600
PIECE_BYTES = 1 << 20
WINDOWS_AT_ONCE = 512


@dataclass(frozen=True)
class Shape:
    embedding: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    steps: int = 700
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


class ByteConvNet:
    def __init__(self, languages: list[str], shape: Shape = Shape()):
        self.languages, self.shape = languages, shape
        rng = np.random.default_rng(shape.seed)
        e, f = shape.embedding, shape.filters
        self.weights = {"embed": rng.normal(0, 0.5, (256, e)).astype(np.float32)}
        self.weights["embed"][0] = 0
        for w in shape.widths:
            self.weights[f"conv{w}"] = rng.normal(0, (2 / (w * e)) ** 0.5, (w * e, f)).astype(np.float32)
        self.weights["bias"] = np.zeros(f * len(shape.widths), np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (f * len(shape.widths), len(languages))).astype(np.float32)
        self.weights["out_bias"] = np.zeros(len(languages), np.float32)

    def _forward(self, windows: np.ndarray):
        w, s = self.weights, self.shape
        x = w["embed"][windows]
        n, length, e = x.shape
        kept = []
        for width in s.widths:
            view = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2)
            rows = np.ascontiguousarray(view).reshape(n * (length - width + 1), width * e)
            out = (rows @ w[f"conv{width}"]).reshape(n, length - width + 1, -1)
            at = out.argmax(axis=1)
            kept.append((rows, at, np.take_along_axis(out, at[:, None, :], axis=1)[:, 0, :]))
        features = np.maximum(np.concatenate([k[2] for k in kept], axis=1) + w["bias"], 0)
        return x, kept, features, softmax(features @ w["out"] + w["out_bias"])

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.weights, self.shape
        x, kept, features, p = self._forward(windows)
        n, length, e = x.shape
        d = p.copy()
        d[np.arange(n), labels] -= 1
        d /= n
        grad = {"out": features.T @ d, "out_bias": d.sum(0)}
        df = (d @ w["out"].T) * (features > 0)
        grad["bias"] = df.sum(0)
        grad["embed"] = np.zeros_like(w["embed"])
        for k, width in enumerate(s.widths):
            rows, at, _ = kept[k]
            part = df[:, k * s.filters : (k + 1) * s.filters]
            picked = rows.reshape(n, length - width + 1, -1)[np.arange(n)[:, None], at]
            grad[f"conv{width}"] = np.einsum("nfk,nf->kf", picked, part)
            back = part[:, :, None] * w[f"conv{width}"].T[None]
            for j in range(width):
                bytes_at = windows[np.arange(n)[:, None], at + j]
                np.add.at(grad["embed"], bytes_at, back[:, :, j * e : (j + 1) * e])
        grad["embed"][0] = 0
        return grad

    def fit(self, texts: list[bytes], labels: list[int]) -> ByteConvNet:
        """Adam over windows drawn from the texts; languages are drawn equally often."""
        s, rng = self.shape, np.random.default_rng(self.shape.seed + 1)
        of = [[i for i, y in enumerate(labels) if y == k] for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, s.steps + 1):
            y = rng.integers(0, len(self.languages), s.batch)
            windows = np.zeros((s.batch, WINDOW), np.uint8)
            for j, k in enumerate(y):
                text = texts[of[k][rng.integers(len(of[k]))]]
                size = WINDOW if rng.random() < 0.6 else int(rng.integers(12, WINDOW))
                at = int(rng.integers(0, max(1, len(text) - size)))
                part = np.frombuffer(text[at : at + size], np.uint8)
                windows[j, : len(part)] = part
            rate = s.rate * (1 - 0.9 * step / s.steps)
            for k, g in self._gradients(windows, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                up = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] -= (rate * up).astype(np.float32)
        return self

    def tables(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """What byte pairs give to each filter: a wide filter is a sum of its pairs and its last byte."""
        w, s = self.weights, self.shape
        e, embed = s.embedding, self.weights["embed"]
        heads, rests = [], []
        for k, width in enumerate(s.widths):
            parts = [embed @ w[f"conv{width}"][j * e : (j + 1) * e] for j in range(width)]
            heads.append((parts[0][:, None] + parts[1][None]).reshape(65536, -1) if width > 1 else None)
            for j in range(2, width, 2):
                tail = (parts[j][:, None] + parts[j + 1][None]).reshape(65536, -1) if j + 1 < width else parts[j]
                rests.append((k, j, tail))
        return np.concatenate(heads, axis=1), rests

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Softmax rows for byte windows; the same values as ``_forward``, from tables of byte pairs."""
        if not hasattr(self, "_tables"):
            self._tables = self.tables()
        head, rests = self._tables
        w, s = self.weights, self.shape
        n, length = windows.shape
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        out = head[pairs]
        for k, j, tail in rests:
            index = pairs[:, j:] if len(tail) == 65536 else windows[:, j:]
            m = length - s.widths[k] + 1
            out[:, :m, k * s.filters : (k + 1) * s.filters] += tail[index[:, :m]]
        tops = [out[:, : length - width + 1, k * s.filters : (k + 1) * s.filters].max(axis=1) for k, width in enumerate(s.widths)]
        features = np.maximum(np.concatenate(tops, axis=1) + w["bias"], 0)
        return softmax(features @ w["out"] + w["out_bias"])

    def __getstate__(self):
        return {"languages": self.languages, "shape": self.shape, "weights": self.weights}


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score_texts(net: ByteConvNet, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all windows of each text, weighted by the bytes in a window."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-sizes // WINDOW))
    first = np.concatenate(([0], np.cumsum(counts)))
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    for t, at in zip(texts, (first[:-1] * WINDOW).tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    windows = flat.reshape(-1, WINDOW)
    p = np.concatenate([net.predict(windows[i : i + WINDOWS_AT_ONCE]) for i in range(0, len(windows), WINDOWS_AT_ONCE)])
    weight = np.full(len(windows), WINDOW, np.float64)
    last = sizes - (counts - 1) * WINDOW
    weight[first[1:] - 1] = np.maximum(last, 1)
    total = np.add.reduceat(p * weight[:, None], first[:-1], axis=0)
    return np.minimum(total / total.sum(axis=1, keepdims=True), 1.0)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, shape: Shape = Shape()) -> ByteConvNet | None:
    """Fit on at most about ``per_language`` texts of each language; ``labelled`` has doc_id, text, lang.

    The sample is a share of each language's rows, by a hash of id and text, so that it
    needs one count and one filtered scan and its size does not grow with the corpus.
    """
    known = labelled.filter("lang is not null and text is not null and length(trim(text)) > 0")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    rows = known.filter(chance < F.element_at(share, F.col("lang"))).select("doc_id", F.col("text").alias("t"), "lang")
    sample = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["t"]))
    if not sample:  # a tiny table whose hashes all missed
        sample = sorted(known.select("doc_id", F.col("text").alias("t"), "lang").limit(per_language).collect())
    languages = sorted({r["lang"] for r in sample})
    at = {k: i for i, k in enumerate(languages)}
    return ByteConvNet(languages, shape).fit([r["t"].encode() for r in sample], [at[r["lang"]] for r in sample])


def predict(docs: DataFrame, net: ByteConvNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ``lang_pred`` and ``score``; the text is the only input."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, PIECE_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                if model.value is None:
                    best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                else:
                    p = score_texts(model.value, [t.encode() for t in texts])
                    lettered = [has_letter(t) for t in texts]
                    best = [
                        model.value.languages[k] if ok else UNKNOWN
                        for k, ok in zip(p.argmax(axis=1).tolist(), lettered, strict=True)
                    ]
                    score = [x if ok else 0.0 for x, ok in zip(p.max(axis=1).tolist(), lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds
