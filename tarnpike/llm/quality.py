"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word and every word shape has a sparse random index vector that its hash decides. A word's context vector sums the
index vectors of its neighbours in the training sample. A document pools the vectors of its words: means of index vectors of
words, of shapes, of context vectors, and index vectors of its rates of repetition. A network of two layers,
trained with numpy and calibrated by a temperature on rows held back, gives the probability of a good text.

Fitting takes a bounded sample (SAMPLE labelled rows); scoring is one pass over all rows, with a model of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready, written
from .words import SPACED, chunks, gram_sets, grams, mix, texts, words

#: labelled rows that the model learns from, at most
SAMPLE = 3_000
#: bytes of their texts, at most; rows that would go beyond are left out whole
SAMPLE_BYTES = 64 << 20
WORD_DIM, SHAPE_DIM, CONTEXT_DIM, HIDDEN = 128, 128, 32, 32
#: words with context vectors; neighbours to either side
VOCABULARY, REACH = 2_048, 2
THRESHOLD = 0.3
#: texts of the sample that the driver takes through numpy at once
DRIVER_BYTES = 128 << 10

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:] = ord("0"), ord("A"), ord("a"), 0


def _indexed(row: np.ndarray, h: np.ndarray, n: int, dim: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of the index vectors of hashes: four places of +1 or -1 each."""
    out = np.zeros(n * dim)
    for j in range(4):
        place = (h >> np.uint64(12 * j)) % np.uint64(dim)
        sign = 1.0 - 2.0 * ((h >> np.uint64(52 + j)) & np.uint64(1))
        out += np.bincount(row * dim + place.astype(np.int64), weights=sign if weight is None else sign * weight, minlength=n * dim)
    return out.reshape(n, dim)


def _shapes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its runs of capitals, small letters, digits and each other character; bytes beyond ASCII do not show."""
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)
    word = np.repeat(np.arange(len(starts)), lengths)
    kind = _SHAPE[data[at]]
    on = kind > 0
    word, kind = word[on], kind[on]
    new = np.append(True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])) if len(kind) else on[:0]
    word, kind = word[new], kind[new]
    place = np.arange(len(word)) - np.searchsorted(word, word, side="left")
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(h, word, mix(kind.astype(np.uint64) + np.uint64(256) * place.astype(np.uint64)))
    return mix(h)


def _pseudo(kind: int, level: np.ndarray) -> np.ndarray:
    return mix(level.astype(np.uint64) + np.uint64(kind << 32))


def pooled(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One vector for each text; zeros where there are no words."""
    n = len(offsets) - 1
    rows, starts, lengths, h = words(data, offsets, SPACED)
    count = np.bincount(rows, minlength=n)
    size = np.maximum(count, 1)[:, None]
    word = _indexed(rows, h, n, WORD_DIM) / size
    shape = _indexed(rows, _shapes(data, starts, lengths), n, SHAPE_DIM) / size
    at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    near = np.zeros((n, CONTEXT_DIM), np.float32)
    for a in range(0, n, 256) if len(vocabulary) else ():
        lo, hi = np.searchsorted(rows, [a, a + 256])
        on = known[lo:hi]
        m = min(256, n - a)
        table = np.bincount((rows[lo:hi][on] - a) * len(vocabulary) + at[lo:hi][on], minlength=m * len(vocabulary)).reshape(m, -1).astype(np.float32)
        near[a : a + m] = table @ context
    again = np.zeros(n)
    if len(h) > 1:
        again = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=n)
    g_rows, _, g = grams(rows, h, 4)
    d_rows, _ = gram_sets(g_rows, g)
    w_rows, _ = gram_sets(rows, h)
    rate = lambda x, of: x / np.maximum(of, 1)
    n_grams = np.bincount(g_rows, minlength=n)
    rates = np.stack([rate(again, count), 1 - rate(np.bincount(d_rows, minlength=n), n_grams), rate(np.bincount(w_rows, minlength=n), count), np.log1p(count) / 10, rate(np.bincount(rows, weights=lengths, minlength=n), count) / 10], axis=1)
    extra = np.zeros((n, 64))
    every = np.arange(n)
    for k in range(rates.shape[1]):  # a rate is an index vector of its level, and the rate itself as weight of another
        level = np.floor(np.clip(rates[:, k], 0, 2) * 10)
        extra += _indexed(every, _pseudo(k + 1, level), n, 64) + _indexed(every, np.full(n, _pseudo(k + 100, np.zeros(1))[0]), n, 64, rates[:, k])
    extra[count == 0] = 0
    return np.concatenate([word, shape, near / size, extra], axis=1).astype(np.float32)


@dataclass
class Model:
    vocabulary: np.ndarray
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (pooled(data, offsets, self.vocabulary, self.context) - self.mean) / self.scale
        z = (np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of the sample, as sorted hashes, and their context vectors of length 1."""
    rows, h = [], []
    for a, _, d, o in chunks(data, offsets, DRIVER_BYTES):
        r, _, _, x = words(d, o, SPACED)
        rows.append((r + a).astype(np.int32))
        h.append(x)
    rows, h = np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(h or [np.zeros(0, np.uint64)])
    kinds, times = np.unique(h, return_counts=True)
    keep = np.sort(kinds[np.lexsort((kinds, -times))[:VOCABULARY]])
    out = np.zeros((len(keep), CONTEXT_DIM))
    if not len(keep):
        return keep, out.astype(np.float32)
    at = np.minimum(np.searchsorted(keep, h), len(keep) - 1)
    known = keep[at] == h
    for d in range(1, REACH + 1):
        same = rows[d:] == rows[:-d]
        for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            on = same & known[a]
            out += _indexed(at[a][on], mix(h[b][on] + np.uint64(d)), len(keep), CONTEXT_DIM)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return keep, out.astype(np.float32)


def train(sample: list[str | None], labels: np.ndarray, seed: int = 11, epochs: int = 25) -> Model:
    """Fits the network on four fifths of the sample and the temperature on the rest. One label alone, or no row, gives a constant score."""
    data, offsets = texts(pa.array(sample, pa.string()))
    vocabulary, context = _contexts(data, offsets)
    parts = [pooled(d, o, vocabulary, context) for _, _, d, o in chunks(data, offsets, DRIVER_BYTES)]
    dim = WORD_DIM + SHAPE_DIM + CONTEXT_DIM + 64
    x, y = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32), np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 1) / (len(y) + 2)
    w1, b1 = rng.normal(0, dim**-0.5, (dim, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    if len(y) < 20 or y.min() == y.max():
        zero = np.zeros(dim, np.float32)
        return Model(vocabulary, context, zero, zero + 1, w1, b1, w2 * 0, float(np.log(prior / (1 - prior))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    theta = [w1, b1, w2, b2]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for i in range(0, len(fit), 64):
            xb, yb = x[fit[i : i + 64]], y[fit[i : i + 64]]
            hid = np.tanh(xb @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(hid @ w2 + b2, -30, 30)))
            dz = (p - yb) / len(yb)
            dh = np.outer(dz, w2) * (1 - hid**2)
            grads = [xb.T @ dh + 1e-3 * w1, dh.sum(0), hid.T @ dz + 1e-3 * w2, dz.sum(keepdims=True)]
            step += 1
            for t, g, a, b in zip(theta, grads, m, v, strict=True):  # Adam
                a += 0.1 * (g - a)
                b += 0.001 * (g**2 - b)
                t -= 0.002 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    z, yh = np.tanh(x[held] @ w1 + b1) @ w2 + b2, y[held]
    loss = lambda t: float(np.mean(np.logaddexp(0, -z / t) * yh + np.logaddexp(0, z / t) * (1 - yh)))
    temperature = min(np.exp(np.linspace(-1.5, 1.5, 61)), key=loss)
    return Model(vocabulary, context, mean, scale, w1, b1, w2, float(b2[0]), float(temperature))


def _held_out():
    """Rows whose labels are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows, those first by a hash of the id, that are not held out.

    Texts of SAMPLE_BYTES in all at most come to the driver. Rows with a null id or label are ignored; of an id with several labels the
    largest counts, of one with several texts the first in order. Without any labelled row every text has the same score.
    """
    ready(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~_held_out())
    chosen = written(known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    once = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # `sample` rows at most
    once = written(once)
    sizes = sorted(once.select("doc_id", F.octet_length("text")).collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    fits, total = [], 0
    for r in sizes:
        if total + r[1] <= SAMPLE_BYTES:
            fits.append(r[0])
            total += r[1]
    got = (once if len(fits) == len(sizes) else once.where(F.col("doc_id").isin(fits))).toArrow()
    ids, text = got["doc_id"].to_pylist(), got["text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], text[i] or ""))
    return train([text[i] for i in order], (got["y"].to_numpy()[order] > 0).astype(np.float32))


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: the probability of a good text, and 1 where it is ``threshold`` or more.

    Only the text goes into a score. Null and blank texts have the score of an empty text. A row with a null id is not held out.
    Repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for a, b, d, o in chunks(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(d, o))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score is ``threshold`` or more. Null and blank texts have the score of an
    empty text; null ids and repeated rows are judged like all others; an empty table gives an empty result."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(place))
            keep = [shared.value.score(d, o) >= threshold for _, _, d, o in chunks(data, offsets)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, schema)
