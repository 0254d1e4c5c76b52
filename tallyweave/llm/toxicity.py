"""Toxicity by averaged subword embeddings under a linear softmax (operator 1).

A text is the bag of its words and their character n-grams, hashed into buckets. The mean of
the buckets' embeddings goes through a linear softmax, and both are trained together, as in
fastText (Joulin et al., 2016), by full-batch Adam in numpy on a bounded sample of labelled
rows. An unseen misspelling shares n-grams with the words that were seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices

WORD = re.compile(r"[^\W_]{1,64}")
GRAMS = (4, 5)
BUCKETS = 1 << 16
DIMENSION = 4
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
SLICE_BYTES = 2 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, cut every 64 characters."""
    return WORD.findall(text.lower()) if text else []


# An odd factor for each character of an n-gram, the last one for words' own hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) % BUCKETS


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, bucket): of each word in brackets, and of the character n-grams of that which are shorter.

    An n-gram's hash is the sum of its characters times ``FACTORS``; the whole word's is the
    value of a polynomial in its characters.
    """
    text = "".join([f"<{w}>" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    places, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero((np.arange(len(chars)) + n <= end[word]) & (size[word] > n))
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h += chars[at + j] * np.uint64(FACTORS[j])
        places.append(word[at])
        buckets.append(_bucket(h))
    h = np.zeros(len(words), np.uint64)
    start = end - size
    for j in range(int(size.max(initial=0))):
        alive = np.flatnonzero(size > j)
        h[alive] = h[alive] * np.uint64(FACTORS[-1]) + chars[start[alive] + j]
    return np.concatenate([np.arange(len(words)), *places]), np.concatenate([_bucket(h), *buckets])


class Model:
    """What scoring needs: each bucket's share of the logit, the intercept, and the base rate for texts without words."""

    def __init__(self, weights: np.ndarray, intercept: float, base_rate: float):
        self.weights, self.intercept, self.base_rate = weights, intercept, base_rate


class _Sparse:
    """Row sums and their transpose over (row, column, weight) entries, in chunks of whole rows that stay in a core's cache."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray | None, n_rows: int, n_columns: int, chunk: int = 1 << 15):
        self.shape, self.sides = (n_rows, n_columns), []
        for key, other in ((rows, columns), (columns, rows)):
            order = np.argsort(key, kind="stable")
            used, first = np.unique(key[order], return_index=True)
            ends = np.append(first, len(key))
            cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(key), chunk)), len(used)))
            w = None if weights is None else weights[order, None]
            self.sides.append((used, ends, other[order], w, list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))))

    def times(self, x: np.ndarray, transpose: bool = False) -> np.ndarray:
        used, ends, other, weights, cuts = self.sides[transpose]
        out = np.zeros((self.shape[transpose], x.shape[1]), x.dtype)
        x = np.ascontiguousarray(x)
        space = np.empty((max((int(ends[hi] - ends[lo]) for lo, hi in cuts), default=0), x.shape[1]), x.dtype)
        for lo, hi in cuts:
            a, b = int(ends[lo]), int(ends[hi])
            picked = np.take(x, other[a:b], axis=0, out=space[: b - a], mode="clip")
            if weights is not None:
                picked *= weights[a:b]
            out[used[lo:hi]] = np.add.reduceat(picked, ends[lo:hi] - a, axis=0)
        return out


def train(texts: list[str | None], labels: list[int], epochs: int = 60, rate: float = 0.1, decay: float = 0.1, gain: float = 30.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly. Without both labels in the sample every text gets the base rate."""
    words: dict[str, int] = {}
    doc, word, count = [], [], []
    for i, text in enumerate(texts):
        bag: dict[int, int] = {}
        for w in words_of(text):
            k = words.setdefault(w, len(words))
            bag[k] = bag.get(k, 0) + 1
        doc.append(np.full(len(bag), i, np.int32))
        word.append(np.fromiter(bag.keys(), np.int32, len(bag)))
        count.append(np.fromiter(bag.values(), np.float32, len(bag)))
    y = np.array(labels, np.int64)
    base = float(y.mean()) if len(y) else 0.0
    if not words or len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((base + 1e-6) / (1 - base + 1e-6))), base)
    places, buckets = subwords(list(words))
    size = np.bincount(places, minlength=len(words)).astype(np.float32)
    of_word = _Sparse(places.astype(np.int32), buckets.astype(np.int32), None, len(words), BUCKETS)
    doc, word, count = np.concatenate(doc), np.concatenate(word), np.concatenate(count)
    total = np.bincount(doc, weights=count * size[word], minlength=len(texts)).astype(np.float32)
    of_doc = _Sparse(doc, word, count * gain / total[doc], len(texts), len(words))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32), rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(2, dtype=np.float32)[y]
    for step in range(1, epochs + 1):
        hidden = of_doc.times(of_word.times(params[0]))
        logits = hidden @ params[1] + params[2]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - truth) / len(texts)
        grads = [of_word.times(of_doc.times(error @ params[1].T, True), True) + decay * params[0] / len(texts), hidden.T @ error, error.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    direction = params[1][:, 1] - params[1][:, 0]
    return Model((gain * params[0] @ direction).astype(np.float32), float(params[2][1] - params[2][0]), base)


class _Numbers(dict):
    """Numbers for words, given on first sight."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Scores texts, remembering the sums of at most about ``most`` words."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.known, self.sums, self.sizes = _Numbers(), np.zeros(0), np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The texts' scores: each the softmax of the mean over all subwords of its words."""
        if len(self.known) > self.most:
            self._reset()
        index, which, n = self.known, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            n[i] = len(words)
            which.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        if fresh := index.fresh:
            places, buckets = subwords(fresh)
            self.sums = np.append(self.sums, np.bincount(places, weights=self.model.weights[buckets], minlength=len(fresh)))
            self.sizes = np.append(self.sizes, np.bincount(places, minlength=len(fresh)))
            fresh.clear()
        out = np.full(len(texts), self.model.base_rate)
        some = np.flatnonzero(n)
        if len(some):
            flat, starts = np.concatenate(which), (np.cumsum(n) - n)[some]
            mean = np.add.reduceat(self.sums[flat], starts) / np.add.reduceat(self.sizes[flat], starts)
            out[some] = 1 / (1 + np.exp(-np.clip(mean + self.model.intercept, -500, 500)))
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most ``sample_rows`` labelled documents that aren't held out: those with the smallest hashes of their ids.

    Of rows that repeat a doc_id the text with the smallest hash is learnt from, of labels that repeat one the largest.
    """
    picked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")).select("doc_id", "label", F.col("t.text").alias("text"))
    rows = sorted(rows.select("doc_id", "text", "label").toLocalIterator(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.label for r in rows]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(*labelled_sample(docs, labels, sample_rows))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are never read): doc_id, score, predicted.

    A text without words, null or empty, gets the base rate of the training labels. Rows of
    equal doc_id are scored each by its own text. Texts are read whole, slices of about
    ``SLICE_BYTES`` at a time; a longer one alone.
    """

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column("text")
            s = np.concatenate([np.zeros(0), *(scorer.scores(texts.slice(a, b - a).to_pylist()) for a, b in text_slices(texts, SLICE_BYTES))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int")
