"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax, numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duplet.llm.common import Words, map_arrow, mix, powers, run_hashes, text_chunks

_U = np.uint64
#: Sizes of the character n-grams, as bytes of UTF-8 within a word.
NGRAMS = (3, 4, 5)
_NGRAM_BASE = 0xA0761D6478BD642F


@dataclass(frozen=True)
class Settings:
    """per_class: labelled documents taken of each class at most, in an order by hash; all else covers all data. steps: of SGD, over as many passes as they fill, so that few examples train as long as many."""

    buckets: int = 1 << 16
    dims: int = 12
    steps: int = 12_000
    rate: float = 2.0
    per_class: int = 1500
    seed: int = 11


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of some texts: each word, one for any word that repeats the one before it (the word pairs x x, all in one bucket), and each n-gram within a word, which knows if it begins or ends the word."""
    words = Words(data, offsets)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])) + 1
    found, where = [words.hash, np.full(len(again), 0x5DEECE66D, _U)], [doc, doc[again]]
    size = words.end - words.start
    word = np.zeros(len(data) + 1, np.int32)
    np.add.at(word, words.start, 1)
    word = np.cumsum(word[:-1]) - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end[words.end < len(inside)]] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    values = data.astype(_U) + _U(1)
    up, down = powers(len(data) + 1, _NGRAM_BASE)
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(values * up[: len(data)], out=prefix[1:])
    for n in NGRAMS:
        if len(data) < n:
            continue
        at = np.flatnonzero(inside[: len(data) - n + 1] & inside[n - 1 :] & (word[: len(data) - n + 1] == word[n - 1 :]))
        w = word[at]
        edge = (at == words.start[w]).astype(_U) + _U(2) * (at + n == words.end[w]).astype(_U) + _U(4 * n)
        found.append(mix((prefix[at + n] - prefix[at]) * down[at] + edge * _U(0x9E3779B97F4A7C15)))
        where.append(doc[w])
    del size
    return (np.concatenate(found) % _U(buckets)).astype(np.int64), np.concatenate(where)


@dataclass(frozen=True)
class Model:
    """weight: for each bucket its vector's part in the difference of the two classes' outputs."""

    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for a, b, data, offsets in text_chunks(column):
            f, doc = features(data, offsets, len(self.weight))
            count = np.bincount(doc, minlength=b - a)
            out[a:b] += np.bincount(doc, self.weight[f], minlength=b - a) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """SGD over documents one by one: the mean of the feature vectors, a softmax layer of two classes, cross entropy weighed so that both classes count alike. One class only: its constant."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(s.buckets), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    docs = []
    for a, b, data, offsets in text_chunks(pa.array(texts, pa.string())):
        f, doc = features(data, offsets, s.buckets)
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(b - a + 1))
        for i in range(b - a):
            ids, n = np.unique(f[order[cut[i] : cut[i + 1]]], return_counts=True)
            docs.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, (s.buckets, s.dims)).astype(np.float32)
    out, bias = np.zeros((2, s.dims), np.float32), np.zeros(2, np.float32)
    even = len(y) / (2 * np.bincount(y, minlength=2))
    steps = 0
    for _ in range(-(-s.steps // len(y))):
        for i in rng.permutation(len(y)):
            ids, share = docs[i]
            rate = s.rate * max(0.0, 1 - steps / s.steps)
            steps += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(s.dims, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(even[y[i]])
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            if len(ids):
                vectors[ids] -= np.float32(rate) * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of labelled documents, per_class of each class at most, the first by a hash of doc_id."""
    known = labels.where(may_learn & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null").distinct()
    picks = None
    for c in (0, 1):
        of = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = of if picks is None else picks.union(of)
    # of a doc_id with several rows the least text, so that at most 2 * per_class come to the driver
    found = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.text or "", r.label) for r in found)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, s: Settings = Settings()) -> Model:
    rows = sample(docs, labels, "quality", may_learn, s.per_class)
    return fit([t for _, t, _ in rows], [y for _, _, y in rows], s)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text. The score depends on the text only.

    Null and empty texts get the bias alone. Repeated rows: each by itself. No rows: no rows. Extra columns are left out.
    The model (one number for each bucket) is of fixed size and travels with the task.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = kept.value
        for b in batches:
            x = m.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array((x >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more.

    Null and empty texts score the bias alone, so all of them stay or all go. Repeated rows: each by itself. No rows: no rows. Columns of any name pass.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(kept.value.scores(b.column(column)) >= threshold))

    return map_arrow(docs, run, docs.schema)
