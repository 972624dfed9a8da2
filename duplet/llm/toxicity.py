"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, and their weighted votes."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from duplet.llm.common import PUNCTUATION, Words, map_arrow, mix, run_hashes, text_chunks
from duplet.llm.quality import sample

_U = np.uint64
#: Leading bits of a hash by which it is looked up.
HEAD = 18


@dataclass(frozen=True)
class Settings:
    """per_class: labelled documents taken of each class at most, in an order by hash; neighbours: how many vote.

    prefixes: sizes in bytes of the word beginnings that are terms beside the words (inflected forms share them).
    Every term that min_docs examples have is indexed; ratio (of its shares among the classes) and min_chi can ask for
    more, and don't by default. A term weighs by its idf, by the logarithm of that ratio, and by chi / (chi + even) of its
    chi-square, as chance makes most rarer terms look one-sided. Terms that more than `common` of the examples have are
    held by example and bounded by blocks, those that make up `rest` of a query's common part. folds: for the calibration.
    """

    per_class: int = 1500
    neighbours: int = 15
    prefixes: tuple[int, ...] = (4, 7)
    min_docs: int = 5
    ratio: float = 1.0
    min_chi: float = 0.0
    even: float = 15.0
    common: float = 0.05
    rest: float = 0.1
    block: int = 128
    folds: int = 5


def terms_of(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, document) of each word and word beginning of some texts; words are runs of letters and digits, A-Z in lower case."""
    w = Words(data, offsets, lower=True, gaps=PUNCTUATION)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    found, where = [w.hash], [doc]
    size = w.end - w.start
    values = w.data.astype(_U) + _U(1)
    for n in prefixes:
        at = np.flatnonzero(size > n)
        found.append(mix(run_hashes(values, w.start[at], w.start[at] + n, 0xB492B66FBE98F273) + _U(n)))
        where.append(doc[at])
    return np.concatenate(found), np.concatenate(where)


def _places(vocabulary: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the vocabulary, if it is there) of each hash; first: where the hashes with each leading HEAD bits begin."""
    at = first[t >> _U(64 - HEAD)]
    if not len(vocabulary):
        return at, np.zeros(len(t), bool)
    ends = np.append(vocabulary, _U(2**64 - 1))
    open_ = np.flatnonzero(ends[at] < t)
    while len(open_):
        at[open_] += 1
        open_ = open_[ends[at[open_]] < t[open_]]
    at = np.minimum(at, len(vocabulary) - 1)
    return at, vocabulary[at] == t


def _counts(column: pa.Array, s: Settings, vocabulary: np.ndarray | None = None):
    """(document, term, count) of a column's texts; terms are indices if there is a vocabulary (sorted hashes), else hashes."""
    docs, terms, counts = [], [], []
    first = None if vocabulary is None else np.searchsorted(vocabulary, np.arange(1 << HEAD, dtype=_U) << _U(64 - HEAD))
    for lo, _, data, offsets in text_chunks(column):
        t, d = terms_of(data, offsets, s.prefixes)
        if vocabulary is not None:
            at, hit = _places(vocabulary, first, t)
            t, d = at[hit], d[hit]
        if vocabulary is None:
            order = np.lexsort((t, d))
            t, d = t[order], d[order]
        else:
            d, t = np.divmod(np.sort(d * len(vocabulary) + t), max(len(vocabulary), 1))
        lead = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(t) else np.zeros(0, np.int64)
        docs.append(d[lead] + lo)
        terms.append(t[lead])
        counts.append(np.diff(np.append(lead, len(t))))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(docs, np.int64), join(terms, np.int64 if vocabulary is not None else _U), join(counts, np.int64)


@dataclass(frozen=True)
class Index:
    """Examples' unit vectors by term (postings in order of example).

    factor: of each term, its idf and class weight. common: of each term, its number among the common ones, or -1; those are
    also held by example (own_*), with the largest weight of each in each block of examples and the length of each example's part.
    """

    vocabulary: np.ndarray
    factor: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    common: np.ndarray
    most: np.ndarray
    own_start: np.ndarray
    own_term: np.ndarray
    own_weight: np.ndarray
    own_length: np.ndarray
    prior: float
    slope: float
    shift: float
    settings: Settings

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0, ties by example. Exact: rarer terms are added up for all examples, common ones for those that their bound (by block, and by length) lets enter."""
        n = len(self.labels)
        number = self.common[terms]
        often = number >= 0
        # the few that carry nearly all of the query's common part are added as well, so that the bound of the rest is tight
        square = np.sort(np.where(often, weights, 0.0) ** 2)
        often &= weights**2 <= np.append(square, -1.0)[np.searchsorted(np.cumsum(square), self.settings.rest * square.sum(), "right") - 1]
        scores = self._added(terms[~often], weights[~often])
        number, extra = number[often], weights[often]
        if len(number):
            bound = np.minimum(np.repeat(extra @ self.most[number], self.settings.block)[:n], np.sqrt(extra @ extra) * self.own_length)
            floor = np.partition(scores, n - k - 1)[n - k - 1] if n > k else 0.0  # of k + 1, as one may be left out
            who = np.flatnonzero((scores + bound > 0) & (scores + bound >= floor - 1e-9))
            begin, count = self.own_start[who], self.own_start[who + 1] - self.own_start[who]
            common = terms[often]
            if count.sum() < (self.start[common, 1] - self.start[common, 0]).sum():
                query = np.zeros(len(self.most))
                query[number] = extra
                post = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                scores[who] += np.bincount(np.repeat(np.arange(len(who)), count), query[self.own_term[post]] * self.own_weight[post], len(who))
            else:
                scores += self._added(common, extra)
                who = np.arange(n)
        else:
            who = np.arange(n)
        who = who[(scores[who] > 0) & (who != but)]
        if len(who) > 4 * k:
            who = who[scores[who] >= np.partition(scores[who], len(who) - k)[len(who) - k] - 1e-9]
        who = who[np.lexsort((who, -np.round(scores[who], 12)))[:k]]
        return scores[who], who

    def _added(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each example the sum of the products of weights over some terms."""
        begin = self.start[terms, 0]
        count = self.start[terms, 1] - begin
        post = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.example[post], np.repeat(weights, count) * self.weight[post], len(self.labels)).astype(float)

    def vote(self, cosines: np.ndarray, who: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each weighing by the square of its cosine over the nearest's, with half a vote for the prior."""
        w = (cosines / cosines.max(initial=1e-12)) ** 2
        return float((w @ self.labels[who] + 0.5 * self.prior) / (w.sum() + 0.5))

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -40, 40)))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """Score of each text, and as evidence its neighbours with their cosines."""
        out = np.full(len(column), self.calibrated(self.prior))
        evidence: list[list[tuple[int, float]]] = [[] for _ in range(len(column))]
        d, t, n = _counts(column, self.settings, self.vocabulary)
        cut = np.searchsorted(d, np.arange(len(column) + 1))
        for i in np.flatnonzero(np.diff(cut)):
            terms = t[cut[i] : cut[i + 1]]
            w = (1 + np.log(n[cut[i] : cut[i + 1]])) * self.factor[terms]
            c, who = self.nearest(terms, w / np.sqrt(w @ w), self.settings.neighbours)
            out[i] = self.calibrated(self.vote(c, who))
            evidence[i] = [(int(self.ids[x]), float(y)) for x, y in zip(who, c, strict=True)]
        return out, evidence


def _index(names: np.ndarray, d: np.ndarray, t: np.ndarray, c: np.ndarray, ids: np.ndarray, y: np.ndarray, prior: float, s: Settings) -> Index:
    """Of counts c of term t (a place in names) in example d, not calibrated."""
    n = len(y)
    pos = np.bincount(t, y[d], minlength=len(names)) if len(names) else np.zeros(0)
    total = np.bincount(t, minlength=len(names)) if len(names) else np.zeros(0)
    p, q = max(int(y.sum()), 1), max(int(n - y.sum()), 1)
    a, b = (pos + 0.5) / (p + 1), (total - pos + 0.5) / (q + 1)
    expected = total * p / (p + q)
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - total / (p + q)) * q / (p + q), 1e-9)
    # at least a trace of weight, so that a term of both classes alike still has its part in the cosine
    factor = (np.log((1 + n) / (1 + total)) + 1) * (np.abs(np.log(a / b)) * chi / (chi + s.even) + 1e-6)
    good = np.flatnonzero((total >= s.min_docs) & (np.maximum(a / b, b / a) >= s.ratio) & (chi >= s.min_chi))  # names are sorted
    factor, often = factor[good], total[good] > s.common * n
    at = np.full(len(names), -1)
    at[good] = np.arange(len(good))
    held = at[t] >= 0
    d, t, c = d[held], at[t[held]], c[held]
    w = (1 + np.log(c)) * factor[t]
    w /= np.sqrt(np.bincount(d, w * w, minlength=n))[d] if len(d) else 1
    order = np.lexsort((d, t))
    d, t, w = d[order], t[order], w[order]
    place = np.searchsorted(t, np.arange(len(good) + 1))
    common = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
    own = np.flatnonzero(often[t]) if len(t) else np.zeros(0, np.int64)
    own = own[np.argsort(d[own], kind="stable")]
    most = np.zeros((int(often.sum()), max(1, -(-n // s.block))))
    np.maximum.at(most, (common[t[own]], d[own] // s.block), w[own])
    length = np.sqrt(np.bincount(d[own], w[own] ** 2, minlength=n)) if len(own) else np.zeros(n)
    by_example = np.searchsorted(d[own], np.arange(n + 1))
    return Index(names[good], factor, ids, y, np.stack([place[:-1], place[1:]], axis=1), d.astype(np.int32), w, common, most, by_example, common[t[own]], w[own], length, prior, 1.0, 0.0, s)


def fit(rows: list[tuple[int, str, int]], s: Settings = Settings(), prior: float | None = None) -> Index:
    """rows: (id, text, label). prior: share of label 1 among all; by default that of the rows. Calibration: a logistic curve over votes, fitted by Newton's method, rows weighed to the prior; each example's vote is by an index of the other folds, since its own label would be in its terms' weights."""
    y = np.array([r[2] for r in rows], np.int64)
    n = len(rows)
    prior = (float(y.mean()) if n else 0.0) if prior is None else prior
    ids = np.array([r[0] for r in rows], np.int64)
    d, t, c = _counts(pa.array([r[1] for r in rows], pa.large_string()), s)
    names, t = np.unique(t, return_inverse=True)
    whole = _index(names, d, t, c, ids, y, prior, s)
    if not n or y.min() == y.max():
        return whole
    votes = np.full(n, prior)
    fold = np.random.default_rng(0).permutation(n) % s.folds
    for f in range(s.folds):
        rest = np.flatnonzero(fold != f)
        number = np.full(n, -1)
        number[rest] = np.arange(len(rest))
        used = number[d] >= 0
        other = _index(names, number[d[used]], t[used], c[used], ids[rest], y[rest], prior, s)
        place = np.minimum(np.searchsorted(other.vocabulary, names), max(len(other.vocabulary) - 1, 0))
        known = (other.vocabulary[place] == names) if len(other.vocabulary) else np.zeros(len(names), bool)
        asks = np.flatnonzero(~used & known[t])
        asks = asks[np.argsort(d[asks], kind="stable")]
        cut = np.searchsorted(d[asks], np.arange(n + 1))
        for i in np.flatnonzero(np.diff(cut)):
            mine = asks[cut[i] : cut[i + 1]]
            terms = place[t[mine]]
            w = (1 + np.log(c[mine])) * other.factor[terms]
            votes[i] = other.vote(*other.nearest(terms, w / np.sqrt(w @ w), s.neighbours))
    p, q = int(y.sum()), int(n - y.sum())
    x = np.stack([np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6))), np.ones(n)], axis=1)
    target = np.where(y == 1, (p + 1) / (p + 2), 1 / (q + 2))
    weight = np.where(y == 1, prior / p, (1 - prior) / q) * n
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * z * (1 - z))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (target - z)) - 1e-3 * (theta - (1.0, 0.0)))
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return replace(whole, slope=float(max(theta[0], 0.1)), shift=float(theta[1]))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, s: Settings = Settings()) -> Index:
    share = labels.where(may_learn & labels.toxic.isin(0, 1)).selectExpr("avg(toxic) AS share").first().share
    return fit(sample(docs, labels, "toxic", may_learn, s.per_class), s, share or 0.0)


def score(docs: DataFrame, index: Index, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every whole text; evidence lists the labelled neighbours with their cosines.

    The score depends on the text only. A text without any term of the vocabulary, null and empty ones among them, gets
    the calibrated prior and no evidence. Equal texts, equal scores; ties among neighbours go to the lower doc_id. No
    rows: no rows. Extra columns are left out. The index is bounded by 2 * per_class examples and travels with the task.
    """
    kept = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            x, evidence = kept.value.scores(b.column(1))
            flat = [e for row in evidence for e in row]
            parts = pa.StructArray.from_arrays([pa.array([e[0] for e in flat], pa.int64()), pa.array([e[1] for e in flat], pa.float64())], ["doc_id", "cosine"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, evidence)]), pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array((x >= threshold).astype(np.int32)), lists], ["doc_id", "score", "predicted", "evidence"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double>>")
