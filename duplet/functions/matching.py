"""The matching runs of many pairs of sequences at once, the same that similarity.Matcher finds one pair at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from duplet.functions.similarity import matching_blocks

#: Runs of so many tokens are sought first, shorter ones only in what they leave. Three codes of 21 bits make one key.
GRAM, BITS = 3, 21
#: Tokens of left sequences that are matched at once, and equal places that are held at once; a region with more runs than these goes the plain way.
TOKENS, HITS = 1 << 17, 1 << 20


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., size[0] of them, then those of first[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Index:
    """Places by key and then by place; equal keys are equal runs of `width` tokens."""

    def __init__(self, keys: np.ndarray, width: int):
        self.width, self.n = width, len(keys)
        self.key = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        self.at = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.at] * self.n + self.at

    def hits(self, regions: np.ndarray) -> Iterator[tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """(regions, (of, i, j) ...) for some regions (pair, i_from, i_to, j_from, j_to) at a time: of each pair of equal places, its region's number in `regions` and the places. A region that has too many comes alone, and they in parts."""
        length = np.maximum(regions[:, 2] - regions[:, 1] - self.width + 1, 0)
        of = np.repeat(np.arange(len(regions)), length)
        i = _ranges(regions[:, 1], length)
        base = self.key[i] * self.n
        low = np.searchsorted(self.sorted, base + regions[of, 3])
        size = np.maximum(np.searchsorted(self.sorted, base + np.maximum(regions[of, 4] - self.width + 1, 0)) - low, 0)
        total = np.bincount(of, size, len(regions)).astype(np.int64)
        ends, places = np.cumsum(total), np.concatenate([[0], np.cumsum(length)])
        at = 0
        while at < len(regions):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
            some = slice(places[at], places[stop])
            yield regions[at:stop], self._parts(of[some] - at, i[some], low[some], size[some])
            at = stop

    def _parts(self, of: np.ndarray, i: np.ndarray, low: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.cumsum(size)
        at = 0
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
            some = slice(at, stop)
            yield np.repeat(of[some], size[some]), np.repeat(i[some], size[some]), self.at[_ranges(low[some], size[some])]
            at = stop


def _runs(codes: np.ndarray, regions: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, ...] | None:
    """(of, i, j, k), in order of `of`: the maximal runs that the equal places make up within their regions. None if one region has too many."""
    last = len(codes) - 1
    begin, end, n = [np.zeros((3, 0), np.int64)], [np.zeros((3, 0), np.int64)], 0
    for of, i, j in parts:
        _, i_from, i_to, j_from, j_to = regions[of].T
        begins = (i == i_from) | (j == j_from) | (codes[i - 1] != codes[j - 1])
        ends = (i + width >= i_to) | (j + width >= j_to) | (codes[np.minimum(i + width, last)] != codes[np.minimum(j + width, last)])
        for held, mask in ((begin, begins), (end, ends)):
            held.append(np.stack([of[mask], i[mask], j[mask]]))
        n += len(begin[-1][0])
        if n > HITS and len(regions) == 1:
            return None
    sides = []
    for held in (begin, end):
        o, x, y = np.concatenate(held, 1)
        order = np.lexsort((x, x - y, o))
        sides.append((o[order], x[order], y[order]))
    (o, x, y), (_, end, _) = sides
    return o, x, y, end - x + width


def _cut(regions: np.ndarray, runs: tuple[np.ndarray, ...], width: int, blocks: list[np.ndarray], rest: list[np.ndarray]) -> None:
    """The longest run of each region is a block, ties to the earliest; then those of the regions left and right of it. rest: regions in which no run has `width` tokens."""
    of, i, j, k = runs
    most = (1 << BITS) - 1
    while len(regions):
        lead = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        has = np.zeros(len(regions), bool)
        has[of[lead]] = True
        rest.append(regions[~has])
        if not len(of):
            return
        group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(of))))
        regions = regions[has]
        _, i_from, i_to, j_from, j_to = regions.T
        best = np.maximum.reduceat((k << 2 * BITS) | ((most - i + i_from[group]) << BITS) | (most - j + j_from[group]), lead)
        bk, bi, bj = best >> 2 * BITS, most - (best >> BITS & most) + i_from, most - (best & most) + j_from
        blocks.append(np.stack([regions[:, 0], bi, bj, bk], 1))
        x, y = bi + bk, bj + bk
        # regions 2g and 2g + 1 are left and right of the block of g
        after = np.stack([regions[:, 0], i_from, bi, j_from, bj, regions[:, 0], x, i_to, y, j_to], 1).reshape(-1, 5)
        short = np.minimum(k, np.minimum(bi[group] - i, bj[group] - j))
        skip = np.maximum(0, np.maximum(x[group] - i, y[group] - j))
        left, right = short >= width, k - skip >= width
        of = np.concatenate([2 * group[left], 2 * group[right] + 1])
        order = np.argsort(of, kind="stable")
        i, j, k = (np.concatenate(v)[order] for v in ((i[left], (i + skip)[right]), (j[left], (j + skip)[right]), (short[left], (k - skip)[right])))
        full = (after[:, 2] > after[:, 1]) & (after[:, 4] > after[:, 3])
        of, regions = (np.cumsum(full) - 1)[of[order]], after[full]


def matched(codes: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, pair, i, j, k) for some pairs from..to - 1 at a time: the matching runs, in order, of the sequences codes[bounds[x] : bounds[x + 1]] of left and right. The place of a run counts from its sequence's start."""
    if not len(left):
        return
    codes = codes.astype(np.int64)
    n = np.diff(bounds)
    indices = [_Index(codes, 1)]
    if codes.max(initial=0) < 1 << BITS and len(codes) >= GRAM:
        grams = codes[2:] | codes[1:-1] << BITS | codes[:-2] << 2 * BITS
        indices.insert(0, _Index(np.append(grams, [-1] * (GRAM - 1)), GRAM))
    ends = np.cumsum(n[left])
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
        a, b = left[at:stop], right[at:stop]
        regions = np.stack([np.arange(at, stop), bounds[a], bounds[a + 1], bounds[b], bounds[b + 1]], 1).astype(np.int64)
        blocks: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        wide = (np.maximum(n[a], n[b]) >> BITS) > 0
        for r in regions[wide]:
            blocks.append(_plain(codes, r))
        regions = regions[~wide]
        for index in indices:
            rest: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
            for some, parts in index.hits(regions):
                runs = _runs(codes, some, parts, index.width)
                if runs is None:
                    blocks.append(_plain(codes, some[0]))
                else:
                    _cut(some, runs, index.width, blocks, rest)
            regions = np.concatenate(rest)
        every = np.concatenate(blocks)
        pair, i, j, k = every[np.lexsort((every[:, 1], every[:, 0]))].T
        yield at, stop, pair, i - bounds[left[pair]], j - bounds[right[pair]], k
        at = stop


def _plain(codes: np.ndarray, region: np.ndarray) -> np.ndarray:
    pair, i_from, i_to, j_from, j_to = region.tolist()
    found = matching_blocks(codes[i_from:i_to].tolist(), codes[j_from:j_to].tolist())
    return np.array([(pair, i_from + i, j_from + j, k) for i, j, k in found], np.int64).reshape(-1, 4)
