"""Similarity of two sequences: the exact ratio of matching runs, and its bounds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher


def real_quick_ratio(a: int, b: int) -> float:
    """Upper bound from lengths alone."""
    return 2.0 * min(a, b) / (a + b) if a + b else 1.0


def quick_ratio(a: Sequence, b: Sequence) -> float:
    """Upper bound from the multisets of elements."""
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if len(a) + len(b) else 1.0


class Matcher:
    """Compares many sequences with one right-hand side, which is indexed once."""

    def __init__(self, b: Sequence):
        self._match = SequenceMatcher(None, autojunk=False)
        self._match.set_seq2(b)
        self._counts = Counter(b)
        self.b = b

    def real_quick_ratio(self, a: Sequence) -> float:
        return real_quick_ratio(len(a), len(self.b))

    def quick_ratio(self, a: Sequence) -> float:
        return 2.0 * sum((Counter(a) & self._counts).values()) / (len(a) + len(self.b)) if len(a) + len(self.b) else 1.0

    def ratio(self, a: Sequence) -> float:
        """2 M / T, M being what the matching runs cover. Not symmetric: runs are sought from the left sequence's side."""
        self._match.set_seq1(a)
        return self._match.ratio()

    def matching_blocks(self, a: Sequence) -> list[tuple[int, int, int]]:
        """Longest common run, then the same to its left and right; in order, ties to the earliest."""
        self._match.set_seq1(a)
        return [tuple(m) for m in self._match.get_matching_blocks() if m.size]


def ratio(a: Sequence, b: Sequence) -> float:
    return Matcher(b).ratio(a)


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    return Matcher(b).matching_blocks(a)
