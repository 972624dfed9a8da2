"""Which sequences may be similar, by the rarest elements of their multisets, without a row for each pair that meets.

Documents go by length to bands, and a cell holds a part of one band with a part of it or of the next one. A cell counts in
memory how many of their rarest elements two sequences share; only pairs that share enough leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.functions.hashes import mix, run_hashes
from duplet.operators.blocks import _groups
from duplet.operators.storage import BATCH_ROWS, discard, map_arrow, stored

#: Counters of how often elements occur; those of one counter count as one. Parts that they are summed in.
COUNTERS, PARTS = 1 << 21, 64
#: One in so many elements of a sequence, and one, must be met twice over: they are what a pair shares among its rarest.
SPARE = 16
#: Sequences of a part of a band, and sequences that are counted at once.
SEQUENCES, SETS = 100_000, 8

_U = np.uint64
_TOKEN, _NTH = 0x9E3779B97F4A7C15, _U(0xA24BAED4963EE407)


def elements(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the elements of token lists, the nth occurrence of a token in its list being one, and the bounds of each list among them."""
    bounds = np.append(0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)))
    flat = tokens.flatten().fill_null("").cast(pa.large_string())
    if not len(flat):
        return np.zeros(0, _U), bounds
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    t = run_hashes(data.astype(_U) + _U(1), offsets[:-1] - offsets[0], offsets[1:] - offsets[0], _TOKEN)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((t, of))
    t, of = t[order], of[order]
    lead = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (of[1:] != of[:-1])))
    nth = np.arange(len(t)) - np.repeat(lead, np.diff(np.append(lead, len(t))))
    return mix(t + nth.astype(_U) * _NTH), bounds


def _slices(tokens: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of token lists, of about `most` tokens, with the row that each begins at."""
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())
    row = 0
    while row < len(tokens):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield row, tokens.slice(row, stop - row)
        row = stop


def _counters(sequences: DataFrame) -> Broadcast:
    """How often the elements of each counter occur."""
    part = COUNTERS // PARTS

    def count(batches):
        held = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, tokens in _slices(batch.column(0)):
                found, n = np.unique(elements(tokens)[0] & _U(COUNTERS - 1), return_counts=True)
                held[found] += n.astype(np.uint32)
        if held.any():
            rows = held.reshape(PARTS, part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in rows], pa.binary())], ["part", "counts"])

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = np.frombuffer(x.as_buffer(), np.uint32)
                held[p] = held[p] + now if p in held else now
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "counts"])

    fields = "part int, counts binary"
    table = map_arrow(map_arrow(sequences.select("tokens"), count, fields).repartition("part"), total, fields).toArrow()
    out = np.zeros((PARTS, part), np.uint32)
    for p, x in zip(table.column("part").to_pylist(), table.column("counts"), strict=True):
        out[p] = np.frombuffer(x.as_buffer(), np.uint32)
    return sequences.sparkSession.sparkContext.broadcast(out.reshape(-1))


def need(n: np.ndarray, least: float) -> np.ndarray:
    """How many elements a sequence of n shares, at least, with any that it reaches `least` with."""
    return np.ceil(least * n / (2.0 - least) - 1e-9).astype(np.int64)


def spare(n: np.ndarray, least: float) -> np.ndarray:
    """How many elements two sequences share, at least, among those that prefixes() keeps of them, n being the shorter one's length."""
    return np.minimum(np.maximum(need(n, least), 1), 1 + n // SPARE)


def prefixes(tokens: pa.Array, counts: np.ndarray, least: float) -> list[np.ndarray]:
    """Of each list, the codes of its rarest elements: so many that pairs which reach `least` share spare() of them."""
    e, bounds = elements(tokens)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    e = e[np.lexsort((e, counts[e & _U(COUNTERS - 1)], of))]
    n = np.diff(bounds)
    keep = np.minimum(n, n - need(n, least) + spare(n, least))
    return [(e[b : b + k] >> _U(32)).astype(np.uint32) for b, k in zip(bounds[:-1].tolist(), keep.tolist(), strict=True)]


class _Lists:
    """The prefixes of some sequences, in order of length, as lists of places by code."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, n_codes: int):
        self.flat, self.bounds = flat, bounds - bounds[0]
        order = np.argsort(flat, kind="stable")
        self.of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))[order]
        self.first = np.searchsorted(flat[order], np.arange(n_codes))
        self.end = self.first.copy()
        self.low = self.high = 0

    def window(self, low: int, high: int) -> None:
        """Keeps the sequences from low to high - 1; neither ever falls."""
        if high > self.high:
            np.add.at(self.end, self.flat[self.bounds[self.high] : self.bounds[high]], 1)
            self.high = high
        if low > self.low:
            np.add.at(self.first, self.flat[self.bounds[self.low] : self.bounds[low]], 1)
            self.low = low

    def met(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many places each of the window's sequences has in each of the lists flat[bounds[i] : bounds[i + 1]]."""
        width, flat = self.high - self.low, flat[bounds[0] : bounds[-1]]
        size = self.end[flat] - self.first[flat]
        ends = np.cumsum(size)
        places = self.of[np.repeat(self.first[flat] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        each = np.repeat(np.arange(len(bounds) - 1) * width - self.low, np.diff(bounds))
        return np.bincount(places + np.repeat(each, size), minlength=(len(bounds) - 1) * width).reshape(len(bounds) - 1, width)


def meeting(n: np.ndarray, role: np.ndarray, flat: np.ndarray, bounds: np.ndarray, least: float, inside: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right): pairs of places that share spare() of their prefixes and are near enough in length.

    Rows are in order of (role, n). Those of role 0 meet one another, if `inside`, and all others; others meet those of role 0 only.
    """
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    cut = int(np.searchsorted(role, 0, "right"))
    own, enough, reach = n[:cut], spare(n, least), least / (2.0 - least)
    low = np.searchsorted(own, np.ceil(reach * n - 1e-6))
    for kind in np.unique(role if inside else role[cut:]):
        begin, stop = int(np.searchsorted(role, kind)), int(np.searchsorted(role, kind, "right"))
        lists = _Lists(codes[: bounds[cut]], bounds[: cut + 1], int(codes.max(initial=-1)) + 1)
        high = np.arange(cut) if kind == 0 else np.searchsorted(own, np.floor(n[begin:stop] / reach + 1e-6), "right")
        for i in range(begin, stop, SETS):
            some = np.arange(i, min(i + SETS, stop))
            lists.window(int(low[some[0]]), max(int(high[some[-1] - begin]), int(low[some[0]])))
            if lists.high == lists.low:
                continue
            met = lists.met(codes, bounds[some[0] : some[-1] + 2])
            found = np.flatnonzero(met.reshape(-1) >= enough[lists.low])  # the shortest one's, then each pair's
            x, y = np.divmod(found, met.shape[1])
            count, x, y = met.reshape(-1)[found], some[x], y + lists.low
            fits = (count >= np.minimum(enough[y], enough[x])) & (y >= low[x]) & (y < high[x - begin])
            yield y[fits], x[fits]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for t in _groups(batches):
        t = t.combine_chunks()
        cell = t.column("cell").to_numpy()
        lead = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist()
        for at, stop in zip(lead, [*lead[1:], len(cell)], strict=True):
            yield t.slice(at, stop - at)


def pairs_of_cells(dealt: DataFrame, least: float, parts: int) -> DataFrame:
    """(a, b) of rows (cell, role, n, id, codes). Of the cells of one part with each of `parts`, that with itself has its own pairs."""

    def run(batches):
        for t in _cells(batches):
            n, role = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "role"))
            name = t.column("cell")[0].as_py()
            own = name % parts == name // parts % parts
            order = np.lexsort((n, role))
            t = t.take(pa.array(order))
            n, role, ids, column = n[order], role[order], t.column("id").combine_chunks(), t.column("codes").combine_chunks()
            ids, column = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, column))
            at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
            flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.uint32)
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            for x, y in meeting(n, role, flat, (at - at[0]) // 4, least, own):
                left.append(x)
                right.append(y)
                if sum(map(len, left)) >= BATCH_ROWS:
                    yield _named(ids, left, right)
                    left, right = [], []
            if left:
                yield _named(ids, left, right)

    return map_arrow(dealt.repartition("cell").sortWithinPartitions("cell"), run, "a {0}, b {0}".format(dealt.schema["id"].dataType.simpleString()))


def _named(ids: pa.Array, left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))) for x in (left, right)], ["a", "b"])


def candidates(sequences: DataFrame, least: float, numbers: DataFrame | None = None) -> DataFrame:
    """(a, b), in no order and each pair once: the pairs of sequences (id, tokens) that may share as many elements as a ratio of `least` > 0 takes. Loses none. Rows of one id are alike. With numbers (name, id long, ...) of the ids, a and b are those.

    To reach t, a sequence of n tokens shares at least c = t n / (2 - t) of them with the other, so that of the rarest n - c + s of
    each, s are shared. Rarity is by counters of fixed number: any order does.
    """
    counts = _counters(sequences)

    def run(batches):
        for batch in batches:
            for row, tokens in _slices(batch.column(1)):
                n = tokens.value_lengths().fill_null(0)
                codes = pa.array([x.tobytes() for x in prefixes(tokens, counts.value, least)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(tokens)), n.cast(pa.int64()), codes], ["id", "n", "codes"])

    kept = map_arrow(sequences.select("id", "tokens"), run, "id string, n long, codes binary").where("n > 0").dropDuplicates(["id"])
    if numbers is not None:
        kept = kept.withColumnRenamed("id", "name").join(numbers.select("name", "id"), "name").select("id", "n", "codes")
    kept = prefixed = stored(kept, "prefixes")
    # sequences that are near enough in length are in one band or in two that follow each other
    band = F.floor(F.log(F.col("n").cast("double") + 1e-6) / F.lit(max(1e-3, math.log((2.0 - least) / least) + 1e-6))).cast("long")
    kept = kept.withColumn("band", band)
    most = kept.groupBy("band").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(most / SEQUENCES))
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    cell = lambda g, i, j: (g * parts + i) * parts + j
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    left = F.transform(every, lambda j: F.struct(cell(F.col("band"), part, j).alias("cell"), F.lit(0).alias("role")))
    above = F.transform(every, lambda i: F.struct(cell(F.col("band") - 1, i, part).alias("cell"), F.lit(1).alias("role")))
    beside = F.transform(F.filter(every, lambda i: i < part), lambda i: F.struct(cell(F.col("band"), i, part).alias("cell"), F.lit(2).alias("role")))
    dealt = kept.withColumn("to", F.explode(F.concat(left, above, beside))).select("to.cell", "to.role", "n", "id", "codes")
    found = stored(pairs_of_cells(dealt, least, parts), "candidates")
    discard(prefixed)
    return found
