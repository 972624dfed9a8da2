"""Exact comparison of candidate pairs of sequences, many at once.

Pairs are dealt to the cells of a square grid, by the family of either end. A sequence goes once to each cell in which it has a
pair, not once for each pair, and the grid grows with the sequences, so that a cell holds about SEQUENCES of either side; a family
of more than FAMILY pairs is dealt to a grid of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.functions.hashes import bit_map, has_bits
from duplet.operators.storage import map_arrow, stored

SEQUENCES, FAMILY = 1000, 10_000


def packed(tokens: pa.Array) -> pa.Array:
    """Token lists as they travel: the lengths of a list's tokens, by bytes of equal weight, and then the tokens, deflated, after their number."""
    bounds = np.append(0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)))
    flat = tokens.flatten().fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8) if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2] or b""
    lengths = np.diff(offsets).astype("<u4").view(np.uint8).reshape(-1, 4)
    found = [n.to_bytes(4, "little") + zlib.compress(lengths[a : a + n].T.tobytes() + memoryview(data)[offsets[a] : offsets[a + n]], 1) for a, n in zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True)]
    return pa.array(found, pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    """The token lists of packed()."""
    n = [int.from_bytes(x.as_buffer()[:4], "little") for x in column]
    held = [zlib.decompress(memoryview(x.as_buffer())[4:]) for x in column]
    lengths = [np.frombuffer(x, np.uint8, 4 * k).reshape(4, k).T.copy().view("<u4")[:, 0].astype(np.int64) for x, k in zip(held, n, strict=True)]
    offsets = np.concatenate([[0], *lengths]).cumsum()
    data = b"".join(memoryview(x)[4 * k :] for x, k in zip(held, n, strict=True))
    flat = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat)


class Cell:
    """sequences: token lists; codes, bounds: their tokens as numbers, equal ones alike, and where each begins; left, right: of each pair, the places of its ends among them; names, first, last: of each sequence, if its ids are numbers."""

    def __init__(self, table: pa.Table):
        kind = table.column("other").is_valid().to_numpy()
        own, pairs = table.filter(pa.array(~kind)), table.filter(pa.array(kind))
        self.ids = own.column("id").to_pylist()
        place = {x: i for i, x in enumerate(self.ids)}
        self.names, self.first, self.last = (own.column(c).combine_chunks() for c in ("name", "id", "last"))
        self.sequences = unpacked(own.column("tokens").combine_chunks())
        self.bounds = np.concatenate([[0], np.cumsum(self.sequences.value_lengths().to_numpy())]).astype(np.int64)
        self.codes = self.sequences.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        self.left, self.right = (np.array([place[x] for x in pairs.column(c).to_pylist()], np.int64) for c in ("id", "other"))

    def shared(self) -> np.ndarray:
        """For each pair, how many tokens its ends share, as multisets."""
        bounds, tokens = self.bounds, self.codes
        # the nth occurrence of a token in its sequence is an element of its own
        of = np.repeat(np.arange(len(self.ids)), np.diff(bounds))
        order = np.lexsort((tokens, of))
        t, s = tokens[order], of[order]
        lead = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])))[: len(t)]
        nth = np.arange(len(t)) - np.repeat(lead, np.diff(np.append(lead, len(t))))
        elements = np.unique(t + nth * (int(tokens.max(initial=0)) + 1), return_inverse=True)[1]
        flag = np.zeros(len(elements) + 1, bool)
        out = np.zeros(len(self.left), np.int64)
        order = np.argsort(self.right, kind="stable")
        begin = np.searchsorted(self.right[order], np.arange(len(self.ids) + 1))
        for b in np.flatnonzero(np.diff(begin)):
            mine = elements[bounds[b] : bounds[b + 1]]
            flag[mine] = True
            pairs = order[begin[b] : begin[b + 1]]
            a = self.left[pairs]
            size = bounds[a + 1] - bounds[a]
            ends = np.cumsum(size)
            met = np.concatenate([[0], np.cumsum(flag[elements[np.repeat(bounds[a] - ends + size, size) + np.arange(ends[-1])]])])
            out[pairs] = met[ends] - met[ends - size]
            flag[mine] = False
        return out


def _dealt(pairs: DataFrame, n_ids: int) -> DataFrame:
    """(row, column, a, b): a cell of each pair. Ends are dealt by the least id that they have a pair with, so that a family of similar sequences meets in one cell; a large one has a grid of its own."""
    leads = pairs.select("a", "b").union(pairs.select("b", "a")).groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("lead"))
    leads = stored(leads, "leads")
    for s in "ab":
        pairs = pairs.join(leads.select(F.col("id").alias(s), F.col("lead").alias(f"lead_{s}")), s)
    large = pairs.groupBy("lead_a", "lead_b").agg(F.ceil(F.sqrt(F.count("*") / F.lit(FAMILY))).alias("parts")).where("parts > 1")
    grid = F.lit(max(1, math.ceil(n_ids / SEQUENCES)))
    parts = F.coalesce("parts", F.lit(1))
    at = lambda s: F.pmod(F.xxhash64(f"lead_{s}"), grid)
    name = lambda s: F.when(parts > 1, F.xxhash64("lead_a", "lead_b", F.lit(s), F.pmod(F.xxhash64(s), parts))).otherwise(at(s))
    return pairs.join(large, ["lead_a", "lead_b"], "left").select(name("a").alias("row"), name("b").alias("column"), "a", "b")


def compared(pairs: DataFrame, sequences: DataFrame, run: Callable[[Cell], Iterator[pa.RecordBatch]], fields: str, numbers: DataFrame | None = None) -> DataFrame:
    """run of every cell. pairs: (a, b); sequences: (name, tokens); rows of one name are alike. A pair's ends are names, or else ids of numbers (name, id, last)."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    blank = lambda kind: F.lit(None).cast(kind)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    names = ids.select(F.col("id").alias("name")) if numbers is None else numbers.join(ids, "id", "left_semi")
    bits = bit_map(names.select(F.xxhash64("name").alias("m")), "m")

    def met(batches):
        for batch in batches:
            own = batch.filter(pa.array(has_bits(bits.value, batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([own.column(1), packed(own.column(2))], ["name", "tokens"])

    own = map_arrow(sequences.select(F.xxhash64("name").alias("m"), "name", "tokens"), met, "name string, tokens binary").dropDuplicates(["name"])
    own = own.select(F.col("name").alias("id"), "name", blank("long").alias("last"), "tokens") if numbers is None else own.join(numbers, "name").select("id", "name", "last", "tokens")
    sequences = stored(own, "met")
    dealt = stored(_dealt(pairs, ids.count()), "dealt")
    ends = dealt.select("row", "column", F.col("a").alias("id")).union(dealt.select("row", "column", F.col("b").alias("id"))).distinct()
    sides = ends.join(sequences, "id").select("row", "column", "id", blank(pairs.schema["b"].dataType).alias("other"), "name", "last", "tokens")
    asked = dealt.select("row", "column", F.col("a").alias("id"), F.col("b").alias("other"), blank("string").alias("name"), blank("long").alias("last"), blank("binary").alias("tokens"))
    together = sides.union(asked).repartition("row", "column").sortWithinPartitions("row", "column")

    def stream(batches):
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            at = 0
            for key, group in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n = len(list(group))
                if key != name and held:
                    yield from run(Cell(pa.Table.from_batches(held)))
                    held = []
                name = key
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield from run(Cell(pa.Table.from_batches(held)))

    return map_arrow(together, stream, fields)
