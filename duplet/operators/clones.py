"""Clones: pairs of units whose token sequences are similar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duplet.functions.matching import matched
from duplet.operators import prefixes
from duplet.operators.cells import Cell, compared
from duplet.operators.storage import discard, stored

UNIT_REF = ("file", "qualname", "start_line", "end_line", "hash")


def streams(units: DataFrame) -> DataFrame:
    """Distinct token sequences: (hash, tokens, n_tokens, units, first, last): how many units have it, and the first and last of them in file order."""
    place = F.struct("path_parts", "start_line", "end_line", "unit_ord")
    return units.groupBy("hash").agg(F.any_value("tokens").alias("tokens"), F.any_value("n_tokens").alias("n_tokens"), F.count("*").alias("units"), F.min(place).alias("first"), F.max(place).alias("last"))


def candidates(sequences: DataFrame, least: float) -> DataFrame:
    """(hash_a, hash_b), hash_a < hash_b: pairs of distinct sequences (hash, tokens) that may reach a ratio of `least`, all of them for 0. Loses none.

    The ratio is at most the Dice coefficient of the multisets, of which prefixes.candidates() has what may reach it.
    """
    if least > 0:
        found = prefixes.candidates(sequences.select(F.col("hash").alias("id"), "tokens"), least)
        return found.select(F.least("a", "b").alias("hash_a"), F.greatest("a", "b").alias("hash_b"))
    ids = sequences.select("hash").distinct()
    return ids.withColumnRenamed("hash", "hash_a").join(ids.withColumnRenamed("hash", "hash_b"), F.col("hash_a") < F.col("hash_b"))


def first_and_last(units: DataFrame) -> DataFrame:
    """(hash, first, last) of streams(units), which may be without tokens."""
    place = F.struct("path_parts", "start_line", "end_line", "unit_ord")
    return units.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def numbered(units: DataFrame) -> DataFrame:
    """(name, id, last) of each distinct sequence of units: its hash, and the numbers of its first and its last unit in file order."""
    ranked = units.orderBy(F.struct("path_parts", "start_line", "end_line", "unit_ord"), "hash").select("hash", F.monotonically_increasing_id().alias("at"))
    return stored(ranked.groupBy(F.col("hash").alias("name")).agg(F.min("at").alias("id"), F.max("at").alias("last")), "numbers")


def similar_streams(units: DataFrame, least: float) -> DataFrame:
    """(hash_a, hash_b, similarity) of distinct sequences of units; a is the one whose first unit comes first, as the ratio has a direction.

    least = 0 asks for every pair by definition and compares all.
    """
    return _similar(units, least)


def similar_blocks(units: DataFrame, least: float) -> DataFrame:
    """(hash_a, hash_b, at_a, at_b, size): the matching runs of each pair that similar_streams() has."""
    return _similar(units, least, runs=True)


def _similar(units: DataFrame, least: float, runs: bool = False) -> DataFrame:
    sequences = stored(units.select("hash", "tokens", "path_parts", "start_line", "end_line", "unit_ord"), "sequences")
    found = _scored(sequences, least, runs)
    discard(sequences)
    return found


def _scored(units: DataFrame, least: float, runs: bool = False, both: bool = False) -> DataFrame:
    """(hash_a, hash_b, similarity), or with runs similar_blocks(), of the distinct sequences of units (hash, tokens and place) that reach least: from the one whose first unit comes first or, if both, in each direction in which units of theirs come.

    The multiset bound goes first, once for both. Up to the result, sequences go by numbers.
    """
    numbers = numbered(units)
    if least > 0:
        pairs = prefixes.candidates(units.select(F.col("hash").alias("id"), "tokens"), least, numbers)
    else:
        pairs = numbers.select(F.col("id").alias("a")).join(numbers.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    names = ["hash_a", "hash_b", "at_a", "at_b", "size"] if runs else ["hash_a", "hash_b", "similarity"]
    kinds = [pa.string(), pa.string(), *([pa.int32()] * 3 if runs else [pa.float64()])]

    def run(cell: Cell):
        lengths = cell.sequences.value_lengths().to_numpy()
        total = lengths[cell.left] + lengths[cell.right]
        near = np.flatnonzero(2.0 * cell.shared() >= least * total - 1e-9)
        first, last = cell.first.to_numpy(), (cell.last if both else cell.first).to_numpy()
        forth, back = near[first[cell.left[near]] < last[cell.right[near]]], near[first[cell.right[near]] < last[cell.left[near]]]
        a, b = np.concatenate([cell.left[forth], cell.right[back]]), np.concatenate([cell.right[forth], cell.left[back]])
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        for at, stop, pair, i, j, k in matched(cell.codes, cell.bounds, a, b):
            n = lengths[a[at:stop]] + lengths[b[at:stop]]
            ratio = np.where(n > 0, 2.0 * np.bincount(pair - at, k, stop - at) / np.maximum(n, 1), 1.0)
            kept = ratio >= least
            pair, *values = (x[kept[pair - at]] for x in (pair, i, j, k)) if runs else (np.flatnonzero(kept) + at, ratio[kept])
            cols = [cell.names.take(pa.array(side[pair])) for side in (a, b)] + [pa.array(x).cast(kind) for x, kind in zip(values, kinds[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names)

    fields = "hash_a string, hash_b string, " + ("at_a int, at_b int, size int" if runs else "similarity double")
    return compared(pairs, units.select(F.col("hash").alias("name"), "tokens"), run, fields, numbers)


def quick_ratios(sequences: DataFrame, least: float) -> DataFrame:
    """(hash_a, hash_b, quick_ratio) of the pairs of distinct sequences (hash, tokens) whose multiset bound reaches least > 0."""
    sequences = stored(sequences.select("hash", "tokens"), "sequences")
    pairs = candidates(sequences, least)

    def run(cell: Cell):
        lengths = cell.sequences.value_lengths().to_numpy().astype(np.int64)
        bound = 2.0 * cell.shared() / np.maximum(lengths[cell.left] + lengths[cell.right], 1)
        near = np.flatnonzero(bound >= least)
        a, b = (pa.array([cell.ids[x] for x in side[near].tolist()], pa.string()) for side in (cell.left, cell.right))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(bound[near])], ["hash_a", "hash_b", "quick_ratio"])

    named = pairs.select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
    return compared(named, sequences.select(F.col("hash").alias("name"), "tokens"), run, "hash_a string, hash_b string, quick_ratio double")


def unit_ref(side: str) -> Column:
    return F.struct(*(F.col(f"{side}.{c}").alias(c) for c in UNIT_REF)).alias(side)


def nested(a: Column, b: Column) -> Column:
    """Whether one of two units holds the other: same file, and one span inside the other or equal to it."""
    inside = lambda x, y: (x["start_line"] <= y["start_line"]) & (y["end_line"] <= x["end_line"])
    return (a["file"] == b["file"]) & (inside(a, b) | inside(b, a))


def find_clones(units: DataFrame, min_similarity: float = 0.85) -> DataFrame:
    """(similarity, a, b) for every pair of units, a before b in file order, that reaches min_similarity and isn't nested.

    Equal sequences need no comparison. Sequences that differ are compared once each way that their units come in.
    Every pair of copies is a row, as in a report; for copies in bulk use streams() with similar_streams().
    """
    if min_similarity < 1:
        whole = stored(units.select(*(c for c in units.columns if c != "text")), "units")
        units = stored(whole.drop("tokens"), "units")
    known = units.withColumnRenamed("path", "file")
    order = F.struct("path_parts", "start_line", "end_line", "unit_ord")
    row = known.select("hash", F.struct(*UNIT_REF, order.alias("order")).alias("u"))
    same = row.select("hash", F.col("u").alias("a")).join(row.select("hash", F.col("u").alias("b")), "hash").where(F.col("a.order") < F.col("b.order")).select(F.lit(1.0).alias("similarity"), "a", "b")
    same = same.where(F.lit(1.0 >= min_similarity)).where(~nested(F.col("a"), F.col("b"))).select("similarity", unit_ref("a"), unit_ref("b"))
    if min_similarity >= 1:  # sequences that differ never reach it
        return same
    scored = _scored(whole, min_similarity, both=True)
    discard(whole)
    left = row.select(F.col("hash").alias("hash_a"), F.col("u").alias("a"))
    right = row.select(F.col("hash").alias("hash_b"), F.col("u").alias("b"))
    other = scored.join(left, "hash_a").join(right, "hash_b").where(F.col("a.order") < F.col("b.order")).select("similarity", "a", "b")
    return same.union(other.where(~nested(F.col("a"), F.col("b"))).select("similarity", unit_ref("a"), unit_ref("b")))


def clone_key() -> list[Column]:
    return [F.least("a.hash", "b.hash").alias("k1"), F.greatest("a.hash", "b.hash").alias("k2")]


def in_order(clones: DataFrame) -> DataFrame:
    """Most similar first, then by key, then by place."""
    place = [F.struct(F.split(f"{s}.file", "/"), f"{s}.start_line", f"{s}.end_line") for s in "ba"]
    return clones.orderBy(F.col("similarity").desc(), *clone_key(), *place)
