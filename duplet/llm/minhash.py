"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

The sketch has BANDS x ROWS coordinates. In round i each shingle goes to one bin, by hash, with value i + uniform; a
coordinate keeps its least value. Rounds from the size of the sketch on place every shingle in one fixed bin, so after
at most twice as many rounds no coordinate is empty (Dahlgaard, Knudsen, Thorup 2017); sets much larger than the sketch
need a round or two.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.llm.common import Words, by_row, components, discard, map_arrow, mix, run_hashes, signed, stored, text_chunks

_U = np.uint64
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
_SHINGLE_BASE = 0xC2B2AE3D27D4EB4F
_BITS = _U((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words_each: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z in lower case, the whole sequence as one where words are fewer."""
    w = Words(data, offsets, lower=True)
    n = np.diff(w.first)
    last = np.repeat(w.first[1:], n)
    at = np.arange(len(w.hash))
    full = at[at + words_each <= last]
    hashes = run_hashes(w.hash, full, full + words_each, _SHINGLE_BASE)
    sets = [np.unique(x) for x in by_row(hashes, np.searchsorted(full, w.first))]
    for i in np.flatnonzero((n > 0) & (n < words_each)):
        sets[i] = run_hashes(w.hash, w.first[i : i + 1], w.first[i + 1 : i + 2], _SHINGLE_BASE)
    return sets


def sketch(x: np.ndarray) -> np.ndarray:
    """The SIZE coordinates of a nonempty set of hashes."""
    out = np.zeros(SIZE, _U)
    filled = np.zeros(SIZE, bool)
    at, step = 0, max(1, min(SIZE, math.ceil(SIZE * 5.5 / len(x))))
    step = min(step, max(1, (1 << 18) // len(x)))
    while at < 2 * SIZE and not filled.all():
        rounds = np.arange(at, min(at + step, SIZE if at < SIZE else 2 * SIZE), dtype=_U)[:, None]
        z = mix(x[None, :] + rounds * _U(0x9E3779B97F4A7C15))
        bins = ((z >> _U(32)) * _U(SIZE)) >> _U(32) if at < SIZE else np.broadcast_to(rounds - _U(SIZE), z.shape)
        keys = np.sort((bins << _U(56) | rounds << _U(48) | (mix(z) & _BITS)).ravel())
        b = (keys >> _U(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        new = first[~filled[b[first]]]
        out[b[new]], filled[b[new]] = keys[new], True
        at += len(rounds)
    return out


def bands(s: np.ndarray) -> np.ndarray:
    odd = mix(np.arange(1, ROWS + 1, dtype=_U)) | _U(1)
    return mix((mix(s.reshape(BANDS, ROWS)) * odd).sum(axis=1) + np.arange(BANDS, dtype=_U))


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return np.array([mix(x).sum(dtype=_U) for x in sets], _U), np.array([mix(x ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U) for x in sets], _U)


def _sketches(docs: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands) of every document; d1 and d2 are a digest of the set; bands is empty for an empty set."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(1)):
                sets = shingle_sets(data, offsets, words_each)
                d1, d2 = _digests(sets)
                bounds = np.cumsum([0, *(BANDS * (len(x) > 0) for x in sets)]).astype(np.int32)
                every = [bands(sketch(x)) for x in sets if len(x)]
                flat = signed(np.concatenate(every)) if every else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(signed(d1)), pa.array(signed(d2)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["doc_id", "n", "d1", "d2", "bands"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(id, items): the set of each of wanted (doc_id, names: its sets' id, d1 and d2), from a document that has it."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(1)):
                sets = shingle_sets(data, offsets, words_each)
                found = [signed(d).tolist() for d in _digests(sets)]
                have = [next((x["id"] for x in names if (x["d1"], x["d2"]) == d), None) for d, names in zip(zip(*found, strict=True), b.column(2)[lo:hi].to_pylist(), strict=True)]
                at = [i for i, x in enumerate(have) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([have[i] for i in at], pa.int64()), pa.array([sets[i].tobytes() for i in at], pa.binary())], ["id", "items"])

    return map_arrow(docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "names"), run, "id long, items binary").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, group: int = 64) -> DataFrame:
    """Those pairs (a, b) with 100 * intersection >= percent * union. A set travels once for each group of its partners, not for each pair."""
    pairs = stored(pairs, "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    salted = pairs.join(groups, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = salted.join(sets, salted.b == sets.id).select("a", "part", "b", "items")
    left = salted.select("a", "part").distinct().join(sets, F.col("a") == sets.id).select("a", "part", F.lit(None).cast("long").alias("b"), "items")
    together = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        mine = np.zeros(0, _U)
        for batch in batches:
            a, b = [], []
            for x, y, items in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                other = np.frombuffer(items.as_buffer(), _U)
                if y is None:
                    mine = other
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stored(map_arrow(together, run, "a long, b long"), "links")


def _split(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """(band, rep, n, c) of the buckets whose members are in more than one component c so far."""
    now = buckets.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
    several = now.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("band")
    return now.join(several, "band", "left_semi")


def _shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, item) of each shingle of the members' sets."""

    def each(batches):
        for b in batches:
            sizes = [v.as_buffer().size // 8 for v in b.column(1)]
            flat = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in b.column(1)]) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(flat)], ["rep", "item"])

    return map_arrow(sets.join(members, sets.id == members.rep, "left_semi").select("id", "items"), each, "rep long, item long")


def _may_link(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, meets): members of split buckets that could still link with one another, and how many of their shingles some other of them has.

    Shingles that no other of these sets has lie outside every intersection, so an intersection has at most the lesser
    `meets` of its two sets, and the union at least the sum of their sizes less that. Heavily edited copies, which share
    buckets with all others of their group, are so told apart from them without a comparison of sets.
    """
    members = split.select("rep", "n").distinct()
    items = _shingles(members, sets)
    alone = items.groupBy("item").agg(F.count("*").alias("df"), F.min("rep").alias("rep")).where("df = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    left = members.join(alone, "rep", "left").withColumn("meets", F.col("n") - F.coalesce("alone", F.lit(0))).where(100 * F.col("meets") >= percent * F.col("n"))
    return stored(left.select("rep", "meets"), "open")


def _meeting(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, n, c) in different components c that can link, a superset of those that do.

    Shingles are put in one order for all sets, rarest first. Sets that link have their first common shingle among the
    first n - ceil(percent * n / 100) + 1 of either, and no more in common than what follows it in the shorter rest.
    """
    items = _shingles(apart, sets)
    common = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    rare = items.join(common, "item").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("rare"))
    first = apart.join(rare, "rep").withColumn("alone", (F.col("n") - F.size("rare")).cast("int"))
    room = F.floor((100 - percent) * F.col("n") / 100).cast("int") + 1 - F.col("alone")
    first = first.where(room > 0).select("rep", "n", "c", "alone", F.posexplode(F.slice("rare", F.lit(1), room)))
    first = stored(first.select("rep", "n", "c", (F.col("n") - F.col("alone") - F.col("pos")).alias("rest"), F.col("col.item").alias("item")), "prefixes")
    several = first.groupBy("item").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("item")
    x = first.join(several, "item", "left_semi")
    y = x.select("item", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("rest").alias("rest2"))
    most = F.least("rest", "rest2")
    return x.join(y, (x.item == y.item) & (x.rep < y.rep2) & (x.c != y.c2) & (100 * most >= percent * (x.n + y.n2 - most))).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))


def _apart(one: DataFrame, named: DataFrame) -> DataFrame:
    """The sets one, each with a rep of its own: where a document stands for several sets, each gets a number outside the range of doc_id."""
    span = named.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    number = F.monotonically_increasing_id()
    if span.low > -(1 << 62):
        number = F.lit(span.low - 1) - number
    elif span.high < 1 << 62:
        number = F.lit(span.high + 1) + number
    else:
        raise ValueError("doc_id leaves no numbers for documents with several texts")
    shared = one.groupBy("rep").agg(F.count("*").alias("sets")).where("sets > 1").drop("sets").withColumn("shared", F.lit(True))
    return stored(one.join(shared, "rep", "left").withColumn("rep", F.when(F.col("shared"), number).otherwise(F.col("rep"))).drop("shared"), "apart")


def near_duplicates(docs: DataFrame, percent: int = 85, words_each: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Equal sets count as one. Candidates share a band. To link a bucket of any size without all its pairs, a round
    compares its members with one leader and merges what is linked; members whose shingles alone show that they link with none
    go; another leader takes its turn; then members of buckets that still hold different components are compared with
    all that they share one of their rarest shingles with, which leaves out no link. So a link can be missed only if it shares no band (for a similarity of 0.85 a chance of about 8e-7) or if
    its ends are joined anyway. All comparisons are on full sets.
    Null, empty and blank texts: n_shingles 0, linked with nothing. Fewer words than a shingle: the sequence is the
    set. Rows with the same doc_id are one node, with the sets of all their texts; n_shingles is each row's own; a null doc_id is linked with nothing and its component is null. No rows:
    no rows. Extra columns are left out.
    """
    known = stored(_sketches(docs, words_each), "sketches")
    named = known.where("n > 0 and doc_id is not null")
    one = stored(named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "sets")
    several = stored(named.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("x"), F.max(F.struct("d1", "d2", "n")).alias("y")).where("x <> y").select("doc_id"), "several")
    torn = not several.isEmpty()
    one = one.withColumn("doc_id", F.col("rep"))
    if torn:
        one = _apart(one, named)
    placed = one.select("rep", "n", F.explode("bands").alias("band"))
    full = placed.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("leader"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(placed.join(full, "band").select("band", "rep", "n", F.col("leader.rep").alias("leader"), F.col("leader.n").alias("leader_n")), "buckets")
    wanted = one.join(buckets.select("rep").distinct(), "rep", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("rep").alias("id"), "d1", "d2")).alias("names"))
    sets = stored(_sets(docs, wanted, words_each), "items")
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    links = _verified(buckets.where((F.col("leader") != F.col("rep")) & alike(F.col("n"), F.col("leader_n"))).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), sets, percent)
    if torn:  # one document with several sets ties them
        of = named.join(several, "doc_id").join(one.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select("doc_id", "rep").distinct()
        ties = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
        links = links.union(stored(ties, "ties"))
    joined = components(links)
    open_ones = _may_link(_split(buckets, joined), sets, percent)
    for last in (False, True):
        now = _split(buckets, joined).join(open_ones, "rep")
        if last:
            pairs = _meeting(stored(now.select("rep", "n", "c").distinct(), "apart"), sets, percent)
        else:
            lead = now.groupBy("band").agg(F.max_by(F.struct("rep", "n", "c"), F.xxhash64("rep")).alias("lead"))
            pairs = now.join(lead, "band").where((F.col("c") != F.col("lead.c")) & alike(F.col("n"), F.col("lead.n"))).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
        links = links.union(_verified(pairs.distinct(), sets, percent))
        joined = components(links)
    names = one.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = known.join(names, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("c"))
    if torn:  # names that are no doc_id: the smallest doc_id of the component instead
        least = out.where("doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
        out = out.join(least, "c", "left").select("doc_id", "n_shingles", F.col("least").alias("c"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))
    discard(sets, buckets, open_ones)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
