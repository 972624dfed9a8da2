"""Embedding near-dedup by sorted projection passes.

Each pass draws random hyperplanes, orders a label's vectors lexicographically by the signs of their projections, and
compares each vector with the `window` before it. What travels is each vector in 16 bits a component with the length of what that leaves out, which
tells links for sure but for cosines next to the threshold; those pairs are verified on the vectors. The number of passes follows each label's size and how crowded its vectors
are, as measured on a sample, so that the chance to miss a pair at the threshold stays under `miss`. Equal vectors go as one. Pairs verified in any pass are united. Within the
components that result, links are then counted over all members, so a vector's number of links doesn't depend on the window.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.llm.common import components, discard, map_arrow, stored

BITS = 63
#: Components up to this many members are compared whole in one task; larger ones go by balls around pivots.
WHOLE = 512
#: Windows that a range of sorted vectors holds at least, on average: pairs across its ends are not compared in that pass.
WINDOWS = 256
PIVOTS = 32
#: Vectors of a label on which its crowding is measured, and passes that are under way at once.
SAMPLE = 1024
ROUND = 6
#: Angles nearer than this to a bound are compared by cosine.
MARGIN = 1e-7
#: More than a cosine of two unit vectors loses by rounding in double precision.
ROUNDING = 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of x as bytes: the step between values, the length of what rounding leaves out, 16 bits a component."""
    step = np.abs(x).max(axis=1, keepdims=True) / 32767
    whole = np.rint(x / step).astype(np.int16)
    left = np.linalg.norm(x - whole * step, axis=1, keepdims=True)
    data = np.concatenate([np.ascontiguousarray(v).view(np.uint8) for v in (step, left, whole)], axis=1)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data.ravel())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths of what they leave out) of rows of one number of dimensions."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)
    part = lambda v, kind: np.ascontiguousarray(v).view(kind)
    return part(data[:, 16:], np.int16) * part(data[:, :8], np.float64), part(data[:, 8:16], np.float64)[:, 0]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, x): distinct rows with a label, an id and a finite nonzero vector, as unit vectors in double precision."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes[sizes > 0]):
                b = batch.filter(pa.array(sizes == d))
                x = _matrix(b.column(2))  # a null component is not a number here
                top = np.abs(x).max(axis=1, keepdims=True)
                fine = np.isfinite(top[:, 0]) & (top[:, 0] > 0)
                x = x[fine] / top[fine]  # scaled first: squares of very large or small components stay finite
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                kept = b.filter(pa.array(fine))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(d))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(np.full(len(x), d, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["vec_id", "label", "dims", "x"])

    asked = vectors.where("vec_id is not null and label is not null and embedding is not null")
    asked = asked.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(asked, run, "vec_id long, label int, dims int, x array<double>").distinct()


def passes_for(largest: int, threshold: float, window: int, miss: float) -> int:
    """Passes until a pair at the threshold shares, but for chance `miss`, in one of them the leading bits that leave a window's worth of vectors."""
    alike = 1 - math.acos(threshold) / math.pi
    near = alike ** max(0.0, math.log2(max(largest, 1) / window) + 1)
    return max(4, math.ceil(math.log(miss) / math.log(1 - min(near, 1 - 1e-9))))


def passes_measured(x: np.ndarray, size: int, threshold: float, window: int, miss: float) -> int:
    """Passes for a label of `size` vectors of which x is a sample: a vector needs the leading bits that leave half a window of
    those it isn't linked with, as expected from its angles to the sample; the chance to miss is the mean over the sample."""
    cosines = np.clip(x @ x.T, -1, 1)
    each = np.where(cosines < threshold, 1 - np.arccos(cosines) / math.pi, 0.0)
    share, bits = (each > 0).astype(float), np.zeros(len(x))
    for _ in range(BITS):
        crowded = share.mean(axis=1) * size > (window if size <= window else window / 2)
        if not crowded.any():
            break
        bits += crowded
        share *= each
    apart = 1 - np.minimum((1 - math.acos(threshold) / math.pi) ** bits, 1 - 1e-9)
    low, high = 0, 1
    while (apart**high).mean() > miss:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if (apart**middle).mean() > miss else (low, middle)
    return max(high, passes_for(size, threshold, window, miss))


def _planned(rows: DataFrame, threshold: float, window: int, miss: float) -> DataFrame:
    """(label, dims, size, passes)."""
    sizes = rows.groupBy("label", "dims").agg(F.count("*").alias("size"))
    u = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)
    sampled = rows.join(F.broadcast(sizes), ["label", "dims"]).where(u * F.col("size") < SAMPLE).select("label", "dims", "size", "vec_id", "x")

    def run(t: pa.Table):
        n = passes_measured(_matrix(t.column("x")), t.column("size")[0].as_py(), threshold, window, miss)
        yield pa.RecordBatch.from_arrays([t.column("label").combine_chunks()[:1], t.column("dims").combine_chunks()[:1], t.column("size").combine_chunks()[:1], pa.array([n], pa.int32())], ["label", "dims", "size", "passes"])

    return stored(_grouped(sampled, ["label", "dims"], ["vec_id"], run, "label int, dims int, size long, passes int"), "passes")


def _alike(rows: DataFrame) -> DataFrame:
    """rows with `first`, the least vec_id of those of its label with an equal vector."""
    keyed = rows.withColumn("h", F.xxhash64("x")).withColumn("k", F.xxhash64(F.lit(1), "x"))
    many = keyed.groupBy("label", "dims", "h", "k").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(many, ["label", "dims", "h", "k"], "left").select("vec_id", "label", "dims", "x", F.coalesce("first", "vec_id").alias("first"))


def _found(rows: DataFrame, keys: int, threshold: float, begin: int, end: int, window: int, seed: int) -> DataFrame:
    """(a, b, sure) of passes begin to end, which give that many keys, as far as a row's label has them: for each window, links
    that join what its sure pairs join, and the pairs between what these leave apart whose cosine is too near the threshold to tell."""

    def project(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            sizes, passes = batch.column(2).value_lengths().to_numpy(), batch.column(3).to_numpy()
            for d in np.unique(sizes):
                for p in range(begin, min(end, int(passes[sizes == d].max()))):
                    b = batch.filter(pa.array((sizes == d) & (passes > p)))
                    if not len(b):
                        continue
                    x = _matrix(b.column(2))
                    key = (int(d), p)
                    if key not in planes:
                        planes[key] = np.random.default_rng((seed, p, int(d))).standard_normal((int(d), BITS))
                    bits = (x @ planes[key] > 0).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), b.column(1), pa.array(np.full(len(x), d, np.int32)), pa.array(bits @ (1 << np.arange(BITS - 1, -1, -1))), b.column(0), _packed(x)], ["pass", "label", "dims", "key", "vec_id", "x"])

    def compare(batches):
        tail = None  # the last rows before this batch: (pass, label, dims), ids, vectors, what they leave out
        for b in batches:
            group = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            a, z, sure = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                name = tuple(group[lo].tolist())
                ids, (x, left) = b.column(4)[lo:hi].to_numpy(zero_copy_only=False), _unpacked(b.column(5)[lo:hi])
                if tail is not None and tail[0] == name:
                    ids, x, left = (np.concatenate(v) for v in zip(tail[1:], (ids, x, left), strict=True))
                for start in range(0, len(ids), window):
                    part = slice(max(0, start - window), start + window)
                    cosine, e = x[part] @ x[part].T, left[part]
                    error = e[:, None] + (1 + e[:, None]) * e[None, :] + ROUNDING
                    place = np.arange(len(cosine))
                    close = np.abs(place[:, None] - place[None, :]) <= window
                    near = close & (cosine >= threshold + error)
                    root = place.copy()
                    while True:
                        lower = np.where(near, root[None, :], len(place)).min(axis=1)
                        lower = np.minimum(root, lower)[np.minimum(root, lower)]
                        if (lower == root).all():
                            break
                        root = lower
                    far = np.flatnonzero(root != place)
                    one, other = np.nonzero(np.triu(close & ~near & (cosine >= threshold - error) & (root[:, None] != root[None, :]), 1))
                    a += [ids[part][root[far]], ids[part][one]]
                    z += [ids[part][far], ids[part][other]]
                    sure += [np.ones(len(far), bool), np.zeros(len(one), bool)]
                tail = (name, ids[-window:], x[-window:], left[-window:])
            join = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([join(a), join(z), pa.array(np.concatenate(sure) if sure else np.zeros(0, bool))], ["a", "b", "sure"])

    keyed = map_arrow(rows, project, "pass int, label int, dims int, key long, vec_id long, x binary")
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys // (WINDOWS * window)))
    order = ["pass", "label", "dims", "key", "vec_id"]
    return map_arrow(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order), compare, "a long, b long, sure boolean").where("a <> b").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) that reach the threshold within a label."""
    a, b = (rows.select(F.col("vec_id").alias(s), "label", F.size("x").alias("dims"), F.col("x").alias(f"x{s}")) for s in "ab")
    cosine = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(a, "a").join(b, ["b", "label", "dims"]).where(cosine >= threshold).select("a", "b")


def _grouped(rows: DataFrame, keys: list[str], then: list[str], run, fields: str) -> DataFrame:
    """run(rows of one group as an Arrow table) for each group of keys, streamed in order."""

    def stream(batches):
        held: list[pa.RecordBatch] = []
        name = None
        for b in batches:
            values = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True))
            at = 0
            for k, g in groupby(values):
                n = len(list(g))
                if k != name and held:
                    yield from run(pa.Table.from_batches(held).combine_chunks())
                    held = []
                name = k
                held.append(b.slice(at, n))
                at += n
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    together = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *then)
    return map_arrow(together, stream, fields)


def _counts_whole(members: DataFrame, threshold: float) -> DataFrame:
    def run(t: pa.Table):
        ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("x"))
        linked = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked.sum(axis=1).astype(np.int64))], ["vec_id", "n"])

    return _grouped(members.select("component", "label", "dims", "vec_id", "x"), ["component", "label", "dims"], ["vec_id"], run, "vec_id long, n long")


def _counts_by_balls(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Links within large components. Every member goes to the ball of its nearest pivot (some PIVOTS a component, by hash); by the
    triangle inequality of angles a member is linked with all of a ball, with none of it, or, if neither is sure, is compared
    with the ball's members in blocks."""
    limit = math.acos(threshold)
    sized = members.join(sizes, ["component", "label", "dims"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / WHOLE)).cast("int"))
    u = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = sized.where(u < F.lit(2.0 * PIVOTS) / F.col("size")).groupBy("component", "label", "dims").agg(F.slice(F.sort_array(F.collect_list(F.struct(u.alias("u"), "vec_id", "x"))), 1, PIVOTS)["x"].alias("pivots"))
    parts = sized.select("component", "label", "dims", "part").distinct().join(chosen, ["component", "label", "dims"])
    blank = lambda kind: F.lit(None).cast(kind)
    rows = parts.select("component", "label", "dims", "part", F.lit(0).alias("role"), blank("long").alias("vec_id"), F.flatten("pivots").alias("x")).union(sized.select("component", "label", "dims", "part", F.lit(1), "vec_id", "x"))

    def place(t: pa.Table):
        d = t.column("dims")[0].as_py()
        pivots = np.array(t.column("x")[0].as_py()).reshape(-1, d)
        own = t.slice(1)
        angle = np.arccos(np.clip(_matrix(own.column("x")) @ pivots.T, -1, 1))
        ball = angle.argmin(axis=1).astype(np.int32)
        n = len(own)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(pivots), pa.int32()), pa.array(angle.ravel()))
        fixed = [own.column(i).combine_chunks() for i in (0, 1, 2, 3)]
        yield pa.RecordBatch.from_arrays([*fixed, own.column("vec_id").combine_chunks(), pa.array(ball), pa.array(angle.min(axis=1)), flat, own.column("x").combine_chunks()], ["component", "label", "dims", "part", "vec_id", "ball", "radius", "angles", "x"])

    placed = stored(_grouped(rows, ["component", "label", "dims", "part"], ["role", "vec_id"], place, "component long, label int, dims int, part int, vec_id long, ball int, radius double, angles array<double>, x array<double>"), "balls")
    balls = stored(placed.groupBy("component", "label", "dims", "ball").agg(F.count("*").alias("members"), F.max("radius").alias("reach")), "reach")
    facts = balls.groupBy("component", "label", "dims").agg(F.collect_list(F.struct("ball", "members", "reach")).alias("balls"))
    known = placed.join(facts, ["component", "label", "dims"]).withColumn("of", F.explode("balls")).withColumn("angle", F.element_at("angles", F.col("of.ball") + 1))
    sure = known.withColumn("all", F.col("angle") + F.col("of.reach") <= limit - MARGIN).withColumn("none", F.col("angle") - F.col("of.reach") > limit + MARGIN)
    by_ball = sure.where("all").select("vec_id", (F.col("of.members") - (F.col("of.ball") == F.col("ball")).cast("int")).alias("n"))
    block = lambda of: F.ceil(F.col(of) / WHOLE).cast("int")
    asks = sure.where("not all and not none").select("component", "label", "dims", F.col("of.ball").alias("ball"), F.explode(F.sequence(F.lit(0), block("of.members") - 1)).alias("part"), F.lit(1).alias("role"), "vec_id", "x")
    holds = placed.join(balls.select("component", "label", "dims", "ball", "members"), ["component", "label", "dims", "ball"]).select("component", "label", "dims", "ball", F.pmod(F.xxhash64("vec_id"), block("members")).cast("int").alias("part"), F.lit(0).alias("role"), "vec_id", "x")
    wanted = asks.select("component", "label", "dims", "ball", "part").distinct()
    holds = holds.join(wanted, ["component", "label", "dims", "ball", "part"], "left_semi").select(*asks.columns)

    def compare(t: pa.Table):
        role = t.column("role").to_numpy()
        ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("x"))
        left, right = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        for at in range(0, len(left), WHOLE):
            q = left[at : at + WHOLE]
            linked = (x[q] @ x[right].T >= threshold) & (ids[q][:, None] != ids[right][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(linked.sum(axis=1).astype(np.int64))], ["vec_id", "n"])

    asked = asks.withColumn("turn", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(64)).cast("int"))
    held = holds.join(asked.select("component", "label", "dims", "ball", "part", "turn").distinct(), ["component", "label", "dims", "ball", "part"]).select(*asked.columns)
    by_member = _grouped(held.union(asked), ["component", "label", "dims", "ball", "part", "turn"], ["role", "vec_id"], compare, "vec_id long, n long")
    return by_ball.union(by_member)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, window: int = 128, miss: float = 0.005, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links hold within a label at a cosine of threshold or more.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components: no links. A null vec_id: no
    links, component null, not kept. Vectors of different lengths are not compared. Rows that repeat whole count once;
    rows that share a vec_id are one node and share its links. No rows: no rows. Extra columns are left out.
    """
    fine = stored(usable(vectors), "vectors")
    rows = stored(_alike(fine), "firsts")
    discard(fine)
    one = rows.where("vec_id = first").select("vec_id", "label", "dims", "x")
    plan = _planned(one, threshold, window, miss)
    most = plan.agg(F.max("passes").alias("n")).first().n or 0
    one = one.join(F.broadcast(plan.drop("size")), ["label", "dims"]).select("vec_id", "label", "x", "passes")
    links = rows.where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    unsure = None
    for begin in range(0, most, ROUND):
        keys = plan.agg(F.sum(F.col("size") * F.greatest(F.lit(0), F.least("passes", F.lit(begin + ROUND)) - begin)).alias("n")).first().n
        found = stored(_found(one, keys, threshold, begin, begin + ROUND, window, seed), "found")
        links = links.union(found.where("sure").select("a", "b"))
        unsure = found if unsure is None else unsure.union(found)
    if unsure is not None:
        pairs = stored(unsure.where("not sure").select("a", "b").distinct(), "unsure")  # its true size decides on the join
        if not pairs.isEmpty():
            links = links.union(_verified(pairs, one, threshold))
    joined = components(links)
    rows = rows.drop("first", "dims")
    # a node belongs to one component; its label keeps vectors of other labels that share an id apart
    members = rows.join(joined.withColumnsRenamed({"id": "vec_id"}), "vec_id").withColumn("dims", F.size("x"))
    sizes = stored(members.groupBy("component", "label", "dims").agg(F.count("*").alias("size")), "sizes")
    small = members.join(sizes.where(F.col("size") <= WHOLE), ["component", "label", "dims"], "left_semi")
    large = sizes.where(F.col("size") > WHOLE)
    counted = _counts_whole(small, threshold)
    if not large.isEmpty():
        counted = counted.union(_counts_by_balls(members.join(large, ["component", "label", "dims"], "left_semi"), large, threshold))
    links = counted.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = vectors.select("vec_id").join(links, "vec_id", "left").join(joined.withColumnsRenamed({"id": "vec_id"}), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
