"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duplet.llm.common import n_words, unused


ADDED = ("size", "source_size", "target", "rate", "copies")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:key); SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds target to (source, source_size): the water level at which shares by weight, none above cap times its source, add up to share of all.

    Sources are ranked by code point, null last, and weigh weights in turn. The level is closed form: in order of
    cap / weight, a source is full if the level that its successors would need is above its own.
    """
    if share > cap:
        raise ValueError("share must not exceed cap: no mix can reach it")
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy((limit / F.col("weight")).asc(), F.col("rank").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= limit)
    first = F.min(F.when(F.col("open"), F.struct(limit / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return found.withColumn("target", F.when(limit > 0, F.least(limit, F.coalesce(first * F.col("weight"), limit))).otherwise(F.lit(0.0))).select("source", "source_size", "rank", "weight", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, rate and copies: how often the mix takes each document.

    rate = target / source_size; a document is taken floor(rate) times plus one Bernoulli copy whose probability is the
    rest, drawn from a hash of seed and doc_id, so reruns agree and rows with the same doc_id fare alike.
    Null or empty text: size 0. Null source: a source of its own, last. A source without words: target 0. No rows: no
    rows. Other columns pass; any named like those added are replaced. Only the table of sources (one row each) is
    ranked in one task; documents are pre-aggregated by source and never sorted.
    """
    base = docs.drop(*ADDED).withColumn("size", n_words(F.col("text")))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = unused(base.columns, "of_source")
    known = targets(sources, weights, share, cap).select(F.col("source").alias(name), "source_size", "target", (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).alias("rate"))
    joined = base.join(known, F.col("source").eqNullSafe(F.col(name)), "left").drop(name)
    whole = F.floor("rate")
    extra = (uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", F.least(whole + extra, F.lit(int(cap)).cast("long")))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, with copy (0-based), which replaces a column of that name.

    Rows of mix() with copies 0 or null go. Repeated rows: each by itself. No rows: no rows. Other columns pass.
    """
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))


def take(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs only, those named like what mix() and emit() add among them."""
    names = list(docs.columns)
    for i, c in enumerate(names):
        if c.lower() in (*ADDED, "copy"):
            names[i] = unused([*names, *ADDED, "copy"], c)
    return emit(mix(docs.toDF(*names), weights, share, cap, seed)).select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)))
