"""What a head report has that its base has not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.operators import blocks as blocks_op
from duplet.operators import clones as clones_op
from duplet.operators import vocab as vocab_op

NEW, UNREFERENCED, WORSENED = "new", "became_unreferenced", "worsened"


def new_clones(head: DataFrame, base: DataFrame, min_similarity: float = 0.85) -> DataFrame:
    """Head pairs at min_similarity or above whose sorted hashes are no base pair's. Base pairs count whatever their similarity."""
    key = clones_op.clone_key()
    known = base.select(*key).distinct()
    return head.where(F.col("similarity") >= min_similarity).withColumns({"k1": key[0], "k2": key[1]}).join(known, ["k1", "k2"], "left_anti").drop("k1", "k2")


def new_blocks(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head pairs whose hash and sorted files are no base pair's: moving a block to another file makes it new, moving it in its file does not."""
    names = ["key_hash", "k1", "k2"]
    known = base.select(*(c.alias(n) for c, n in zip(blocks_op.block_key(), names, strict=True))).distinct()
    return head.withColumns(dict(zip(names, blocks_op.block_key(), strict=True))).join(known, names, "left_anti").drop(*names)


def vocab_changes(head: DataFrame, base: DataFrame, worsened_delta: float = 0.05) -> DataFrame:
    """Head pairs with what changed: new, became_unreferenced (a side lost its last importer) or worsened (overlap grew by more than worsened_delta); others are left out."""
    key = lambda d: d.withColumns({"k1": F.least("a", "b"), "k2": F.greatest("a", "b")})
    known = key(base).groupBy("k1", "k2").agg(F.max("overlap").alias("base_overlap"), F.max("zero_inbound").alias("base_zero"))
    both = key(head).join(known, ["k1", "k2"], "left")
    grew = F.col("overlap") > F.col("base_overlap") + F.lit(worsened_delta)
    change = F.when(F.col("base_overlap").isNull(), NEW).when(F.col("zero_inbound") & ~F.col("base_zero"), UNREFERENCED).when(grew, WORSENED)
    found = both.withColumn("change", change).where("change is not null")
    worse = F.col("change") == WORSENED
    return found.select("change", F.when(worse, F.col("base_overlap")).alias("from_overlap"), F.when(worse, F.col("overlap")).alias("to_overlap"), *head.columns)


@dataclass(frozen=True)
class Delta:
    """The three categories, each in report order and under the cap, and how many the cap withheld in all."""

    new_clones: DataFrame
    vocab: DataFrame
    new_blocks: DataFrame
    withheld: int

    def finding_count(self) -> int:
        return sum(d.count() for d in (self.new_clones, self.vocab, self.new_blocks))

    def is_empty(self) -> bool:
        return all(d.isEmpty() for d in (self.new_clones, self.vocab, self.new_blocks))


def truncate(found: DataFrame, most: int | None) -> tuple[DataFrame, int]:
    """The first `most` rows in their order, and how many others there are; None: all, 0: none."""
    if most is None:
        return found, 0
    return found.limit(most), max(0, found.count() - most)


def compute(head: dict[str, DataFrame], base: dict[str, DataFrame], min_similarity: float = 0.85, worsened_delta: float = 0.05, max_findings: int | None = None) -> Delta:
    """Of reports as {"clones", "vocab", "blocks"}. The cap holds for each category; withheld is the sum."""
    parts = (
        truncate(clones_op.in_order(new_clones(head["clones"], base["clones"], min_similarity)), max_findings),
        truncate(vocab_op.in_order(vocab_changes(head["vocab"], base["vocab"], worsened_delta)), max_findings),
        truncate(blocks_op.in_order(new_blocks(head["blocks"], base["blocks"])), max_findings),
    )
    return Delta(*(p for p, _ in parts), sum(n for _, n in parts))
