"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duplet.llm import minhash, mixing, quality, sentencepiece_sampling, substring_dedup
from duplet.llm.common import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more. Learns from labelled rows outside the held-out fold. Null and empty texts score the bias alone, so all of them stay or all go, as it was fitted."""
    test = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~test)
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by shingles of five words at 0.8 or more. Texts without words and rows without a doc_id stay."""
    gone = minhash.near_duplicates(docs, percent=80, words_each=5).where("component_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that a repeated window of 35 words covers."""
    return substring_dedup.remove(docs, length=35)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 5, 2 and 1 in turn and share 150 % of all words."""
    return mixing.take(docs, (5.0, 2.0, 1.0), share=1.5, cap=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text. Copies that the mix made are alike."""
    return sentencepiece_sampling.encode(docs, k=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("source mix", mix_sources),
    ("segmentation", encode),
]
#: Stages learn, sketch and sample; SQL does not express them. tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
