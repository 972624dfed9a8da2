"""The prose profile: the driver's tables as a tree of files, so that the detectors run on them.

A document is a file with one unit: its path is source/number, its language is lang, a token is a lower-case run of letters and
digits with numbers abstracted to NUM. There is no renaming of identifiers, and the vocabulary is the set of words.

Snapshots: "base" has the documents; for deltas, "old" has those that the table of labels knows, the older part of the corpus,
and "head" has all documents and, as a second source, the benchmark's texts.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duplet.functions.hashes import SEPARATOR
from duplet.functions.text import TOKEN, content_hash, prose_lines, prose_tokens
from duplet.operators.storage import map_arrow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(texts: DataFrame) -> DataFrame:
    """texts, dealt out evenly if the session has more cores than they have splits: small tables come as one."""
    return texts.repartition("path") if texts.rdd.getNumPartitions() < texts.sparkSession.sparkContext.defaultParallelism else texts


def _path(source, number):
    return F.concat(source, F.lit("/"), F.lpad(number.cast("string"), 8, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(_path(F.coalesce("source", F.lit("none")), F.col("doc_id")).alias("path"), F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("unit_ord"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(_path(F.lit("benchmark"), F.col("item_id")).alias("path"), F.lit("und").alias("language"), F.coalesce("text", F.lit("")).alias("text"), F.col("item_id").alias("unit_ord"))


def _texts(spark: SparkSession, sf_dir: str, snapshot: str) -> DataFrame:
    base = documents(spark, sf_dir)
    if snapshot == "old":
        base = base.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_ord")), "unit_ord", "left_semi").select(*base.columns)
    return base.union(benchmark(spark, sf_dir)) if snapshot == "head" else base


def files(spark: SparkSession, sf_dir: str, snapshot: str = "base") -> DataFrame:
    """(path, path_parts, language, text, unit_ord, tokens, n_tokens). Dealt out evenly: small tables come as one split."""
    both = _texts(spark, sf_dir, snapshot)
    tokens = both.withColumn("path_parts", F.split("path", "/")).withColumn("tokens", prose_tokens(F.col("text")))
    return tokens.withColumn("n_tokens", F.size("tokens")).repartition("path")


def packed(spark: SparkSession, sf_dir: str, snapshot: str = "base") -> DataFrame:
    """blocks.packed(file_tokens()) of the base or the head, from one search of each text: for tokens and line ends."""
    both = documents(spark, sf_dir)
    both = spread(both.union(benchmark(spark, sf_dir)) if snapshot == "head" else both).where("path is not null")
    found = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(rf"{TOKEN}|\n"), F.lit(0)), SEPARATOR)
    numbers = rf"(?<![^{SEPARATOR}\n])[0-9]+(?![^{SEPARATOR}\n])"
    marked = both.select(F.array_join(F.split("path", "/"), "\x00").alias("key"), "path", F.regexp_replace(found, numbers, "NUM").alias("marked"))

    def run(batches):
        for batch in batches:
            tokens, lines = [], []
            for x in batch.column(2).to_pylist():
                each = [line.strip(SEPARATOR) for line in x.split("\n")]
                tokens.append(SEPARATOR.join(filter(None, each)))
                lines.append(np.repeat(np.arange(1, len(each) + 1, dtype=np.int32), [line.count(SEPARATOR) + 1 if line else 0 for line in each]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.string()), pa.array(lines, pa.list_(pa.int32()))], ["key", "path", "tokens", "lines"])

    return map_arrow(marked, run, "key string, path string, tokens string, lines array<int>")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key) of the old snapshot's files, as packed() has them."""
    old = documents(spark, sf_dir).select("path", "unit_ord").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_ord")), "unit_ord", "left_semi")
    return old.select(F.array_join(F.split("path", "/"), "\x00").alias("key"))


def file_tokens(spark: SparkSession, sf_dir: str, snapshot: str = "base") -> DataFrame:
    return files(spark, sf_dir, snapshot).withColumn("lines", prose_lines(F.col("text"))).select("path", "path_parts", "tokens", "lines")


def identifiers(spark: SparkSession, sf_dir: str, snapshot: str = "base") -> DataFrame:
    return files(spark, sf_dir, snapshot).select("path", "path_parts", "language", F.explode("tokens").alias("name"))


#: What each character below 256 is in lower case, if it is a letter or a digit; else a space.
_LATIN = "".join(chr(i).lower() if unicodedata.category(chr(i))[0] in "LN" else " " for i in range(256)).encode("latin-1")


def latin_names(text: str) -> str:
    """The distinct prose_tokens() of a text without characters from 256 on, in order, with spaces between."""
    found = dict.fromkeys(text.encode("latin-1").translate(_LATIN).split())
    return b" ".join(dict.fromkeys(b"NUM" if x.isdigit() else x for x in found)).decode("latin-1")


def vocabularies(spark: SparkSession, sf_dir: str, snapshot: str = "base") -> DataFrame:
    """(path, path_parts, names): the distinct words of each file."""
    texts = spread(_texts(spark, sf_dir, snapshot)).where("path is not null").select("path", "text")
    if not texts.groupBy("path").count().where("count > 1").isEmpty():
        own = texts.select("path", F.split("path", "/").alias("path_parts"), F.array_distinct(prose_tokens(F.col("text"))).alias("names"))
        return own.groupBy("path", "path_parts").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    other = F.col("text").rlike(r"[^\x00-\xFF]")
    either = texts.select("path", F.when(~other, F.col("text")).alias("text"), F.when(other, F.array_join(F.array_distinct(prose_tokens(F.col("text"))), " ")).alias("names"))

    def run(batches):
        for batch in batches:
            names = [latin_names(x) if y is None else y for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            lists = pc.split_pattern(pa.array(names, pa.string()), " ")
            none = pc.equal(pa.array(names, pa.string()), "")
            if pc.any(none).as_py():
                lists = pc.if_else(none, pa.scalar([], lists.type), lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["path", "names"])

    return map_arrow(either, run, "path string, names array<string>").select("path", F.split("path", "/").alias("path_parts"), "names")


def vocabularies_since(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """vocabularies() of the head with `known`: whether the old snapshot has the file, as it is. None if it has some of a path's texts and not others."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_ord"), F.lit("base").alias("of")).distinct().withColumn("known", F.lit(True))
    both = spread(documents(spark, sf_dir).withColumn("of", F.lit("base")).union(benchmark(spark, sf_dir).withColumn("of", F.lit("added")))).where("path is not null")
    own = both.join(old, ["unit_ord", "of"], "left").select("path", F.split("path", "/").alias("path_parts"), F.array_distinct(prose_tokens(F.col("text"))).alias("names"), F.coalesce("known", F.lit(False)).alias("known"))
    again = own.groupBy("path").agg(F.count("*").alias("count"), F.count_if("known").alias("known")).where("count > 1")
    if again.isEmpty():
        return own
    if not again.where("known > 0 and known < count").isEmpty():
        return None
    return own.groupBy("path", "path_parts", "known").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))


def units(spark: SparkSession, sf_dir: str, snapshot: str = "base", min_nodes: int = 40) -> DataFrame:
    both = spread(_texts(spark, sf_dir, snapshot)).withColumn("path_parts", F.split("path", "/")).withColumn("tokens", prose_tokens(F.col("text")))
    f = both.withColumn("n_tokens", F.size("tokens")).where(F.col("n_tokens") >= min_nodes)
    return f.select("unit_ord", "path", "path_parts", F.element_at("path_parts", -1).alias("qualname"), F.lit(1).cast("long").alias("start_line"), F.size(F.split("text", "\n")).cast("long").alias("end_line"), "n_tokens", "tokens", content_hash(F.col("tokens")).alias("hash"))
