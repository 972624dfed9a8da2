"""New documents against what is known already, batch by batch with Structured Streaming.

This is the keyed anti-join of a delta, kept up to date: each micro-batch is held against the
table of content hashes seen before, exact copies are written out with the first path that had the hash, and new hashes
are appended. A batch that is repeated after a failure gives the same rows: its own earlier entries are known by batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duplet.functions.text import content_hash, prose_tokens

KNOWN = "hash string, path string, batch long"


def copies(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(path, hash, first): rows of batch (path, hash) whose hash is known, or that another row of the batch had before."""
    earlier = known.groupBy("hash").agg(F.min_by("path", F.struct("batch", "path")).alias("known"))
    mine = batch.groupBy("hash").agg(F.min("path").alias("own"))
    first = batch.join(mine, "hash").join(earlier, "hash", "left").withColumn("first", F.coalesce("known", "own"))
    return first.where("path <> first").select("path", "hash", "first")


def watch(spark: SparkSession, stream: DataFrame, known_path: str, out_path: str, checkpoint: str, min_tokens: int = 40) -> StreamingQuery:
    """stream: (path, text). Writes copies as Parquet to out_path/batch=n; known_path holds the hashes."""
    tokens = prose_tokens(F.col("text"))
    hashed = stream.where(F.size(tokens) >= min_tokens).select("path", content_hash(tokens).alias("hash"))

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        known = spark.read.schema(KNOWN).parquet(known_path).where(F.col("batch") < n)
        copies(batch, known).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        fresh = batch.join(known, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path"))
        fresh.withColumn("batch", F.lit(n).cast("long")).select("hash", "path", "batch").write.mode("overwrite").parquet(f"{known_path}/n={n}")
        batch.unpersist()

    spark.createDataFrame([], KNOWN).write.mode("ignore").parquet(f"{known_path}/n=-1")
    return hashed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
