"""Scanning a tree: files to findings, and the findings as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duplet.config import Config
from duplet.operators import blocks, clones, vocab
from duplet.sources.registry import EXTENSIONS
from duplet.syntax.provider import provider

UNIT = "struct<qualname: string, start_line: long, end_line: long, n_tokens: int, tokens: array<string>>"


def parse(files: DataFrame, min_nodes: int) -> DataFrame:
    """One row a file, parsed once: units, tokens with their lines, identifiers, had_syntax_errors."""

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("qualname", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.string()))])
        for b in batches:
            got = [provider(lang).extract(text, lang, min_nodes) for lang, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            units = [[{"qualname": u.qualname, "start_line": u.start_line, "end_line": u.end_line, "n_tokens": len(u.tokens), "tokens": u.tokens} for u in x.units] for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(units, pa.list_(kind)), pa.array([[t for t, _ in x.tokens] for x in got], pa.list_(pa.string())), pa.array([[n for _, n in x.tokens] for x in got], pa.list_(pa.int32())), pa.array([x.identifiers for x in got], pa.list_(pa.string())), pa.array([x.had_syntax_errors for x in got])], ["path", "path_parts", "language", "text", "units", "tokens", "lines", "identifiers", "had_syntax_errors"])

    return files.select("path", "path_parts", "language", "text").mapInArrow(run, f"path string, path_parts array<string>, language string, text string, units array<{UNIT}>, tokens array<string>, lines array<int>, identifiers array<string>, had_syntax_errors boolean")


def scan(spark: SparkSession, files: DataFrame, config: Config | None = None) -> dict:
    """{"clones", "vocab", "blocks"} as DataFrames, with "files_scanned", "units_considered" and "files_with_syntax_errors"."""
    from duplet.functions.text import content_hash

    config = config or Config()
    parsed = parse(files, config.function.min_nodes).persist()
    units = parsed.select("path", "path_parts", F.posexplode("units").alias("unit_ord", "u")).select("path", "path_parts", F.col("unit_ord").cast("long").alias("unit_ord"), "u.*").withColumn("hash", content_hash(F.col("tokens")))
    noise = [(lang, n) for lang, names in config.vocab.noise.items() for n in names]
    names = vocab.vocabulary(parsed.select("path", "path_parts", "language", F.explode("identifiers").alias("name")), spark.createDataFrame(noise, "language string, name string") if noise else None)
    inbound = vocab.inbound_imports(parsed.select("path", "text"), EXTENSIONS)
    return {
        "clones": clones.find_clones(units, config.function.min_similarity),
        "vocab": vocab.find_vocab_pairs(names, inbound, config.vocab.min_overlap, config.vocab.min_vocabulary),
        "blocks": blocks.find_blocks(parsed.select("path", "path_parts", "tokens", "lines"), config.blocks.min_tokens),
        "files_scanned": parsed.count(),
        "units_considered": units.count(),
        "files_with_syntax_errors": sorted({r.path for r in parsed.where("had_syntax_errors").select("path").distinct().collect()}),
    }
