"""What several operators share: word hashes over Arrow buffers, tables in the shared folder, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that one numpy step works on; documents longer than this go through alone.
CHUNK_BYTES = 1 << 19
#: Bytes that one Arrow batch brings to a worker; a longer row goes alone.
BATCH_BYTES = 1 << 22

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_text(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see. Only a session on one machine, as in tests, may do without the setting: it gets a folder there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/duplet-checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, survives a lost executor. The table goes with discard(), or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/duplet/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    spark.sparkContext._jvm.System.gc()  # lets Spark drop shuffle files of the finished job
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes what stored() wrote for each frame; none may be read again."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def powers(n: int, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U))]) for b in (base, inverse))
        _powers[base] = have
    return have


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[starts[i]:ends[i]] for each i, from one prefix sum."""
    up, down = powers(len(values) + 1, base)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts: hash, byte span and, by text, the range of words."""

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        self.data = data
        n = len(data)
        solid = ~gaps[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | cut[1:n]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | cut[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = run_hashes(data.astype(_U) + _U(1), self.start, self.end, int(_BASE)) if len(self.start) else np.zeros(0, _U)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, offsets) for parts of a string column; nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable. Min labels spread by joins and pointers are halved each round."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = stored(step.join(jump, "component", "left").select("id", F.least("component", "further").alias("component"), (F.least("component", "further") < F.col("was")).alias("moved")), "labels")
        discard(labels)
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(both)
    return labels


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: str | StructType, rows: int = 1000) -> DataFrame:
    """df.mapInArrow(run, fields) with batches of that many rows and BATCH_BYTES at most, however long the texts. Workers give memory back when a task ends.

    Frames are lazy, so the two settings of the session must hold until the caller acts: they are only ever lowered, and stay so.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)

    def freed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim is not None:
            trim(0)

    return df.mapInArrow(freed, fields)


def unused(columns: Iterable[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_row(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
