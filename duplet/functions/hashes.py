"""64-bit hashes of token runs over Arrow buffers, many at once, and a bit map of fixed size for what occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between the tokens of a packed sequence; content_hash() has it after each.
SEPARATOR = "\x1f"
#: Bytes that one numpy step works on; a longer sequence goes alone.
CHUNK_BYTES = 1 << 19
#: Bits of a bit map, a power of two.
BITS = 1 << 27

_U = np.uint64
_TOKEN, _RUN, _LENGTH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, _U(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _powers_of(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U))]) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = have
    return have


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _RUN) -> np.ndarray:
    """A 64-bit hash of values[starts[i]:ends[i]] for each i, from one prefix sum."""
    up, down = _powers_of(len(values) + 1, base)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U) * _LENGTH)


class Packed:
    """Tokens of packed sequences: hash; byte span in data; row; first: of each row, the place of its first token."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        gap = np.flatnonzero(data == ord(SEPARATOR))
        full = offsets[1:] > offsets[:-1]
        self.start = np.sort(np.concatenate([gap + 1, offsets[:-1][full]]))
        self.end = np.sort(np.concatenate([gap, offsets[1:][full]]))
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = run_hashes(data.astype(_U) + _U(1), self.start, self.end, _TOKEN)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, Packed]]:
    """(first row, row after the last, tokens) for parts of a column of packed sequences."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, stop, Packed(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i that has so many."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[: len(values) - reach], values[reach:])
        reach *= 2
    more = width - reach
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def bit_map(found: DataFrame, name: str) -> Broadcast:
    """BITS bits on every machine: those of the longs in column `name`, by their low bits. What it lacks is not among them."""
    at = F.col(name).bitwiseAND(F.lit(BITS - 1))
    words = found.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = words.selectExpr("word", "shiftleft(one, bit) AS bits").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return found.sparkSession.sparkContext.broadcast(out.view(_U))


def has_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(_U) & _U(BITS - 1)
    return (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1
