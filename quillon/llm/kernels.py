"""Vectorised byte kernels shared by the training-data operators.

They work on the UTF-8 buffer of an Arrow string column, a block of rows at a time, so that no Python object is made
for a word or a line. A block holds whole rows and about ``block`` bytes; one longer row makes a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 1 << 20
BATCH = 1 << 19
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def lut(member) -> np.ndarray:
    """A table over byte values: True where member(byte) holds."""
    return np.array([bool(member(b)) for b in range(256)])


#: ASCII white space: space and 9 to 13.
NOT_SPACE = lut(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Digits, letters a-z and every byte of a non-ASCII character (after lower-casing A-Z).
ALNUM = lut(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def powers(name: str, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base ("up") or of its inverse ("down") modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 2), _BASE if name == "up" else _INV, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def trim() -> None:
    """Gives freed memory back to the system: allocators keep it else."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if give:
        give(0)


def light(of: Callable) -> Callable:
    """of, for mapInArrow; a worker that waits for its next task gives back the memory of the last one."""

    def run(batches):
        yield from of(batches)
        for name in [x for x, held in _powers.items() if len(held) > BLOCK + 2]:
            del _powers[name]
        trim()

    return run


def mapped(df: DataFrame, of: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(light(of), schema), in batches of about BATCH bytes; one longer row makes a batch of its own.

    Spark bounds batches by 10,000 rows, however long: whole tasks, which the JVM and the worker then hold several times.
    The bound is a setting of the session, read when the plan runs, and so stays set; one that is set already is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH))
    return df.mapInArrow(light(of), schema)


class Rows:
    """Texts of some rows as one byte array; bounds[i]:bounds[i + 1] is row first + i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int = 0):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def pick(rows: Rows, take: np.ndarray) -> Rows:
    """The rows for which take holds."""
    n = np.diff(rows.bounds)
    return Rows(rows.data[np.repeat(take, n)], np.concatenate(([0], np.cumsum(n[take]))), rows.first)


def blocks(column, block: int = BLOCK) -> Iterator[Rows]:
    """Splits an Arrow string or binary array into blocks of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, dat = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + block, "right")) - 1)
        to = min(to, len(column))
        yield Rows(data[off[at] : off[to]], off[at : to + 1] - off[at], at)
        at = to


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross rows."""
    n = len(member)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | edge[1:-1]
    end = member.copy()
    end[:-1] &= ~member[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; byte values count from 1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of byte spans, the same wherever the bytes stand."""
    return mix((sums[ends] - sums[starts]) * powers("down", len(sums))[starts])


def windows(words: np.ndarray, k: int, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of the k words from each place; the last k - 1 places are not windows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed & (2**64 - 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out)


def row_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """bounds in units of items: items of row i are out[i]:out[i + 1], for items given by sorted starts."""
    return np.searchsorted(starts, bounds)


def within(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of k items that lie in one row, and the row of each."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else np.empty(0, np.int64)
    return np.arange(len(row)) - first[row] + bounds[:-1][row], row


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each row."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
