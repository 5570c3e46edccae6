"""Text and hash helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.session import fresh_path, materialize, release, shared_dir, shuffle_partitions, table  # noqa: F401

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
TRIM = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def new_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_fold(col: str, mod: int) -> Column:
    """crc32 of an id's text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % mod


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int):
    """Ranges [a, b) of rows that hold about ``limit`` bytes at most, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row's range; 0 for an empty range."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+`` of a batch, and a 64-bit hash of each.

    A to Z count as lower case in the hash, a rolling polynomial taken at the word's ends.
    """
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.ones(len(raw) + 1, bool)
    edge[:-1] = gap
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    word = ~edge
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | cut))
    end = np.flatnonzero(before & (~word | cut))
    row = np.searchsorted(offsets, start, "right") - 1
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += np.uint8(32)
    h = span_hashes(low, start, end)
    return start, end, row, h


_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, the same for equal bytes wherever they stand."""
    n = len(raw)
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.cumprod(power, dtype=np.uint64)
    back = np.ones(n + 1, np.uint64)
    back[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    back = np.cumprod(back, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], dtype=np.uint64, out=total[1:])
    return mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
