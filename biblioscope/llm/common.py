"""Helpers that the operators share: table access, UTF-8 buffers and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path, stored  # noqa: F401

#: Bytes of text that numpy handles at a time; bounds a worker's memory.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker gets at once: texts may be long. Plans read this setting when they run, so it stays; a smaller one is kept."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def id_crc(column: str) -> Column:
    """crc32 of the id as text, unsigned."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as bytes and offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_remembered: dict = {}


def remembered(key, make):
    """What a worker keeps from task to task (a tokenizer, a memo): one thing at a time, so memos of different operators
    don't add up in a worker that is used again."""
    if key not in _remembered:
        _remembered.clear()
        release()
        _remembered[key] = make()
    return _remembered[key]


def release() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: np.ndarray = np.ones(1, np.uint64)
_inverse: np.ndarray = np.ones(1, np.uint64)
_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverse


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[0] = 0, such that span_hash() of P is a polynomial hash of any span."""
    powers, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_value[data] * powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    _, inverse = _tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word for near-duplicates: all but space and \t to \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of a word for licences and benchmarks: digits, lower-case letters and all beyond ASCII.
WORDISH = np.zeros(256, bool)
WORDISH[48:58] = WORDISH[97:123] = WORDISH[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of the class, and for each document the number of words before it; words end where documents do."""
    is_in = inside[data]
    before = np.empty_like(is_in)
    before[:1] = False
    before[1:] = is_in[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    start = np.flatnonzero(is_in & ~before)
    after = np.empty_like(is_in)
    after[-1:] = False
    after[:-1] = is_in[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(is_in & ~after) + 1
    return start, end, np.searchsorted(start, offsets)
