"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators of words: the space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(name: str = "text") -> Column:
    """A key that equal texts share; null and empty texts share one."""
    return F.sha2(F.coalesce(F.col(name), F.lit("")), 256)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded row count and bounded bytes."""
    columns, count, held = [[] for _ in schema], 0, 0
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
            if isinstance(value, (bytes, str)):
                held += len(value)
        count += 1
        if count >= size or held >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns, count, held = [[] for _ in schema], 0, 0
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


# Hashes of words and shingles, without a Python object per word.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16, 2 * len(_POWERS["up"]))
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which neighbours look unrelated."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word of a lower-cased text, in order."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate(([True], _SEPARATOR[raw], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(raw))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return scramble((total[ends] - total[starts]) * down[starts])


def shingle_set(words: np.ndarray, length: int = 5) -> np.ndarray:
    """The distinct hashes of all runs of ``length`` words, sorted; a shorter text is one run."""
    if not len(words):
        return words
    size = min(length, len(words))
    mixed = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        mixed = scramble(mixed + words[j : j + len(mixed)] + np.uint64(j + 1))
    return np.unique(mixed)
