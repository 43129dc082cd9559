"""Helpers that the text operators share: words, hashes, rolling windows, Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the rolling hashes (arithmetic is modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93
#: What one Arrow batch of whole texts holds at most: rows, and bytes (a longer single text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound a Python worker's memory by rows and bytes of a batch. Plans are lazy and the setting is the session's, so
    every operator sets the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text as UTF-8 binary); null texts become empty."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` consecutive values, by prefix sums of a polynomial modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = np.empty(len(hashes), np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:] = np.uint64(base)
    down[1:] = np.uint64(pow(base, -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(up, dtype=np.uint64), dtype=np.uint64)])
    return (total[width:] - total[:-width]) * np.cumprod(down, dtype=np.uint64)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).to_pylist()]


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count-1 for every count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
