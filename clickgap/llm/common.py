"""Shared helpers of the training-data operators.

``stage`` cuts lineage by writing Parquet below the session's shared
checkpoint folder (``spark.checkpoint.dir``) and reading it back: the
plan above becomes a prunable scan, and losing an executor does not lose
the data. The files are dropped when the application ends.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

__all__ = ["stage", "table", "fresh", "row_key", "ship_package", "prepare",
           "ascii_lower", "WHITE", "word_spans", "word_hashes", "mix64",
           "letter_spans", "equal_words", "segment_ids"]

#: white space of the word rule, as a set for byte tables
WHITE = (9, 10, 11, 12, 13, 32)


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, package importable in Python workers."""
    checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the copy."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none in ``df``: each wanted name, with
    leading underscores added until it is free (names compare without
    case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: Column, text_col: Column) -> Column:
    """Key of a row by its id and whole text (two independent 64-bit
    hashes); equal only for repeated rows."""
    t = F.coalesce(text_col, F.lit("\u0000"))
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("?")),
                       F.xxhash64(t).cast("string"), F.xxhash64(F.lit(7), t).cast("string"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- numpy over the bytes of many texts at once -------------------------------

_P1 = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply), on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, bounds: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts stored back to back.

    ``data``: UTF-8 bytes; text i is ``data[bounds[i]:bounds[i + 1]]``.
    Returns (start, end, text index) of every word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = ~_IS_WHITE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = bounds[:-1][bounds[:-1] < n]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    end = bounds[1:][bounds[1:] > 0] - 1
    last[end] = solid[end]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, owner


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word, 8 bytes a step over all words at once."""
    if lower:
        data = _LOWER[data]
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = ends - starts
    h = mix64(length.astype(np.uint64) * _P1 + np.uint64(seed))
    live = np.arange(len(starts))
    at = 0
    keep = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    while len(live):
        block = np.ascontiguousarray(wide[starts[live] + at]).view("<u8").ravel()
        left = length[live] - at
        short = left < 8
        block = np.where(short, block & keep[np.minimum(left, 7)], block)
        h[live] = mix64((h[live] ^ block) * _P1)
        at += 8
        live = live[left > 8]
    return h


def _wide(data: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)


def equal_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool,
                book: np.ndarray, book_starts: np.ndarray, book_ends: np.ndarray) -> np.ndarray:
    """Whether word i of ``data`` and word i of ``book`` are the same bytes,
    8 bytes a step over all pairs at once."""
    left, right = _wide(_LOWER[data] if lower else data), _wide(book)
    length = ends - starts
    same = length == book_ends - book_starts
    live = np.flatnonzero(same)
    keep = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    at = 0
    while len(live):
        a = np.ascontiguousarray(left[starts[live] + at]).view("<u8").ravel()
        b = np.ascontiguousarray(right[book_starts[live] + at]).view("<u8").ravel()
        rest = length[live] - at
        mask = np.where(rest < 8, keep[np.minimum(rest, 7)], ~np.uint64(0))
        same[live] &= (a & mask) == (b & mask)
        at += 8
        live = live[(rest > 8) & same[live]]
    return same


_WORDY = np.zeros(256, dtype=bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = True
_WORDY[128:] = True


def letter_spans(data: np.ndarray, bounds: np.ndarray):
    """Maximal runs of ASCII letters, digits and non-ASCII characters of
    texts stored back to back: (start, end, text index), as ``word_spans``."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = _WORDY[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = bounds[:-1][bounds[:-1] < n]
    first[cut] = solid[cut]
    end = bounds[1:][bounds[1:] > 0] - 1
    last[end] = solid[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, side="right") - 1


def segment_ids(counts: np.ndarray) -> np.ndarray:
    """0,0,..,1,1,.. with counts[i] copies of i."""
    return np.repeat(np.arange(len(counts)), counts)


def text_chunks(column, max_bytes: int = 4 << 20, max_rows: int = 4096):
    """(first row, last row, bytes, bounds) over runs of rows of an Arrow
    string column that stay below both limits (one row at least); nulls
    read as empty."""
    import pyarrow as pa

    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, raw = col.buffers()
    n = len(col)
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
