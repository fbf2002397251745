"""Helpers the operators share: stored tables, pieces of Arrow batches, array hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import new_dir

# bytes of text that a task works on at a time
UNIT_BYTES = 2 << 20

# delete a statement's shuffle files when it ends, not when the driver's memory is collected
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, and its shuffle files are deleted."""
    spark = df.sparkSession
    path, kept = new_dir(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of ``stored`` tables whose readers have all been stored."""
    for df in tables:
        files = df.inputFiles()
        if files:
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def row_key() -> F.Column:
    """Tells rows of one doc_id but different texts apart; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def units(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = UNIT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each; a longer row is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.diff(offsets_of(batch.column(column))[0])
        start, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and the UTF-8 bytes of a string column; null counts as empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    marks = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return marks - marks[0], body[marks[0] : marks[-1]]


def ids_of(column: pa.Array) -> list[int | None]:
    return column.to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed, kept per worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which ``range_hash`` gets the hash of any range."""
    up, _ = _Powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], by content and length alone."""
    _, down = _Powers.upto(len(prefix))
    sums = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first entry of each run of equal keys."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(body: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ``gaps``, ASCII white space by default) and the row of each; words end with their row."""
    space = gaps[body]
    inside = ~space
    if len(body) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= space[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(body)]
    begins[edges] |= inside[edges]
    finish = inside.copy()
    finish[:-1] &= space[1:]
    before = edges[edges > 0] - 1
    finish[before] |= inside[before]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lower_ascii(body: np.ndarray) -> np.ndarray:
    upper = (body >= 65) & (body <= 90)
    return body + upper.astype(np.uint8) * np.uint8(32)
