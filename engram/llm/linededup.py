"""Removal of multi-line chunks that other documents already have.

A document is cut after the lines whose rolling hash (over the line and the one
before) is a local minimum, so an edit moves only the cuts next to it and every
chunk but the last has at least two lines. Chunks are grouped by their bytes:
the grouping itself is the byte comparison, and partial sums shrink a chunk
that many documents share before anything is moved. The 128-bit key of a chunk
only carries the decision back; a key that stands for two different byte
strings removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from engram.llm.common import mix, offsets_of, prefix_hash, range_hash, row_key, units

_LAST = (1 << 63) - 1
_NO = np.uint64(2**64 - 1)


def chunk_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of lines, start and end byte of every chunk of the texts in ``body``."""
    breaks = np.flatnonzero(body == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    row = np.repeat(np.arange(len(lines)), lines)
    h = range_hash(prefix_hash(body), starts, ends)
    same = row[1:] == row[:-1]
    before = np.concatenate((np.zeros(1, np.uint64), np.where(same, h[:-1], np.uint64(0))))
    rolling = mix(h + before * np.uint64(0xC2B2AE3D27D4EB4F))
    left = np.concatenate((np.zeros(1, np.uint64), np.where(same, rolling[:-1], np.uint64(0))))
    right = np.concatenate((np.where(same, rolling[1:], _NO), np.full(1, _NO)))
    cut = (rolling < left) & (rolling < right)
    begins = np.concatenate(([True], ~same | cut[:-1]))
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], last - first + 1, starts[first], ends[last]


def _shared(lines: int, start: int, end: int) -> bool:
    """Whether a chunk can be removed: several lines, not all of them empty."""
    return lines > 1 and end - start > lines - 1


def _occurrences(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """A document's chunks, each once."""
    for unit in units(batches):
        offsets, body = offsets_of(unit.column("text"))
        row, lines, start, end = (x.tolist() for x in chunk_bounds(body, offsets))
        raw = body.tobytes()
        docs, keys = unit.column("doc").to_pylist(), unit.column("key").to_pylist()
        out, seen, at = {}, set(), -1
        for r, n, a, b in zip(row, lines, start, end, strict=True):
            if r != at:
                seen, at = set(), r
            if not _shared(n, a, b):
                continue
            chunk = raw[a:b]
            mark = xxhash.xxh3_128_digest(chunk)
            if mark in seen:
                continue
            seen.add(mark)
            if with_text:
                # of a unit's equal chunks only the least document is needed, and that there are others
                low, least, most = out.get(chunk, (mark, docs[r], docs[r]))
                out[chunk] = (low, min(least, docs[r]), max(most, docs[r]))
            else:
                out[r, mark] = (docs[r], keys[r])
        if with_text:
            cols = [pa.array(list(out), pa.binary()), pa.array([x[0] for x in out.values()], pa.binary()), pa.array([x[1] for x in out.values()], pa.int64()), pa.array([x[2] for x in out.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "mark", "least", "most"])
        else:
            cols = [pa.array([k[1] for k in out], pa.binary()), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["mark", "doc", "key"])


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(mark, least): chunks that several documents hold, byte for byte, and the smallest document."""
    held = rows.mapInArrow(lambda b: _occurrences(b, True), "chunk binary, mark binary, least long, most long")
    compared = held.groupBy("mark", "chunk").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    one = compared.groupBy("mark").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.max("most").alias("most"))
    return one.where((F.col("texts") == 1) & (F.col("least") < F.col("most"))).select("mark", "least")


def cut_text(text: str | None, marks: set[bytes]) -> tuple[str | None, int, int]:
    """The text without the marked chunks and without a chunk's repeats in it; lines removed; all lines."""
    if text is None:
        return None, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    _, lines, start, end = (x.tolist() for x in chunk_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    kept, seen, gone = [], {}, 0
    for n, a, b in zip(lines, start, end, strict=True):
        chunk = raw[a:b]
        if _shared(n, a, b):
            mark = xxhash.xxh3_128_digest(chunk)
            if mark in marks or seen.get(mark) == chunk:
                gone += n
                continue
            seen[mark] = chunk
        kept.append(chunk)
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), gone, sum(lines)


def _cut(text: Column, marks: Column) -> Column:
    @pandas_udf("text string, n_removed long, n_lines long")
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = [cut_text(t, set() if m is None else set(m)) for t, m in zip(texts, found, strict=True)]
        return pd.DataFrame(out, columns=["text", "n_removed", "n_lines"])

    return run(text, marks)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with ``text`` cut, plus struct ``_cut`` (n_removed, n_lines).

    The document with the smallest doc_id keeps a chunk, in its first place;
    everywhere else the chunk goes. Chunks of one line and of empty lines only
    always stay. Rows without a doc_id count as the largest; rows with the same
    doc_id count as one document and keep what no smaller one has. A null text
    stays null; a text of repeated chunks alone becomes empty.
    """
    # the caller's columns travel in one struct, so their names cannot clash with the ones used here
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    marked = docs.select(F.struct(*map(_quoted, docs.columns)).alias("row"), doc, row_key().alias("key"), "text")
    rows = marked.select("doc", "key", "text")
    held = rows.mapInArrow(lambda b: _occurrences(b, False), "mark binary, doc long, key long")
    gone = held.join(repeated_chunks(rows), "mark").where(F.col("doc") > F.col("least"))
    # a document's own chunks, no more than its lines
    by_doc = gone.groupBy(F.col("doc").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set("mark").alias("marks"))
    joined = marked.join(by_doc, (F.col("doc") == F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    cut = joined.select("row", _cut(F.col("text"), F.col("marks")).alias("c"))
    plain = [(F.col("c.text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return cut.select(*plain, F.struct("c.n_removed", "c.n_lines").alias("_cut"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
