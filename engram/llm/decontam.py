"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are sequences of words. A random walk (one bit per step and word decides
whether it moves on) turns the edit distance of two sequences into the Hamming
distance of their walks. A table of the index samples a few steps of one walk;
windows and items that agree there in one of the tables are compared exactly.
Windows have the size of the items they are compared with.

Which windows are embedded follows from the q-gram lemma alone: a passage within
``e`` word edits of an item of ``n`` words shares at least ``n - 2 - 3e`` word
trigrams with it, so places with fewer trigrams of any item cannot match and
are skipped without loss.

Items are taken in blocks of ``BLOCK`` items; each block is one pass over the
documents, so what a task holds of the benchmark is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from engram.llm.common import UNIT_BYTES, lower_ascii, mix, offsets_of, prefix_hash, range_hash, word_ranges

EDITS = 0.2
LEAST_WORDS = 6
# walks, tables per walk, steps sampled per table; recall at EDITS is tested to be at least 0.95
WALKS = 4
TABLES = 12
STEPS = 2
# items per pass over the documents
BLOCK = 20_000
_SIEVE_BITS = 22
_SIZE_BITS = 16
_PAD = np.uint64(0)
_HIT = "array<struct<item_id: long, distance: int, start: int, n_words: int>>"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (ASCII letters lower-cased) and the row of each word."""
    offsets, body = offsets_of(column)
    body = lower_ascii(body)
    starts, ends, rows = word_ranges(body, offsets)
    return range_hash(prefix_hash(body), starts, ends) | np.uint64(1), rows


def trigrams(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of each word with the next two; 0 where the row ends before."""
    out = np.zeros(len(words), np.uint64)
    if len(words) > 2:
        value = mix(words[:-2] + mix(words[1:-1] + mix(words[2:])))
        out[:-2] = np.where(rows[2:] == rows[:-2], value, np.uint64(0))
    return out


def edits(n: int, share: float = EDITS) -> int:
    return math.floor(share * n + 1e-9)


def walks(words: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The first 2n steps of the CGK walk over the n words at each start, as word hashes, 0 behind the end.

    A walk passes n words in about 2n steps; later ones are mostly padding and are not sampled.
    """
    out = np.zeros((len(starts), 2 * n), np.uint64)
    padded = np.append(words, np.zeros(1, np.uint64))
    at = np.zeros(len(starts), np.int64)
    for step in range(2 * n):
        here = np.where(at < n, padded[np.minimum(starts + np.minimum(at, n), len(words))], _PAD)
        out[:, step] = here
        at += (mix(here + np.uint64((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)).astype(np.int64)
    return out


def keys(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One key per table for the n words at each start."""
    out = []
    for walk in range(WALKS):
        steps = walks(words, starts, n, walk)
        chosen = np.random.default_rng([walk, n]).integers(0, 2 * n, (TABLES, STEPS))
        for table, some in enumerate(chosen):
            key = np.full(len(starts), walk * TABLES + table + 1, np.uint64)
            for s in some:
                key = mix(key + steps[:, s])
            out.append(key)
    return np.stack(out, axis=1) if len(starts) else np.zeros((0, WALKS * TABLES), np.uint64)


def fit_distance(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edit distance between the item and a prefix of each window (rows; 0 is no word)."""
    width = windows.shape[1]
    places = np.arange(width + 1)
    row = np.broadcast_to(places, (len(windows), width + 1)).copy()
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - places, axis=1) + places
    return row.min(axis=1)


class Index:
    """A block of items: their words, the sieve of their trigrams and the LSH tables by item size."""

    def __init__(self, ids: list[int], texts: list[str], share: float = EDITS):
        words, rows = word_hashes(pa.array(texts, pa.string()))
        self.share, self.ids = share, ids
        marks = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.items = [words[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        grams = trigrams(words, rows)
        self.sieve[(grams[grams != 0] >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
        # by item size: a sieve of its own, and the sorted keys with their items
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(x) for x in self.items if len(x) >= LEAST_WORDS}):
            own = np.array([i for i, x in enumerate(self.items) if len(x) == n])
            table = keys(words, marks[own], n)
            flat, item = table.ravel(), np.repeat(own, table.shape[1])
            order = np.argsort(flat, kind="stable")
            sieve = np.zeros(1 << _SIZE_BITS, bool)
            mine = grams[np.isin(rows, own) & (grams != 0)]
            sieve[(mine >> np.uint64(64 - _SIZE_BITS)).astype(np.int64)] = True
            self.sizes[n] = (sieve, flat[order], item[order])

    def needed(self, n: int) -> int:
        return max(1, n - 2 - 3 * edits(n, self.share))

    def find(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, distance, first word, words of the item): the best place per row and item."""
        if len(words) == 0 or not self.sizes:
            return []
        grams = trigrams(words, rows)
        hit = self.sieve[(grams >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)]
        upto = np.concatenate(([0], np.cumsum(hit)))
        row_start = np.searchsorted(rows, rows, side="left")
        row_end = np.searchsorted(rows, rows, side="right")
        longest = max(n + edits(n, self.share) for n in self.sizes)
        some = np.flatnonzero(upto[np.minimum(np.arange(len(words)) + longest, row_end)] - upto[:-1] >= min(map(self.needed, self.sizes)))
        place = (grams[hit] >> np.uint64(64 - _SIZE_BITS)).astype(np.int64)
        found = []
        for n, (sieve, table, owner) in self.sizes.items():
            most = edits(n, self.share)
            end = np.minimum(some + n + most, row_end[some])
            of_size = np.concatenate(([0], np.cumsum(sieve[place])))
            starts = some[(of_size[upto[end]] - of_size[upto[some]] >= self.needed(n)) & (end - some >= n - most)]
            for at in range(0, len(starts), 1 << 14):
                found += self._matches(words, row_end, starts[at : at + (1 << 14)], n, most, table, owner)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for start, item, d in found:
            key = (int(rows[start]), item)
            place = (d, int(start - row_start[start]))
            best[key] = min(best.get(key, place), place)
        return [(row, item, d, at, len(self.items[item])) for (row, item), (d, at) in sorted(best.items())]

    def _matches(self, words, row_end, starts, n, most, table, owner):
        # a window at the end of a row is shorter; what lies behind it is no word
        reach = n + most
        places = starts[:, None] + np.arange(reach)
        windows = np.where(places < row_end[starts][:, None], words[np.minimum(places, len(words) - 1)], _PAD)
        wanted = keys(windows.ravel(), np.arange(len(starts)) * reach, n)
        low, high = np.searchsorted(table, wanted.ravel(), "left"), np.searchsorted(table, wanted.ravel(), "right")
        many = high - low
        window = np.repeat(np.repeat(np.arange(len(starts)), wanted.shape[1]), many)
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.stack([owner[entry], window], axis=1), axis=0)
        out = []
        for item in np.unique(pairs[:, 0]).tolist():
            own = pairs[pairs[:, 0] == item, 1]
            exact = (windows[own, :n] == self.items[item]).all(axis=1)
            out += [(int(s), item, 0) for s in starts[own[exact]]]
            # a place of no edits is the best one of its row; others in it need no distance
            done = np.unique(row_end[starts[own[exact]]])
            own = own[~np.isin(row_end[starts[own]], done)]
            distance = fit_distance(self.items[item], windows[own])
            near = distance <= most
            out += [(int(s), item, int(d)) for s, d in zip(starts[own[near]], distance[near], strict=True)]
        return out


def _slices(column: pa.Array):
    lengths = np.diff(offsets_of(column)[0])
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > UNIT_BYTES:
            yield start, column.slice(start, i - start)
            start, size = i, 0
        size += n
    yield start, column.slice(start)


def passages(text: Column, index: Index) -> Column:
    """The items of the index found in a text, each with its least distance and first best place."""

    @arrow_udf(_HIT)
    def run(column: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for start, part in _slices(column):
            for row, item, d, at, n in index.find(*word_hashes(part)):
                out[start + row].append({"item_id": index.ids[item], "distance": d, "start": at, "n_words": n})
        kind = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("n_words", pa.int32())])
        return pa.array(out, pa.list_(kind))

    return run(text)


def index_blocks(items: DataFrame, share: float = EDITS, block: int = BLOCK) -> list[Index]:
    """The items (item_id, text) in blocks by a hash of their text; null ids and texts are left out."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, math.ceil(rows.count() / block))
    out = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        out.append(Index([r["item_id"] for r in part], [r["text"] for r in part], share))
    return out


def find_passages(docs: DataFrame, items: DataFrame, share: float = EDITS) -> DataFrame:
    """doc_id, item_id, distance, start, n_words: the benchmark items each document holds, whole or in part changed.

    An item matches where its edit distance in words to the document is at most
    ``share`` of its words; of several places the one of the least distance,
    then the first, is given. Items of fewer than ``LEAST_WORDS`` words match
    nothing. Null or empty texts hold nothing; equal rows are found alike;
    empty tables give no rows; other columns are ignored.
    """
    parts = []
    for index in index_blocks(items, share):
        hits = docs.select("doc_id", F.explode(passages(F.col("text"), index)).alias("h"))
        parts.append(hits.select("doc_id", "h.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, share: float = EDITS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    for index in index_blocks(items, share):
        docs = docs.where(F.size(passages(F.col("text"), index)) == 0)
    return docs
