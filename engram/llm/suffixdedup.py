"""Exact removal of long byte strings that an earlier document has, by a logarithmic index family.

Suffixes are taken at sampled places: in every window of ``length`` bytes at
least one place is chosen by the least hash of the ``GRAM`` bytes that start
there, so equal windows choose the same place. Three steps:

1. Places whose ``GRAM`` bytes no other document has can start no match. Each
   task sends the hashes of its places, one per hash and piece of work, to the
   bucket of the hash; the bucket answers which ones several documents have.
2. For the rest, the ``length``-byte windows around a place are its suffixes.
   They go to the bucket of the place's hash, where documents arrive in the
   order of their ids. A batch of documents gets a sorted suffix array, is
   merge-scanned against the levels of the index family built so far, and
   becomes a level; levels of equal size are merged, so each entry moves a
   logarithmic number of times. A hit is compared byte by byte.
3. The matched windows of a document, joined, are what is removed from it.

A task replaces equal contexts of its piece of work by the one of the smallest
document before anything is sent, so what many documents share reaches a bucket
once per piece of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from engram.llm.common import group_starts, mix, offsets_of, prefix_hash, range_hash, row_key, stored, units

LENGTH = 50
GRAM = 20
# text whose places one bucket gets; entries of a batch of the index family
BUCKET_BYTES = 2 << 20
BATCH = 1 << 17
_WORK = 8 << 20
_ROWS = 1 << 14
_TURNS = 8


def places(body: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, byte and hash of the chosen places, and the least and most bytes before it at which its own windows start.

    A window's place is the first of the least hash in it, so equal windows
    choose alike, and each window of a row belongs to one place.
    """
    width = length - gram + 1
    n = len(body) - length + 1
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    if n <= 0:
        return none
    starts = np.arange(len(body) - gram + 1)
    h = range_hash(prefix_hash(body), starts, starts + gram)
    # least hash of the ``width`` grams from each byte, by doubling
    least, span = h, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    row_end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    window = np.flatnonzero(np.arange(n) + length <= row_end)
    if len(window) == 0:
        return none
    # runs of windows with one least hash: the first place with it serves them until it leaves the window
    new = np.concatenate(([True], (least[window[1:]] != least[window[:-1]]) | (window[1:] != window[:-1] + 1)))
    first, last = window[new], window[np.append(np.flatnonzero(new)[1:], len(window)) - 1]
    found = []
    for _ in range(_TURNS):
        at = _first_place(h, least, first, width)
        found.append((at, first, np.minimum(at, last)))
        more = at < last
        first, last = at[more] + 1, last[more]
        if len(first) == 0:
            break
    else:
        # very many equal grams in a row: window by window
        sizes = last - first + 1
        each = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        found.append((_first_place(h, least, each, width), each, each))
    at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, at))
    at, first, last = at[order], first[order], last[order]
    head = group_starts(at)
    at, first, last = at[head], first[head], np.maximum.reduceat(last, head)
    return np.searchsorted(offsets, at, side="right") - 1, at, h[at], at - last, at - first


def _first_place(h: np.ndarray, least: np.ndarray, window: np.ndarray, width: int) -> np.ndarray:
    """The first byte of each window whose gram has the least hash of the window."""
    at, open_ = window.copy(), np.arange(len(window))
    for back in range(width):
        here = window[open_]
        hit = h[here + back] == least[here]
        at[open_[hit]] = here[hit] + back
        open_ = open_[~hit]
        if len(open_) == 0:
            break
    return at


def _cut(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    offsets, body = offsets_of(batch.column("text"))
    doc = batch.column("doc").to_numpy(zero_copy_only=False)
    return offsets, body, doc, batch.column("key").to_numpy(zero_copy_only=False)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """The values byte plane by byte plane: planes that hardly change take little room in a shuffle file."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(data: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash are enough to find candidates; more false ones only cost work."""
    return h & np.uint64(2**64 - 2**16)


def _send(buckets: int, length: int, gram: int):
    """Per piece of work and bucket the hashes (with their document) of its places; hashes of several own documents
    are answered here (bucket -1) and sent only as a witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work in units(batches, most=_WORK):
            docs, hashes = [], []
            for unit in units(iter([work])):
                offsets, body, doc, _ = _cut(unit)
                row, _, h, _, _ = places(body, offsets, length, gram)
                docs.append(doc[row])
                hashes.append(_short(h))
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            if len(h) == 0:
                continue
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            first = group_starts(h)
            low, high = doc[first], doc[np.append(first[1:], len(h)) - 1]
            shared = low < high
            mine = np.flatnonzero(np.repeat(shared, np.diff(np.append(first, len(h)))))
            out = list(_answers(doc[mine], h[mine]))
            bucket = _bucket(h[first], buckets)
            for b, some in _runs(bucket, np.argsort(bucket, kind="stable")):
                at = first[some]
                out.append((b, 0, 0, _planes(h[at]) + _planes(doc[at]) + shared[some].astype(np.uint8).tobytes()))
            yield _rows(out)

    return run


def _runs(value: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values in order, each with the places that have it."""
    bounds = np.append(group_starts(value[order]), len(order)).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(value[order[a]]), order[a:b]


_PACKED = "bucket int, doc long, key long, data binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    bucket, doc, key, data = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(data, pa.binary())], ["bucket", "doc", "key", "data"])


def _answers(doc: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """One row per document: its values packed."""
    order = np.argsort(doc, kind="stable")
    for d, some in _runs(doc, order):
        yield -1, d, 0, _planes(np.sort(h[some]))


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """What a bucket answers: for the hashes that several documents have, the documents that do not know it yet."""
    parts = []
    for data in rows["data"]:
        n = len(data) // 17
        parts.append((_values(data, np.uint64, n, 0), _values(data, np.int64, n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n)))
    h, doc, known = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, doc, known = h[order], doc[order], known[order]
    first = group_starts(h)
    several = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(known, first) > 0)
    told = np.repeat(several, np.diff(np.append(first, len(h)))) & (known == 0)
    return _frame(list(_answers(doc[told], h[told])))


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"doc": pd.Series([x[1] for x in out], dtype="int64"), "key": pd.Series([x[2] for x in out], dtype="int64"), "data": [x[3] for x in out]})


def _contexts(buckets: int, length: int, gram: int):
    """The bytes around the shared places of each document: (bucket, packed entries), and matches inside a piece of work."""
    side = length - gram
    width = 2 * side + gram

    def entries(unit: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        offsets, body, doc, key = _cut(unit)
        row, at, h, least, most = places(body, offsets, length, gram)
        wanted = unit.column("data").to_pylist()
        keep = np.zeros(len(row), bool)
        marks = np.searchsorted(row, np.arange(len(wanted) + 1))
        for i, data in enumerate(wanted):
            a, b = marks[i], marks[i + 1]
            if data is not None and a < b:
                known = np.unique(np.concatenate([_values(x, np.uint64, len(x) // 8, 0) for x in data]))
                keep[a:b] = np.isin(_short(h[a:b]), known)
        row, at, h, least, most = row[keep], at[keep], h[keep], least[keep], most[keep]
        padded = np.concatenate((np.zeros(side, np.uint8), body, np.zeros(side + gram, np.uint8)))
        byte = np.arange(width)
        ctx = padded[at[:, None] + byte] if len(at) else np.zeros((0, width), np.uint8)
        # only the bytes of its own windows tell one place from another
        ctx[(byte < (side - most)[:, None]) | (byte >= (side - least + length)[:, None])] = 0
        return doc[row], key[row], at - offsets[row], h, least, most, ctx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for work in units(_with_texts(batches), most=_WORK // 4):
            parts = [entries(u) for u in units(iter([work]))]
            doc, key, at, h, least, most, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(doc) == 0:
                continue
            first, copy = _first_copies(doc, least, most, ctx)
            out = _matches(doc[copy], key[copy], at[copy], _all_backs(least[copy], most[copy])) if len(copy) else []
            sent = first
            bucket = _bucket(h[sent], buckets)
            by = np.lexsort((doc[sent], bucket))
            for b, some in _runs(bucket, by):
                i = sent[some]
                data = doc[i].tobytes() + key[i].tobytes() + at[i].astype(np.int32).tobytes() + least[i].astype(np.uint8).tobytes() + most[i].astype(np.uint8).tobytes() + ctx[i].tobytes()
                out.append((b, 0, 0, packer.compress(data)))
            yield _rows(out)

    return run


def _first_copies(doc: np.ndarray, least: np.ndarray, most: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the smallest document with their bytes and windows, and the others: all windows of those are matched."""
    same = np.concatenate((ctx, least[:, None].astype(np.uint8), most[:, None].astype(np.uint8)), axis=1)
    order = np.argsort(np.concatenate([_row_hashes(same[i : i + _ROWS]) for i in range(0, len(same), _ROWS)]), kind="stable")
    breaks = np.concatenate([[True], *[(same[order[i + 1 : i + 1 + _ROWS]] != same[order[i : i + _ROWS][: len(order) - 1 - i]]).any(axis=1) for i in range(0, len(order) - 1, _ROWS)]])
    low = np.minimum.reduceat(doc[order], np.flatnonzero(breaks))
    is_first = np.empty(len(order), bool)
    is_first[order] = doc[order] == low[np.cumsum(breaks) - 1]
    return np.flatnonzero(is_first), np.flatnonzero(~is_first)


def _all_backs(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return ((one << (most + 1).astype(np.uint64)) - one) & ~((one << least.astype(np.uint64)) - one)


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    edges = np.arange(len(rows) + 1) * rows.shape[1]
    return range_hash(prefix_hash(rows.ravel()), edges[:-1], edges[1:])


def _matches(doc: np.ndarray, key: np.ndarray, at: np.ndarray, backs: np.ndarray) -> list[tuple]:
    """One row per document: places and the set of matched windows of each, packed."""
    order = np.lexsort((key, doc))
    doc, key, at, backs = doc[order], key[order], at[order], backs[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
    last = np.append(first[1:], len(doc))
    return [(-1, int(doc[a]), int(key[a]), at[a:b].astype(np.int64).tobytes() + backs[a:b].astype(np.uint64).tobytes()) for a, b in zip(first, last, strict=True)]


class Family:
    """Levels of sorted suffix arrays (hash of the first ``length`` bytes, where they are), each twice the one before."""

    def __init__(self, ctx: np.ndarray, length: int):
        self.ctx, self.length = ctx, length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _same(self, e1: np.ndarray, s1: np.ndarray, e2: np.ndarray, s2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(e1), bool)
        for a in range(0, len(e1), _ROWS):
            b = slice(a, a + _ROWS)
            i = np.arange(self.length, dtype=np.int32)
            out[b] = (self.ctx[e1[b][:, None], s1[b][:, None].astype(np.int32) + i] == self.ctx[e2[b][:, None], s2[b][:, None].astype(np.int32) + i]).all(axis=1)
        return out

    def scan(self, h: np.ndarray, entry: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which suffixes of a sorted batch some level has, byte for byte."""
        hit = np.zeros(len(h), bool)
        for known, e, s in self.levels:
            at = np.searchsorted(known, h)
            open_ = np.flatnonzero((at < len(known)) & ~hit)
            # equal hashes of different bytes lie side by side
            while len(open_):
                open_ = open_[(at[open_] < len(known)) & ~hit[open_]]
                open_ = open_[known[at[open_]] == h[open_]]
                same = self._same(entry[open_], start[open_], e[at[open_]], s[at[open_]])
                hit[open_[same]] = True
                at[open_] += 1
        return hit

    def add(self, h: np.ndarray, entry: np.ndarray, start: np.ndarray) -> None:
        level = (h, entry, start)
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            old = self.levels.pop()
            joined = [np.concatenate(x) for x in zip(old, level, strict=True)]
            order = np.argsort(joined[0], kind="stable")
            level = tuple(x[order] for x in joined)
        self.levels.append(level)


def matched_windows(doc: np.ndarray, least: np.ndarray, most: np.ndarray, ctx: np.ndarray, length: int, gram: int, batch: int = BATCH) -> np.ndarray:
    """Per entry (documents ascending) the set of windows, as bits by bytes before the place, that a smaller document has."""
    side = length - gram
    family, backs = Family(ctx, length), np.zeros(len(doc), np.uint64)
    a = 0
    while a < len(doc):
        # a batch ends between documents
        b = min(len(doc), a + max(1, batch // (side + 1)))
        b = int(np.searchsorted(doc, doc[b - 1], side="right"))
        own = np.arange(a, b)
        width = ctx.shape[1]
        running = prefix_hash(ctx[a:b].ravel())
        hs, es, ss = [], [], []
        for start in range(side + 1):
            back = side - start
            some = own[(back >= least[a:b]) & (back <= most[a:b])]
            at = (some - a) * width + start
            hs.append(range_hash(running, at, at + length))
            es.append(some.astype(np.int32))
            ss.append(np.full(len(some), start, np.int8))
        h, entry, start = np.concatenate(hs), np.concatenate(es), np.concatenate(ss)
        order = np.lexsort((doc[entry], h))
        h, entry, start = h[order], entry[order], start[order]
        hit = family.scan(h, entry, start)
        # inside the batch: the first suffix of equal ones is of the smallest document
        head, fresh = np.arange(len(h)), np.ones(len(h), bool)
        if len(h):
            first = group_starts(h)
            head = np.repeat(first, np.diff(np.append(first, len(h))))
            later = np.flatnonzero(head != np.arange(len(h)))
            same = family._same(entry[later], start[later], entry[head[later]], start[head[later]])
            fresh[later[same]] = False
            hit[later[same]] |= doc[entry[later[same]]] > doc[entry[head[later[same]]]]
            # different bytes under one hash: compare with each of the group
            for i in later[~same].tolist():
                for j in range(head[i] + 1, i):
                    if family._same(entry[i : i + 1], start[i : i + 1], entry[j : j + 1], start[j : j + 1])[0]:
                        fresh[i] = False
                        hit[i] |= bool(doc[entry[i]] > doc[entry[j]])
                        break
        np.bitwise_or.at(backs, entry[hit], np.uint64(1) << (side - start[hit].astype(np.int64)).astype(np.uint64))
        new = fresh & ~hit
        family.add(h[new], entry[new], start[new])
        a = b
    return backs


def _search(length: int, gram: int):
    width = 2 * (length - gram) + gram

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for data in map(_unpacked, rows["data"]):
            n = len(data) // (22 + width)
            cuts = ((np.int64, 0, n), (np.int64, 8 * n, n), (np.int32, 16 * n, n), (np.uint8, 20 * n, n), (np.uint8, 21 * n, n))
            parts.append([*(np.frombuffer(data, t, m, o) for t, o, m in cuts), np.frombuffer(data, np.uint8, n * width, 22 * n).reshape(n, width)])
        doc, key, at, least, most, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
        least, most = least.astype(np.int64), most.astype(np.int64)
        first, copy = _first_copies(doc, least, most, ctx)
        first = first[np.argsort(doc[first], kind="stable")]
        backs = np.zeros(len(doc), np.uint64)
        backs[copy] = _all_backs(least[copy], most[copy])
        backs[first] = matched_windows(doc[first], least[first], most[first], ctx[first], length, gram)
        some = np.flatnonzero(backs)
        return _frame(_matches(doc[some], key[some], at[some], backs[some]) if len(some) else [])

    return run


def removed_runs(found: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the matched windows cover."""
    sizes = [len(data) // 16 for data in found]
    at = np.concatenate([np.frombuffer(data, np.int64, n) for data, n in zip(found, sizes, strict=True)])
    backs = np.concatenate([np.frombuffer(data, np.uint64, n, 8 * n) for data, n in zip(found, sizes, strict=True)])
    entry, back = np.nonzero(np.unpackbits(backs.view(np.uint8), bitorder="little").reshape(-1, 64))
    starts = np.unique(at[entry] - back)
    # windows that touch make one run
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + length)))
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + length


def cut_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    bounds = np.concatenate(([0], np.stack((starts, ends), axis=1).ravel(), [len(raw)])).tolist()
    return b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def _result(text: Column, found: Column, length: int) -> Column:
    @pandas_udf("n_bytes long, kept binary, starts array<int>, ends array<int>")
    def run(texts: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, data, strict=True):
            raw = _unpacked(t)
            if d is None or len(d) == 0:
                out.append((len(raw), raw, [], []))
                continue
            starts, ends = removed_runs(list(d), length)
            out.append((len(raw), cut_bytes(raw, starts, ends), starts.tolist(), ends.tolist()))
        return pd.DataFrame(out, columns=["n_bytes", "kept", "starts", "ends"])

    return run(text, found)


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (binary), starts and ends (removed byte runs) per row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts in a row with a smaller doc_id; overlaps count, strings are judged on
    the input, no match crosses documents. A null text is empty. Rows without a
    doc_id neither lose bytes nor make others lose any; rows of one doc_id do
    not act on each other. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    numbered = rows.where("doc is not null").select("doc", "key", "text")
    spread = F.pmod(F.xxhash64("doc", "key"), F.lit(buckets)).cast("int")
    sent = numbered.mapInArrow(_send(buckets, length, gram), _PACKED)
    # what a piece of work answers itself passes through the same exchange, spread over the buckets
    asked = sent.withColumn("to", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(spread))
    shared = stored(asked.groupBy("to").applyInPandas(lambda g: _pass(g, _shared), "doc long, key long, data binary"), "shared-places")
    by_doc = shared.groupBy(F.col("doc").alias("_d")).agg(F.collect_list("data").alias("data"))
    packed = rows.mapInArrow(_packed_texts, "doc long, key long, packed binary")
    known = packed.join(by_doc, F.col("doc") == F.col("_d")).select("doc", "key", "packed", "data")
    found = known.mapInArrow(_contexts(buckets, length, gram), _PACKED)
    dealt = found.withColumn("to", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(spread))
    search = _search(length, gram)
    matched = dealt.groupBy("to").applyInPandas(lambda g: _pass(g, search), "doc long, key long, data binary")
    runs = matched.groupBy(F.col("doc").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list("data").alias("found"))
    here = (F.col("doc") == F.col("_d")) & (F.col("key") == F.col("_k"))
    joined = packed.join(runs, here, "left").select("doc", _result(F.col("packed"), F.col("found"), length).alias("r"))
    return joined.select(F.col("doc").alias("doc_id"), "r.*")


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed: they are moved twice."""
    packer = zstandard.ZstdCompressor(level=1)
    for unit in units(batches):
        data = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in unit.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([unit.column("doc"), unit.column("key"), pa.array(data, pa.binary())], ["doc", "key", "packed"])


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = pa.array([_unpacked(x) for x in part.column("packed").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("key"), texts, part.column("data")], ["doc", "key", "text", "data"])


def _pass(rows: pd.DataFrame, work) -> pd.DataFrame:
    """Rows for documents as they are, rows for a bucket worked on."""
    ready, packed = rows[rows["bucket"] < 0], rows[rows["bucket"] >= 0]
    parts = [ready[["doc", "key", "data"]].astype({"doc": "int64", "key": "int64"})]
    if len(packed):
        parts.append(work(packed))
    return pd.concat(parts, ignore_index=True)
