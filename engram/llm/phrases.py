"""Phrase collocations: HAT-trie counts of word sequences, scored by their weakest cut.

Each task counts the windows of its texts in a burst trie: the upper nodes
branch on prefix partitions and then on word ids, the leaves are containers
that add up equal windows by hash and burst when they grow. A trie over its
row bound spills whole subtrees as sorted runs, one row per prefix partition;
a partition merges its runs and keeps what is frequent. A window at a word
counts all sequences that start there, so every length is read off the same
sorted runs.

A sequence is frequent only if its words and word pairs are: single words are
counted first, pairs next, longer windows last, each with a bitmap of fixed
size of what the round before found frequent. A bit shared by chance lets a
window through; it never drops one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import discard, lower_ascii, mix, offsets_of, prefix_hash, range_hash, stored, units, word_ranges

LONGEST = 5
LEAST = 100
TOP = 2_000
# percent of a phrase's occurrences that lie in one longer phrase and make it a part of that
ABSORBED = 100

# distinct words a task holds before it passes their counts on
MOST_WORDS = 100_000
# bytes of a task's trie before it spills, rows of a container before it bursts, windows per prefix partition
MOST_BYTES, BURST, PART_ROWS = 40 << 20, 1 << 15, 1_000_000
RUN_BYTES = 1 << 14
# bytes of text a task works on at a time
TEXT_BYTES = 1 << 20
SLOTS = 64
SIEVE_BITS = 25

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BITS = 15
_RUN = "part long, rows long, run binary"
_GRAM = "ids array<long>, c long, key long"

_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _CUT.copy()
_GAP[list(b" \t")] = True


def word_ids(unit: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Per word of the unit: its id (by language), the words left in its piece, and (bytes, starts, ends, rows) to spell it."""
    offsets, body = offsets_of(unit.column("text"))
    body = lower_ascii(body)
    starts, ends, row = word_ranges(body, offsets, _GAP)
    marks, letters = offsets_of(unit.column("lang"))
    lang = range_hash(prefix_hash(letters), marks[:-1], marks[1:])
    ids = mix(range_hash(prefix_hash(body), starts, ends) ^ (lang[row] * _GOLD))
    ids[ids == 0] = 1
    piece = np.concatenate(([0], np.cumsum(_CUT[body])))[starts]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    heads = np.append(np.flatnonzero(fresh), len(ids))
    left = np.repeat(heads[1:], np.diff(heads)) - np.arange(len(ids))
    return ids, left, (body, starts, ends, row)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, id, word, c) of each distinct word, and (lang, null, null, c) of all words."""
    counts: dict[int, int] = {}
    spelled: dict[int, tuple[str, str]] = {}
    totals: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        ids = np.array(list(counts), np.uint64).view(np.int64)
        langs = [spelled[i][0] for i in counts] + list(totals)
        words = [spelled[i][1] for i in counts] + [None] * len(totals)
        out = pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(ids.tolist() + [None] * len(totals), pa.int64()), pa.array(words, pa.string()),
             pa.array(list(counts.values()) + list(totals.values()), pa.int64())],
            ["lang", "id", "word", "c"],
        )
        for held in (counts, spelled, totals):
            held.clear()
        return out

    for unit in units(batches, most=TEXT_BYTES):
        ids, _, (body, starts, ends, row) = word_ids(unit)
        langs = unit.column("lang").to_pylist()
        rows, n = np.unique(row, return_counts=True)
        for r, c in zip(rows.tolist(), n.tolist(), strict=True):
            totals[langs[r]] = totals.get(langs[r], 0) + c
        values, at, n = np.unique(ids, return_index=True, return_counts=True)
        for i, k, c in zip(values.tolist(), at.tolist(), n.tolist(), strict=True):
            if i in counts:
                counts[i] += c
            else:
                counts[i] = c
                spelled[i] = (langs[row[k]], body[starts[k] : ends[k]].tobytes().decode())
        if len(counts) > MOST_WORDS:
            yield flush()
    if totals:
        yield flush()


def sieve_of(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** ``SIEVE_BITS`` bits (4 MB, whatever the data) with the bits of the hashes in ``column`` set."""
    bit = F.shiftrightunsigned(column, 64 - SIEVE_BITS)
    bits = df.select(bit.alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", _CHUNK_BITS))

    def pack(rows: pa.Table) -> pa.Table:
        flags = np.zeros(1 << _CHUNK_BITS, np.uint8)
        flags[rows.column("bit").to_numpy() & ((1 << _CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    size = 1 << (_CHUNK_BITS - 3)
    for r in bits.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").toLocalIterator():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
    return (sieve[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def fold_hash(columns: np.ndarray) -> np.ndarray:
    """64-bit hash of the rows of ``columns``."""
    out = np.zeros(len(columns), np.uint64)
    for k in range(columns.shape[1]):
        out = mix(out * _GOLD + columns[:, k])
    return out


def pair_windows(ids: np.ndarray, left: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    good = passes(sieve, ids)
    at = np.flatnonzero((left[:-1] >= 2) & good[:-1] & good[1:]) if len(ids) else np.zeros(0, np.int64)
    return np.stack([ids[at], ids[at + 1]], axis=1) if len(at) else np.zeros((0, 2), np.uint64)


def long_windows(ids: np.ndarray, left: np.ndarray, sieve: np.ndarray, longest: int) -> np.ndarray:
    """The window of each word that starts three or more words whose pairs all pass; a shorter one ends in zeros."""
    if len(ids) < 3 or longest < 3:
        return np.zeros((0, longest), np.uint64)
    pair = np.zeros(len(ids) + longest, bool)
    pair[: len(ids) - 1] = (left[:-1] >= 2) & passes(sieve, fold_hash(np.stack([ids[:-1], ids[1:]], axis=1)))
    at = np.flatnonzero(pair[: len(ids)] & pair[1 : len(ids) + 1])
    out = np.zeros((len(at), longest), np.uint64)
    out[:, 0], out[:, 1], out[:, 2] = ids[at], ids[at + 1], ids[at + 2]
    on = np.arange(len(at))
    for k in range(3, longest):
        on = on[pair[at[on] + k - 1]]
        out[on, k] = ids[at[on] + k]
    return out


class _Node:
    """A container of windows, or after its burst up to 16 nodes by bits of one word id.

    Rows are (hash, word ids, count).
    """

    __slots__ = ("base", "depth", "fresh", "kids", "n_fresh")

    def __init__(self, depth: int, width: int):
        self.depth, self.kids, self.fresh, self.n_fresh = depth, None, [], 0
        self.base = np.zeros((0, width + 2), np.uint64)

    def add(self, rows: np.ndarray) -> None:
        if self.kids is not None:
            self._deal(rows)
            return
        self.fresh.append(rows)
        self.n_fresh += len(rows)
        if self.n_fresh > max(len(self.base), BURST // 8):
            self.reduce()
            if len(self.base) > BURST and self.depth < self.base.shape[1] - 2:
                rows, self.base, self.kids = self.base, self.base[:0], [None] * 16
                self._deal(rows)

    def _deal(self, rows: np.ndarray) -> None:
        branch = (rows[:, 1 + self.depth] >> np.uint64(60)).astype(np.int64)
        order = np.argsort(branch, kind="stable")
        bounds = np.searchsorted(branch[order], np.arange(17))
        for b in range(16):
            if bounds[b] < bounds[b + 1]:
                if self.kids[b] is None:
                    self.kids[b] = _Node(self.depth + 1, rows.shape[1] - 2)
                self.kids[b].add(rows[order[bounds[b] : bounds[b + 1]]])

    def reduce(self) -> None:
        """Adds the counts of equal windows."""
        if not self.fresh:
            return
        rows = np.concatenate([self.base, *self.fresh])
        rows = rows[np.argsort(rows[:, 0])]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
        at = np.flatnonzero(new)
        total = np.add.reduceat(rows[:, -1], at)
        self.base, self.fresh, self.n_fresh = rows[at], [], 0
        self.base[:, -1] = total

    def leaves(self) -> Iterator[np.ndarray]:
        if self.kids is None:
            self.reduce()
            yield self.base
        for kid in self.kids or ():
            if kid is not None:
                yield from kid.leaves()


class Trie:
    """Counts of windows, bounded: ``spill`` frees whole subtrees as sorted runs."""

    def __init__(self, width: int, lead: int, parts: int, most: int | None = None):
        self.width, self.lead, self.parts = width, lead, parts
        self.most = MOST_BYTES // (8 * (width + 2)) if most is None else most
        self.slots: dict[int, _Node] = {}
        self.rows: dict[int, int] = {}

    def part(self, words: np.ndarray) -> np.ndarray:
        """Prefix partition of each window."""
        return (fold_hash(words[:, : self.lead]) % np.uint64(self.parts)).astype(np.int64)

    def add(self, windows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        if len(windows) == 0:
            return
        rows = np.concatenate([fold_hash(windows)[:, None], windows, np.ones((len(windows), 1), np.uint64)], axis=1)
        slot = self.part(windows) % SLOTS
        order = np.argsort(slot, kind="stable")
        bounds = np.searchsorted(slot[order], np.arange(SLOTS + 1))
        for s in range(SLOTS):
            if bounds[s] < bounds[s + 1]:
                self.slots.setdefault(s, _Node(0, self.width)).add(rows[order[bounds[s] : bounds[s + 1]]])
                self.rows[s] = self.rows.get(s, 0) + int(bounds[s + 1] - bounds[s])
        if sum(self.rows.values()) > self.most:
            # the exact numbers, now that equal windows are added up
            self.rows = {s: sum(map(len, node.leaves())) for s, node in self.slots.items()}
            if sum(self.rows.values()) > self.most:
                yield from self.spill(self.most // 2)

    def spill(self, most: int = 0) -> Iterator[tuple[int, int, bytes]]:
        """Sorted runs (partition, rows, bytes) of the largest subtrees, until at most ``most`` rows stay."""
        held = sum(self.rows.values())
        for s in sorted(self.rows, key=self.rows.get, reverse=True):
            if held <= most and self.rows[s]:
                break
            rows = np.concatenate(list(self.slots.pop(s).leaves()))[:, 1:]
            held -= self.rows.pop(s)
            yield from runs_of(rows, self.part(rows))


def runs_of(rows: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Windows and counts as sorted runs per partition (see ``pack``)."""
    order = np.lexsort((*rows[:, -2::-1].T, part))
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    # a reader holds some thousand runs at once, so a run is small
    step = max(RUN_BYTES // (8 * rows.shape[1]), 1)
    for start, end in zip([0, *cuts], [*cuts, len(part)], strict=True):
        for at in range(start, end, step):
            some = rows[at : min(at + step, end)]
            yield int(part[at]), len(some), pack(some)


def pack(rows: np.ndarray) -> bytes:
    """A sorted run: its numbers of rows, of first words and of large counts; first words once each with
    their lengths; the other words column by column; counts of one byte, those of 255 or more apart."""
    at = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
    lengths = np.diff(np.append(at, len(rows))).astype(np.uint16)
    counts = rows[:, -1]
    large = counts[counts >= 255]
    head = np.array([len(rows), len(at), len(large)], np.uint32)
    pieces = [head, rows[at, 0], lengths, np.ascontiguousarray(rows[:, 1:-1].T), np.minimum(counts, 255).astype(np.uint8), large]
    return b"".join(p.tobytes() for p in pieces)


def unpack(data: bytes, width: int) -> np.ndarray:
    n, heads, large = np.frombuffer(data, np.uint32, 3).tolist()
    at = 12

    def take(kind: type, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, size, at)
        at += out.nbytes
        return out

    first, lengths = take(np.uint64, heads), take(np.uint16, heads)
    rows = np.empty((n, width + 1), np.uint64)
    rows[:, 0] = np.repeat(first, lengths)
    rows[:, 1:-1] = take(np.uint64, n * (width - 1)).reshape(width - 1, n).T
    rows[:, -1] = take(np.uint8, n)
    rows[rows[:, -1] == 255, -1] = take(np.uint64, large)
    return rows


def _batch(runs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, rows, data = zip(*runs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(rows, pa.int64()), pa.array(data, pa.binary())], ["part", "rows", "run"])


def _count(windows: Callable, width: int, lead: int, parts: int, most: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(width, lead, parts, most)
        for unit in units(batches, most=TEXT_BYTES):
            ids, left, _ = word_ids(unit)
            found = list(trie.add(windows(ids, left)))
            if found:
                yield _batch(found)
        found = list(trie.spill())
        if found:
            yield _batch(found)

    return run


def _read(rows: pa.Table, width: int) -> np.ndarray:
    """Windows and counts of all runs."""
    return np.concatenate([unpack(r, width) for r in rows.column("run").to_pylist()])


def merged(rows: np.ndarray, lengths: range, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word ids, counts) of the sequences of each length in ``lengths`` with ``least`` or more occurrences."""
    rows = rows[np.lexsort(rows[:, -2::-1].T)]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in range(1, lengths.stop):
        new[1:] |= rows[1:, k - 1] != rows[:-1, k - 1]
        if k in lengths:
            at = np.flatnonzero(new)
            total = np.add.reduceat(rows[:, -1], at)
            keep = (total >= least) & (rows[at, k - 1] != 0)
            yield rows[at[keep], :k], total[keep].astype(np.int64)


def _merge(width: int, lengths: range, least: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        # what a split partition holds of its shortest sequences is only a part of their count
        split = bool(rows.column("split")[0].as_py())
        ids, marks, counts, keys = [], [0], [], []
        data = _read(rows, width)
        found = [*merged(data, lengths[:1], 1), *merged(data, lengths[1:], least)] if split and len(lengths) > 1 else merged(data, lengths, least)
        for grams, total in found:
            ids.append(grams.reshape(-1))
            marks += (marks[-1] + grams.shape[1] * np.arange(1, len(grams) + 1)).tolist()
            counts.append(total)
            keys.append(fold_hash(grams[:, :2]))
        joined = np.concatenate(ids).view(np.int64)
        return pa.table({
            "ids": pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(joined)),
            "c": pa.array(np.concatenate(counts)), "key": pa.array(np.concatenate(keys).view(np.int64)),
        })

    return run


def _resplit(width: int, lead: int) -> Callable:
    """Runs of partitions that are too large, cut by the word after the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, split, data in zip(*(batch.column(c).to_pylist() for c in ("part", "split", "run")), strict=True):
                rows = unpack(data, width)
                salt = (mix(rows[:, lead]) % np.uint64(split)).astype(np.int64)
                found = list(runs_of(rows, salt))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())],
                    ["part", "salt", "run"],
                )

    return run


def count_grams(docs: DataFrame, windows: Callable, lengths: range, lead: int, n_words: int, least: int, part_rows: int = PART_ROWS, most: int | None = None) -> DataFrame:
    """Stored (ids, c, key) of the word sequences of ``lengths`` that occur ``least`` times or more.

    ``windows`` gives the windows of a text's words. The runs of a window go to
    the partition of its first ``lead`` words, the shortest length counted; a
    partition over its bound is cut by the word after them, and what is counted
    in several cuts is added up.
    """
    width = lengths.stop - 1
    parts = max(n_words // part_rows, 1)
    runs = docs.mapInArrow(_count(windows, width, lead, parts, most), _RUN)
    merge = _merge(width, lengths, least)
    if width == lead:
        # a sequence is one row per task, so no partition is hot
        return stored(runs.select("part", "run", F.lit(False).alias("split")).groupBy("part").applyInArrow(merge, _GRAM), "grams")
    runs = stored(runs, "runs")
    hot = stored(runs.groupBy("part").agg(F.sum("rows").alias("n")).where(F.col("n") > 4 * part_rows), "hot-parts")
    if hot.isEmpty():
        plain = runs.select("part", "run", F.lit(False).alias("split"))
        found = stored(plain.groupBy("part").applyInArrow(merge, _GRAM), "grams")
    else:
        cold = runs.join(hot, "part", "left_anti").select("part", F.lit(0).cast("long").alias("salt"), "run", F.lit(False).alias("split"))
        large = runs.join(hot.select("part", F.ceil(F.col("n") / part_rows).cast("long").alias("split")), "part")
        cut = large.select("part", "split", "run").mapInArrow(_resplit(width, lead), "part long, salt long, run binary").withColumn("split", F.lit(True))
        partial = cold.union(cut).groupBy("part", "salt").applyInArrow(merge, _GRAM)
        found = stored(partial.groupBy("ids").agg(F.sum("c").alias("c"), F.first("key").alias("key")).where(F.col("c") >= least), "grams")
    discard(runs, hot)
    return found


def _scored(grams: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(ids, lang, a, l, r, n, score) of all sequences of two words or more."""
    size = F.size("ids")
    cuts = grams.where(size > 1).select("ids", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    side = lambda ids, c: grams.select(F.col("ids").alias(ids), F.col("c").alias(c))
    told = cuts.join(side("head", "l"), "head").join(side("rest", "r"), "rest")
    first = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    told = told.withColumn("first", F.col("ids")[0]).join(first, "first")
    # 38 digits hold 1000 * a * n and l * r up to 10 ** 17 occurrences
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')} div ({whole('l')} * {whole('r')})")
    told = told.withColumn("score", score.cast("long"))
    worst = told.groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    return worst.select("ids", "lang", "a", "w.l", "w.r", "n", "w.score")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED, part_rows: int = PART_ROWS, most: int | None = None
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases per language of 2 to ``longest`` words.

    Texts lose the case of A-Z and are cut into pieces at ``.,;:!?`` and line
    ends, those at spaces and tabs into words. A phrase occurs ``a`` times
    (``least`` or more) inside pieces, overlaps included; ``n`` counts the
    words of the language. Of its cuts in two, with ``l`` and ``r``
    occurrences of the halves, the one of the lowest floor(1000 a n / (l r))
    counts, of equal ones that with the shortest first half. A phrase is left out if
    ``absorbed`` % of its occurrences lie in one longer phrase. Ranks go by
    score, then ``a``, both falling, then by the bytes of the phrase.

    Null texts count as empty; a null language is ``und``. A text without
    words adds nothing, equal rows count each, texts of any length are read
    whole, other columns are ignored. No frequent phrase gives no rows. Words
    are told apart by 64-bit hashes; ``part_rows`` and ``most`` bound what a
    task holds and change no row.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = rows.mapInArrow(_word_counts, "lang string, id long, word string, c long").groupBy("lang", "id").agg(F.sum("c").alias("c"), F.min("word").alias("word"))
    table = stored(counted.where((F.col("c") >= least) | F.col("id").isNull()), "words")
    words, totals = table.where("id is not null"), table.where("id is null").select("lang", F.col("c").alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    sc = docs.sparkSession.sparkContext
    singles = sc.broadcast(sieve_of(words, "id"))
    pairs = count_grams(rows, lambda ids, left: pair_windows(ids, left, singles.value), range(2, 3), 2, n_words, least, part_rows, most)
    grams = words.select(F.array("id").alias("ids"), "c").union(pairs.select("ids", "c"))
    if longest > 2:
        doubles = sc.broadcast(sieve_of(pairs, "key"))
        longer = count_grams(rows, lambda ids, left: long_windows(ids, left, doubles.value, longest), range(3, longest + 1), 3, n_words, least, part_rows, most)
        grams = grams.union(longer.select("ids", "c"))
    grams = stored(grams, "all-grams")
    size = F.size("ids")
    parts = F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))
    # occurrences of a longer phrase are no more than those of the phrases between, so one word more is enough
    inside = grams.where(size > 2).select(F.explode(parts).alias("ids"), "c").groupBy("ids").agg(F.max("c").alias("longer"))
    alive = _scored(grams, words, totals).join(inside, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    order = [F.desc("score"), F.desc("a")]
    best = stored(alive.drop("longer").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top), "best")
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = best.join(spelled.groupBy("ids").agg(phrase.alias("phrase")), "ids")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
