"""Sampled SentencePiece segmentations without replacement, and their decoding.

The lattice of a text holds every piece of the vocabulary at every place (and
bytes where a character has no piece). Its paths get perturbed log
probabilities top down: the best path below a node has the node's value, every
other branch a truncated Gumbel below it. A search that always opens the
highest branch (A-star with exact bounds) therefore emits distinct paths in the
order of their perturbed values: a sample without replacement. Draws are seeded
by the row's id, so a repeated task gives the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from engram.llm.common import prefix_hash, range_hash, row_key, units

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 2.0
# a word's lattice is made once per batch
_BATCH_BYTES = 3 << 20
# words whose lattices are made at a time, and text whose words are hashed at a time
_BLOCK_BYTES = 1 << 18
_SIEVE_BITS = 20
_SIEVE_SHIFT = np.uint64(64 - _SIEVE_BITS)


class Vocabulary:
    """Pieces by the hash of their bytes, written with a space where the model has its space mark.

    BPE models rank their pieces; a piece of rank r weighs -sharpness * log(r + 2),
    a byte as much as the last piece.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes_of = {i: model.id_to_piece(i).replace("▁", " ").encode() for i in plain}
        rank = {i: max(0.0, -model.get_score(i)) for i in plain}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of |= {int(j): bytes([b]) for b, j in enumerate(self.byte_ids)}
        self.byte_weight = -sharpness * np.log(max(rank.values()) + 2)
        chars = {i: len(self.bytes_of[i].decode()) for i in plain}
        self.longest = max(chars.values())
        # one table for pieces and beginnings of pieces: id (-1: no piece), weight, and whether a longer piece begins so
        begins = {self.bytes_of[i].decode()[:n].encode() for i in plain for n in range(1, chars[i])}
        of = {self.bytes_of[i]: i for i in plain}
        known = sorted(begins | of.keys())
        hashes = np.concatenate([_hash_of(s) for s in known])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([of.get(s, -1) for s in known], np.int32)[order]
        self.weights = -sharpness * np.log(np.array([rank.get(of.get(s, -1), 0.0) for s in known])[order] + 2)
        self.longer = np.array([s in begins for s in known])[order]
        # where the hashes of each beginning start
        self.begin = np.searchsorted(self.hashes >> _SIEVE_SHIFT, np.arange((1 << _SIEVE_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.sieve = self.begin[1:] > self.begin[:-1]
        self.text_of = np.full(max(self.bytes_of) + 1, None, object)
        self.text_of[list(self.bytes_of)] = list(self.bytes_of.values())

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the table, and where."""
        beginning = (wanted >> _SIEVE_SHIFT).astype(np.int64)
        some = np.flatnonzero(self.sieve[beginning])
        asked = wanted[some]
        at = self.begin[beginning[some]]
        # few hashes share a beginning
        behind = np.flatnonzero(self.hashes[at] < asked)
        while len(behind):
            at[behind] = np.minimum(at[behind] + 1, len(self.hashes) - 1)
            behind = behind[(self.hashes[at[behind]] < asked[behind]) & (at[behind] < len(self.hashes) - 1)]
        there = np.flatnonzero(self.hashes[at] == asked)
        return some[there], at[there]

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes of a text: those of its pieces without the space put before it; None if an id has none."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.text_of):
            return None
        try:
            return b"".join(self.text_of[ids].tolist())[1:]
        except TypeError:
            return None


def _hash_of(value: bytes) -> np.ndarray:
    return range_hash(prefix_hash(np.frombuffer(value, np.uint8)), np.array([0]), np.array([len(value)]))


@lru_cache(maxsize=4)
def _vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Lattice:
    """The lattices of distinct words; no piece crosses a word's edge.

    The edges of a character, longest piece first, are ``first[c]`` to
    ``first[c + 1]``; ``piece`` has an edge's id, -1 for the bytes of a
    character without a piece. ``upto`` are the running shares of the mass
    behind a character, ``log_rest`` the log share of the other edges beside one;
    ``target`` is the next character, -1 behind a word.
    """

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        marks = np.cumsum([0, *map(len, words)])
        cuts = [0, *(np.flatnonzero(np.diff(marks[:-1] // _BLOCK_BYTES)) + 1).tolist(), len(words)]
        self.raw = np.frombuffer(b"".join(words), np.uint8)
        # walks are faster on whole words, so only numbers they do not read are narrowed
        narrow = np.int32 if len(self.raw) < 1 << 31 else np.int64
        parts, n_chars, n_edges = [], 0, 0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            start, chars, first, source, target, *rest = _lattice_of(words[i:j], vocabulary)
            target[target >= 0] += n_chars
            parts.append([start + n_chars, (chars + marks[i]).astype(narrow), first + n_edges, (source + n_chars).astype(narrow), target, *rest])
            n_chars, n_edges = n_chars + len(chars), n_edges + len(source)
        # a field's parts are dropped once joined
        joined = (np.concatenate([p.pop(0) for p in parts]) for _ in range(len(parts[0])))
        self.start, self.chars, first, self.source, self.target, self.piece, self.log_share, self.upto, self.log_rest = joined
        self.first = np.append(first, n_edges)
        self.after = np.append(self.chars[1:], narrow(len(self.raw)))

    def closes(self, edges: np.ndarray) -> np.ndarray:
        """Whether an edge ends its word."""
        return self.target[edges] < 0

    def edges_at(self, edge: int) -> np.ndarray:
        """All edges of the character that an edge starts from."""
        c = self.source[edge]
        return np.arange(self.first[c], self.first[c + 1])

    def ids(self, edges: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
        pieces = self.piece[edges]
        lone = np.flatnonzero(pieces < 0)
        if len(lone) == 0:
            return pieces
        c = self.source[edges[lone]]
        sizes = np.ones(len(edges), np.int64)
        sizes[lone] = self.after[c] - self.chars[c]
        out = np.repeat(pieces, sizes)
        starts = np.cumsum(sizes) - sizes
        for at, a, b in zip(starts[lone].tolist(), self.chars[c].tolist(), self.after[c].tolist(), strict=True):
            out[at : at + b - a] = byte_ids[self.raw[a:b]]
        return out


def _lattice_of(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """The arrays of ``Lattice`` for some of its words, numbered from their first."""
    body = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum([0, *map(len, words)])[:-1]
    chars = np.flatnonzero((body & 0xC0) != 0x80)
    start = np.searchsorted(chars, begin)
    sizes = np.diff(np.append(start, len(chars)))
    end = np.repeat(start + sizes, sizes)
    after = np.append(chars[1:], len(body))
    running = prefix_hash(body)
    at, found, count = np.arange(len(chars)), [], np.zeros(len(chars), np.int64)
    for n in range(1, vocabulary.longest + 1):
        at = at[at + n <= end[at]]
        if len(at) == 0:
            break
        some, where = vocabulary.find(range_hash(running, chars[at], after[at + n - 1]))
        whole = vocabulary.ids[where] >= 0
        hit, of = at[some[whole]], where[whole]
        if n == 1:
            lone = np.ones(len(chars), bool)
            lone[hit] = False
            lone = np.flatnonzero(lone)
            found.append((lone, count[lone], 1, np.int32(-1), (after[lone] - chars[lone]) * vocabulary.byte_weight))
        found.append((hit, count[hit], n, vocabulary.ids[of], vocabulary.weights[of]))
        count[hit] += 1
        if n == 1:
            count[lone] += 1
        at = at[some[vocabulary.longer[where]]]
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    source, target = np.zeros(total, np.int64), np.zeros(total, np.int64)
    piece, weight = np.zeros(total, np.int32), np.zeros(total)
    for c, rank, n, own, w in found:
        e = first[c + 1] - 1 - rank
        source[e], piece[e], weight[e] = c, own, w
        target[e] = np.where(c + n == end[c], -1, c + n)
    # characters by how many are left of their word: the mass behind one needs only those with fewer
    left = end - np.arange(len(chars))
    order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
    marks = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 2)).tolist()
    # one more place, with nothing behind it, for the end of a word
    behind = np.zeros(len(chars) + 1)
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        i = order[a:b]
        if len(i):
            many = count[i]
            heads = np.cumsum(many) - many
            e = np.repeat(first[i] - heads, many) + np.arange(many.sum())
            behind[i] = np.logaddexp.reduceat(weight[e] + behind[target[e]], heads)
    log_share = np.minimum(0.0, weight + behind[target] - behind[source])
    share = np.exp(log_share)
    upto = np.cumsum(share)
    upto = upto - (upto - share)[first[source]]
    upto[first[1:] - 1] = np.inf
    # mass of a character's other edges; that beside a main edge is summed, as one minus it would round to nothing
    main = share > 0.5
    beside = np.add.reduceat(np.where(main, 0.0, share), first[:-1]) if total else share
    with np.errstate(divide="ignore"):
        log_rest = np.log(np.where(main, beside[source], 1.0 - share))
    return start, chars, first[:-1], source, target, piece, log_share, upto, log_rest


def _walk(lattice: Lattice, nodes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Edges of paths drawn from each character to its word's end, word after word."""
    place, parts = np.arange(len(nodes)), []
    words = len(nodes)
    while len(nodes):
        edges, drawn = lattice.first[nodes], rng.random(len(nodes))
        later = (drawn >= lattice.upto[edges]).nonzero()[0]
        drawn, edge = drawn[later], edges[later]
        while len(later):
            edge = edge + 1
            edges[later] = edge
            more = (drawn >= lattice.upto[edge]).nonzero()[0]
            later, drawn, edge = later[more], drawn[more], edge[more]
        parts.append((place, edges))
        nodes = lattice.target[edges]
        inside = nodes >= 0
        place, nodes = place[inside], nodes[inside]
    if not parts:
        return np.zeros(0, np.int64)
    place, edges = (np.concatenate(x) for x in zip(*parts, strict=True))
    # a word's edges stand side by side, one for each step
    size = np.bincount(place, minlength=words)
    step = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
    out = np.empty_like(edges)
    out[(np.cumsum(size) - size)[place] + step] = edges
    return out


def _below(top: float, where: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Gumbel draws at locations ``where`` (log masses), truncated at ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(rng.random(len(where)))) - where)


def _highest(values: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` highest values, falling; of equal ones the first."""
    if len(values) <= n:
        return np.argsort(-values, kind="stable")
    some = np.flatnonzero(values >= np.partition(values, len(values) - n)[len(values) - n])
    return some[np.argsort(-values[some], kind="stable")[:n]]


def sample(lattice: Lattice, words: np.ndarray, k: int, seed: int) -> list[tuple[np.ndarray, float, float, float]]:
    """Up to k distinct paths: (edges, log probability, perturbed value, log inclusion score)."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    top = -np.log(-np.log(rng.random()))
    # a branch: value, order of entry, path above it, place on the path, edges already used at that place
    heap: list[tuple[float, int, np.ndarray, int, tuple[int, ...]]] = []
    found, entered = [], 0
    ready = (top, _walk(lattice, lattice.start[words], rng), 0)
    while True:
        value, path, fixed = ready
        log_q = lattice.log_share[path]
        above = np.concatenate(([0.0], np.cumsum(log_q)))
        found.append((path, float(above[-1]), value))
        open_at = np.arange(fixed, len(path))
        values = _below(value, above[open_at] + lattice.log_rest[path[open_at]], rng)
        # no more branches of one path than samples can be opened
        for i in _highest(values, k + 1).tolist():
            if values[i] > -np.inf:
                entered += 1
                heapq.heappush(heap, (-float(values[i]), entered, path, int(open_at[i]), (int(path[open_at[i]]),)))
        if len(found) > k or not heap:
            break
        negative, _, path, at, used = heapq.heappop(heap)
        value = -negative
        if len(found) == k:
            return _scored(found, value)
        edges = lattice.edges_at(int(path[at]))
        edges = edges[[e not in used for e in edges.tolist()]]
        share = np.exp(lattice.log_share[edges])
        total = float(share.sum())
        edge = int(edges[min(len(edges) - 1, np.searchsorted(np.cumsum(share), rng.random() * total, side="right"))])
        left = float(share[edges != edge].sum())
        if left > 0:
            where = np.array([float(lattice.log_share[path[:at]].sum()) + np.log(left)])
            again = float(_below(value, where, rng)[0])
            entered += 1
            heapq.heappush(heap, (-again, entered, path, at, (*used, edge)))
        # words that the path above has ended
        done = int(lattice.closes(path[:at]).sum())
        here = lattice.target[edge : edge + 1]
        nodes = np.concatenate((here[here >= 0], lattice.start[words[done + 1 :]]))
        ready = (value, np.concatenate((path[:at], [edge], _walk(lattice, nodes, rng))), at + 1)
    return _scored(found, -np.inf)


def _scored(found: list[tuple[np.ndarray, float, float]], bound: float) -> list[tuple[np.ndarray, float, float, float]]:
    """log P(perturbed value > bound) of each path; 0 when every path was found."""
    out = []
    for path, log_p, value in found:
        gap = log_p - bound
        score = 0.0 if gap > 40 else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else gap
        out.append((path, log_p, value, score))
    return out


def number_words(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of the texts and the numbers of each text's words.

    A text is read with a space before it; a word is a line break, or what
    follows a run of spaces with the run. An empty text has no words.
    """
    full = [b" " + t if t else b"" for t in texts]
    raw = b"".join(full)
    body = np.frombuffer(raw, np.uint8)
    marks = np.cumsum([0, *map(len, full)])
    begins = np.zeros(len(body) + 1, bool)
    begins[marks] = True
    lines = np.flatnonzero(body == 10)
    begins[lines] = begins[lines + 1] = True
    space = body == 32
    begins[1:-1] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(begins[:-1])
    ends = np.append(starts[1:], len(body))
    hashes = np.empty(len(starts), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(starts // _BLOCK_BYTES)) + 1).tolist(), len(starts)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            at = starts[i]
            hashes[i:j] = range_hash(prefix_hash(body[at : ends[j - 1]]), starts[i:j] - at, ends[i:j] - at)
    _, first, number, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    # frequent words first, so that their lattices lie close together
    order = np.argsort(-often, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    first, number = first[order], place[number]
    distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return distinct, np.split(number, np.searchsorted(starts, marks[1:-1])) if texts else []


def _seed(doc: int | None, key: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}/{key if doc is None else doc}")


_OUT = "doc_id long, key long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def _encode(path: str, k: int, sharpness: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, sharpness)
        for unit in units(batches, most=_BATCH_BYTES):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in unit.column("text").to_pylist()]
            distinct, docs = number_words(raw)
            lattice = Lattice(distinct, vocabulary)
            rows, held = [], 0
            for doc, key, text, words in zip(unit.column("doc_id").to_pylist(), unit.column("key").to_pylist(), raw, docs, strict=True):
                paths = sample(lattice, words, k, _seed(doc, key, seed)) if len(words) else [(np.zeros(0, np.int64), 0.0, 0.0, 0.0)]
                for n, (edges, log_p, value, score) in enumerate(paths, 1):
                    ids = lattice.ids(edges, vocabulary.byte_ids)
                    rows.append((doc, key, n, ids, round(log_p, 6), round(value, 6), round(score, 6), vocabulary.decode(ids) == text))
                    held += len(edges)
                if held > 1 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
            # not beside the next one
            del lattice

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, key, n, ids, *scores, same = zip(*rows, strict=True)
    marks = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(marks), pa.array(np.concatenate(ids).astype(np.int32)))
    names = [c.split()[0] for c in _OUT.split(", ")]
    cols = [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int32()), lists, *(pa.array(s, pa.float64()) for s in scores), pa.array(same)]
    return pa.RecordBatch.from_arrays(cols, names)


def encode(docs: DataFrame, model: str = MODEL, k: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = 0) -> DataFrame:
    """Up to ``k`` distinct segmentations per row: doc_id, key, sample, ids, log_prob, perturbed, log_inclusion,
    and round_trip: whether decoding the ids gives the text back.

    ``key`` is a hash of the text; samples come in falling order of their
    perturbed log probability; ``log_inclusion`` is the log of the chance to be
    among the samples given the next perturbed value. A text with fewer
    segmentations gives them all, with score 0; a null or empty text gives one
    without ids. Equal rows draw alike; rows without a doc_id are seeded by
    their text. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    return rows.mapInArrow(_encode(model, k, sharpness, seed), _OUT)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of a segmentation; null for null ids or an id without a text."""

    @pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        vocabulary = _vocabulary(model, SHARPNESS)

        def text(own: np.ndarray) -> str | None:
            raw = vocabulary.decode(own)
            return None if raw is None else raw.decode("utf-8", "replace")

        return column.map(text, na_action="ignore").astype(object)

    return run(ids)
