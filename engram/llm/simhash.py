"""SimHash near-duplicates found with vantage-point trees.

A top tree over a bounded sample splits the fingerprint space: a node holds a
vantage fingerprint and a radius, the inside child takes the fingerprints at
most that far away. Each fingerprint lives in one leaf; as a query it also goes
to every later leaf that its ball of ``radius`` bits can reach by the triangle
inequality, so each pair of leaves is searched once and no pair is missed.
Inside a leaf the same pruning goes on down to small blocks. Leaves over the
planned size are cut into a grid of cells. A cell returns a spanning forest of
its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import mix, row_key, stored, units
from engram.llm.graph import components

WORDS = 3
RADIUS = 2
LEAF = 16_384
# the top tree: at most this many leaves, from at most this many sampled fingerprints
MAX_LEAVES = 4_096
PER_LEAF = 16
_BLOCK = 64


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 (seed 42) of the word n-grams of a text, A-Z lower-cased, repeats included."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return []
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(cuts) + 1
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return [digest(joined, 42)]
    starts = [0, *(cuts[: n - words] + 1).tolist()]
    ends = [*cuts[words - 1 :].tolist(), len(joined)]
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``counts`` hashes: a bit is set where it is set in over half of them; no hashes give 0."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled) == 0:
        return out
    starts = np.concatenate(([0], np.cumsum(counts[filled])[:-1]))
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    won = (2 * votes > counts[filled][:, None]).astype(np.uint8)
    out[filled] = np.packbits(won, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            hashes, counts, seen = [], [], {}
            for text in unit.column("text").to_pylist():
                own = seen.get(text)
                if own is None:
                    own = seen[text] = np.array(shingle_hashes(text, words), np.uint64)
                hashes.append(own)
                counts.append(len(own))
            prints = majority_bits(np.concatenate(hashes), np.array(counts))
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), unit.column("key"), pa.array(prints.view(np.int64))], ["doc_id", "key", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, fp long) per row; ``key`` is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, key long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class TopTree:
    """Vantage points and radii as flat arrays; negative children are leaves (-1 - leaf)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[list[int]] = []
        self.leaves = 0
        self.root = self._build(np.unique(sample), leaves)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _build(self, points: np.ndarray, leaves: int) -> int:
        if leaves <= 1 or len(points) < 2:
            return self._leaf()
        vantage = points[np.argmax(distance(points, points[0]))]
        d = distance(points, vantage)
        radius = int(np.median(d))
        if (d <= radius).all():
            radius = int(d.max()) - 1
        inside = d <= radius
        at = len(self.nodes)
        self.nodes.append([int(vantage), radius, 0, 0])
        share = max(1, min(leaves - 1, round(leaves * inside.mean())))
        self.nodes[at][2] = self._build(points[inside], share)
        self.nodes[at][3] = self._build(points[~inside], leaves - share)
        return at

    def home(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.int64)
        stack = [(self.root, np.arange(len(prints)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            vantage, radius, left, right = self.nodes[node]
            inside = distance(prints[rows], np.uint64(vantage)) <= radius
            stack += [(left, rows[inside]), (right, rows[~inside])]
        return out

    def reached(self, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a ball of ``reach`` bits around the row may overlap."""
        rows_out, leaf_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(self.root, np.arange(len(prints)))]
        while stack:
            node, rows = stack.pop()
            if len(rows) == 0:
                continue
            if node < 0:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), -1 - node))
                continue
            vantage, radius, left, right = self.nodes[node]
            d = distance(prints[rows], np.uint64(vantage))
            stack += [(left, rows[d - reach <= radius]), (right, rows[d + reach > radius])]
        return np.concatenate(rows_out), np.concatenate(leaf_out)


class Forest:
    """Union of links between numbered nodes; the root of a class is its least node."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if (up == root).all():
                return root
            root = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            a, b = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            np.minimum.at(self.parent, a, b)


def close_pairs(points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, point) indices at most ``reach`` bits apart, by a vantage-point tree over the points."""
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if len(p) == 0 or len(q) == 0:
            continue
        d = distance(points[p], points[p[0]]) if len(p) > _BLOCK else np.zeros(1, np.int64)
        if d.max() == 0:
            for at in range(0, len(q), 1 << 12):
                for of in range(0, len(p), 1 << 10):
                    hit = np.bitwise_count(queries[q[at : at + (1 << 12)], None] ^ points[None, p[of : of + (1 << 10)]]) <= reach
                    i, j = np.nonzero(hit)
                    yield q[at + i], p[of + j]
            continue
        vantage = points[p[np.argmax(d)]]
        d, to = distance(points[p], vantage), distance(queries[q], vantage)
        radius = min(int(np.median(d)), int(d.max()) - 1)
        inside = d <= radius
        stack += [(p[inside], q[to - reach <= radius]), (p[~inside], q[to + reach > radius])]


def _cell(reach: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["fp"].to_numpy().view(np.uint64)
        home = rows["home"].to_numpy(bool)
        nodes, number = np.unique(prints, return_inverse=True)
        forest = Forest(len(nodes))
        points, queries = number[home], number[~home]
        for q, p in close_pairs(nodes[points], nodes[queries], reach):
            forest.add(queries[q], points[p])
        root = forest.find(np.arange(len(nodes)))
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[tied].view(np.int64), "b": nodes[root[tied]].view(np.int64)})

    return run


def _cells(tree: TopTree, parts: dict[int, int], reach: int):
    sizes = np.ones(tree.leaves, np.int64)
    for leaf, n in parts.items():
        sizes[leaf] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home = tree.home(prints)
            row, leaf = tree.reached(prints, reach)
            later = leaf >= home[row]
            row, leaf = row[later], leaf[later]
            own = mix(prints)
            for is_home, rows, leaves in ((True, np.arange(len(prints)), home), (False, row, leaf)):
                n = sizes[leaves]
                copies = np.repeat(np.arange(len(rows)), n)
                across = np.arange(len(copies)) - np.repeat(np.cumsum(n) - n, n)
                fixed = (own[rows[copies]] % n[copies].astype(np.uint64)).astype(np.int64)
                i, j = (fixed, across) if is_home else (across, fixed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[copies].astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                     pa.array(prints[rows[copies]].view(np.int64)), pa.array(np.full(len(copies), is_home))],
                    ["leaf", "i", "j", "fp", "home"],
                )

    return run


def links(points: DataFrame, reach: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints ``fp`` at most ``reach`` bits apart."""
    n = points.count()
    leaves = min(MAX_LEAVES, math.ceil(n / leaf))
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PER_LEAF * leaves).toPandas() if leaves > 1 else pd.DataFrame({"fp": []})
    tree = TopTree(sample["fp"].to_numpy(np.int64).view(np.uint64), leaves)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = tree.home(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            found, many = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(many)], ["leaf", "n"])

    counts = points.select("fp").mapInArrow(homes, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    # one row per leaf of the bounded tree
    parts = {r["leaf"]: math.ceil(r["n"] / (2 * leaf)) for r in counts.collect()}
    cells = points.select("fp").mapInArrow(_cells(tree, parts, reach), "leaf int, i int, j int, fp long, home boolean")
    return cells.groupBy("leaf", "i", "j").applyInPandas(_cell(reach), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, reach: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(doc_id, key, fp, component_id) per row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``reach``
    differing bits reach, directly or through others; null only if no row of
    the component has a doc_id. A null or empty text has fingerprint 0 and
    links like any other; equal rows are two rows of one component. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    labels = components(links(points, reach, leaf))
    labelled = points.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.select("fp", "label").join(named, "label").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "key", "fp", "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate class: that of the smallest doc_id.

    Of several texts under that doc_id the one with the least key stays, of
    several rows with that text one. Of classes without any doc_id each text stays once.
    """
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    found = groups(docs).where("doc_id <=> component_id")
    nameless = F.when(F.col("component_id").isNull(), F.col("key"))
    least = found.groupBy(known("component_id").alias("_i"), nameless.alias("_n")).agg(F.min("key").alias("_k"))
    # the caller's columns travel in one struct, so their names cannot clash with the ones used here
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    marked = docs.select(F.struct(*quoted).alias("row"), known("doc_id").alias("id"), row_key().alias("key"))
    kept = marked.join(least, (F.col("id") == F.col("_i")) & (F.col("key") == F.col("_k")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))
