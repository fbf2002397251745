"""Merkle manifest of a dataset: one tree per source, their roots under one more tree, a proof per row.

Rows are ordered in each source by range partitioning, so a source of any size
is spread. A superblock is a run of ``FANOUT ** height`` leaves; first each superblock
reduces to its top (and the tops, by superblocks again, to the root of the
source). Then the leaves of a superblock and the outer nodes its proofs need,
two per level above it at most, are cogrouped: one function finishes the local
reduction, joins inner and outer siblings to proofs and folds them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import stored

FANOUT = 3
# levels in a superblock, which has 2,187 leaves
HEIGHT = 7
# leaves sorted by one task
PART_ROWS = 500_000

_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
_NODE = "tree string, place long, size long, hash string"
_OUTER = "tree string, place long, subroot string, shape string, proof string"
_PROOF = "doc_id long, leaf string, received string, subroot string, shape string, proof string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(text: str | Column = "text") -> Column:
    """SHA-256 over doc_id, source, lang, n_chars and ``text``: ``-`` for null, else byte count, ``:`` and value."""
    values = [*(F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")), F.col(text) if isinstance(text, str) else text]
    fields = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*fields), 256)


def _placed(rows: DataFrame, order: list[str], size: int = PART_ROWS) -> DataFrame:
    """Stored ``rows`` with their 0-based ``place`` in their ``tree`` and the ``size`` of the tree."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(min(spark.sparkContext.defaultParallelism, n // 20_000), n // size, 1)
    split = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    split = stored(split.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", _INDEX_BITS)), "merkle-order")
    # one row per tree and part: at most the number of trees plus the number of parts
    spans = split.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return split.join(spans, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _levels(nodes: list[str], size: int, height: int) -> list[list[str]]:
    """Levels of one superblock: up to its top, or ``height`` of them where the tree is larger than it."""
    out = [nodes]
    while len(out) <= height if size > FANOUT**height else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def _block(height: int) -> Column:
    return F.expr(f"place div {FANOUT**height}").alias("block")


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The top of each superblock, as a node of the tree of tops."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        top = _levels(rows.sort_values("place")["hash"].tolist(), size, height)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "size": [-(-size // FANOUT**height)], "hash": [top]})

    narrow = nodes.select("tree", "place", "size", "hash")
    return stored(narrow.groupBy("tree", _block(height)).applyInPandas(run, _NODE), "merkle-tops")


def _climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of superblocks, lowest first, and the root of each tree (tree, hash)."""
    levels, roots = [nodes], []
    while True:
        tops = _tops(levels[-1], height)
        roots.append(tops.where("size = 1").select("tree", "hash"))
        higher = tops.where("size > 1")
        if higher.isEmpty():
            break
        levels.append(higher)
    out = roots[0]
    for more in roots[1:]:
        out = out.union(more)
    return levels, out


def _paths(rows: pd.DataFrame, height: int) -> tuple[list[str], list[str]]:
    """Shape and siblings inside the superblock for each of its nodes, in order.

    A shape has two digits per level: the place in the run and the length of the run.
    """
    levels = _levels(rows["hash"].tolist(), int(rows["size"].iloc[0]), height)
    shapes, proofs = [""] * len(rows), [""] * len(rows)
    for i in range(len(rows)):
        at, shape, proof = i, [], []
        for level in levels[:-1]:
            start = at - at % FANOUT
            run = level[start : start + FANOUT]
            shape.append(f"{at - start}{len(run)}")
            proof += run[: at - start]
            proof += run[at - start + 1 :]
            at //= FANOUT
        shapes[i], proofs[i] = "".join(shape), "".join(proof)
    return shapes, proofs


def fold(node: str, shape: str, proof: str) -> str:
    """The root that ``node`` leads to with the siblings of its proof."""
    at = 0
    for i in range(0, len(shape), 2):
        mine, run = int(shape[i]), int(shape[i + 1])
        cut, end = at + 64 * mine, at + 64 * (run - 1)
        node = digest(proof[at:cut] + node + proof[cut:end])
        at = end
    return node


def _outer(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Proofs of ``nodes``: their siblings in the superblock, then those of the superblock."""

    def run(mine: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("place")
        shapes, proofs = _paths(mine, height)
        top = upper.iloc[0]
        return pd.DataFrame({
            "tree": mine["tree"], "place": mine["place"], "subroot": top["subroot"],
            "shape": [s + top["shape"] for s in shapes], "proof": [p + top["proof"] for p in proofs],
        })

    return _cogrouped(nodes, above, height).applyInPandas(run, _OUTER)


def _cogrouped(nodes: DataFrame, above: DataFrame, height: int):
    return nodes.groupBy("tree", _block(height)).cogroup(above.groupBy("tree", F.col("place").alias("block")))


def _proved(leaves: DataFrame, above: DataFrame, height: int) -> DataFrame:
    def run(mine: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("place")
        shapes, proofs = _paths(mine, height)
        top = upper.iloc[0]
        shapes, proofs = [s + top["shape"] for s in shapes], [p + top["proof"] for p in proofs]
        return pd.DataFrame({
            "doc_id": mine["doc_id"].astype("Int64"), "leaf": mine["hash"], "received": mine["received"], "subroot": top["subroot"],
            "shape": shapes, "proof": proofs, "folded_root": [fold(*x) for x in zip(mine["received"], shapes, proofs, strict=True)],
        })

    return _cogrouped(leaves, above, height).applyInPandas(run, _PROOF)


def manifest(docs: DataFrame, received: str | Column = "text", height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, received, subroot, root, shape, proof, folded_root, verified.

    ``leaf`` is the hash of the row (``leaf_hash``). Leaves of one source stand
    in order of doc_id (null first, then by leaf); while several nodes remain,
    every three consecutive ones become the hash of their digests. ``subroot``
    is what remains per source; the subroots, null source first, then bytewise,
    give ``root`` alike. ``proof`` holds the siblings of the leaf up to the
    root, 64 hex digits each, and ``shape`` the place and length of each run.
    ``received`` is the text to verify (a column, or an expression over the
    columns of ``docs``); its leaf is folded with the proof to ``folded_root``,
    and ``verified`` tells if that is the root. ``height`` is the number of levels
    in a superblock; it changes no row.

    Null, empty and very long texts are values like any other, and so are
    nulls in any column; equal rows are leaves of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("hash"), leaf_hash(received).alias("received"))
    leaves = _placed(stored(rows, "merkle-leaves"), ["tree", "doc_id", "hash", "received"])
    levels, subroots = _climb(leaves, height)
    sources = _placed(stored(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), "merkle-subroots"), ["source"])
    upper, roots = _climb(sources.drop("source"), height)
    root = roots.select("hash").first()
    above = roots.select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("subroot"), F.lit("").alias("shape"), F.lit("").alias("proof"))
    for level in reversed(upper):
        above = _outer(level, above, height)
    # a source's tree ends in one node, whose outer siblings are those of the source among the sources
    named = sources.select("source", F.col("hash").alias("own"), "place").join(above.drop("tree", "subroot"), "place")
    ends = stored(named.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("own").alias("subroot"), "shape", "proof"), "merkle-ends")
    above = None
    for k in range(len(levels) - 1, 0, -1):
        # trees that end at this level have one superblock in it
        ended = ends.join(levels[k].where(f"size <= {FANOUT**height}").select("tree").distinct(), "tree", "left_semi")
        above = stored(_outer(levels[k], ended if above is None else above.union(ended), height), "merkle-outer")
    if above is None:
        above = ends
    else:
        above = above.union(ends.join(levels[1].select("tree").distinct(), "tree", "left_anti"))
    found = _proved(leaves, above, height)
    value = F.lit(root[0] if root else None).cast("string")
    return found.select("doc_id", "leaf", "received", "subroot", value.alias("root"), "shape", "proof", "folded_root", (F.col("folded_root") == value).alias("verified"))
