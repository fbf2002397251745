"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and components.

SuperMinHash deals the elements of a set to the slots of its signature along
one random permutation per element: in step j an element puts j plus a random
fraction into its j-th slot, and a slot keeps the least value. So a set stops
as soon as every slot is filled, a large one after a step or two, and the
slots are less dependent on chance than those of separate hash functions.

Equal sets are one node from the start. Each node is first compared with one
head of its buckets; what is not connected then is compared in tiles of a
bucket that have a bound, every two nodes in one tile only, and of each tile
only links that connect something leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import discard, lower_ascii, mix, offsets_of, prefix_hash, range_hash, row_key, stored, units, word_ranges
from engram.llm.graph import components
from engram.plans.skew import hot_keys, salted_lookup

WORDS = 4
PERCENT = 80
BANDS, BAND_ROWS = 24, 4
SIZE = BANDS * BAND_ROWS
# nodes with fewer equal slots are not compared in full: five deviations below what 80 % of equal shingles give
AGREE = 57
# nodes and shingles on a side of a tile; rows of a tile whose pairs are looked at together
TILE, TILE_SHINGLES = 2_000, 1_000_000
OWNED_ROWS = 500
# rows that one task compares by signature, shingles that one task compares in full
TASK_ROWS, TASK_SHINGLES = 20_000, 2_000_000
HOT_PAIRS = 20_000
# bytes of text a task works on at a time; each word has its own permutation of the slots
TEXT_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)
_NOBODY = 2**63 - 1
_SEAT = "cell long, band int, node long, label long, n long, guest boolean, roams boolean, sig binary, bands array<long>"
_PRINT = "doc_id long, key long, n long, k1 long, k2 long, bands array<long>, sig binary"


def shingle_sets(unit: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each row, one after the other, and where each row starts."""
    offsets, body = offsets_of(unit.column("text"))
    body = lower_ascii(body)
    starts, ends, row = word_ranges(body, offsets)
    each = range_hash(prefix_hash(body), starts, ends)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.diff(first)
    # place of each word in its row; the last words of a row start no whole shingle, in a short row only the first word does
    left = first[row + 1] - np.arange(len(row))
    begins = np.flatnonzero((left >= words) | ((count[row] < words) & (left == count[row])))
    owner = row[begins]
    length = np.minimum(count[owner], words)
    hashes = mix(length.astype(np.uint64) * _GOLD)
    for k in range(words):
        on = length > k
        hashes[on] = mix(hashes[on] * _GOLD + each[begins[on] + k])
    bounds = np.searchsorted(owner, np.arange(n_rows + 1))
    for i in range(n_rows):
        hashes[bounds[i] : bounds[i + 1]].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def signatures(elements: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of the sets elements[bounds[i]:bounds[i + 1]]: per slot the step (high half) and the least fraction in it."""
    n_rows = len(bounds) - 1
    out = np.full((n_rows, size), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    order = None
    for step in range(size):
        if len(elements) == 0:
            break
        bits = mix(elements + np.uint64((step + 1) * int(_GOLD) % 2**64))
        at = np.uint64(step) + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(size - step)) >> np.uint64(32))
        at = at.astype(np.intp)
        here = np.arange(len(elements))
        slot = at if order is None else order[here, at].astype(np.intp)
        np.minimum.at(flat, row * size + slot, (np.uint64(step) << np.uint64(32)) | (bits >> np.uint64(32)))
        # a set whose slots are all filled takes no value of a later step
        keep = (out == _EMPTY).any(axis=1)[row]
        elements, row, at = elements[keep], row[keep], at[keep]
        if order is None:
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint32), (len(elements), 1))
        else:
            order = order[keep]
        here = np.arange(len(elements))
        order[here, at] = order[here, step]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    for r in range(rows.shape[2]):
        key = mix(key * _GOLD + rows[:, :, r])
    return key


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _print(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, most=TEXT_BYTES):
            elements, bounds = shingle_sets(unit, words)
            found = signatures(elements, bounds)
            keys = band_keys(found)
            count = np.diff(bounds)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            sigs = pa.array([r.tobytes() for r in found.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [unit.column("doc_id"), unit.column("key"), pa.array(count.astype(np.int64)), pa.array(_sums(mix(elements), bounds)),
                 pa.array(_sums(mix(elements * _GOLD + np.uint64(1)), bounds)), bands, sigs],
                ["doc_id", "key", "n", "k1", "k2", "bands", "sig"],
            )

    return run


def _pack(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, most=TEXT_BYTES):
            elements, bounds = shingle_sets(unit, words)
            sets = [elements[bounds[i] : bounds[i + 1]].tobytes() for i in range(unit.num_rows)]
            yield pa.RecordBatch.from_arrays([unit.column("node"), pa.array(np.diff(bounds)), pa.array(sets, pa.binary())], ["node", "n", "shingles"])

    return run


def _known() -> F.Column:
    return F.coalesce(F.col("doc_id"), F.lit(_NOBODY))


def _sets(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Stored (node, n, shingles) of ``nodes`` (node, source_id, source_key)."""
    wanted = rows.join(nodes, (_known() == F.col("source_id")) & (F.col("key") == F.col("source_key")))
    # rows of one doc_id and text are alike
    one = wanted.select("node", "text").dropDuplicates(["node"])
    return stored(one.mapInArrow(_pack(words), "node long, n long, shingles binary"), "shingle-sets")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values that two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(both: int, na: int, nb: int, percent: int) -> bool:
    return 100 * both >= percent * (na + nb - both)


def _overlaps(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(left, right, strict=True)], dtype="int64")


def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    side = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), SIZE)
    return pd.Series((side(left) == side(right)).sum(axis=1)).astype("int64")


def _star(rows: DataFrame, nodes: DataFrame, bands: DataFrame, words: int, percent: int) -> DataFrame:
    """Stored links (a, b) of each node with the head it shares most buckets with."""
    apart = (F.col("n") * 100 < F.col("head_n") * percent) | (F.col("head_n") * 100 < F.col("n") * percent)
    shared = bands.where((F.col("node") != F.col("head")) & ~apart).groupBy("node", "head").agg(F.count("*").alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("m"))
    pairs = stored(best.select(F.col("node").alias("b"), (-F.col("m.h")).alias("a")), "star-pairs")
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("c")), ["a"], "c", HOT_PAIRS)
    with_a = salted_lookup(pairs, nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), ["a"], hot, ["b"], "inner")
    alike = with_a.join(nodes.select(F.col("node").alias("b"), "sig"), "b").where(F.pandas_udf(_agreement, "long")("sig_a", "sig") >= AGREE)
    alike = stored(alike.select("a", "b"), "star-alike")
    used = alike.select(F.col("a").alias("node")).union(alike.select(F.col("b").alias("node"))).distinct()
    sets = _sets(rows, nodes.join(used, "node", "left_semi").select("node", "source_id", "source_key"), words)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"set_{c}"))
    told = salted_lookup(alike, side("a"), ["a"], hot, ["b"], "inner").join(side("b"), "b").withColumn("both", F.pandas_udf(_overlaps, "long")("set_a", "set_b"))
    found = stored(told.where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b"), "star-links")
    discard(pairs, alike, sets)
    return found


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The 64-bit values of each entry, without a copy."""
    data = column.combine_chunks().cast(pa.large_binary())
    _, offsets, body = data.buffers()
    marks = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1].tolist()
    return [np.frombuffer(body, np.uint64, (end - start) // 8, start) for start, end in zip(marks, marks[1:], strict=False)]


def _owned(home: dict, guest: dict, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The (home, guest) pairs this tile of ``band`` decides, those with most equal slots first.

    They have different labels, enough equal slots, and meet in no earlier band.
    """
    found = []
    for low in range(0, len(home["node"]), OWNED_ROWS):
        part = {c: home[c][low : low + OWNED_ROWS] for c in ("label", "roams", "node", "n")}
        differ = part["label"][:, None] != guest["label"][None, :]
        # two guests' labels meet in two tiles: the one of the smaller node counts
        differ &= ~part["roams"][:, None] | (part["node"][:, None] < guest["node"][None, :])
        na, nb = part["n"][:, None], guest["n"][None, :]
        differ &= (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
        i, j = np.nonzero(differ)
        i += low
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            same = (home["sig"][p] == guest["sig"][q]).sum(axis=1)
            p, q, same = p[same >= AGREE], q[same >= AGREE], same[same >= AGREE]
            late = ~(home["bands"][p, :band] == guest["bands"][q, :band]).any(axis=1)
            found.append(np.stack([p[late], q[late], same[late]]))
    p, q, same = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.argsort(-same, kind="stable")
    return p[order], q[order]


def _tiles(rows: pa.Table) -> Iterator[tuple[int, dict, dict, int]]:
    """(cell, home, guest, band) of the tiles in one task's rows."""
    column = lambda c: rows.column(c).to_numpy()
    order = np.argsort(column("cell"), kind="stable")
    data = {c: column(c) for c in ("cell", "band", "node", "label", "n", "guest", "roams")}
    data["guest"], data["roams"] = data["guest"].astype(bool), data["roams"].astype(bool)
    data["at"] = np.arange(len(order))
    data["sig"] = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(order), SIZE)
    data["bands"] = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(order), BANDS)
    shingles = _views(rows.column("shingles")) if "shingles" in rows.column_names else None
    cuts = np.flatnonzero(np.diff(data["cell"][order])) + 1
    for start, end in zip([0, *cuts], [*cuts, len(order)], strict=True):
        part, sides = order[start:end], []
        for on in (~data["guest"][part], data["guest"][part]):
            side = {c: v[part[on]] for c, v in data.items()}
            side["shingles"] = [shingles[k] for k in part[on]] if shingles else None
            sides.append(side)
        yield int(data["cell"][part[0]]), *sides, int(data["band"][part[0]])


def _meetings(percent: int):
    """The rows that are in a pair which their tile decides."""

    def run(rows: pa.Table) -> pa.Table:
        kept = [np.zeros(0, np.int64)]
        for _, home, guest, band in _tiles(rows):
            p, q = _owned(home, guest, band, percent)
            kept += [home["at"][np.unique(p)], guest["at"][np.unique(q)]]
        return rows.take(pa.array(np.concatenate(kept))).select([c.split()[0] for c in _SEAT.split(", ")])

    return run


def _joined(percent: int):
    """Links (a, b) between labels, checked on the full sets; labels that a tile has connected already are not compared again."""

    def run(rows: pa.Table) -> pa.Table:
        a, b = [], []
        for _, home, guest, band in _tiles(rows):
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for i, j in zip(*_owned(home, guest, band, percent), strict=True):
                p, q = find(home["label"][i]), find(guest["label"][j])
                if p == q:
                    continue
                x, y = home["shingles"][i], guest["shingles"][j]
                if linked(overlap(x, y), len(x), len(y), percent):
                    root[p] = q
                    a.append(home["node"][i])
                    b.append(guest["node"][j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(rows: DataFrame, nodes: DataFrame, bands: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame:
    """Stored links (a, b) between nodes of different labels in one bucket.

    In a bucket the rows of its commonest label are at home in one row of
    tiles each, all others also visit, so few strangers in a large group make
    few tiles. A tile has a bounded number of rows and of shingles on a side.
    """
    marked = bands.join(labels, F.col("node") == F.col("own"), "left").select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    counted = marked.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    mixed = counted.groupBy("key").agg(
        F.sum("c").alias("rows"), F.sum("s").alias("size"), F.count("*").alias("labels"), F.max(F.struct("c", "label", "s")).alias("bulk")
    ).where("labels > 1")
    grid = lambda n, s: F.greatest(F.ceil(n / TILE), F.ceil(s / TILE_SHINGLES)).cast("int")
    mixed = mixed.select(
        "key", F.col("bulk.label").alias("most"), grid(F.col("rows"), F.col("size")).alias("high"),
        grid(F.col("rows") - F.col("bulk.c"), F.col("size") - F.col("bulk.s")).alias("wide"),
    )
    open_rows = stored(marked.join(mixed, "key").withColumn("roams", F.col("label") != F.col("most")), "open-buckets")
    n_cells = open_rows.agg(F.sum(F.col("wide") + F.when(F.col("roams"), F.col("high")).otherwise(0))).first()[0]
    if not n_cells:
        discard(open_rows)
        return rows.sparkSession.createDataFrame([], "a long, b long")
    # signatures are looked up once per bucket and node, before a row is seated in all its tiles
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    seat = lambda guest, i, j: F.struct(F.lit(guest).alias("guest"), i.alias("i"), j.alias("j"))
    home = F.transform(each("wide"), lambda j: seat(False, spot("high"), j))
    guest = F.when(F.col("roams"), F.transform(each("high"), lambda i: seat(True, i, spot("wide"))))
    seats = F.explode(F.concat(home, F.coalesce(guest, F.array().cast("array<struct<guest:boolean,i:int,j:int>>")))).alias("seat")
    seated = open_rows.join(nodes.select("node", "sig", "bands"), "node").select("*", seats)
    seen = seated.select(F.xxhash64("key", "seat.i", "seat.j").alias("cell"), "band", "node", "label", "n", "seat.guest", "roams", "sig", "bands")
    task = F.pmod("cell", F.lit(max(-(-n_cells // TASK_ROWS), 1))).cast("int").alias("task")
    met = stored(seen.groupBy(task).applyInArrow(_meetings(percent), _SEAT), "met")
    sets = _sets(rows, nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "source_id", "source_key"), words)
    size = met.agg(F.sum("n")).first()[0] or 0
    again = met.join(sets.select("node", "shingles"), "node")
    task = F.pmod("cell", F.lit(max(-(-size // TASK_SHINGLES), 1))).cast("int").alias("task")
    found = stored(again.groupBy(task).applyInArrow(_joined(percent), "a long, b long"), "tile-links")
    discard(open_rows, met, sets)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) per row of ``docs``.

    Texts lose the case of A-Z and are cut at ASCII white space; a row's set
    holds its distinct runs of ``words`` words, or its whole word sequence if
    it has fewer. Rows link if ``percent`` % of the union of their sets is in
    both, judged on the full sets (64-bit hashes). ``component_id`` is the
    smallest doc_id reachable, the own one included; null only if no row of
    the component has one. ``kept`` marks the rows with that doc_id. Pairs
    that share one of 24 groups of 4 slots are candidates: of pairs that just
    link about 3 in a million share none.

    A null or empty text, or one of white space, has an empty set and links
    with nothing. Equal rows link; rows of one doc_id with different texts are
    judged by their texts. ``key`` tells them apart. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    prints = stored(rows.mapInArrow(_print(words), _PRINT), "prints")
    source = F.min(F.struct(_known().alias("i"), F.col("key").alias("k")))
    same = prints.where("n > 0").groupBy("k1", "k2", "n").agg(source.alias("s"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    same = same.withColumns({"node": F.monotonically_increasing_id(), "least": F.nullif(F.col("s.i"), F.lit(_NOBODY))})
    nodes = stored(same.select("node", "k1", "k2", "n", "least", F.col("s.i").alias("source_id"), F.col("s.k").alias("source_key"), "bands", "sig"), "nodes")
    every = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    heads = every.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h"), F.max("node").alias("most")).where("h.node < most")
    heads = heads.select("key", F.col("h.node").alias("head"), F.col("h.n").alias("head_n"))
    bands = stored(every.join(heads, "key"), "buckets")
    star = _star(rows, nodes, bands, words, percent)
    labels = stored(components(star), "star-labels").select(F.col("node").alias("own"), "label")
    rest = _rest(rows, nodes, bands, labels, words, percent)
    labels = components(star.union(rest)).select(F.col("node").alias("own"), "label")
    told = nodes.join(labels, F.col("node") == F.col("own"), "left").select("node", "k1", "k2", "n", "least", F.coalesce("label", "node").alias("label"))
    named = told.groupBy("label").agg(F.min("least").alias("component"))
    classes = stored(told.join(named, "label").select("k1", "k2", "n", "component"), "classes")
    hot = hot_keys(prints.groupBy("k1", "k2", "n").agg(F.count("*").alias("c")), ["k1", "k2", "n"], "c")
    found = salted_lookup(prints.select("doc_id", "key", "n", "k1", "k2"), classes, ["k1", "k2", "n"], hot, ["doc_id", "key"])
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    discard(bands)
    return found.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
