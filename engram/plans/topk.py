"""Exact filtered cosine top-k for many requests at once.

A block holds some memories and some requests of the same scopes. One matrix
product scores the block and at most ``k`` rows per request leave it, so the
pairs themselves never become rows. Blocks come from one of two plans:

* few requests (a checked number of bytes): they are broadcast, and every scan
  partition of the memories is a stream of blocks; vectors are not shuffled;
* many requests: both sides are cut into blocks of bounded size per scope, so
  a hot tenant becomes a grid of blocks instead of one group.

Either way a window then ranks the block winners of each request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.plans.skew import hot_keys, salted_lookup
from engram.session import checkpoint

MAX_BROADCAST_REQUESTS = 16_384
# room of one winner in memory
WINNER_BYTES = 256
MAX_BROADCAST_BYTES = 128 << 20
MEMORY_BLOCK_ROWS = 10_000
REQUEST_BLOCK_ROWS = 2_000
_MAX_SCORES = 4_000_000  # scores held at once
_MARGIN = 1e-9  # slack of the matrix product against the exact score

REQUEST_COLUMNS = ["request_id", "user_id", "namespace", "query_embedding", "k", "threshold"]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


class _Requests:
    """Requests of a block as arrays, indexed by the scopes they search."""

    def __init__(self, table: pa.Table, dim: int):
        self.table = table.select(["request_id", "k"])
        self.vectors = _matrix(table["query_embedding"], dim)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.k = np.asarray(table["k"])
        self.threshold = np.asarray(table["threshold"])
        self.floor = self.threshold.copy()  # raised as good matches are found
        self.tags = table["tags"].to_pylist() if "tags" in table.column_names else None
        self.dim = dim
        self.by_scope: dict[tuple, list[int]] = {}
        users, spaces = table["user_id"].to_pylist(), table["namespace"].to_pylist()
        for row, scope in enumerate(zip(users, spaces)):
            if self.norms[row] > 0:  # a zero vector matches nothing
                self.by_scope.setdefault(scope, []).append(row)

    def searching(self, user, namespace) -> np.ndarray:
        in_space = self.by_scope.get((user, namespace), [])
        in_all = self.by_scope.get((user, None), [])
        return np.array(in_space + in_all, dtype=np.int64)


def _scope_groups(block: pa.Table) -> Iterator[tuple[object, object, np.ndarray]]:
    codes, values = [], []
    for name in ("user_id", "namespace"):
        encoded = block[name].combine_chunks().dictionary_encode()
        codes.append(np.asarray(encoded.indices).astype(np.int64))
        values.append(encoded.dictionary.to_pylist())
    combined = codes[0] * (len(values[1]) + 1) + codes[1]
    order = np.argsort(combined, kind="stable")
    starts = np.flatnonzero(np.diff(combined[order], prepend=-1))
    for rows in np.split(order, starts[1:]):
        if len(rows):
            yield values[0][codes[0][rows[0]]], values[1][codes[1][rows[0]]], rows


def _holds_tags(tag_lists: pa.ListArray, wanted_lists: list[list[str]]) -> np.ndarray:
    """Matrix [memory, request]: does the memory hold all tags of the request?"""
    wanted = sorted({tag for tags in wanted_lists for tag in tags})
    if not wanted:
        return np.ones((len(tag_lists), len(wanted_lists)), dtype=bool)
    position = {tag: i for i, tag in enumerate(wanted)}
    found = pc.index_in(tag_lists.flatten(), value_set=pa.array(wanted, pa.string()))
    parents = np.asarray(pc.list_parent_indices(tag_lists))
    hit = np.asarray(found.is_valid())
    held = np.zeros((len(tag_lists), len(wanted)), dtype=bool)
    held[parents[hit], np.asarray(found.drop_null())] = True
    columns = [held[:, [position[t] for t in set(tags)]].all(axis=1) for tags in wanted_lists]
    return np.stack(columns, axis=1)


def _candidates(vectors, norms, rows, reqs: _Requests, wanted: np.ndarray, allowed):
    """Pairs that can be in the answer: above the floor and near the k best of this block."""
    step = max(1, _MAX_SCORES // max(1, len(rows)))
    for start in range(0, len(wanted), step):
        req = wanted[start : start + step]
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = (vectors[rows] @ reqs.vectors[req].T) / np.outer(norms[rows], reqs.norms[req])
        keep = scores >= reqs.floor[req] - _MARGIN  # false for the NaN of a zero vector
        if allowed is not None:
            keep &= allowed[:, start : start + step]
        for col in np.flatnonzero(keep.sum(axis=0) > reqs.k[req]):
            held = np.flatnonzero(keep[:, col])
            k = reqs.k[req[col]]
            kth = np.partition(scores[held, col], len(held) - k)[len(held) - k]
            keep[held, col] = scores[held, col] >= kth - _MARGIN
        r, c = np.nonzero(keep)
        yield rows[r], req[c]


def _exact_scores(vectors, norms, rows, reqs: _Requests, req) -> np.ndarray:
    """Scores that depend on the two vectors only, not on the block around them."""
    out = np.empty(len(rows))
    step = max(1, _MAX_SCORES // reqs.dim)
    for start in range(0, len(rows), step):
        r, q = rows[start : start + step], req[start : start + step]
        dots = (vectors[r] * reqs.vectors[q]).sum(axis=1)
        out[start : start + step] = dots / (norms[r] * reqs.norms[q])
    return out


_ORDER = [("_req", "ascending"), ("sim", "descending"), ("created_at", "ascending"), ("id", "ascending")]


def _best_of_block(block: pa.Table, reqs: _Requests, carried: pa.Table | None) -> pa.Table | None:
    """Merge the matches of one block into the best rows so far."""
    block = block.filter(pc.equal(pc.list_value_length(block["embedding"]), reqs.dim))
    if not block.num_rows:
        return carried
    vectors = _matrix(block["embedding"], reqs.dim)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    picked_rows, picked_reqs = [], []
    for user, namespace, rows in _scope_groups(block):
        wanted = reqs.searching(user, namespace)
        if not len(wanted):
            continue
        allowed = None
        if reqs.tags is not None:
            tags = block["tags"].combine_chunks().take(pa.array(rows))
            allowed = _holds_tags(tags, [reqs.tags[i] for i in wanted])
        for r, q in _candidates(vectors, norms, rows, reqs, wanted, allowed):
            picked_rows.append(r)
            picked_reqs.append(q)
    if not picked_rows:
        return carried
    rows, req = np.concatenate(picked_rows), np.concatenate(picked_reqs)
    sim = _exact_scores(vectors, norms, rows, reqs, req)
    ok = sim >= reqs.threshold[req]
    rows, req, sim = rows[ok], req[ok], sim[ok]
    found = block.select(["id", "created_at"]).take(pa.array(rows))
    found = found.append_column("_req", pa.array(req)).append_column("sim", pa.array(sim))
    if carried is not None:
        found = pa.concat_tables([carried, found])
    found = found.sort_by(_ORDER)
    ids = np.asarray(found["_req"])
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    kept = found.filter(pa.array(rank < reqs.k[ids]))
    ids, sims = np.asarray(kept["_req"]), np.asarray(kept["sim"])
    full = np.bincount(ids, minlength=len(reqs.k)) >= reqs.k
    last = np.full(len(reqs.k), -np.inf)
    last[ids] = sims  # rows are in rank order, so the worst kept score stays
    reqs.floor = np.where(full, np.maximum(reqs.threshold, last), reqs.threshold)
    return kept


def _winners(kept: pa.Table, reqs: _Requests) -> pa.Table:
    picked = reqs.table.take(kept["_req"])
    return pa.table(
        {
            "request_id": picked["request_id"],
            "k": picked["k"],
            "id": kept["id"],
            "created_at": kept["created_at"],
            "sim": kept["sim"],
        }
    )


def _winner_schema(memories: DataFrame, requests: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("request_id", requests.schema["request_id"].dataType),
            T.StructField("k", T.IntegerType()),
            T.StructField("id", memories.schema["id"].dataType),
            T.StructField("created_at", memories.schema["created_at"].dataType),
            T.StructField("sim", T.DoubleType()),
        ]
    )


def _rank(winners: DataFrame) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.col("sim").desc(), "created_at", "id")
    return (
        winners.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("k"))
        .drop("k")
    )


def _bounded(requests: DataFrame, dim: int) -> pa.Table | None:
    """The requests as one table when they fit the broadcast bound, else None."""
    most = min(MAX_BROADCAST_REQUESTS, MAX_BROADCAST_BYTES // (4 * dim))
    table = requests.limit(most + 1).toArrow()
    # the filter tags have no bound of their own, so the real bytes count
    return table if table.num_rows <= most and table.nbytes <= MAX_BROADCAST_BYTES else None


def _broadcast_plan(memories: DataFrame, requests: DataFrame, table: pa.Table, dim: int) -> DataFrame:
    spark = memories.sparkSession
    shared = spark.sparkContext.broadcast(table)
    searched = spark.createDataFrame(table.select(["user_id", "namespace"])).distinct()
    m, s = memories.alias("m"), F.broadcast(searched).alias("s")
    same_space = F.col("s.namespace").isNull() | (F.col("s.namespace") == F.col("m.namespace"))
    scanned = m.join(s, (F.col("m.user_id") == F.col("s.user_id")) & same_space, "left_semi")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reqs, kept = _Requests(shared.value, dim), None
        for batch in batches:
            kept = _best_of_block(pa.Table.from_batches([batch]), reqs, kept)
        if kept is not None:
            yield from _winners(kept, reqs).to_batches()

    return scanned.mapInArrow(score, _winner_schema(memories, requests))


def _block_plan(memories: DataFrame, requests: DataFrame, dim: int, memory_rows: int, request_rows: int) -> DataFrame:
    # A scope is one namespace of a user, or all of them (all_spaces).
    asked = requests.withColumn("all_spaces", F.col("namespace").isNull()).withColumn(
        "scope", F.coalesce("namespace", F.lit(""))
    )
    keys = ["user_id", "scope", "all_spaces"]
    in_space = F.struct(F.col("namespace").alias("scope"), F.lit(False).alias("all_spaces"))
    in_all = F.struct(F.lit("").alias("scope"), F.lit(True).alias("all_spaces"))
    # repeat a memory only for the kinds of scope some request asks for
    kinds = [
        struct
        for struct, wanted in ((in_space, F.isnotnull("namespace")), (in_all, F.isnull("namespace")))
        if not requests.where(wanted).isEmpty()
    ]
    scoped = memories.withColumn("s", F.explode(F.array(*kinds or [in_space]))).select("*", "s.*").drop("s")
    n_requests = asked.groupBy(keys).agg(F.count("*").alias("n_requests"))
    n_memories = scoped.groupBy(keys).agg(F.count("*").alias("n_memories"))

    def blocks(n: str, size: int):
        return F.ceil(F.col(n) / size).cast("int")

    # one row per asked scope, stored: it is used six times
    grid = checkpoint(
        n_requests.join(n_memories, keys).select(
            *keys,
            "n_requests",
            "n_memories",
            blocks("n_memories", memory_rows).alias("m_blocks"),
            blocks("n_requests", request_rows).alias("q_blocks"),
        )
    )

    def placed(rows: DataFrame, count_col: str, own: str, repeat: str, key: str) -> DataFrame:
        facts = grid.select(*keys, "m_blocks", "q_blocks")
        hot = hot_keys(grid, keys, count_col)
        own_block = F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int")
        copies = F.sequence(F.lit(0), F.col(f"{repeat}_blocks") - 1)
        return (
            salted_lookup(rows, facts, keys, hot, [key], how="inner")
            .withColumn(f"{own}_block", own_block)
            .withColumn(f"{repeat}_block", F.explode(copies))
            .drop("m_blocks", "q_blocks")
        )

    block_keys = [*keys, "m_block", "q_block"]
    left = placed(scoped, "n_memories", "m", "q", "id").groupBy(block_keys)
    right = placed(asked, "n_requests", "q", "m", "request_id").groupBy(block_keys)
    schema = _winner_schema(memories, requests)

    def score(block: pa.Table, asked_block: pa.Table) -> pa.Table:
        reqs = _Requests(asked_block, dim)
        kept = _best_of_block(block, reqs, None) if asked_block.num_rows else None
        if kept is None:
            none = block.select(["id", "created_at"]).slice(0, 0)
            none = none.append_column("_req", pa.array([], pa.int64()))
            kept = none.append_column("sim", pa.array([], pa.float64()))
        return _winners(kept, reqs)

    return left.cogroup(right).applyInArrow(score, schema)


def top_k(
    memories: DataFrame,
    requests: DataFrame,
    dim: int,
    strategy: str | None = None,
    memory_block_rows: int = MEMORY_BLOCK_ROWS,
    request_block_rows: int = REQUEST_BLOCK_ROWS,
    ranked: bool = True,
) -> DataFrame:
    """Best ``k`` memories per request: request_id, id, created_at, sim (unclamped), rank.

    ``memories`` needs id, user_id, namespace, created_at, embedding; ``requests``
    the ``REQUEST_COLUMNS``, a null namespace meaning all of the user's. Both may
    carry ``tags`` (arrays): a memory must hold all tags of the request.
    Ties rank by created_at, then id. ``strategy`` "blocks" takes the block plan
    also for few requests; both plans give the same rows. Without ``ranked`` the
    winners of each block come as they are, with no rank and no shuffle, for a
    caller that merges them itself: at least the best ``k`` of each request.
    """
    with_tags = "tags" in requests.columns
    memory_cols = ["id", "user_id", "namespace", "created_at", "embedding"]
    typed = [
        F.col("k").cast("int").alias("k") if c == "k"
        else F.col(c).cast("double").alias(c) if c == "threshold"
        else F.col(c)
        for c in REQUEST_COLUMNS
    ]
    requests = requests.select(*typed, *(["tags"] if with_tags else []))
    requests = requests.where((F.size("query_embedding") == dim) & (F.col("k") > 0))
    memories = memories.select(*memory_cols, *(["tags"] if with_tags else []))
    table = None if strategy == "blocks" else _bounded(requests, dim)
    if table is None:
        winners = _block_plan(memories, requests, dim, memory_block_rows, request_block_rows)
        return _rank(winners) if ranked else winners.drop("k")
    winners = _broadcast_plan(memories, requests, table, dim)
    if not ranked:
        return winners.drop("k")
    best = _rank(winners)
    # at most k rows per request: within the bound they go to the memories, which then need no shuffle
    rows = pc.sum(table["k"]).as_py() or 0
    return best.hint("broadcast") if rows * WINNER_BYTES <= MAX_BROADCAST_BYTES else best


__all__ = ["top_k", "REQUEST_COLUMNS"]
