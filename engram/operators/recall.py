"""Recall: similarity queries over memories, and their text form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.metadata import filter_tags, metadata_tags
from engram.functions.text import escape_attribute, escape_markup, iso_millis
from engram.functions.vector import clamp_unit, mock_embedding
from engram.plans.topk import top_k
from engram.schemas import DEFAULT_NAMESPACE, EMBEDDING_DIM


def _with_default(requests: DataFrame, name: str, default) -> DataFrame:
    if name not in requests.columns:
        return requests.withColumn(name, F.lit(default))
    return requests.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def _matches(memories: DataFrame, requests: DataFrame, dim: int, strategy: str | None) -> DataFrame:
    """top_k with the metadata filter turned into tags when requests carry one."""
    if "metadata_filter" in requests.columns:
        requests = requests.withColumn("tags", filter_tags(F.col("metadata_filter")))
        memories = memories.withColumn("tags", metadata_tags(F.col("metadata")))
    return top_k(memories, requests, dim, strategy)


def _attach(matches: DataFrame, memories: DataFrame, columns: list[str]) -> DataFrame:
    """Fetch display columns for the few rows that won, so scoring never carries them."""
    wanted = memories.select("id", *columns)
    return matches.join(wanted, "id")


def recall(
    memories: DataFrame,
    requests: DataFrame,
    dim: int = EMBEDDING_DIM,
    strategy: str | None = None,
) -> DataFrame:
    """Bulk recall (R2; R1 with a single request row).

    ``requests``: request_id, user_id, query_embedding and optionally namespace
    ("default"), k (10), threshold (0.7), metadata_filter (JSON text).
    """
    for name, default in (("namespace", DEFAULT_NAMESPACE), ("k", 10), ("threshold", 0.7)):
        requests = _with_default(requests, name, default)
    matches = _matches(memories, requests, dim, strategy)
    rows = _attach(matches, memories, ["content", "metadata", "namespace"])
    return rows.select(
        "request_id",
        "rank",
        "id",
        "content",
        clamp_unit(F.col("sim")).alias("similarity"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        "namespace",
        "created_at",
    )


def search(
    memories: DataFrame,
    requests: DataFrame,
    dim: int = EMBEDDING_DIM,
    strategy: str | None = None,
) -> DataFrame:
    """Search with an optional namespace (null = all), default k 5, all columns, unclamped."""
    for name, default in (("k", 5), ("threshold", 0.7)):
        requests = _with_default(requests, name, default)
    if "namespace" not in requests.columns:
        requests = requests.withColumn("namespace", F.lit(None).cast("string"))
    matches = _matches(memories, requests, dim, strategy).withColumnRenamed("sim", "similarity")
    others = [c for c in memories.columns if c not in ("id", "created_at")]
    return _attach(matches, memories, others)


def nearest(
    memories: DataFrame,
    requests: DataFrame,
    dim: int = EMBEDDING_DIM,
    strategy: str | None = None,
) -> DataFrame:
    """The k nearest ids in a namespace, with no threshold."""
    everything = requests.withColumn("threshold", F.lit(float("-inf")))
    matches = top_k(memories, everything, dim, strategy)
    return matches.select("request_id", "rank", "id", F.col("sim").alias("similarity"))


def recall_text(
    spark: SparkSession,
    memories: DataFrame,
    user_id: str,
    query: str,
    namespace: str = DEFAULT_NAMESPACE,
    limit: int = 10,
    min_similarity: float = 0.7,
    metadata_filter: str | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Recall of one query text with the mock embedding."""
    request = spark.createDataFrame(
        [("1", user_id, query, namespace, limit, float(min_similarity), metadata_filter)],
        "request_id string, user_id string, query string, namespace string, k int,"
        " threshold double, metadata_filter string",
    ).withColumn("query_embedding", mock_embedding(F.col("query"), dim))
    return recall(memories, request, dim).orderBy("rank")


def memory_tag(id_: Column, namespace: Column, created_at: Column, content: Column) -> Column:
    """One memory as an escaped tag that its content cannot break out of."""
    return F.concat(
        F.lit('<memory id="'),
        escape_attribute(id_),
        F.lit('" namespace="'),
        escape_attribute(namespace),
        F.lit('" created="'),
        iso_millis(created_at),
        F.lit('">\n<content>'),
        escape_markup(content),
        F.lit("</content>\n</memory>"),
    )


def format_recall(results: DataFrame, requests: DataFrame) -> DataFrame:
    """One text per request: its tags in rank order, blank line between, '' if none.

    The list per request is bounded by the request's k.
    """
    tag = memory_tag(F.col("id"), F.col("namespace"), F.col("created_at"), F.col("content"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", tag.alias("tag"))))
    texts = results.groupBy("request_id").agg(
        F.array_join(F.transform(ranked, lambda x: x["tag"]), "\n\n").alias("text")
    )
    asked = requests.select("request_id")
    return asked.join(texts, "request_id", "left").select(
        "request_id", F.coalesce("text", F.lit("")).alias("text")
    )


# --- approximate search ----------------------------------------------------


def _plane_codes(df: DataFrame, vector_col: str, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """Add ``codes``: per hash table, the signs of ``bits`` random projections."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = 1 << np.arange(bits)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def codes(vectors: pd.Series) -> pd.Series:
        signs = np.stack(vectors.to_numpy()).astype(np.float64) @ planes > 0
        return pd.Series(list((signs.reshape(-1, tables, bits) @ weights).astype(np.int32)))

    return df.where(F.size(vector_col) == dim).withColumn("codes", codes(F.col(vector_col)))


def recall_approximate(
    memories: DataFrame,
    requests: DataFrame,
    dim: int = EMBEDDING_DIM,
    tables: int = 8,
    bits: int = 4,
    seed: int = 7,
    strategy: str | None = None,
) -> DataFrame:
    """Approximate recall (R5): random-hyperplane buckets, then exact scores inside them.

    A bucket is a scope of the same block top-k, so a hot bucket is cut into
    blocks as a hot tenant is, and candidate pairs never become rows. Every
    returned score is exact. A query also looks into the buckets one sign away
    from its own; a true neighbour is missed only when it is in none of them.
    """
    near = F.array(F.lit(0), *[F.lit(1 << i) for i in range(bits)])

    def in_buckets(df: DataFrame, vector_col: str, probing: bool = False) -> DataFrame:
        coded = _plane_codes(df, vector_col, dim, tables, bits, seed)
        bucket = F.concat_ws("\x1f", "namespace", F.col("t").cast("string"), F.col("c").cast("string"))
        placed = coded.select("*", F.posexplode("codes").alias("t", "c"))
        if probing:
            placed = placed.withColumn("flip", F.explode(near)).withColumn("c", F.col("c").bitwiseXOR(F.col("flip"))).drop("flip")
        return placed.withColumn("namespace", bucket)

    for name, default in (("namespace", DEFAULT_NAMESPACE), ("k", 10), ("threshold", 0.7)):
        requests = _with_default(requests, name, default)
    probes = in_buckets(requests, "query_embedding", probing=True)
    probes = probes.withColumn("probe", F.struct("request_id", "t", "c")).drop("request_id")
    probes = probes.withColumnRenamed("probe", "request_id")
    bucketed = in_buckets(memories, "embedding")
    hits = top_k(bucketed, probes, dim, strategy)
    hits = hits.select(F.col("request_id.request_id").alias("request_id"), "id", "created_at", "sim")
    hits = hits.dropDuplicates(["request_id", "id"])
    best = Window.partitionBy("request_id").orderBy(F.col("sim").desc(), "created_at", "id")
    limits = requests.select("request_id", "k")
    ranked = hits.withColumn("rank", F.row_number().over(best)).join(limits, "request_id")
    return ranked.where(F.col("rank") <= F.col("k")).select(
        "request_id", "rank", "id", clamp_unit(F.col("sim")).alias("similarity"), "created_at"
    )


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact answers that an approximate search found (R5), in one row."""
    hits = found.select("request_id", "id", F.lit(1).alias("hit"))
    pairs = exact.select("request_id", "id").join(hits, ["request_id", "id"], "left")
    return pairs.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
