"""Listing pages of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.plans.ordered import numbered
from engram.schemas import DEFAULT_NAMESPACE

_SCOPE = ["user_id", "scope", "all_spaces"]


def list_memories(
    memories: DataFrame,
    user_id: str,
    namespace: str = DEFAULT_NAMESPACE,
    limit: int = 100,
    offset: int = 0,
    order: str = "created_at",
) -> DataFrame:
    """One page of one namespace, oldest first."""
    column = order if order in ("created_at", "updated_at") else "created_at"
    return (
        memories.where((F.col("user_id") == user_id) & (F.col("namespace") == namespace))
        .select("id", "content", "namespace", "created_at", "updated_at")
        .orderBy(column, "id")
        .offset(offset)
        .limit(limit)
    )


def list_page_after(
    memories: DataFrame,
    user_id: str,
    namespace: str | None = None,
    limit: int = 50,
    cursor: tuple | None = None,
) -> DataFrame:
    """One keyset page, newest first, with ``has_more`` on each row.

    The cursor of the next page is (created_at, id) of the last row returned.
    """
    rows = memories.where(F.col("user_id") == user_id)
    if namespace:
        rows = rows.where(F.col("namespace") == namespace)
    if cursor is not None:
        at, id_ = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < id_)))
    page = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit + 1)
    # at most limit + 1 rows from here on
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    fetched = F.count("*").over(Window.partitionBy("user_id"))
    ranked = page.withColumn("rank", F.row_number().over(newest)).withColumn("has_more", fetched > limit)
    return ranked.where(F.col("rank") <= limit)


def _scoped(df: DataFrame) -> DataFrame:
    """Scope of a request: one namespace of a user, or all when null or empty."""
    space = F.nullif(F.col("namespace"), F.lit(""))
    return df.withColumn("scope", F.coalesce(space, F.lit(""))).withColumn("all_spaces", space.isNull())


def _rows_in_scopes(memories: DataFrame, wants: DataFrame, column: str, whole_users: bool) -> DataFrame:
    """Narrow memory rows of the requested scopes, once per scope they belong to."""
    in_space = F.struct(F.col("namespace").alias("scope"), F.lit(False).alias("all_spaces"))
    in_all = F.struct(F.lit("").alias("scope"), F.lit(True).alias("all_spaces"))
    kinds = F.array(in_space, in_all) if whole_users else F.array(in_space)
    rows = memories.select("user_id", "id", column, F.explode(kinds).alias("s")).select("user_id", "id", column, "s.*")
    return rows.join(wants.select(_SCOPE).distinct(), _SCOPE, "left_semi")


def _pick(places: DataFrame, wants: DataFrame, memories: DataFrame, extra: int, display: list[str]) -> DataFrame:
    """Rows at positions first+1 .. first+k+extra of each request."""
    asked = wants.select(
        "request_id",
        *_SCOPE,
        "k",
        F.posexplode(F.sequence(F.col("first") + 1, F.col("first") + F.col("k") + extra)).alias("at", "position"),
    )
    rows = asked.join(places.select(*_SCOPE, "position", "id"), [*_SCOPE, "position"])
    rows = rows.select("request_id", "k", (F.col("at") + 1).alias("rank"), "id")
    return rows.join(memories.select("id", *display), "id")


def list_pages(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Bulk R6: request_id, user_id and optionally namespace, k, offset, order per request."""
    defaults = {"namespace": DEFAULT_NAMESPACE, "k": 100, "offset": 0, "order": "created_at"}
    for name, value in defaults.items():
        given = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(given, F.lit(value)))
    wants = (
        requests.withColumn("scope", F.col("namespace"))
        .withColumn("all_spaces", F.lit(False))
        .withColumn("by_updated", F.col("order") == "updated_at")
        .withColumn("first", F.col("offset").cast("bigint"))
    )
    pages = []
    for by_updated, column in ((False, "created_at"), (True, "updated_at")):
        part = wants.where(F.col("by_updated") == by_updated)
        if by_updated and part.isEmpty():
            continue
        places = numbered(_rows_in_scopes(memories, part, column, False), _SCOPE, [F.col(column), F.col("id")])
        display = ["content", "namespace", "created_at", "updated_at"]
        pages.append(_pick(places, part, memories, 0, display))
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out.drop("k")


def keyset_pages(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Bulk R7 and R8: pages newest first after a cursor, with the next cursor.

    ``requests``: request_id, user_id, namespace (null or '' = all), k,
    cursor_created_at, cursor_id (null = first page). Cursors are sorted in with
    the rows, so a cursor whose row is gone still finds its place.
    """
    wants = _scoped(requests)
    rows = _rows_in_scopes(memories, wants, "created_at", True).withColumn("request_id", F.lit(None))
    marks = wants.where(F.col("cursor_id").isNotNull()).select(
        *_SCOPE,
        F.col("cursor_id").alias("id"),
        F.col("cursor_created_at").alias("created_at"),
        "request_id",
    )
    items = rows.unionByName(marks)
    is_row = F.col("request_id").isNull()
    # a mark sorts right after the row it names
    order = [F.col("created_at").desc(), F.col("id").desc(), is_row.desc()]
    places = numbered(items, _SCOPE, order, counted=is_row)
    after = places.where(~is_row).select("request_id", F.col("position").alias("after"))
    wants = wants.join(after, "request_id", "left").withColumn("first", F.coalesce("after", F.lit(0)))
    found = _pick(places.where(is_row), wants, memories, 1, ["content", "namespace", "created_at"])
    # the row past the page only tells that there is more
    fetched = F.count("*").over(Window.partitionBy("request_id"))
    page = found.withColumn("has_more", fetched > F.col("k")).where(F.col("rank") <= F.col("k"))
    is_last = F.col("has_more") & (F.col("rank") == F.col("k"))
    return page.select(
        "request_id",
        "rank",
        "id",
        "content",
        "namespace",
        "created_at",
        "has_more",
        F.when(is_last, F.col("created_at")).alias("next_created_at"),
        F.when(is_last, F.col("id")).alias("next_id"),
    )
