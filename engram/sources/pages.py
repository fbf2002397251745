"""Page directory (R6, R7): pages at any depth from the blocks that hold them.

Memories are numbered once per order that pages ask for: by creation and by
update inside a namespace, by creation over all of a user. A block is
``block`` consecutive numbers of one scope, so an offset names its blocks by
division. The directory has the first key of each block; a cursor finds its
block by being sorted in with those of its scope, a thousandth of the rows.
Numbers are narrow rows; texts are stored once, by their block in the first
order, and read for the rows of the page only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.plans.ordered import numbered
from engram.schemas import DEFAULT_NAMESPACE
from engram.session import checkpoint

BLOCK = 1_000
# blocks in a row that share a directory of files, and the directories they are dealt to, per rows
RUN_BLOCKS = 64
PART_ROWS = 500_000
MAX_LISTED = 2_000

BY_CREATED, BY_UPDATED, BY_USER = "created", "updated", "user"
_SCOPE = ["kind", "user_id", "scope"]
_TEXT = ["content", "namespace", "created_at", "updated_at"]


class PageDirectory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _shape(self) -> tuple[int, int]:
        return tuple(self.spark.read.schema("block int, parts int").parquet(f"{self.path}/shape").first())

    @staticmethod
    def _part(parts: int, block: str = "block") -> Column:
        return F.pmod(F.xxhash64(*_SCOPE, F.expr(f"{block} div {RUN_BLOCKS}")), F.lit(parts)).cast("int")

    def build(self, memories: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> None:
        """Number and store the memories; ids are unique in a user."""
        parts = max(3 * memories.count() // part_rows, 1) * 4
        kinds = F.array(
            F.struct(F.lit(BY_CREATED).alias("kind"), F.col("namespace").alias("scope"), F.col("created_at").alias("at")),
            F.struct(F.lit(BY_UPDATED).alias("kind"), F.col("namespace").alias("scope"), F.col("updated_at").alias("at")),
            F.struct(F.lit(BY_USER).alias("kind"), F.lit("").alias("scope"), F.col("created_at").alias("at")),
        )
        rows = memories.select("id", "user_id", "namespace", F.explode(kinds).alias("k")).select("id", "user_id", "namespace", "k.*")
        ranked = numbered(rows, _SCOPE, [F.col("at"), F.col("id")]).withColumn("block", F.expr(f"(position - 1) div {block}"))
        ranked = checkpoint(ranked)
        home = ranked.where(F.col("kind") == BY_CREATED).select("id", "user_id", F.col("block").alias("home"))
        self._write(ranked.join(home, ["id", "user_id"]), "numbers", parts, ["user_id", "scope", "position"])
        texts = memories.select("id", "user_id", *_TEXT).join(home, ["id", "user_id"])
        texts = texts.withColumns({"kind": F.lit(BY_CREATED), "scope": F.col("namespace"), "block": F.col("home")})
        self._write(texts, "texts", parts, ["user_id", "namespace", "created_at", "id"])
        firsts = ranked.groupBy(*_SCOPE, "block").agg(F.min(F.struct("at", "id")).alias("first"), F.count("*").alias("n"))
        firsts.select(*_SCOPE, "block", "first.at", "first.id", "n").write.parquet(f"{self.path}/blocks")
        # written last: a directory without it is not there
        self.spark.createDataFrame([(block, parts)], "block int, parts int").write.parquet(f"{self.path}/shape")

    def _write(self, rows: DataFrame, name: str, parts: int, order: list[str]) -> None:
        placed = rows.withColumn("part", self._part(parts)).repartition("part", F.expr(f"block div {RUN_BLOCKS}"))
        placed.sortWithinPartitions("part", "kind", *order).write.partitionBy("part").parquet(f"{self.path}/{name}")

    def _open(self, name: str, wanted: DataFrame) -> DataFrame:
        """Rows of the ``wanted`` (scope, block); directories of none of them are not read."""
        _, parts = self._shape()
        rows = self.spark.read.schema(_NUMBERS if name == "numbers" else _TEXTS).parquet(f"{self.path}/{name}")
        blocks = wanted.select(*_SCOPE, "block").distinct()
        listed = blocks.select(self._part(parts).alias("p")).distinct().limit(MAX_LISTED + 1).collect()
        if len(listed) <= MAX_LISTED:
            rows = rows.where(F.col("part").isin([r.p for r in listed]))
        return rows.join(blocks, [*_SCOPE, "block"], "left_semi")

    def _texts(self, page: DataFrame) -> DataFrame:
        """``page`` with its rows' texts."""
        homes = page.select(F.lit(BY_CREATED).alias("kind"), "user_id", F.col("namespace").alias("scope"), F.col("home").alias("block"))
        texts = self._open("texts", homes).select("user_id", "id", *_TEXT)
        return page.drop("namespace", "home").join(texts, ["user_id", "id"])

    def list_pages(self, requests: DataFrame) -> DataFrame:
        """As ``operators.paging.list_pages``: request_id, user_id and optionally namespace, k, offset, order."""
        defaults = {"namespace": DEFAULT_NAMESPACE, "k": 100, "offset": 0, "order": "created_at"}
        for name, value in defaults.items():
            given = F.col(name) if name in requests.columns else F.lit(None)
            requests = requests.withColumn(name, F.coalesce(given, F.lit(value)))
        block, _ = self._shape()
        kind = F.when(F.col("order") == "updated_at", BY_UPDATED).otherwise(BY_CREATED)
        asked = requests.where("k > 0").select("request_id", "user_id", F.col("namespace").alias("scope"), kind.alias("kind"), F.col("offset").cast("long").alias("first"), F.col("k").cast("long").alias("k"))
        blocks = F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + k - 1) div {block}"))
        asked = checkpoint(asked.withColumn("block", F.explode(blocks)))
        rows = self._open("numbers", asked).select(*_SCOPE, "block", "position", "id", "namespace", "home")
        page = asked.join(rows, [*_SCOPE, "block"]).where("position > first and position <= first + k")
        found = page.select("request_id", "user_id", (F.col("position") - F.col("first")).cast("int").alias("rank"), "id", "namespace", "home")
        return self._texts(checkpoint(found)).drop("user_id")

    def _last_blocks(self, wants: DataFrame) -> DataFrame:
        """(request_id, last): the last block of which a row may be before the request's cursor."""
        blocks = self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks").join(wants.select(*_SCOPE).distinct(), _SCOPE, "left_semi")
        open_ended = wants.where(F.col("cursor_id").isNull()).join(blocks.groupBy(*_SCOPE).agg(F.max("block").alias("last")), _SCOPE).select("request_id", "last")
        marks = wants.where(F.col("cursor_id").isNotNull()).select(*_SCOPE, F.col("cursor_created_at").alias("at"), F.col("cursor_id").alias("id"), "request_id")
        if marks.isEmpty():
            return open_ended
        items = blocks.select(*_SCOPE, "at", "id").withColumn("request_id", F.lit(None)).unionByName(marks)
        is_block = F.col("request_id").isNull()
        # a mark sorts before the block it is the first key of
        placed = numbered(items, _SCOPE, [F.col("at"), F.col("id"), is_block], counted=is_block)
        marked = placed.where(~is_block).select("request_id", (F.col("position") - 1).alias("last"))
        return open_ended.unionByName(marked.where("last >= 0"))

    def keyset_pages(self, requests: DataFrame) -> DataFrame:
        """As ``operators.paging.keyset_pages``: pages newest first after a cursor, with the next cursor."""
        block, _ = self._shape()
        space = F.nullif(F.col("namespace"), F.lit(""))
        wants = requests.where("k > 0").select(
            "request_id", "user_id", F.coalesce(space, F.lit("")).alias("scope"), F.when(space.isNull(), BY_USER).otherwise(BY_CREATED).alias("kind"),
            F.col("k").cast("long").alias("k"), "cursor_created_at", "cursor_id",
        )
        wants = checkpoint(wants)
        # k + 1 rows before the cursor lie in its block and the ones before
        low = F.greatest(F.lit(0), F.col("last") - F.expr(f"k div {block}") - 1)
        asked = wants.join(self._last_blocks(wants), "request_id").withColumn("block", F.explode(F.sequence(low, F.col("last"))))
        asked = checkpoint(asked)
        rows = self._open("numbers", asked).select(*_SCOPE, "block", "at", "id", "namespace", "home")
        cursor = F.struct("cursor_created_at", "cursor_id")
        before = F.col("cursor_id").isNull() | (F.struct(F.col("at").alias("cursor_created_at"), F.col("id").alias("cursor_id")) < cursor)
        near = asked.join(rows, [*_SCOPE, "block"]).where(before)
        newest = Window.partitionBy("request_id").orderBy(F.desc("at"), F.desc("id"))
        near = near.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= F.col("k") + 1)
        near = near.withColumn("has_more", F.count("*").over(Window.partitionBy("request_id")) > F.col("k"))
        found = checkpoint(near.where(F.col("rank") <= F.col("k")).select("request_id", "user_id", "k", "rank", "id", "namespace", "home", "has_more"))
        is_last = F.col("has_more") & (F.col("rank") == F.col("k"))
        return self._texts(found).select(
            "request_id", "rank", "id", "content", "namespace", "created_at", "has_more",
            F.when(is_last, F.col("created_at")).alias("next_created_at"), F.when(is_last, F.col("id")).alias("next_id"),
        )


_BLOCKS = "kind string, user_id string, scope string, block long, at timestamp, id string, n long"
_NUMBERS = "id string, user_id string, namespace string, kind string, scope string, at timestamp, position long, block long, home long, part int"
_TEXTS = "id string, user_id string, content string, namespace string, created_at timestamp, updated_at timestamp, home long, kind string, scope string, block long, part int"
