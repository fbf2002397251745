"""Memories in versions, copy on write: a batch of writes rewrites only the partitions of its users.

A folder holds ``data/run=<name>/part=<n>`` (rows by a hash of the user) and
``manifests/<version>.json``, which names the run of each partition. A version
exists once its manifest does, which is created in one step and never
replaced, so of two writers one fails and reads the table again, and a job
that was killed leaves files that no version names.

Rows for a few partitions are written by the tasks that hold them, without a
shuffle, one file per task and partition; those for many are dealt by
partition first, so that no task writes a file for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.schemas import MEMORIES
from engram.session import checkpoint, remove
from engram.sources.manifests import Manifests, VersionConflict

PART_ROWS = 200_000
# a batch of users in at most this many partitions names them; a wider one reads all
MAX_LISTED = 10_000
# partitions that a task may write a file for
FEW_PARTS = 32

Change = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class VersionedMemories:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = MEMORIES):
        self.spark, self.path, self.schema = spark, path, schema
        self.manifests = Manifests(spark, path)

    def versions(self) -> list[int]:
        return self.manifests.versions()

    def _part(self, parts: int):
        return F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int").alias("part")

    def _write(self, rows: DataFrame, parts: int, run: str, few: bool) -> list[int]:
        """Write ``rows`` as a run; the partitions that have any. A user over the partition size fills several files.

        ``few``: the rows are known to fill at most ``FEW_PARTS`` partitions.
        """
        placed = rows.select(*self.schema.names, self._part(parts))
        if not few:
            placed = placed.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8)))
        path = f"{self.path}/data/run={run}"
        placed.sortWithinPartitions("part", "user_id", "namespace", "created_at", "id").write.partitionBy("part").parquet(path)
        written = self.spark.read.schema("part int").option("basePath", path).parquet(path)
        return [r.part for r in written.select("part").distinct().collect()]

    def _read(self, manifest: dict, wanted: set[int] | None) -> DataFrame:
        paths = [f"{self.path}/data/run={run}/part={part}" for part, run in manifest["runs"].items() if wanted is None or int(part) in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # the files alone hold the rows; the folder names are no columns of the table
        return self.spark.read.schema(self.schema).parquet(*paths)

    def create(self, memories: DataFrame, part_rows: int = PART_ROWS) -> int:
        """Version 0 of the table."""
        parts, n = 1, memories.count()
        while parts * part_rows < n:
            parts *= 2
        few = parts <= FEW_PARTS or memories.select(self._part(parts)).distinct().count() <= FEW_PARTS
        run = uuid.uuid4().hex
        self.manifests.publish(0, {"parts": parts, "runs": {str(p): run for p in self._write(memories, parts, run, few)}})
        return 0

    def read(self, version: int | None = None, users: DataFrame | None = None) -> DataFrame:
        """The table of a version (default: the last), or the rows of the ``users`` (user_id) in it."""
        manifest = self.manifests.read(self.versions()[-1] if version is None else version)
        if users is None:
            return self._read(manifest, None)
        return self._read(manifest, self._touched(manifest, users)).join(users.select("user_id").distinct(), "user_id", "left_semi").select(*self.schema.names)

    def _touched(self, manifest: dict, users: DataFrame) -> set[int] | None:
        found = users.where(F.col("user_id").isNotNull()).select(self._part(manifest["parts"])).distinct().limit(MAX_LISTED + 1).collect()
        return {r.part for r in found} if len(found) <= MAX_LISTED else None

    def commit(self, users: DataFrame, change: Change) -> tuple[int, DataFrame]:
        """A new version: ``change`` of the partitions that hold the ``users`` (user_id) of a batch; (version, outcomes).

        ``change`` takes the rows of those partitions and returns (all their
        rows after the batch, outcomes), as the functions of
        ``operators/writes.py`` do; it must touch rows of those users alone.
        Other partitions keep their files.
        """
        last = self.versions()[-1]
        manifest = self.manifests.read(last)
        touched = self._touched(manifest, users)
        before = self._read(manifest, touched)
        after, outcomes = change(before)
        run = uuid.uuid4().hex
        filled = set(self._write(after, manifest["parts"], run, touched is not None and len(touched) <= FEW_PARTS))
        if touched is not None and not filled <= touched:
            remove(self.spark, [f"{self.path}/data/run={run}"])
            raise ValueError("the change wrote rows of users that the batch does not name")
        outcomes = checkpoint(outcomes)
        kept = {p: r for p, r in manifest["runs"].items() if touched is not None and int(p) not in touched}
        try:
            self.manifests.publish(last + 1, {"parts": manifest["parts"], "runs": {**kept, **{str(p): run for p in filled}}})
        except VersionConflict:
            remove(self.spark, [f"{self.path}/data/run={run}"])
            raise
        return last + 1, outcomes

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions and the files that only they use. No writer may be at work."""
        versions = self.versions()
        live = {run for v in versions[-keep:] for run in self.manifests.read(v)["runs"].values()}
        data, fs = self.manifests.open(f"{self.path}/data")
        runs = [s.getPath() for s in fs.listStatus(data)]
        remove(self.spark, [r.toString() for r in runs if r.getName()[4:] not in live])
        remove(self.spark, [self.manifests.name(v) for v in versions[:-keep]])
