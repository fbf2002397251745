"""Latest row per key as a log of runs, merged by size.

A batch adds one run with its own rows. When ``FAN`` runs of one level exist
they are merged into one of the next, so a row is rewritten about
log(batches) times. A merged run is cut into directories by a hash of its
key; a lookup opens those its keys fall into. Which runs are live is the
caller's to record, so runs of a batch that failed are never seen.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.session import checkpoint

FAN = 4
BUCKET_ROWS = 100_000
# directories a lookup names one by one; beyond it reads all and joins
MAX_LISTED = 2_000


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    rows: int
    buckets: int
    seq: int


class KeyedLog:
    """Rows of ``schema``, unique by the columns ``unique``, looked up by the column ``by`` (one of those)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str, unique: list[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.schema = spark, path, schema
        self.by, self.unique, self.bucket_rows = by, unique, bucket_rows

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.by), F.lit(buckets)).cast("int").alias("bucket")

    def folder(self, run: Run) -> str:
        return f"{self.path}/{run.name}"

    def write(self, rows: DataFrame, name: str, level: int, most: int | None, seq: int) -> Run:
        """A run of ``rows``; with ``most``, a bound of their number, cut into buckets."""
        buckets, path = 1, f"{self.path}/{name}"
        while most is not None and buckets * self.bucket_rows < most:
            buckets *= 2
        named = rows.select(*self.schema.names, self._bucket(buckets))
        if buckets > 1:
            named = named.repartition("bucket").sortWithinPartitions("bucket", self.by)
        named.write.mode("overwrite").partitionBy("bucket").parquet(path)
        run = Run(name, level, 0, buckets, seq)
        return replace(run, rows=self._read(run).count())

    def _read(self, run: Run) -> DataFrame:
        fields = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(fields).parquet(self.folder(run))

    def _latest(self, parts: list[tuple[DataFrame, Run]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return parts[0][0].select(*self.schema.names)
        every = [df.select(F.struct(*self.schema.names).alias("row"), F.lit(run.seq).alias("seq")) for df, run in parts]
        union = every[0]
        for more in every[1:]:
            union = union.unionByName(more)
        keys = [F.col("row")[c].alias(c) for c in self.unique]
        return union.groupBy(*keys).agg(F.max_by("row", "seq").alias("row")).select("row.*")

    def rows(self, runs: list[Run]) -> DataFrame:
        """The whole table."""
        return self._latest([(self._read(run), run) for run in runs])

    def lookup(self, runs: list[Run], keys: DataFrame) -> DataFrame:
        """The rows whose ``by`` is in the one column of ``keys``."""
        # found once; every run is joined with it
        wanted = checkpoint(keys.select(F.col(keys.columns[0]).alias(self.by)).where(F.col(self.by).isNotNull()).distinct())
        most = max((run.buckets for run in runs), default=1)
        listed = wanted.select(self._bucket(most)).distinct().limit(MAX_LISTED + 1).collect() if most > 1 else []
        parts = []
        for run in runs:
            df = self._read(run)
            if run.buckets > 1 and len(listed) <= MAX_LISTED:
                df = df.where(F.col("bucket").isin(sorted({r.bucket % run.buckets for r in listed})))
            parts.append((df.join(wanted, self.by, "left_semi"), run))
        return self._latest(parts)

    def append(self, runs: list[Run], rows: DataFrame, batch_id: int, tag: str = "") -> list[Run]:
        """Runs after ``rows`` (unique) came as batch ``batch_id``; a batch that runs again writes the same runs.

        Writers that may meet tell their runs apart by a ``tag``.
        """
        added = self.write(rows, f"{batch_id}-0{tag}", 0, None, batch_id)
        out = [*runs, added] if added.rows else list(runs)
        level = 0
        while sum(run.level == level for run in out) >= FAN:
            small = [run for run in out if run.level == level]
            size = sum(run.rows for run in small)
            merged = self.write(self.rows(small), f"{batch_id}-{level + 1}{tag}", level + 1, size, max(run.seq for run in small))
            out = [run for run in out if run.level != level] + [merged]
            level += 1
        return out
