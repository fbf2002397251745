"""Streaming jobs that end in tables: usage, usage windows, billing.

Every micro-batch writes its own folder with overwrite, so a batch that is
run again after a failure replaces its output instead of repeating it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from engram.operators.billing import CUSTOMER_CREATED, fold
from engram.operators.usage import usage_windows
from engram.plans.keyed_log import BUCKET_ROWS, KeyedLog, Run
from engram.schemas import BILLING_EVENTS, USAGE_EVENTS, USERS
from engram.session import checkpoint, exists, remove
from engram.sources.tables import billing_fields

_BINDINGS = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("user_id", T.StringType())])
_BASE_LEVEL = 100


def batch_dir(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _start(stream: DataFrame, write: Callable, checkpoint_dir: str, mode: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_table(stream: DataFrame, path: str, checkpoint_dir: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a table, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_dir(path, batch_id))

    return _start(stream, write, checkpoint_dir, "append", once)


def write_usage(
    events: DataFrame,
    path: str,
    checkpoint_dir: str,
    on_error: Callable[[Exception], None] | None = None,
    once: bool = False,
    dead_letters: str | None = None,
) -> StreamingQuery:
    """Append usage events; a failed write is reported and the stream goes on.

    With ``dead_letters`` the rows of a batch that could not be written are
    kept there, in the batch's own folder, for ``replay_usage``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for target in (path, dead_letters):
            if target is None:
                continue
            try:
                return batch.write.mode("overwrite").parquet(batch_dir(target, batch_id))
            except Exception as error:
                if on_error is not None:
                    on_error(error)

    return _start(events, write, checkpoint_dir, "append", once)


def replay_usage(spark: SparkSession, dead_letters: str, path: str) -> list[int]:
    """Move the batches of a dead-letter table to their table; the numbers of those moved.

    A batch's folder is replaced, never added to, and its dead letters go
    last, so a replay that was killed is run again without repeating a row.
    """
    schema = T.StructType([*USAGE_EVENTS.fields, T.StructField("batch", T.IntegerType())])
    held = spark.read.schema(schema).parquet(dead_letters).select("batch").distinct().orderBy("batch").collect() if exists(spark, dead_letters) else []
    for row in held:
        source = batch_dir(dead_letters, row.batch)
        spark.read.schema(USAGE_EVENTS).parquet(source).write.mode("overwrite").parquet(batch_dir(path, row.batch))
        remove(spark, [source])
    return [row.batch for row in held]


def write_usage_windows(
    events: DataFrame,
    path: str,
    checkpoint_dir: str,
    window: str = "1 hour",
    lateness: str = "10 minutes",
    final_only: bool = True,
    once: bool = False,
) -> StreamingQuery:
    """Usage per user and window.

    ``final_only`` appends each window once the watermark has passed it and
    frees its state. Otherwise every micro-batch writes all windows so far.
    """
    mode = "append" if final_only else "complete"

    def write(batch: DataFrame, batch_id: int) -> None:
        target = batch_dir(path, batch_id) if final_only else path
        batch.write.mode("overwrite").parquet(target)

    return _start(usage_windows(events, window, lateness), write, checkpoint_dir, mode, once)


class BillingTables:
    """Users and processed events after each micro-batch, in the folders of one job.

    Users, the customer ids bound to them and the processed ids are keyed logs
    (``plans/keyed_log.py``): a batch looks up the users its events name,
    folds the events over those alone, and adds the changed rows as a run. The
    manifest of a batch lists its live runs and is written last, so a batch
    that was killed anywhere starts again from what the batch before left and
    writes the same runs; no id is ever applied twice.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path = spark, path
        self.logs = {
            "users": KeyedLog(spark, f"{path}/users", USERS, "id", ["id"], bucket_rows),
            "bindings": KeyedLog(spark, f"{path}/bindings", _BINDINGS, "customer_id", ["customer_id", "user_id"], bucket_rows),
            "processed": KeyedLog(spark, f"{path}/processed", BILLING_EVENTS, "id", ["id"], bucket_rows),
        }

    def _manifest_dir(self, batch_id: int) -> str:
        return f"{self.path}/manifests/batch={batch_id}"

    def _commit(self, runs: dict[str, list[Run]], batch_id: int) -> None:
        text = json.dumps({name: [vars(run) for run in live] for name, live in runs.items()})
        self.spark.range(1, numPartitions=1).select(F.lit(text).alias("value")).write.mode("overwrite").text(self._manifest_dir(batch_id))

    def runs(self, batch_id: int) -> dict[str, list[Run]]:
        """The live runs of each log after a batch."""
        text = self.spark.read.text(self._manifest_dir(batch_id)).first().value
        return {name: [Run(**run) for run in live] for name, live in json.loads(text).items()}

    def begin(self, users: DataFrame) -> None:
        bound = users.where(F.col("stripe_customer_id").isNotNull()).select(F.col("stripe_customer_id").alias("customer_id"), F.col("id").alias("user_id"))
        size = users.count()
        # a base stands above the levels that merging a few batches reaches
        base = {name: [self.logs[name].write(rows, "base", _BASE_LEVEL, size, -1)] for name, rows in (("users", users), ("bindings", bound))}
        self._commit({**base, "processed": []}, -1)

    def users(self, batch_id: int) -> DataFrame:
        return self.logs["users"].rows(self.runs(batch_id)["users"])

    def processed(self, before: int | None = None) -> DataFrame:
        last = before - 1 if before is not None else self._last()
        return self.logs["processed"].rows(self.runs(last)["processed"])

    def _last(self) -> int:
        return self.spark.read.text(f"{self.path}/manifests").select(F.max("batch")).first()[0]

    def _concerned(self, runs: dict[str, list[Run]], events: DataFrame) -> DataFrame:
        """The users that ``events`` name or whose customer ids they name."""
        fields = billing_fields(F.col("payload"))
        named = events.select("event_type", fields["customer_id"].alias("customer_id"), fields["app_user_id"].alias("app_user_id"))
        binding = F.col("event_type") == CUSTOMER_CREATED
        bound = self.logs["bindings"].lookup(runs["bindings"], named.where(~binding).select("customer_id"))
        ids = bound.select(F.col("user_id").alias("id")).union(named.where(binding).select("app_user_id"))
        return self.logs["users"].lookup(runs["users"], ids)

    def apply(self, events: DataFrame, batch_id: int, prices: DataFrame, as_of) -> None:
        runs = self.runs(batch_id - 1)
        events = checkpoint(events)
        before = checkpoint(self._concerned(runs, events))
        held = self.logs["processed"].lookup(runs["processed"], events.select("id"))
        result = fold(before, held, events, prices, as_of)
        old = before.select("id", F.struct("tier", "stripe_customer_id").alias("old"))
        changed = result.users.join(old, "id").where(~F.struct("tier", "stripe_customer_id").eqNullSafe(F.col("old"))).drop("old")
        changed = checkpoint(changed)
        bound = changed.where(F.col("stripe_customer_id").isNotNull()).select(F.col("stripe_customer_id").alias("customer_id"), F.col("id").alias("user_id"))
        result.rejects.write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch_id}")
        after = {
            name: self.logs[name].append(runs[name], rows, batch_id)
            for name, rows in (("users", changed), ("bindings", bound), ("processed", result.processed))
        }
        # written last: until then the batch counts as not applied
        self._commit(after, batch_id)
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Deletes the runs and the manifest that neither this batch nor a retry of it reads."""
        if batch_id < 1:
            return
        kept = {(name, run) for at in (batch_id - 1, batch_id) for name, live in self.runs(at).items() for run in live}
        try:
            old = {(name, run) for name, live in self.runs(batch_id - 2).items() for run in live}
        except AnalysisException:  # cleaned by an earlier try of this batch
            return
        gone = [self.logs[name].folder(run) for name, run in old - kept]
        remove(self.spark, [*gone, self._manifest_dir(batch_id - 2)])


def apply_billing(
    inbox: DataFrame, tables: BillingTables, prices: DataFrame, as_of, checkpoint_dir: str, once: bool = False
) -> StreamingQuery:
    """Fold a stream of billing events into the users table (T4)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.apply(batch, batch_id, prices, as_of)

    return _start(inbox, write, checkpoint_dir, "append", once)
