import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.functions import vector as vec
from engram.operators import writes
from engram.sources.manifests import Manifests, VersionConflict
from engram.sources.versions import VersionedMemories

AS_OF = "2025-01-01 00:00:00"
DIM = 4


def memories(spark, n=60):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), F.col("id") % 12).alias("user_id"), F.lit("ns").alias("namespace"),
        F.concat(F.lit("text "), F.col("id")).alias("content"), F.lit("{}").alias("metadata"),
    )
    moment = F.timestamp_seconds(F.col("id").cast("long"))
    return rows.withColumns({
        "embedding": vec.mock_embedding(F.col("content"), DIM), "content_hash": tx.content_hash(F.col("content")),
        "created_at": moment, "updated_at": moment,
    })


def updates(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, user_id string, content string, metadata string")


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet") if os.path.isfile(f)}


def content(df):
    return {r.id: (r.user_id, r.content, r.metadata, r.updated_at) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedMemories(spark, str(tmp_path))
    made.create(memories(spark), part_rows=8)
    return made


def test_versions_equal_plain_tables_and_keep_other_files(spark, table, tmp_path):
    embed = writes.mock_embedder(DIM)
    changes = updates(spark, [(1, "3", "u3", "new text", None), (2, "15", "u3", None, '{"a":1}'), (3, "4", "u9", "not mine", None)])
    before = files(tmp_path / "data")
    version, outcomes = table.commit(changes, lambda rows: writes.update(rows, changes, AS_OF, embed))
    assert version == 1
    whole, verdicts = writes.update(memories(spark), changes, AS_OF, embed)
    assert content(table.read(1)) == content(whole) and content(table.read(0)) == content(memories(spark))
    assert sorted(map(tuple, outcomes.collect())) == sorted(map(tuple, verdicts.collect()))
    after = files(tmp_path / "data")
    assert {f: after[f] for f in before} == before
    # only the partitions of u3 and u9 were written
    m0, m1 = table.manifests.read(0), table.manifests.read(1)
    moved = {p for p in m1["runs"] if m1["runs"][p] != m0["runs"].get(p)}
    assert len(m0["runs"]) >= 4 and 1 <= len(moved) <= 2 and {p: m0["runs"][p] for p in m0["runs"] if p not in moved} == {p: m1["runs"][p] for p in m1["runs"] if p not in moved}
    gone = spark.createDataFrame([(1, str(i), "u5") for i in range(60)], "seq long, id string, user_id string")
    table.commit(gone, lambda rows: writes.forget(rows, gone))
    assert {r.user_id for r in table.read().collect()} == {f"u{i}" for i in range(12)} - {"u5"}
    assert table.read(1).count() == 60 and table.read().count() == 55


def test_reads_only_the_users_partitions(spark, table):
    one = spark.createDataFrame([("u7",)], "user_id string")
    rows = table.read(0, one)
    assert {r.id for r in rows.collect()} == {str(i) for i in range(7, 60, 12)}
    assert len({os.path.dirname(f) for f in rows.inputFiles()}) == 1


def test_remember_appends_to_a_version(spark, table):
    asked = spark.createDataFrame([(1, "u1", "free", "fresh text", "ns"), (2, "u1", "free", "text 1", "ns")], "seq long, user_id string, tier string, content string, namespace string")

    def change(rows):
        new, outcomes = writes.remember(rows, asked, AS_OF, writes.mock_embedder(DIM))
        return rows.unionByName(new), outcomes

    _, outcomes = table.commit(asked, change)
    assert {r.seq: r.status for r in outcomes.collect()} == {1: "stored", 2: "deduped"}
    assert table.read().count() == 61


def test_conflicts_and_killed_writers(spark, table, tmp_path, monkeypatch):
    changes = updates(spark, [(1, "3", "u3", "mine", None)])
    embed = writes.mock_embedder(DIM)

    def racing(rows):
        other = updates(spark, [(1, "4", "u4", "theirs", None)])
        table.commit(other, lambda r: writes.update(r, other, AS_OF, embed))
        return writes.update(rows, changes, AS_OF, embed)

    with pytest.raises(VersionConflict):
        table.commit(changes, racing)
    assert table.versions() == [0, 1] and content(table.read())["3"][1] == "text 3"
    monkeypatch.setattr(Manifests, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        table.commit(changes, lambda rows: writes.update(rows, changes, AS_OF, embed))
    monkeypatch.undo()
    assert table.versions() == [0, 1]
    table.commit(changes, lambda rows: writes.update(rows, changes, AS_OF, embed))
    kept = content(table.read())
    assert kept["3"][1] == "mine" and kept["4"][1] == "theirs"
    table.vacuum(keep=1)
    assert table.versions() == [2] and content(table.read()) == kept
    runs = set(table.manifests.read(2)["runs"].values())
    assert {d.name[4:] for d in (tmp_path / "data").iterdir() if d.is_dir()} == runs


def test_a_change_may_not_touch_other_users(spark, table):
    with pytest.raises(ValueError, match="users"):
        table.commit(spark.createDataFrame([("u1",)], "user_id string"), lambda rows: (rows.unionByName(memories(spark).where("user_id = 'u2'").withColumn("user_id", F.lit("u0x"))).unionByName(memories(spark)), rows.limit(0)))
    assert table.versions() == [0]


def test_empty_table_and_empty_batch(spark, tmp_path):
    table = VersionedMemories(spark, str(tmp_path))
    table.create(memories(spark).limit(0))
    assert table.read().count() == 0
    none = updates(spark, [])
    version, outcomes = table.commit(none, lambda rows: writes.update(rows, none, AS_OF, writes.mock_embedder(DIM)))
    assert version == 1 and table.read().count() == 0 and outcomes.count() == 0


@pytest.mark.parametrize("few", [64, 0])
def test_few_partitions_are_written_where_their_rows_lie(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("engram.sources.versions.FEW_PARTS", few)
    made = VersionedMemories(spark, str(tmp_path))
    rows = memories(spark, 240)
    task = {r.id: r.task for r in rows.select("id", F.spark_partition_id().alias("task")).collect()}
    made.create(rows, part_rows=8)

    def widest(version):
        held = {}
        for r in made.read(version).select("id", F.input_file_name().alias("file")).collect():
            held.setdefault(r.file, set()).add(task[r.id])
        return max(len(tasks) for tasks in held.values())

    # a file has rows of one task, or of many where a shuffle has dealt them
    assert (widest(0) == 1) == (few > 0)
    changes = updates(spark, [(1, "3", "u3", "new text", None), (2, "16", "u4", None, '{"a":1}')])
    made.commit(changes, lambda r: writes.update(r, changes, AS_OF, writes.mock_embedder(DIM)))
    whole, _ = writes.update(rows, changes, AS_OF, writes.mock_embedder(DIM))
    assert content(made.read(0)) == content(rows) and content(made.read(1)) == content(whole)
    assert made.read(1).count() == 240
