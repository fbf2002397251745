"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder with one ledger and one delta table per batch. The ledger
rows of a batch say what each (doc_id, version) counts for after it; the deltas
are what the batch takes away and adds. Totals are sums of deltas, so no batch
reads older deltas. A batch counts once its delta table is complete; committing
it again changes nothing, and a batch that broke off is written anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import units

TOKENIZERS = "/opt/tokenizers"
VERSION = "byte_bpe_50k"

# fixed value: how the byte-level vocabularies split a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_GROUP = ["source", "lang", "version"]
_KEY = ["doc_id", "version"]
_LEDGER = "doc_id long, version string, source string, lang string, tokens long, live boolean"
_DELTA = "source string, lang string, version string, docs long, tokens long"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, version: str = VERSION, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, version, tokens per row, by the vocabulary file ``version`` in ``folder``; a null text counts 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(f"{folder}/{version}.tiktoken")
        for unit in units(batches):
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in unit.column("text").to_pylist()]
            kept = [unit.column(c) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "version", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _complete(spark: SparkSession, store: str, batch: int) -> bool:
    fs, path = _path(spark, f"{store}/deltas/batch={batch}/_SUCCESS")
    return fs.exists(path)


def batches(spark: SparkSession, store: str) -> list[int]:
    """The committed batches in order."""
    fs, path = _path(spark, f"{store}/deltas")
    if not fs.exists(path):
        return []
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    return sorted(b for b in found if _complete(spark, store, b))


def _tables(spark: SparkSession, store: str, kind: str, known: list[int], schema: str) -> DataFrame:
    if not known:
        return spark.createDataFrame([], f"{schema}, batch int")
    reader = spark.read.schema(f"{schema}, batch int").option("basePath", f"{store}/{kind}")
    return reader.parquet(*[f"{store}/{kind}/batch={b}" for b in known])


def ledger(spark: SparkSession, store: str, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """What each (doc_id, version), or those of ``keys`` only, counts for after the batches (``before`` one)."""
    known = [b for b in batches(spark, store) if before is None or b < before]
    rows = _tables(spark, store, "ledger", known, _LEDGER)
    if keys is not None:
        rows = rows.join(keys, _KEY, "left_semi")
    latest = rows.groupBy(*_KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "live"), "batch").alias("r"))
    return latest.select(*_KEY, "r.*").where("live")


def commit(spark: SparkSession, store: str, batch: int, events: DataFrame) -> bool:
    """Apply a batch of events: doc_id, op (insert, revise or delete), source, lang, version, tokens, seq.

    Batches are committed in rising order. Per (doc_id, version) the event of
    the highest ``seq`` counts (of equal ones the greatest row); insert and
    revise set what the document counts for, delete ends it. Events without a
    doc_id, version or known op are left out; null tokens count 0. False when
    the batch was committed before; then nothing is read or written.
    """
    if _complete(spark, store, batch):
        return False
    known = batches(spark, store)
    if known and known[-1] > batch:
        raise ValueError(f"batch {batch} comes after batch {known[-1]} was committed")
    valid = events.where(F.col("doc_id").isNotNull() & F.col("version").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
    live = (F.col("op") != "delete").alias("live")
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")
    rows = valid.select(F.col("doc_id").cast("long").alias("doc_id"), "version", F.col("seq").cast("long").alias("seq"), live, *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), tokens)
    last = rows.groupBy(*_KEY).agg(F.max(F.struct("seq", "live", "source", "lang", "tokens")).alias("e"))
    mine = f"{store}/ledger/batch={batch}"
    last.select(*_KEY, "e.source", "e.lang", "e.tokens", "e.live").write.mode("overwrite").parquet(mine)
    now = spark.read.schema(_LEDGER).parquet(mine)
    old = ledger(spark, store, now.select(*_KEY), before=batch)
    signed = lambda df, sign: df.select(*_GROUP, F.lit(sign).alias("docs"), (F.col("tokens") * sign).alias("tokens"))
    change = signed(now.where("live"), 1).union(signed(old, -1))
    deltas = change.groupBy(*_GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").alias("tokens"))
    deltas.where("docs <> 0 or tokens <> 0").coalesce(1).write.mode("overwrite").parquet(f"{store}/deltas/batch={batch}")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, version, docs, tokens of the live documents, from the deltas alone; null sources and languages are groups."""
    rows = _tables(spark, store, "deltas", batches(spark, store), _DELTA)
    summed = rows.groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return summed.where("docs <> 0 or tokens <> 0")
