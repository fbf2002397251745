"""Vectors by the hash of their text, so that no text is embedded twice (V5, V6, V7).

Vectors are a keyed log (``plans/keyed_log.py``). The texts of a frame are
hashed once; the hashes the store does not have are embedded, each once, and
stored before anything reads them, so work after it that fails or runs again
calls the embedder for nothing. A vector of the wrong width is stored as a
reject, without its numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.vector import VECTOR
from engram.plans.keyed_log import BUCKET_ROWS, KeyedLog, Run
from engram.plans.skew import hot_keys, salted_lookup
from engram.schemas import EMBEDDING_DIM
from engram.session import checkpoint
from engram.sources.manifests import Manifests, VersionConflict

_STORED = T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("embedding", VECTOR), T.StructField("width", T.IntegerType())])
# texts of one task: what a lost executor makes the embedder repeat
TASK_TEXTS = 5_000

EmbedBatch = Callable[[list[str]], Sequence]


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, dim: int = EMBEDDING_DIM, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.dim = spark, dim
        self.log = KeyedLog(spark, f"{path}/vectors", _STORED, "text_hash", ["text_hash"], bucket_rows)
        self.manifests = Manifests(spark, path)

    def _runs(self) -> tuple[int, list[Run]]:
        versions = self.manifests.versions()
        return (versions[-1], [Run(**r) for r in self.manifests.read(versions[-1])["runs"]]) if versions else (-1, [])

    def rows(self) -> DataFrame:
        """text_hash, embedding (null for a reject), width."""
        return self.log.rows(self._runs()[1])

    def _publish(self, before: list[Run], runs: list[Run], version: int) -> None:
        new = [run for run in runs if run not in before]
        while True:
            try:
                return self.manifests.publish(version, {"runs": [vars(run) for run in runs]})
            except VersionConflict:
                # another writer came first: what this one added is added to that, unmerged
                last, theirs = self._runs()
                version, runs = last + 1, [*theirs, *[run for run in new if run.level == 0]]

    def _fresh(self, texts: DataFrame, embed_batch: EmbedBatch, batch_size: int) -> DataFrame:
        dim = self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), batch_size):
                    part = pdf.iloc[start : start + batch_size]
                    vectors = [np.asarray(v, np.float32).reshape(-1) for v in embed_batch(part["text"].tolist())]
                    if len(vectors) != len(part):
                        raise ValueError(f"embedder returned {len(vectors)} vectors for {len(part)} texts")
                    good = [v if len(v) == dim else None for v in vectors]
                    yield pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "embedding": good, "width": [len(v) for v in vectors]})

        return texts.mapInPandas(run, _STORED)

    def embed(
        self, df: DataFrame, embed_batch: EmbedBatch, text_col: str = "content", out_col: str = "embedding", batch_size: int = 256, retry_rejects: bool = False
    ) -> tuple[DataFrame, DataFrame]:
        """(``df`` with ``out_col``, rejects): the vector of each row's text, null for a null text.

        ``embed_batch`` gets at most ``batch_size`` different texts at a time
        and returns a vector for each. Rejects are the rows of ``df`` whose
        text got a vector of another width, with that ``width``; such texts
        are not sent again unless ``retry_rejects``.
        """
        named = df.withColumn("_hash", F.sha2(F.col(text_col), 256))
        # one pass over the texts: their hashes and how often each comes
        counts = checkpoint(named.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.count("*").alias("n")))
        version, runs = self._runs()
        seen = self.log.lookup(runs, counts.select("_hash"))
        if retry_rejects:
            seen = seen.where(F.col("embedding").isNotNull())
        unseen = counts.join(seen.select(F.col("text_hash").alias("_hash")), "_hash", "left_anti").select("_hash")
        unseen = checkpoint(unseen)
        n = unseen.count()
        if n:
            texts = named.select("_hash", F.col(text_col).alias("text")).join(unseen, "_hash", "left_semi")
            texts = texts.groupBy(F.col("_hash").alias("text_hash")).agg(F.min("text").alias("text"))
            texts = texts.repartition(-(-n // TASK_TEXTS), "text_hash")
            after = self.log.append(runs, self._fresh(texts, embed_batch, batch_size), version + 1, uuid.uuid4().hex)
            self._publish(runs, after, version + 1)
            runs = self._runs()[1]
        vectors = self.log.lookup(runs, counts.select("_hash")).select(F.col("text_hash").alias("_hash"), F.col("embedding").alias(out_col), F.col("width").alias("_width"))
        hot = hot_keys(counts, ["_hash"], "n")
        told = salted_lookup(named.drop(out_col), vectors, ["_hash"], hot, [c for c in df.columns if c not in (text_col, out_col)] or [text_col])
        rejected = F.col("_width").isNotNull() & F.col(out_col).isNull()
        rows = told.where(~rejected).drop("_hash", "_width")
        return rows, told.where(rejected).withColumnRenamed("_width", "width").drop("_hash", out_col)
