"""The corpus pipeline: documents in, sampled token ids of the kept, deduplicated, clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, linededup, pieces, simhash, supermin, toxicity
from engram.llm.common import table
from engram.session import new_dir, remove

# words of a shingle in the near-duplicate stage, where texts of a Jaccard similarity of 0.8 or more link
SHINGLE_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose expected severity is too high; the model is fitted on the labelled ones of ``docs``."""
    model = toxicity.fit(docs, toxicity.label_grades(table(spark, sf_dir, "labels")), top=2)
    return toxicity.keep_mild(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without line chunks that a smaller document has; n_chars follows the text."""
    cut = linededup.dedup_lines(docs).drop("_cut")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates, then of texts with a five-word Jaccard of 0.8: that of the smallest doc_id."""
    return simhash.keep_one(simhash.keep_one(docs), partial(supermin.near_duplicates, words=SHINGLE_WORDS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with a check that they decode to its text."""
    return pieces.encode(docs).drop("key")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", one_per_group),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# the classifier, SimHash and the sampled segmentations have no SQL form; tests compare with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, [before])
        before = path
    return docs
