import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of the documents table from (doc_id, text) pairs, plus columns whose names clash with internal ones."""

    def make(pairs):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        extra = "key doc data label a b fp text_ _id _doc _key _c _marks bucket node".split()
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(None).cast("string") for c in extra})

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
