import datetime
import hashlib
import json
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import metadata as md
from engram.functions import text as tx
from engram.functions import vector as vec
from engram.functions.redact import redact_df
from engram.functions.tiers import effective_tier, tier_rank
from engram.sources.sinks import json_rows

NFD = "é"


@pytest.mark.parametrize("two_step", [False, True])
def test_normalize(spark, two_step):
    cases = {
        "  a\t\tb \n c ": "a b c",
        "": "",
        " \n ": "",
        f"caf{NFD}": "café",
        " x　﻿y ": "x y",
        "keep\u0085this\x1c": "keep\u0085this\x1c",  # not white space to JavaScript
        "\U0001f600  ok": "\U0001f600 ok",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    if two_step:
        rows = tx.with_normalized(df, "t", "n").collect()
    else:
        rows = df.select("t", tx.normalize_text(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_hash_is_of_normalized_text(spark):
    df = spark.createDataFrame([(f" {NFD} x",), ("é  x\n",)], "t string")
    hashes = {r[0] for r in df.select(tx.content_hash(tx.normalize_text(F.col("t")))).collect()}
    assert hashes == {hashlib.sha256("é x".encode()).hexdigest()}


def js_hash(text):
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def test_mock_embedding(spark):
    texts = ["", "hello", "\U0001f600 emoji", "Buy groceries and milk", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", vec.mock_embedding(F.col("t")).alias("v")).collect():
        h = js_hash(row.t)
        assert len(row.v) == 1536
        want = np.array([math.sin(h + i) * 0.5 + 0.5 for i in range(1536)], dtype=np.float32)
        assert np.allclose(row.v, want, atol=1e-6)


def test_scalars(spark):
    df = spark.createDataFrame([("<a href='x'>&\U0001f600",)], "t string")
    row = df.select(
        tx.escape_markup(F.col("t")).alias("e"),
        tx.utf16_length(F.col("t")).alias("n"),
        tx.iso_millis(F.lit("2026-08-18 22:30:00.0009").cast("timestamp")).alias("iso"),
        tx.is_email(F.lit("a@b.c")).alias("mail"),
        tx.is_email(F.lit("a b@c")).alias("no_mail"),
        tx.is_uuid(F.lit("A0000000-0000-0000-0000-000000000000")).alias("loose"),
        tx.is_uuid(F.lit("A0000000-0000-0000-0000-000000000000"), strict=True).alias("strict"),
    ).first()
    assert row.e == "&lt;a href='x'&gt;&amp;\U0001f600"
    assert row.n == 15
    assert row.iso == "2026-08-18T22:30:00.000Z"
    assert (row.mail, row.no_mail, row.loose, row.strict) == (True, False, True, False)


@pytest.mark.parametrize(
    "metadata,wanted,expected",
    [
        ('{"a":1,"b":"x"}', '{"a":1.0}', True),
        ('{"a":1}', '{"a":1e0}', True),
        ('{"a":"1"}', '{"a":1}', False),
        ('{"a":1}', '{"a":"1"}', False),
        ('{"a":true}', '{"a":"true"}', False),
        ('{"a":false}', '{"a":false}', True),
        ('{"a":[1]}', '{"a":1}', False),
        ('{"a":null}', '{"a":1}', False),
        ('{"a.b":1}', '{"a.b":1}', True),
        ('{"a":{"b":1}}', '{"b":1}', False),
        ('{"source":"journal","year":2025}', '{"source":"journal","year":2025}', True),
        ('{"source":"journal","year":2024}', '{"source":"journal","year":2025}', False),
        ("{}", "{}", True),
        ("not json", "{}", True),
        ("not json", '{"a":1}', False),
    ],
)
def test_metadata_contains(spark, metadata, wanted, expected):
    df = spark.createDataFrame([(metadata, wanted)], "m string, w string")
    assert df.select(md.metadata_contains(F.col("m"), F.col("w"))).first()[0] is expected


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vec.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, -1.0, None]
    assert abs(got[3] - math.sqrt(0.5)) < 1e-12
    text = df.select(vec.vector_to_text(F.col("a")).alias("t")).select(vec.vector_from_text(F.col("t"))).first()[0]
    assert text == [1.0, 0.0]


def test_embed_with(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(10)] + [(10, None)], "id int, text string")

    def embed(texts):
        assert len(texts) <= 2
        return np.array([[float(t[1:]), 1.0] for t in texts])

    rows = vec.embed_with(df, embed, batch_size=2, dim=2).collect()
    assert {r.id: r.embedding and r.embedding[0] for r in rows} == {**{i: float(i % 3) for i in range(10)}, 10: None}
    with pytest.raises(Exception, match="wanted"):
        vec.embed_with(df, embed, batch_size=2, dim=3).collect()


def test_redact(spark):
    inner = T.StructType([T.StructField("query", T.StringType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType(
        [
            T.StructField("content", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("meta", inner),
            T.StructField("list", T.ArrayType(inner)),
            T.StructField("memory_content", T.IntegerType()),
        ]
    )
    df = spark.createDataFrame([("secret", [1.0], ("q", 1), [("kept", 2)], 5), (None, None, None, None, None)], schema)
    first, second = redact_df(df).collect()
    digest = hashlib.sha256(b"secret").hexdigest()[:8]
    assert first.content == f"[redacted:{digest}]"
    assert first.embedding == "[redacted]"
    assert first.meta.query.startswith("[redacted:") and first.meta.n == 1
    assert first["list"][0].query == "kept" and first.memory_content == 5
    assert second.content is None and second.meta is None


def test_json_dates_at_any_depth(spark):
    moment = datetime.datetime(2026, 8, 18, 22, 30)
    df = spark.createDataFrame(
        [(1, moment, [moment], {"k": moment})], "id int, at timestamp, list array<timestamp>, m map<string,timestamp>"
    )
    iso = "2026-08-18T22:30:00.000Z"
    assert json.loads(json_rows(df).first().value) == {"id": 1, "at": iso, "list": [iso], "m": {"k": iso}}


def test_tiers(spark):
    df = spark.createDataFrame([("pro", "free"), ("", "team"), (None, None), ("", "")], "k string, u string")
    assert [r[0] for r in df.select(effective_tier(F.col("k"), F.col("u"))).collect()] == ["pro", "team", "free", "free"]
    ranks = df.select(tier_rank(F.col("k"))).collect()
    assert [r[0] for r in ranks] == [2, 0, 0, 0]
    assert unicodedata.normalize("NFC", NFD) == "é"


def test_metadata_filters_that_are_no_object_match_nothing(spark):
    rows = [('{"a":1,"a":2}', f) for f in ('{"a":1}', '{"a":2}', '{"a":', "[1]", "1", '"x"', "", "{}", None)]
    df = spark.createDataFrame(rows, "m string, f string")
    got = [r[0] for r in df.select(md.metadata_contains(df["m"], df["f"])).collect()]
    assert got == [False, True, False, False, False, False, False, True, True]


def test_json_sizes(spark):
    cases = {
        '{"a":1e2}': 9, '{"a":1,"a":22}': 8, '{ "a" : 1.50 }': 9, '{"a":1e21}': 11, '{"a":1e-7}': 10, '{"a":0.000001}': 14,
        '{"a":123456789012345680000}': 27, '{"a":-0.0}': 7, '["1.0, é"]': 11, "{": None, "nan": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(tx.json_size_bytes(df["t"])).collect()] == list(cases.values())


def test_redact_maps(spark):
    df = spark.sql("select map('content', 'x', 'role', 'y', 'embedding', 'z') m, map('s', named_struct('query', 'q')) n, map('embedding', 1) d")
    row = redact_df(df).first()
    assert row.m["content"].startswith("[redacted:") and row.m["role"] == "y" and row.m["embedding"] == "[redacted]"
    assert row.n["s"]["query"].startswith("[redacted:") and row.d["embedding"] is None
