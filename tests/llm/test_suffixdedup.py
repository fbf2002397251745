import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from engram.llm import suffixdedup


def expected(pairs, length=50):
    """(doc_id, bytes, removed, spans, hash of the rest) by a set of all strings of smaller documents."""
    texts = [(i, (t or "").encode()) for i, t in pairs]
    least = {}
    for i, b in texts:
        for j in range(len(b) - length + 1 if i is not None else 0):
            s = b[j : j + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for j in range(len(b) - length + 1 if i is not None else 0):
            if least[b[j : j + length]] < i:
                gone[j + 1 : j + length + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefg é\n") for _ in range(n))


P, Q = text("p", 90), text("q", 50)
PAIRS = [
    (4, text(1, 200) + P + text(2, 30)), (2, P), (9, P[:60] + "X" + P[20:]), (5, text(3, 10) + Q), (6, Q + Q), (7, Q[:-1] + "é"), (8, None), (10, ""),
    (11, "z" * 200), (12, "z" * 49), (13, "z" * 50), (14, "ab" * 300), (15, "ba" * 300), (3, P), (3, P + "!"), (None, P), (None, P), (16, text(4, 30_000) + P), (17, P + P), (17, P + P),
]


def found(df, query=False):
    return sorted((tuple(r) for r in df.collect()), key=str)


def digest(df):
    from pyspark.sql import functions as F

    n = F.octet_length("kept")
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - n).cast("long"), F.size("starts").cast("long"), F.sha2("kept", 256))


def test_edge_cases(documents):
    assert found(digest(suffixdedup.dedup_strings(documents(PAIRS).repartition(4)))) == expected(PAIRS)


def test_query_equals_brute_force(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(entry.queries()["op7_suffix_dedup"](spark, sf)) == expected(pairs)


def test_small_buckets_and_batches(spark, documents, sf, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 20_000)
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    assert found(digest(suffixdedup.dedup_strings(documents(pairs).repartition(5)))) == expected(pairs)


@pytest.mark.parametrize("batch", [1, 60, 100_000])
def test_family_of_levels(batch):
    rng = np.random.default_rng(0)
    n, length, gram = 300, 6, 4
    ctx = rng.integers(0, 2, (n, 8)).astype(np.uint8)
    doc = np.sort(rng.integers(0, 40, n))
    backs = suffixdedup.matched_windows(doc, np.zeros(n, np.int64), np.full(n, 2), ctx, length, gram, batch)
    for e in range(n):
        for back in range(3):
            own = ctx[e, 2 - back : 8 - back].tobytes()
            earlier = {ctx[j, 2 - b : 8 - b].tobytes() for j in range(n) if doc[j] < doc[e] for b in range(3)}
            assert bool(int(backs[e]) >> back & 1) == (own in earlier)


def test_empty_table(documents):
    assert suffixdedup.dedup_strings(documents([])).count() == 0
