import numpy as np
import pytest

from engram.llm import topk


def brute(rows, queries, k):
    out = []
    known = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in known if i in queries}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 10_000])
def test_equals_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (None, [1.0] * 5), (204, [1.0, 2.0]), (205, [2.0, 1.0]), (206, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as score", "3 as rank", "4 as query_id")
    got = topk.top_k(df, df.where("vec_id % 10 = 0 or vec_id = 204"), k=5, tile=tile)
    asked = {i for i, _ in rows if i is not None and (i % 10 == 0 or i == 204)}
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def test_large_values_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**40, 1.0]])
    assert topk.scores(a, b).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_ties_in_a_tile():
    rows, cols = topk.best_of_tile(np.zeros((2, 6)), np.arange(6), np.array([0, 9]), 3)
    assert list(zip(rows.tolist(), cols.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]
