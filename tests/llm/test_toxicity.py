import random

import numpy as np

import __spark_entry__ as entry
from engram.llm import toxicity


def corpus(n, seed=0):
    """Half clean, a quarter with some bad words, a quarter with many."""
    rng = random.Random(seed)
    usual = [f"word{i}" for i in range(300)]
    bad = ["grumble", "snarl", "vile", "wretch"]
    out = []
    for i in range(n):
        grade = 0 if i % 4 < 2 else i % 4 - 1
        words = [rng.choice(usual) for _ in range(60)] + [rng.choice(bad) + rng.choice(["", "ing", "s"]) for _ in range((0, 2, 12)[grade])]
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_held_out_grades(spark, documents):
    rows = corpus(900)
    docs = documents([(i, t) for i, t, _ in rows])
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i < 600], "doc_id long, grade int")
    model = toxicity.fit(docs, grades, top=2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], g) for i, _, g in rows if i >= 600]
    assert np.mean([r.grade == g for r, g in held]) > 0.95
    assert all(r.at_least[0] >= r.at_least[1] for r, _ in held)
    assert all(abs(r.severity - sum(r.at_least)) < 1e-5 for r, _ in held)
    means = [np.mean([r.severity for r, g in held if g == k]) for k in range(3)]
    assert means[0] < 0.2 < 0.8 < means[1] < 1.3 < 1.7 < means[2]
    again = toxicity.fit(docs.repartition(7), grades, top=2)
    assert again.weights == model.weights


def test_edge_cases(spark, documents):
    rows = corpus(200)
    pairs = [(i, t) for i, t, _ in rows] + [(None, "grumble " * 30), (900, None), (901, ""), (902, "x" * 50_000 + " vile" * 20_000), (1, rows[1][1])]
    docs = documents(pairs)
    labels = [(i, int(g > 0), 0 if g == 2 else 1) for i, _, g in rows] + [(None, 1, 1), (0, None, 1), (1, 0, None), (777_777, 1, 0)]
    grades = toxicity.label_grades(spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    model = toxicity.fit(docs, grades, top=2)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(pairs)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].severity == by_id[901].severity < 0.5 < by_id[902].severity
    assert by_id[None].severity > 0.5
    mild = toxicity.keep_mild(docs, model)
    assert mild.columns == docs.columns
    assert mild.count() == sum(r.severity < toxicity.REJECT_FROM for r in got)


def test_nothing_to_learn(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = toxicity.fit(docs, none, top=2)
    assert not model.weights and toxicity.score(docs, model).count() == 2
    assert toxicity.score(documents([]), model).count() == 0
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, grade int")
    assert toxicity.keep_mild(docs, toxicity.fit(docs, one, top=2)).count() == 2


def test_query_scores_every_document(spark, sf):
    assert entry.queries()["op1_toxicity"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
