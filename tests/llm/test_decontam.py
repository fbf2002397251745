import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from engram.llm import decontam


def made(seed, n):
    rng = random.Random(str(seed))
    return [f"w{rng.randrange(2000)}" for _ in range(n)]


def edited(words, edits, seed):
    rng, words = random.Random(str(seed)), list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[at] = f"z{rng.randrange(10**6)}"
        elif kind < 0.67:
            words.insert(at, f"y{rng.randrange(10**6)}")
        else:
            del words[at]
    return words


def fit(item, doc):
    """Least edit distance of the item to any stretch of the document."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(doc, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


ITEMS = [(i, " ".join(made(("item", i), 8 + 3 * i))) for i in range(20)]


def test_recall_and_precision_at_the_allowed_edits(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as distance")
    pairs = []
    for t in range(300):
        item = ITEMS[t % 20][1].split()
        some = edited(item, decontam.edits(len(item)) + (t % 3 == 2) * 3, t)
        pairs.append((t, " ".join([*made(("a", t), 40), *some, *made(("b", t), 40)])))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_passages(documents(pairs), items).collect()}
    wanted = {}
    for t, text in pairs:
        item = ITEMS[t % 20][1].split()
        d = fit(item, text.split())
        if d <= decontam.edits(len(item)):
            wanted[t, t % 20] = d
    assert set(got) <= set(wanted) and all(got[k] >= wanted[k] for k in got)
    assert len(got) >= 0.95 * len(wanted)


def test_edge_cases(spark, documents):
    item = ITEMS[9][1]
    items = [(9, item), (9, item), (30, item), (None, item), (31, None), (32, ""), (33, "too short item")]
    pairs = [(1, item), (1, item), (2, item.upper()), (3, f"x\n\t{item}  y"), (4, None), (5, ""), (None, item), (6, "too short item"), (7, " ".join(made("c", 30_000) + item.split())), (8, " ".join(item.split()[:20]))]
    found = decontam.find_passages(documents(pairs), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.item_id, r.distance, r.start) for r in found.collect()), key=str)
    where = {1: 0, 2: 0, 3: 1, None: 0, 7: 30_000}
    assert got == sorted([(d, i, 0, s) for d, s in [*where.items(), (1, 0)] for i in (9, 30)], key=str)
    clean = decontam.keep_clean(documents(pairs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 8] and clean.columns == documents(pairs).columns


def test_blocks_of_items(spark, documents, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents([(i, t) for i, t in ITEMS])
    whole = {tuple(r) for r in decontam.find_passages(docs, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK", 7)
    assert len(decontam.index_blocks(items, block=7)) == 3
    assert {(r[0], r[1]) for r in whole} == {(i, i) for i, _ in ITEMS}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_passages(documents([(1, "a b c")]), none).count() == 0
    assert decontam.find_passages(documents([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_query_finds_verbatim_items(spark, sf):
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op8_decontamination"](spark, sf).collect()}
    plain = lambda t: f" {' '.join(t.lower().split())} "
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    assert {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)} <= got
    assert all(fit(i.text.lower().split(), d.text.lower().split()) <= decontam.edits(len(i.text.split())) for d in docs for i in items if (d.doc_id, i.item_id) in got)


@pytest.mark.parametrize("n", [1, 7])
def test_fit_distance(n):
    rng = np.random.default_rng(n)
    windows = rng.integers(0, 3, (50, 9)).astype(np.uint64)
    item = rng.integers(0, 3, n).astype(np.uint64)
    got = decontam.fit_distance(item, windows)

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    assert got.tolist() == [min(levenshtein(item, w[:k]) for k in range(10)) for w in windows]


def test_walks_start_alike():
    words, _ = decontam.word_hashes(pa.array(["a b c d e f g h", "a b c d x f g h"]))
    walk = decontam.walks(words, np.array([0, 8]), 8, 0)
    assert (walk[0, :4] == walk[1, :4]).all()
