import re

import numpy as np
import xxhash

import __spark_entry__ as entry
from engram.llm import simhash
from engram.llm.graph import components

LONG = " ".join(f"w{i * i % 977}" for i in range(4000))
PAIRS = [(3, None), (1, ""), (2, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, LONG), (8, LONG), (8, LONG), (9, LONG + " tail"), (None, LONG), (None, "alone here now"), (10, "Äb äb x y z"), (11, "a b c d e")]


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in parent}


def expected(pairs):
    prints = [(i, fingerprint(t)) for i, t in pairs]
    label = classes([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted(((i, f"{p:016x}", least.get(label[p])) for i, p in prints), key=str)


def test_edge_cases(spark, documents):
    found = simhash.near_duplicates(documents(PAIRS))
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found.collect()]
    assert sorted(got, key=str) == expected(PAIRS)


def test_query_equals_brute_force(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in entry.queries()["op5_simhash_dedup"](spark, sf).collect()]
    assert sorted(got, key=str) == expected(pairs)


def test_trees_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.int64).astype(np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (150, 8)).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, (150, 8)).astype(np.uint64))
    prints = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), np.arange(40, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {r.node: r.label for r in components(simhash.links(df, leaf=64)).collect()}
    wanted = classes(prints.tolist())
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    signed = {int(np.uint64(k).view(np.int64)): v for k, v in wanted.items()}
    full = {k: got.get(k, k) for k in signed}
    assert groups(full) == groups(signed)


def test_keep_one_and_empty(spark, documents):
    kept = simhash.keep_one(documents(PAIRS))
    wanted = {i for i, _, c in expected(PAIRS) if i == c and i is not None}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(wanted)
    assert [r.text for r in rows if r.doc_id is None] == ["alone here now"]
    assert kept.columns == documents(PAIRS).columns
    assert simhash.near_duplicates(documents([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
