import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from engram.llm import supermin

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def brute(rows, words=4, percent=80):
    """(doc_id, set size, component) by comparing every two rows."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    name = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    return sorted(repr((doc, len(sets[i]), name(i), doc == name(i))) for i, (doc, _) in enumerate(rows))


def found(docs, **more):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in supermin.near_duplicates(docs, **more).collect())


def family(rng, size, near, edits):
    """A text and ``near`` copies of it with some words changed."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(near):
        copy = list(base)
        for at in rng.sample(range(size), rng.choice(edits)):
            copy[at] = f"v{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_links_around_the_bound(spark, words):
    rng = random.Random(words)
    texts = [t for _ in range(12) for t in family(rng, 120, 10, range(1, 8))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows, words)
    # neither all linked nor all apart
    assert 20 < len({r.split(", ")[2] for r in wanted}) < 110
    assert found(docs, words=words) == wanted


def test_chain_and_large_family(spark, monkeypatch):
    """Each text links only with its neighbours in the chain; a large family is cut into tiles."""
    rng = random.Random(3)
    words = [f"c{i}" for i in range(400)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words[6 * i : 6 * i + 80])))
    rows += [(100 + i, t) for i, t in enumerate(family(rng, 60, 150, [1, 2, 3]))]
    monkeypatch.setattr(supermin, "TILE", 20)
    monkeypatch.setattr(supermin, "TASK_ROWS", 300)
    monkeypatch.setattr(supermin, "TASK_SHINGLES", 3_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows)
    assert sum(r.split(", ")[2] == "0" for r in wanted) == 40
    assert found(docs) == wanted


def test_edges(spark, documents):
    long_text = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e"), (None, None), (4, "A B c d e"), (4, "a b c d e"), (5, "x"), (6, "X"), (7, "x y"), (7, "x y"), (7, "z"), (8, long_text), (9, long_text + " more"), (None, "lone")]
    assert found(documents(rows)) == sorted(r.replace("None, False", "None, True") if r.startswith("(None") and ", None," in r else r for r in brute(rows))
    assert supermin.near_duplicates(documents([])).count() == 0


def test_no_words_link_with_nothing(documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in supermin.near_duplicates(documents([(1, None), (2, ""), (3, "\t")])).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True)}


def test_signature_is_that_of_one_element_at_a_time():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 3, 40, 500, 3_000]
    elements = np.unique(rng.integers(0, 2**64, sum(sizes), dtype=np.uint64))
    rng.shuffle(elements)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = supermin.signatures(elements, bounds)
    for i, n in enumerate(sizes):
        least = [supermin._EMPTY] * supermin.SIZE
        for e in elements[bounds[i] : bounds[i + 1]] if n < 100 else ():
            order = list(range(supermin.SIZE))
            for step in range(supermin.SIZE):
                bits = int(supermin.mix(np.array([(int(e) + (step + 1) * int(supermin._GOLD)) % 2**64], np.uint64))[0])
                at = step + (((bits & 0xFFFFFFFF) * (supermin.SIZE - step)) >> 32)
                order[step], order[at] = order[at], order[step]
                least[order[step]] = min(least[order[step]], (step << 32) | bits >> 32)
        if n < 100:
            assert got[i].tolist() == [int(x) for x in least]
        else:
            assert (got[i] != supermin._EMPTY).all()


def test_estimates_and_candidates():
    """Equal slots follow the similarity, and pairs at 0.8 share a band."""
    rng = np.random.default_rng(6)
    shares, apart = [], 0
    for _ in range(300):
        n = int(rng.integers(20, 400))
        both, own = rng.integers(0, 2**64, 8 * n, dtype=np.uint64), rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = np.concatenate([both, own[:n]]), np.concatenate([both, own[n:]])
        x, y = supermin.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        shares.append((x == y).mean())
        keys = supermin.band_keys(np.stack([x, y]))
        apart += not (keys[0] == keys[1]).any()
        assert (x.astype(np.uint8) == y.astype(np.uint8)).sum() >= supermin.AGREE
    assert abs(np.mean(shares) - 0.8) < 0.01 and apart == 0


def test_sets_of_a_unit():
    texts = ["a b c d e", None, "A  b\nC", "", "x x x x x x", "é"]
    unit = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    _, bounds = supermin.shingle_sets(unit, 4)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in entry.queries()["op12_supermin_dedup"](spark, sf).collect())
    assert got == brute(rows)


def test_signatures_and_sets_are_joined_once(spark, monkeypatch):
    """A row of a bucket takes up its signature before it is seated in its tiles, and what has met keeps it."""
    joins, write = {}, supermin.stored

    def spy(df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return write(df, name)

    monkeypatch.setattr(supermin, "stored", spy)
    rows = list(enumerate(family(random.Random(8), 120, 40, range(1, 8))))
    wanted = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted
    assert joins["met"] == 1 and joins["tile-links"] == 1
