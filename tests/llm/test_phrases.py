import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from engram.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top=2_000, longest=5, absorbed=100):
    """Result rows from (text, lang) pairs by plain counting."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {key: a for key, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = False
        for (other, q), b in frequent.items():
            if other == lang and len(q) > len(p) and 100 * b >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)):
                inside = True
        if not inside:
            cuts = [(1000 * a * n[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p), frequent[lang, p[:k]], frequent[lang, p[k:]]))
    return [
        (lang, rank, p, -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2].encode()))[:top], 1)
    ]


def made(rng, n):
    vocabulary = ["the", "Of", "new", "york", "city", "a", "b", "é", "x", "of"]
    phrase = ["new", "york", "city", "the", "a", "b"]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(30))
        at = rng.randrange(len(words) + 1)
        words[at:at] = phrase[rng.randrange(3) :][: rng.randrange(6)]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "-"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("absorbed", [100, 60])
@pytest.mark.parametrize(("part_rows", "most"), [(1_000_000, 1_000_000), (50, 40)])
def test_matches_plain_counting(spark, part_rows, most, absorbed):
    rows = made(random.Random(part_rows + absorbed), 300)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    # small bounds: several partitions, all of them over their bound, tries that spill often
    found = phrases.collocations(docs, least=5, top=40, absorbed=absorbed, part_rows=part_rows, most=most).collect()
    wanted = brute(rows, 5, 40, absorbed=absorbed)
    assert len(wanted) > 60 and sorted(map(tuple, found)) == sorted(wanted)


def test_shorter_phrases(spark):
    rows = made(random.Random(2), 200)
    docs = spark.createDataFrame(rows, "text string, lang string")
    for longest in (2, 3):
        assert sorted(map(tuple, phrases.collocations(docs, longest=longest, least=4).collect())) == sorted(brute(rows, 4, longest=longest))


def test_edges(spark, documents):
    assert phrases.collocations(documents([])).count() == 0
    assert phrases.collocations(documents([(1, None), (None, ""), (2, " ., "), (3, "a b")])).count() == 0
    # repeated rows count each, one very long text, A-Z only, ties by bytes
    rows = [(1, "É a b"), (1, "É a b"), (2, "x y. " * 50_000), (3, None), (3, "q r, é A"), (4, "q r, é A")]
    got = [tuple(r) for r in phrases.collocations(documents(rows), least=2).collect()]
    assert sorted(got) == sorted(brute([(t, "en") for _, t in rows], 2))


def test_trie_holds_its_bound():
    rng = np.random.default_rng(0)
    trie = phrases.Trie(3, 2, 7, most=500)
    total, runs = Counter(), []
    for _ in range(40):
        windows = rng.integers(1, 12, (300, 3)).astype(np.uint64) << np.uint64(59)
        total.update(map(tuple, windows.tolist()))
        runs += trie.add(windows)
        assert sum(sum(map(len, node.leaves())) for node in trie.slots.values()) <= 800
    runs += trie.spill()
    assert not trie.slots
    back = Counter()
    for part, n, data in runs:
        rows = phrases.unpack(data, 3)
        assert len(rows) == n and (trie.part(rows[:, :3]) == part).all()
        assert rows[:, :3].tolist() == sorted(rows[:, :3].tolist())
        for *words, c in rows.tolist():
            back[tuple(words)] += c
    assert back == total


def test_runs_pack_large_counts():
    rows = np.array([[1, 5, 3], [1, 6, 254], [1, 7, 255], [2, 2**63 + 1, 2**40], [9, 9, 1]], np.uint64)
    assert phrases.unpack(phrases.pack(rows), 2).tolist() == rows.tolist()


def test_bursting_container():
    rng = np.random.default_rng(1)
    node = phrases._Node(0, 2)
    windows = rng.integers(0, 2**64, (60_000, 2), dtype=np.uint64)
    windows = np.concatenate([windows, windows[:20_000]])
    rows = np.concatenate([phrases.fold_hash(windows)[:, None], windows, np.ones((len(windows), 1), np.uint64)], axis=1)
    for start in range(0, len(rows), 5_000):
        node.add(rows[start : start + 5_000])
    assert node.kids is not None
    leaves = np.concatenate(list(node.leaves()))
    assert len(leaves) == 60_000 and leaves[:, -1].sum() == 80_000 and (leaves[:, -1] == 2).sum() == 20_000


def test_query(spark, sf):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in entry.queries()["op13_collocations"](spark, sf).collect()]
    assert got and sorted(got) == sorted(brute(rows, 100))
