import random

import numpy as np

import __spark_entry__ as entry
from engram.llm import linededup


def chunks(text):
    raw = text.encode()
    _, lines, start, end = linededup.chunk_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(int(n), raw[a:b]) for n, a, b in zip(lines, start, end, strict=True)]


def expected(pairs):
    """Kept text per row: the smallest doc_id keeps a chunk, once; null ids are the largest."""
    last = float("inf")
    holder = {}
    shared = lambda n, c: n > 1 and c.strip(b"\n") != b""
    for i, t in pairs:
        for n, c in chunks(t or ""):
            if shared(n, c):
                holder[c] = min(holder.get(c, last), last if i is None else i)
    out = []
    for i, t in pairs:
        if t is None:
            out.append((i, None))
            continue
        kept, seen = [], set()
        for n, c in chunks(t):
            if shared(n, c) and (holder[c] < (last if i is None else i) or c in seen):
                continue
            seen.add(c)
            kept.append(c)
        out.append((i, b"\n".join(kept).decode()))
    return sorted(out, key=str)


def lines(seed, n):
    rng = random.Random(seed)
    return [f"line {rng.randrange(10**6)} of {seed}" for _ in range(n)]


PASSAGE = lines("shared", 40)
PAIRS = [
    (5, "\n".join(lines("a", 20) + PASSAGE + lines("b", 7))), (2, "\n".join(lines("c", 3) + PASSAGE)), (9, "\n".join(PASSAGE + PASSAGE)),
    (9, "\n".join(PASSAGE + PASSAGE)), (None, "\n".join(PASSAGE)), (1, None), (3, ""), (4, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "one line"), (8, "one line"),
    (10, "\n".join(lines("big", 5000))), (11, "é\nü\n" * 30), (12, "é\nü\n" * 30),
]


def test_equals_brute_force(documents):
    cut = linededup.dedup_lines(documents(PAIRS))
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == expected(PAIRS)
    assert cut.columns == [*documents(PAIRS).columns, "_cut"]


def test_query_equals_brute_force(spark, sf):
    import hashlib

    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.kept_sha256) for r in entry.queries()["op2_line_dedup"](spark, sf).collect())
    assert got == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in expected(pairs))


def test_boundaries_move_only_near_an_edit():
    text = lines("x", 300)
    before = [c for _, c in chunks("\n".join(text))]
    after = [c for _, c in chunks("\n".join([*text[:150], "new line", *text[150:]]))]
    assert len(set(before) - set(after)) <= 3


def test_chunks_cover_the_text():
    for t in ("", "\n", "a", "a\n", "\n\nb", "\n".join(lines("y", 50))):
        assert b"\n".join(c for _, c in chunks(t)) == t.encode()
        assert all(n > 1 for n, _ in chunks(t)[:-1])


def test_empty_table(documents):
    assert linededup.dedup_lines(documents([])).count() == 0
