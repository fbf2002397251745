import collections
import tracemalloc

import numpy as np
import pyarrow as pa
import sentencepiece

import __spark_entry__ as entry
from engram.llm import pieces

TEXTS = ["the a é▁ x", "", None, "  two  spaces\n\nand lines ", "日本語 text ☃ \x00", "a" * 30_000, "x", "word " * 5_000]


def lattice(text):
    vocabulary = pieces._vocabulary(pieces.MODEL, pieces.SHARPNESS)
    distinct, (words,) = pieces.number_words([text.encode()])
    return vocabulary, pieces.Lattice(distinct, vocabulary), words


def test_words_cover_the_texts():
    texts = [(t or "").encode() for t in TEXTS]
    distinct, numbers = pieces.number_words(texts)
    assert len(set(distinct)) == len(distinct)
    assert [b"".join(distinct[i] for i in own)[1:] for own in numbers] == texts
    assert all(w == b"\n" or b"\n" not in w and b" " not in w.lstrip(b" ") for w in distinct)


def test_distribution_and_order():
    vocabulary, graph, words = lattice("the a é▁ x")
    first, chance = collections.Counter(), {}
    for seed in range(4000):
        drawn = pieces.sample(graph, words, 3, seed)
        assert len({tuple(path) for path, *_ in drawn}) == 3
        values = [value for _, _, value, _ in drawn]
        assert values == sorted(values, reverse=True)
        first[tuple(drawn[0][0])] += 1
        chance.update({tuple(path): np.exp(p) for path, p, _, _ in drawn})
    for path, n in first.most_common(3):
        assert abs(n / 4000 - chance[path]) < 0.03


def test_all_paths_and_inclusion():
    _, graph, words = lattice("a the")
    drawn = pieces.sample(graph, words, 10_000, 1)
    assert abs(sum(np.exp(p) for _, p, _, _ in drawn) - 1) < 1e-9
    assert all(score == 0 for *_, score in drawn)
    # the inclusion scores make the weighted sample an unbiased count of all mass
    total = np.mean([sum(np.exp(p - score) for _, p, _, score in pieces.sample(graph, words, 2, s)) for s in range(3000)])
    assert abs(total - 1) < 0.05


def test_paths_are_those_of_the_vocabulary():
    vocabulary, graph, words = lattice("ab c")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)}

    def splits(text):
        return [[]] if not text else [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in known for rest in splits(text[n:])]

    got = {tuple(model.id_to_piece(int(i)) for i in graph.ids(path, vocabulary.byte_ids)) for path, *_ in pieces.sample(graph, words, 1000, 0)}
    assert got == {tuple(s) for s in splits("▁ab▁c")}


def test_round_trip_and_edge_cases(documents):
    pairs = [*enumerate(TEXTS), (0, TEXTS[0]), (None, "no id"), (None, "no id")]
    docs = documents(pairs)
    rows = pieces.encode(docs, k=3)
    got = rows.withColumn("back", pieces.decode(rows["ids"])).collect()
    assert all(r.round_trip for r in got)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        assert all(r.back == (t or "") for r in by_id[i])
        assert len({tuple(r.ids) for r in by_id[i]}) == (3 if t and t != "x" else len(by_id[i]) // (2 if i == 0 else 1))
    assert [len(by_id[i]) for i in (1, 2)] == [1, 1] and by_id[1][0].ids == []
    twice = sorted(tuple(r)[2:7] for r in by_id[0])
    assert twice[::2] == twice[1::2]
    again = sorted(tuple(r) for r in pieces.encode(docs.repartition(5), k=3).drop("key", "ids").na.fill(-1).collect())
    assert again == sorted(tuple(r) for r in rows.drop("key", "ids").na.fill(-1).collect())
    assert pieces.encode(documents([])).count() == 0


def test_decode_unknown(spark):
    df = spark.createDataFrame([([1 << 20],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(pieces.decode(df["ids"])).collect()] == [None, None, ""]


def test_query_round_trips(spark, sf):
    rows = entry.queries()["op9_sentencepiece"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = rows.collect()
    assert all(r.round_trip for r in got) and len({r.doc_id for r in got}) == n
    assert all(r.log_inclusion <= 0 and r.log_prob <= 0 for r in got)


def test_a_words_lattice_is_made_once_for_megabytes_of_text(monkeypatch):
    made = []

    class Counted(pieces.Lattice):
        def __init__(self, words, vocabulary):
            made.append(len(words))
            super().__init__(words, vocabulary)

    monkeypatch.setattr(pieces, "Lattice", Counted)
    texts = ["some words again " * 4_000] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts), pa.array(range(40), pa.int64())], ["doc_id", "text", "key"])
    rows = list(pieces._encode(pieces.MODEL, 2, pieces.SHARPNESS, 0)(iter([batch])))
    assert made == [4] and sum(r.num_rows for r in rows) == 80
    assert all(all(r.column("round_trip").to_pylist()) for r in rows)


def test_find_and_highest_equal_a_search_and_a_sort():
    vocabulary = pieces._vocabulary(pieces.MODEL, pieces.SHARPNESS)
    rng = np.random.default_rng(1)
    edge = np.array([0, 1, 2**64 - 1], np.uint64)
    wanted = np.concatenate((rng.permutation(vocabulary.hashes), rng.integers(0, 2**64, 50_000, np.uint64), vocabulary.hashes[:2000] + np.uint64(1), vocabulary.hashes[-2000:] - np.uint64(1), edge))
    at = np.minimum(np.searchsorted(vocabulary.hashes, wanted), len(vocabulary.hashes) - 1)
    some = np.flatnonzero(vocabulary.hashes[at] == wanted)
    found, where = vocabulary.find(wanted)
    assert (found == some).all() and (where == at[some]).all()
    for n in (0, 1, 3, 4, 50):
        for values in (rng.random(n), rng.integers(0, 3, n).astype(float), np.full(n, -np.inf)):
            assert (pieces._highest(values, 3) == np.argsort(-values, kind="stable")[:3]).all()


def test_a_lattice_made_in_blocks_is_the_same(monkeypatch):
    vocabulary = pieces._vocabulary(pieces.MODEL, pieces.SHARPNESS)
    texts = [(t or "").encode() for t in TEXTS]
    whole, numbers = pieces.number_words(texts)
    one = pieces.Lattice(whole, vocabulary)
    monkeypatch.setattr(pieces, "_BLOCK_BYTES", 3)
    words, again = pieces.number_words(texts)
    assert words == whole and all((x == y).all() for x, y in zip(numbers, again, strict=True))
    many = pieces.Lattice(words, vocabulary)
    for name in ("raw", "start", "chars", "after", "first", "source", "target", "piece", "log_share", "log_rest"):
        assert np.array_equal(getattr(one, name), getattr(many, name)), name
    assert np.allclose(one.upto, many.upto, rtol=0, atol=1e-9)
    assert len(pieces.Lattice([], vocabulary).source) == 0


def test_memory_of_a_batch_of_distinct_words():
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (2, 120, 1500, 10), np.uint8)
    letters[..., 9] = 32
    texts = [t.tobytes().decode() for t in letters.reshape(240, -1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(240), pa.int64()), pa.array(texts), pa.array(range(240), pa.int64())], ["doc_id", "text", "key"])
    pieces._vocabulary(pieces.MODEL, pieces.SHARPNESS)
    tracemalloc.start()
    try:
        rows = sum(r.num_rows for r in pieces._encode(pieces.MODEL, 1, pieces.SHARPNESS, 0)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 3.6 MB of text, whose second batch is not read beside the lattice of the first
    assert rows == 240 and peak < 640 << 20, peak >> 20
