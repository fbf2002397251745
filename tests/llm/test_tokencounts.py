import collections

import pytest

import __spark_entry__ as entry
from engram.llm import tokencounts
from engram.session import new_dir

EVENT = "doc_id long, op string, source string, lang string, version string, tokens long, seq long"
BATCHES = {
    0: [(1, "insert", "s", "en", "v1", 10, 1), (2, "insert", "s", None, "v1", 5, 1), (3, "insert", None, "de", "v1", 7, 1), (1, "insert", "s", "en", "v2", 4, 1), (None, "insert", "s", "en", "v1", 99, 1), (8, "insert", "s", "en", None, 9, 1), (8, "odd", "s", "en", "v1", 9, 1), (9, "insert", "t", "en", "v1", None, 1)],
    1: [(1, "revise", "s", "en", "v1", 12, 2), (2, "delete", None, None, "v1", None, 2), (77, "delete", None, None, "v1", None, 2), (3, "revise", "t", "de", "v1", 7, 3), (3, "revise", "u", "de", "v1", 8, 2)],
    2: [(2, "insert", "s", "fr", "v1", 6, 4), (1, "delete", None, None, "v2", 0, 4), (1, "revise", "s", "en", "v1", 12, 4), (1, "revise", "s", "en", "v1", 12, 4)],
}


def expected(upto):
    state = {}
    for b in range(upto + 1):
        last = {}
        for i, op, source, lang, version, tokens, seq in BATCHES[b]:
            if i is not None and version is not None and op in ("insert", "revise", "delete") and (seq >= last.get((i, version), (0,))[0]):
                last[i, version] = (seq, op, source, lang, tokens or 0)
        for k, (_, op, *rest) in last.items():
            state.pop(k, None)
            if op != "delete":
                state[k] = rest
    sums = collections.defaultdict(lambda: [0, 0])
    for (_, version), (source, lang, tokens) in state.items():
        sums[source, lang, version][0] += 1
        sums[source, lang, version][1] += tokens
    return sorted(((*k, *v) for k, v in sums.items()), key=str)


def totals(spark, store):
    return sorted((tuple(r) for r in tokencounts.totals(spark, store).collect()), key=str)


def test_batches(spark):
    store = new_dir(spark, "test-counts")
    assert totals(spark, store) == []
    for b, rows in BATCHES.items():
        events = spark.createDataFrame(rows, EVENT).selectExpr("*", "1 as live", "2 as batch", "3 as docs")
        assert tokencounts.commit(spark, store, b, events)
        assert totals(spark, store) == expected(b)
        # a second delivery changes nothing
        assert not tokencounts.commit(spark, store, b, events)
        assert totals(spark, store) == expected(b)
    assert tokencounts.commit(spark, store, 3, spark.createDataFrame([], EVENT))
    assert totals(spark, store) == expected(2)
    with pytest.raises(ValueError):
        tokencounts.commit(spark, new := store, 2_000, spark.createDataFrame([], EVENT)) and tokencounts.commit(spark, new, 1_000, spark.createDataFrame([], EVENT))


def test_a_batch_that_broke_off_is_written_anew(spark):
    store = new_dir(spark, "test-counts")
    tokencounts.commit(spark, store, 0, spark.createDataFrame(BATCHES[0], EVENT))
    # the ledger of batch 1 was written with other rows, its deltas were not
    spark.createDataFrame([(1, "v1", "x", "x", 1000, True)], tokencounts._LEDGER).write.parquet(f"{store}/ledger/batch=1")
    assert tokencounts.batches(spark, store) == [0] and totals(spark, store) == expected(0)
    tokencounts.commit(spark, store, 1, spark.createDataFrame(BATCHES[1], EVENT))
    assert totals(spark, store) == expected(1)


def test_count_tokens(documents):
    encoding = tokencounts._encoding(f"{tokencounts.TOKENIZERS}/byte_bpe_50k.tiktoken")
    pairs = [(1, "Hello <|endoftext|> world"), (1, "Hello <|endoftext|> world"), (2, None), (3, ""), (None, "é\n\n x"), (4, "a" * 40_000)]
    got = sorted(((r.doc_id, r.tokens) for r in tokencounts.count_tokens(documents(pairs)).collect()), key=str)
    assert got == sorted(((i, len(encoding.encode_ordinary(t or ""))) for i, t in pairs), key=str)
    assert tokencounts.count_tokens(documents([])).count() == 0


def test_query_equals_brute_force(spark, sf):
    one, other = (tokencounts._encoding(f"{tokencounts.TOKENIZERS}/{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sums = collections.defaultdict(lambda: [0, 0])

    def add(key, n):
        sums[key][0] += 1
        sums[key][1] += n

    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        label = labels.get(r.doc_id)
        if r.lang == "es":
            add((r.source, r.lang, "byte_bpe_multi_50k"), len(other.encode_ordinary(r.text)))
        if label and label.quality == 0:
            continue
        import re

        text = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text) if label and label.toxic == 1 else r.text
        add((r.source, r.lang, "byte_bpe_50k"), len(one.encode_ordinary(text)))
    got = sorted(map(tuple, entry.queries()["op10_token_counts"](spark, sf).collect()))
    assert got == sorted((*k, *v) for k, v in sums.items())
