import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from engram.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_hash(r, text):
    values = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and per node its levels of (siblings before, siblings after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = nodes[at[i] - at[i] % 3 :][:3]
            path.append(("".join(run[: at[i] % 3]), "".join(run[at[i] % 3 + 1 :])))
            at[i] //= 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows, received):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of every row."""
    sources = sorted({r.source for r in rows}, key=lambda s: b"" if s is None else b"s" + s.encode())
    trees = []
    for source in sources:
        mine = [(r.doc_id, row_hash(r, r.text), row_hash(r, received(r))) for r in rows if r.source == source]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append((mine, *climb([x[1] for x in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for (doc, leaf, got), path in zip(mine, paths, strict=True):
            node = got
            for before, after in path + top:
                node = H(before, node, after)
            out.append((doc, leaf, subroot, root, H(*(b + a for b, a in path + top)), node, node == root))
    return sorted(map(repr, out))


def digest(df):
    cols = ("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")
    return sorted(repr(tuple(r)) for r in df.select(*cols).collect())


def made(spark, n):
    """One source with two thirds of the rows, one per row, one null."""
    rows = [(i, f"text {i}\nmore", "en" if i % 5 else None, "hot" if i % 3 else None if i % 2 else f"é{i}", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("height", [1, 2, 7])
def test_trees_of_several_superblocks(spark, height):
    docs = made(spark, 200)
    rows = docs.collect()
    found = merkle.manifest(docs, F.when(F.col("doc_id") % 4 == 0, F.upper("text")).otherwise(F.col("text")), height=height)
    assert digest(found) == brute(rows, lambda r: r.text.upper() if r.doc_id % 4 == 0 else r.text)


def test_order_over_several_parts(spark):
    docs = made(spark, 300).withColumn("tree", F.coalesce("source", F.lit("")))
    placed = merkle._placed(docs, ["tree", "doc_id"], size=20).collect()
    assert len({r.doc_id for r in placed}) == 300
    for tree in {r.tree for r in placed}:
        mine = sorted((r for r in placed if r.tree == tree), key=lambda r: r.doc_id)
        assert [r.place for r in mine] == list(range(len(mine))) and {r["size"] for r in mine} == {len(mine)}


def test_edges(spark, documents):
    rows = [(1, None), (None, "a\nb"), (2, ""), (2, ""), (2, "b"), (3, "x\n" * 200_000), (4, "\n")]
    docs = documents(rows)
    found = merkle.manifest(docs, F.translate("text", "\n", ""))
    assert digest(found) == brute(docs.collect(), lambda r: None if r.text is None else r.text.replace("\n", ""))
    assert {(r.doc_id, r.verified) for r in found.collect()} == {(1, True), (None, False), (2, True), (3, False), (4, False)}
    assert merkle.manifest(documents([])).count() == 0
    lone = merkle.manifest(documents([(7, "t")])).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof == lone["shape"] == "" and lone.verified


def test_proofs_fold_by_themselves(spark):
    for r in merkle.manifest(made(spark, 100), height=1).collect():
        assert merkle.fold(r.leaf, r["shape"], r.proof) == r.root == r.folded_root


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(repr(tuple(r)) for r in entry.queries()["op11_merkle_manifest"](spark, sf).collect())
    tamper = lambda r: r.text.replace("\n", "") if r.text and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text
    assert got == brute(rows, tamper)
