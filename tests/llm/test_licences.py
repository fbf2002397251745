import random

import __spark_entry__ as entry
from engram.llm import licences


def background(n=400):
    rng = random.Random(3)
    usual = "the a of under this is work in and version public you may file that with source code terms for not by".split()
    return [" ".join(rng.choice([*usual, f"word{rng.randrange(500)}"]) for _ in range(rng.randint(3, 30))) for _ in range(n)]


def test_held_out_accuracy():
    model = licences.train(background(), seed=0)
    for family, text in licences.made_notices(seed=99, copies=8):
        assert model.classify(text) is not None, text
    rows = licences.made_notices(seed=7, copies=8)
    right = sum(model.classify(t)[0] == family for family, t in rows)
    assert right > 0.95 * len(rows)
    assert sum(model.classify(t) is not None for t in background(900)[400:]) <= 2


def test_bound_skips_only_no_licence():
    model = licences.train(background(), seed=0)
    none = model.classes.index(licences.NONE)
    for text in [t for _, t in licences.made_notices(5, 3)] + background(50) + [""]:
        assert (model.classify(text) is None) == (model.chances(licences.grams(licences.words(text))).argmax() == none)


def test_edge_cases(spark, documents):
    notice = "Released under the MIT License."
    pairs = [(1, notice), (1, notice), (2, None), (3, ""), (4, "\n \n"), (None, f"x\n{notice}\ny"), (5, "Licensed under the Zorbo Terms, version 3."), (6, "w " * 40_000 + "\n" + notice), *((10 + i, t) for i, t in enumerate(background(60)))]
    docs = documents(pairs)
    found = licences.scan(docs, licences.fit(docs)).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(pairs) and len(by_id[1]) == 2
    for i in (1, None, 6):
        assert [(h.family, h.confirmed) for h in by_id[i][0].hits] == [("mit", True)]
    assert by_id[None][0].hits[0].paragraph == 1
    assert [(h.family, h.confirmed) for h in by_id[5][0].hits] == [("unknown", False)]
    assert [by_id[i][0].n_paragraphs for i in (2, 3, 4)] == [0, 0, 0]
    assert licences.scan(documents([]), licences.fit(documents([]))).count() == 0


def test_wrapped_notices(documents):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = " * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and\n * associated documentation files"
    prose = "\n".join(background(30))
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    pairs = [(1, f"First words.\n\n{gpl}\n\nLast words."), (2, f"{prose}\n{mit}\n{prose}"), (3, bsd), *((10 + i, t) for i, t in enumerate(background(60)))]
    docs = documents(pairs)
    got = {r.doc_id: [(h.paragraph, h.family) for h in r.hits if h.confirmed] for r in licences.scan(docs, licences.fit(docs)).collect()}
    assert got[1] == [(1, "gpl")] and got[2] == [(30, "mit")] and got[3] == [(0, "bsd")]
    assert not any(got[i] for i in got if i >= 10)


def test_query_finds_the_notices(spark, sf):
    got = {r.doc_id: r.families for r in entry.queries()["op6_licence_scan"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    marks = {"MIT License": "mit", "Apache License": "apache", "GNU General": "gpl", "CC BY-NC": "cc-by-nc"}
    for r in docs:
        wanted = sorted(f for m, f in marks.items() if m in r.text)
        assert (got[r.doc_id] or "") == ",".join(wanted)
