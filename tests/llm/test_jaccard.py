"""The Jaccard join against brute force over real sets."""

import re

import pytest

from tests.llm.cases import SCHEMA, documents
from weftline.llm.components import components
from weftline.llm.op1_jaccard_join import jaccard_groups, op1_jaccard_join

SF = "/root/testdata/sf0.001"


def brute(rows, words, num, den):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


@pytest.mark.parametrize("seed,words,num", [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 1, 75)])
def test_random(spark, seed, words, num):
    rows = documents(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df, words, num, 100).collect())
    assert got == brute([r[:2] for r in rows], words, num, 100)


def test_whole_table(spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op1_jaccard_join(spark, SF).collect())
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()], 4, 85, 100)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_groups(empty).count() == 0
    two = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_groups(two).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (203, 202), (201, 202), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 204)}}


def test_one_id_with_two_texts(spark):
    words = [f"w{k}" for k in range(40)]
    a, b, near = " ".join(words), " ".join(f"v{k}" for k in range(40)), " ".join([*words, "more"])
    for rows in ([(5, a), (5, b), (7, near)], [(5, b), (5, a), (7, near)]):
        got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4, 85, 100).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5)]
