"""The pipeline's stages, each on its own input, against brute force; and the whole run."""

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_lines_secrets import lines_by_hand

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() <= docs.count()
    lines = stages["line_dedup"](spark, docs, SF)
    assert lines.dtypes == docs.dtypes and sorted(pairs(lines)) == [x[:2] for x in lines_by_hand(pairs(docs), 40, 5)]
    near = stages["near_duplicates"](spark, docs, SF)
    assert near.dtypes == docs.dtypes and sorted(i for i, _ in pairs(near)) == sorted(d for d, _, c in brute(pairs(docs), 5, 80, 100) if d == c)
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.dtypes == docs.dtypes and clean.count() < docs.count()
    twice = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", docs.doc_id * None))
    assert stages["near_duplicates"](spark, twice, SF).count() == near.count() + 1
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    windows = {}
    for r in rows:
        windows[r.sequence_id] = windows.get(r.sequence_id, 0) + r.length
    assert rows and max(windows.values()) <= 1024
