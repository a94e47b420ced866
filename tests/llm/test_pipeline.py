"""The pipeline's stages against plain re-implementations on small tables."""

import corpus_pipeline
from quillion.llm import jaccard_join

WORDS = "the of and a in is that it was for river stone light house wind tree road bird song glass paper chair water cloud field night".split()


def text(seed, n=60):
    import random

    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) if rnd.random() < 0.6 else rnd.choice(WORDS[:10]) for _ in range(n))


def test_one_of_each_group_stays(spark):
    a, b = text(1), text(2)
    near = a.replace(a.split()[30], "zzz", 1)
    rows = [(5, a, 1), (3, a, 2), (9, near, 3), (7, b, 4), (None, b, 5), (8, "", 6), (8, None, 7), (11, text(3), 8), (11, text(3), 8), (12, text(4), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(3, a, 2), (7, b, 4), (8, "", 6), (8, None, 7), (11, text(3), 8), (12, text(4), 9)], key=str)
    assert jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0


def test_stages_keep_columns_and_act(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    before = len(seen)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = jaccard_join.written(stage(spark, docs, d))
        rows = docs.collect()
        assert docs.columns == columns and all(r == seen[r.doc_id] for r in rows) and len(rows) <= before, name
        before = len(rows)
    assert not [r.doc_id for r in rows if labels.get(r.doc_id) == 0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    assert len(corpus_pipeline.run(spark, d).collect()) == len(packed)
