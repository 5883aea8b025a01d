import itertools

import corpus_pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = docs.persist()
        held.append(docs.count())
    assert sorted(held[:-1], reverse=True) == held[:-1]  # mixing may repeat documents
    assert held[-1] > 0.6 * held[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in last] == [0, *itertools.accumulate(r.n_tokens for r in last)][:-1]
