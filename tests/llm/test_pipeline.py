"""The pipeline's stages on a small fixture and on the smallest driver tables."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages(spark):
    from rasterweave.llm.common import materialize
    from rasterweave.llm.decontaminate import mark
    from rasterweave.llm.jaccard import link

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == names
    before, after = seen["near copies"]
    groups = link(before).groupBy("component_id").count().collect()
    assert after.count() == len(groups) and {r.doc_id for r in after.collect()} == {r.component_id for r in groups}
    _, after = seen["leaks"]
    assert mark(after, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(_items) > 0").count() == 0
    before, after = seen["mixing"]
    rows = after.groupBy("doc_id").count().collect()
    assert rows and max(r["count"] for r in rows) <= 3
    before, after = seen["tokens"]
    got = after.orderBy("start").collect()
    assert len(got) == before.count() and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(got, got[1:]))


def test_run(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    base = " ".join(f"word{i % 37}x{i % 11}" for i in range(60))
    leak = " ".join(f"secret{i}" for i in range(12))
    texts = [base, base, "12 34 ..", None, "clean words stay here in this text", f"start of it {leak} and the end of it goes on for some more words than the leak has", leak]
    pq.write_table(pa.table({"doc_id": range(7), "text": texts, "lang": ["en"] * 7, "source": ["a", "b", "a", "b", "a", "b", "a"], "n_chars": [len(t or "") for t in texts]}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [leak]}), f"{tmp_path}/benchmark.parquet")
    before = dict(spark.conf.getAll)
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert dict(spark.conf.getAll) == before
    assert ids <= {0, 4, 5} and ids
