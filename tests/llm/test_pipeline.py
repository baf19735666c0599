"""The pipeline's stages on planted documents, each judged on its own input."""
import random

import pytest
from llm_fixtures import make_docs, rows  # noqa: F401

from cinegraph.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def test_stages_run_in_order_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= before
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in rows(packed.select("doc_id").distinct())} == {r[0] for r in rows(docs, "doc_id")}


def test_planted_copies_lines_and_passages_go(spark, make_docs, tmp_path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    bench = " ".join(word() for _ in range(30))
    own = [" ".join(word() for _ in range(80)) for _ in range(8)]
    docs = make_docs([(1, own[0]), (2, own[0]), (3, own[1] + "\n" + passage), (4, own[2] + "\n" + passage),
                      (5, own[3] + " " + bench), (6, own[4]), (7, None), (8, "")])
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    got = {r.doc_id: r.text for r in docs.collect()}
    # of the null and the empty text, near copies of each other, the smaller id stays
    assert sorted(got) == [1, 3, 4, 6, 7]
    assert passage in got[3] and passage not in got[4]


def test_empty_documents(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_stage_drops_what_the_query_rejects(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for value, left in ((0.4, 0), (0.2, docs.count())):
        model = toxicity.EMPTY._replace(values=(value,))
        monkeypatch.setattr(toxicity, "fit", lambda *_, model=model: model)
        predicted = toxicity.op5_toxicity(spark, "/root/testdata/sf0.001")
        assert corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001").count() == left == predicted.where("predicted = 0").count()
