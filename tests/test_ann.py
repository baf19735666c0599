"""The stored vector index against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegraph.operators import ann
from cinegraph.operators.knn import knn_exact
from conftest import rows


def vector_table(spark, n=240, dim=8, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x.astype(float), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "movie_id long, embedding array<float>")


def asked(vdf, n=12):
    return vdf.where(F.col("movie_id") < n).select(F.col("movie_id").alias("query_id"), "embedding")


def brute(x, model, q, n, nprobe):
    """Item ids by (score of the code, id), code by code."""
    out = []
    probed = sorted(range(len(model.centers)), key=lambda c: (-round(float(x[q] @ model.centers[c]), 9), c))[:nprobe]
    for i, v in enumerate(x):
        cell = min(range(len(model.centers)), key=lambda c: (-round(float(v @ model.centers[c]), 9), c))
        if cell not in probed:
            continue
        score, width = float(x[q] @ model.centers[cell]), model.books.shape[2]
        for p, book in enumerate(model.books):
            part = slice(p * width, (p + 1) * width)
            gaps = [round(float(((v - model.centers[cell])[part] - w) @ ((v - model.centers[cell])[part] - w)), 9) for w in book]
            score += float(x[q][part] @ book[gaps.index(min(gaps))])
        out.append((-round(score, 9), i))
    return [i for _, i in sorted(out)[:n]]


@pytest.mark.parametrize("iterations", [0, 4])
@pytest.mark.parametrize("blocks", [{}, {"list_block": 7, "query_block": 3}])
def test_list_hits_are_those_of_every_code_scored(spark, tmp_path, iterations, blocks):
    x, vdf = vector_table(spark)
    model = ann.fit(vdf, 5, 4, 16, sample=100, iterations=iterations)
    index = ann.write_index(vdf, model, str(tmp_path / "index"))
    got = {}
    for r in ann.list_hits(asked(vdf), index, 9, 2, **blocks).collect():
        got.setdefault(r.query_id, []).append((-r.score_key, r.item_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: brute(x, model, q, 9, 2) for q in range(12)}


def test_ranking_everything_is_exact_and_the_index_opens_again(spark, tmp_path):
    _, vdf = vector_table(spark)
    path = str(tmp_path / "index")
    ann.write_index(vdf, ann.fit(vdf, 4, 2, 8, sample=60, iterations=2), path)
    found = ann.search_index(asked(vdf), ann.open_index(spark, path), vdf, 5, 4, 240)
    cols = ["query_id", "movie_id", "vec_rank"]
    assert rows(found, *cols) == rows(knn_exact(asked(vdf), vdf, 5), *cols)
    rec = ann.recall_at_k(found, knn_exact(asked(vdf), vdf, 5)).collect()
    assert len(rec) == 12 and all(r.recall == 1.0 for r in rec)


def test_a_query_reads_the_folders_of_its_cells(spark, tmp_path):
    _, vdf = vector_table(spark)
    index = ann.write_index(vdf, ann.fit(vdf, 6, 2, 8, sample=60, iterations=2), str(tmp_path / "index"))
    sizes = {r.cell: r["count"] for r in index.lists.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 240
    for r in ann.codes_read(asked(vdf), index, 6).collect():
        assert r.codes == 240
    one = ann.probes(asked(vdf, 1), index.model, 1).first()
    assert ann.codes_read(asked(vdf, 1), index, 1).first().codes == sizes[one.cell]


def test_ties_copies_and_few_vectors(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(20, [0.0, 1.0])], "movie_id long, embedding array<float>")
    index = ann.write_index(same, ann.fit(same, 3, 2, 4, iterations=3), str(tmp_path / "same"))
    found = ann.search_index(asked(same, 1), index, same, 3, 3, 5, list_block=2)
    assert [r.movie_id for r in found.orderBy("vec_rank").collect()] == [0, 1, 2]
    few = same.limit(2)
    index = ann.write_index(few, ann.fit(few, 8, 2, 4), str(tmp_path / "few"))
    assert index.model.books.shape == (2, 1, 1)
    assert ann.search_index(asked(few), index, few, 3, 8, 5).count() == 4
    assert ann.search_index(asked(few, 0), index, few, 3, 8, 5).count() == 0
    with pytest.raises(ValueError):
        ann.fit(same.limit(0), 2, 2)
    with pytest.raises(ValueError):
        ann.fit(same, 2, 3)


@pytest.mark.parametrize("copies", [1, 40])
@pytest.mark.parametrize("scale", [1.0, 1e20, 1e40])
def test_few_codes_are_looked_up_and_none_of_the_best_is_missed(copies, scale):
    rng = np.random.default_rng(3)
    words, q = np.repeat(rng.normal(size=(4000 // copies, 8)) * scale, copies, axis=0), rng.normal(size=(9, 8))
    exact = q @ words.T
    with np.errstate(over="ignore"):
        rough = words.astype(np.float32)
    row, at = ann._may_reach(q, np.zeros(9), rough, np.linalg.norm(words, axis=1).max(), 20)
    for i in range(9):
        assert set(at[row == i]) >= set(np.flatnonzero(exact[i] >= np.sort(exact[i])[-20]))
    # past single precision all are looked up
    assert len(row) == 9 * 4000 if scale > 1e30 else len(row) < 9 * 120


def test_probing_does_not_repeat_vectors_in_python(spark, tmp_path):
    _, vdf = vector_table(spark)
    model = ann.fit(vdf, 6, 2, 8, sample=60)
    probed = ann.probes(asked(vdf), model, 4)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "MapInPandas" not in plan
    assert probed.schema.simpleString() == "struct<query_id:bigint,q_vec:array<float>,cell:int,base:double>"
    q = asked(vdf, 3).collect()
    got = {(r.query_id, r.cell): r.base for r in probed.where("query_id < 3").collect()}
    for r in q:
        scores = np.array(r.embedding) @ model.centers.T
        best = np.argsort(-scores)[:4]
        assert all(abs(got.pop((r.query_id, c)) - scores[c]) < 1e-9 for c in best)
    assert not got
