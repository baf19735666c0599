"""Every registered query against its DuckDB oracle (sf0.001), plus physical-plan checks."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402
from cinegraph.operators.signals import SignalParams, signal_collab, signal_tags  # noqa: E402
from cinegraph.operators.tags import build_tags  # noqa: E402
from cinegraph.plans.catalog import catalog  # noqa: E402
from cinegraph.plans.queries import ORACLE, REGISTRY  # noqa: E402
from cinegraph.sources import adapters  # noqa: E402


def plan(df, mode="formatted"):
    return df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def duck(sf_small):
    return check_oracle.duck(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_small, duck, name):
    sp = REGISTRY[name](spark, sf_small).toPandas()
    dk = duck.execute(ORACLE[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert check_oracle.digest(sp) == check_oracle.digest(dk)


def test_collab_plan(spark, sf_small):
    c = catalog(spark, sf_small)
    df = signal_collab(adapters.seeds(spark, sf_small, [4, 5, 11]), c.rated(), c.fan_edges(), c.nodes(), seed_ids=[4, 5, 11])
    p = plan(df)
    assert "WindowGroupLimit" in p                      # per-seed top-k limited before the shuffle
    assert "BroadcastHashJoin" in p                     # bounded fan set broadcast to the edge scan
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "PushedFilters: [IsNotNull(rating), GreaterThanOrEqual(rating,4.0), In(movie_id" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_tags_plan_no_cross_join(spark, sf_small):
    c = catalog(spark, sf_small)
    p = plan(signal_tags(adapters.seeds(spark, sf_small, [4, 5, 11]), c.has_tag(), c.nodes(), seed_ids=[4, 5, 11]))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "WindowGroupLimit" in p


def test_tag_build_plan(spark, sf_small):
    c = catalog(spark, sf_small)
    p = plan(build_tags(c.ml_tags(), c.movies()))
    assert "WindowGroupLimit" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_returnflag:string>" in p


def test_recommend_plan_python_only_in_knn(spark, sf_small):
    df = REGISTRY["recommend"](spark, sf_small)
    p = plan(df)
    assert "BatchEvalPython" not in p                   # no row-at-a-time Python UDF anywhere
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_many_seed_overlap_signals_plans(spark, sf_small):
    """The tag signal runs on the cogroup grid: no equi-join on the tag (which would emit every
    pair of a popular tag). The co-fan signal joins light users only and has no grid without
    heavy ones. Neither has a cross join."""
    c = catalog(spark, sf_small)
    seeds = c.movies().selectExpr("movie_id AS seed_id")
    tags = plan(signal_tags(seeds, c.has_tag(), c.nodes(), seed_ids=None))
    collab = plan(signal_collab(seeds, c.rated(), c.fan_edges(), c.nodes(), seed_ids=None))
    heavy = plan(signal_collab(seeds, c.rated(), c.fan_edges(), c.nodes(), SignalParams(heavy_fan=25), seed_ids=None))
    for p in (tags, collab, heavy):
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    join_keys = [ln for ln in tags.split("\n") if ln.startswith(("Left keys", "Right keys"))]
    assert "FlatMapCoGroupsInPandas" in tags and not any("tag#" in ln and "movie_id" not in ln for ln in join_keys)
    assert "FlatMapCoGroupsInPandas" not in collab and "InPandas" not in collab
    assert "FlatMapCoGroupsInPandas" in heavy
