"""Tables laid out by key: results equal the plain ones, plans have no exchange for the buckets."""
import pytest
from pyspark.sql import functions as F

from cinegraph.sources.bucketed import write_bucketed
from conftest import rows


@pytest.fixture()
def sides(spark):
    left = [(k, i) for k in range(40) for i in range(k % 5)] + [(7, i) for i in range(300)] + [(None, 1), (None, 2)]
    right = [(k, f"m{k}") for k in range(3, 50)] + [(9, f"x{i}") for i in range(150)] + [(None, "n")]
    return spark.createDataFrame(left, "k long, v int"), spark.createDataFrame(right, "k long, name string")


@pytest.mark.parametrize("hot_rows", [1, 100, 10_000])
def test_join_and_group_equal_the_plain_ones(spark, sides, tmp_path, hot_rows):
    left, right = sides
    a = write_bucketed(left, str(tmp_path / "a"), "k", 4, hot_rows=hot_rows)
    b = write_bucketed(right, str(tmp_path / "b"), "k", 4, hot_rows=hot_rows)
    assert rows(a.all_rows()) == rows(left) and rows(b.all_rows()) == rows(right)
    assert (a.n_hot, b.n_hot) == {1: (25, 1), 100: (1, 1), 10_000: (0, 0)}[hot_rows]
    assert rows(a.join(b), "k", "v", "name") == rows(left.join(right, "k"), "k", "v", "name")
    sums = [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")]
    assert rows(a.group(*sums)) == rows(left.groupBy("k").agg(*sums))
    counted = a.join(b, lambda df: df.groupBy("k", "name").agg(F.count(F.lit(1)).alias("n")))
    assert rows(counted) == rows(left.join(right, "k").groupBy("k", "name").agg(F.count(F.lit(1)).alias("n")))


def test_hot_keys_lie_apart(spark, sides, tmp_path):
    left, _ = sides
    a = write_bucketed(left, str(tmp_path / "a"), "k", 4, hot_rows=100)
    assert [r.k for r in a.hot.select("k").distinct().collect()] == [7]
    assert a.cold.where("k = 7").count() == 0


def test_empty_tables(spark, sides, tmp_path):
    left, right = sides
    a = write_bucketed(left.limit(0), str(tmp_path / "a"), "k", 4)
    b = write_bucketed(right, str(tmp_path / "b"), "k", 4)
    assert a.join(b).count() == b.join(a).count() == a.group(F.count("v").alias("n")).count() == 0


def test_buckets_join_and_group_without_exchange(spark, sides, tmp_path):
    left, right = sides
    a = write_bucketed(left, str(tmp_path / "a"), "k", 4)
    b = write_bucketed(right, str(tmp_path / "b"), "k", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = a.join(b, lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        plain = left.join(right, "k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert "Exchange" in plain


@pytest.mark.parametrize("hot_rows", [1, 100, 10_000])
def test_rows_are_made_where_they_lie(spark, sides, tmp_path, hot_rows):
    left, right = sides
    twice = left.unionByName(left)
    a = write_bucketed(twice, str(tmp_path / "a"), "k", 4, ["k", "v"], hot_rows=hot_rows,
                       then=lambda part: part.join(right, "k", "left_semi").dropDuplicates(["k", "v"]))
    want = rows(left.join(right, "k", "left_semi").distinct())
    assert rows(a.files()) == rows(a.all_rows()) == want
    assert rows(write_bucketed(left, str(tmp_path / "b"), "k", 4, hot_rows=hot_rows).files()) == rows(left)


def test_lines_are_joined_once_for_stats_edges_and_tags(spark, tmp_path, monkeypatch):
    from cinegraph.plans.catalog import Catalog
    from cinegraph.sources import adapters
    lines = [(o, p, n, float(n), "R") for o in range(8) for p in range(1, 4) for n in (1, 4)] + [(99, 1, 1, 1.0, "R"), (1, None, 2, 2.0, "A")]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string"),
        "orders": spark.createDataFrame([(o, 10 + o // 2, "1-URGENT") for o in range(8)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "part": spark.createDataFrame([(p, f"p{p}", "B", "T", p, 9.0) for p in range(1, 4)],
                                      "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "documents": spark.createDataFrame([(1, "text")], "doc_id long, text string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, plain = spark.sparkContext.accumulator(0), adapters.rating_lines

    def counted(q):
        seen.add(1)
        return q

    monkeypatch.setattr(adapters, "rating_lines", lambda *a: plain(*a).withColumn("q", F.udf(counted, "int")("q")))
    c = Catalog(spark, str(tmp_path))
    given = [(10 + o // 2, p, min(10, 1 + (n - 1) % 5 + 2 * (p % 6)) / 2) for o in range(8) for p in range(1, 4) for n in (1, 4)]
    assert sorted(tuple(r) for r in c.rated().select("user_id", "movie_id", "rating").collect()) == sorted(set(given))
    assert c.ratings().count() == len(given) == 48
    assert {r.movie_id: r.rating_count for r in c.movies().collect()} == {1: 16, 2: 16, 3: 16}
    assert rows(c.movie_tags()) == [(1, "urgent-r-1", 16), (2, "urgent-r-e", 16), (3, "urgent-r-0", 16)]
    assert rows(c.by_movie("rated").all_rows()) == rows(c.rated())
    assert seen.value == len(given) + 1
