"""Batch build: stats, canonical movies, tags, availability, graph edges, readers, sinks."""

import pytest
from pyspark.sql import functions as F

from cinegraph.operators import graph as G
from cinegraph.operators.availability import build_availability
from cinegraph.operators.movies import build_movies, clean_ext_meta
from cinegraph.operators.ratings import bayesian_average, global_constants, rating_stats
from cinegraph.operators.tags import build_tags
from cinegraph.sources import readers, sinks
from conftest import rows


def ratings_df(spark, triples):
    return spark.createDataFrame(triples, "userId long, movieId long, rating double")


def test_m1_bayesian_average(spark):
    r = ratings_df(spark, [(1, 1, 5.0), (2, 1, 3.0), (1, 2, 4.0), (1, 3, 1.0), (2, 3, 2.0), (3, 3, 3.0),
                           (4, None, 5.0), (5, 2, None)])
    stats = rating_stats(r)
    c, m = global_constants(stats).first()
    assert c == pytest.approx(10 / 3) and m == pytest.approx(1.5)
    got = {k: round(v, 6) for k, v in rows(bayesian_average(stats), "movie_id", "bayesian_avg")}
    assert got == {1: 3.714286, 2: 3.6, 3: 2.444444}
    # null ratings are ignored by the count, null movie ids are dropped (no null group)
    assert rows(stats, "movie_id", "rating_count") == [(1, 2), (2, 1), (3, 3)]


def test_t4_constants_use_all_rated_movies_not_canonical(spark):
    # movie 9 is rated but never canonical: it still moves C and m
    r = ratings_df(spark, [(1, 1, 5.0), (1, 9, 1.0), (2, 9, 1.0)])
    c, m = global_constants(rating_stats(r)).first()
    assert c == pytest.approx(3.0) and m == pytest.approx(1.25)


def _movie_inputs(spark):
    ml = spark.createDataFrame([(1, "Heat (1995)", "Action|Crime"), (2, "Lost (1990)", "Drama"),
                                (3, "Gone (2000)", "Drama"), (4, "Dup (2001)", "War")],
                               "movieId long, title string, genres string")
    links = spark.createDataFrame([(1, "tt1", 862.0), (2, "tt2", 5.0), (3, "tt3", None), (4, "tt4", 7.0)],
                                  "movieId long, imdbId string, tmdbId double")
    ext = spark.createDataFrame(
        [("862", "Heat T", "A heist.", None, "Thriller", " A, B ,C,D,E,F", "Mann", None, 8.0, 10, "1995-12-15"),
         (" 5 ", "Lost T", None, "tag", "X", None, None, "/l.jpg", 6.0, 5, "unknown"),
         ("x", "junk", "o", None, "X", None, None, None, 1.0, 1, "2000-01-01"),
         ("7.0", "Dup A", "first", None, "X", "Q", None, None, 1.0, 1, "2001-01-01"),
         ("7.9", "Dup B", "second", None, "X", "Q", None, None, 1.0, 1, "2001-01-01")],
        "id string, title string, overview string, tagline string, genres string, movie_cast string, "
        "director string, poster_path string, vote_average double, vote_count int, release_date string")
    stats = bayesian_average(rating_stats(ratings_df(spark, [(1, 1, 4.0), (2, 1, 5.0), (1, 4, 2.0)])))
    return ml, links, ext, stats


def test_canonical_movies(spark):
    ml, links, ext, stats = _movie_inputs(spark)
    mv = build_movies(ml, links, clean_ext_meta(ext), stats)
    got = {r.movie_id: r for r in mv.collect()}
    assert sorted(got) == [1, 2, 4]                      # 3 has no tmdb link
    assert got[1].title == "Heat (1995)" and got[1].genres == "Action|Crime"   # list title/genres win
    assert got[1].year == 1995 and got[1].top_cast == "A, B, C, D, E" and got[1].tmdb_id == 862
    assert got[2].year is None and got[2].top_cast == "" and got[2].rating_count is None   # T5: unrated
    assert got[4].overview == "first"                    # one row per movie, deterministic
    assert len(mv.columns) == 15


def test_m2_t1_t2_tags_and_parallel_edges(spark):
    tags = ([(1, "Noir")] * 3 + [(1, "noir")] * 2 + [(1, " noir ")] * 2 + [(1, "NOIR")] + [(1, None)] * 4
            + [(2, "noir")] * 4 + [(3, "orphan")] * 5)
    t = spark.createDataFrame(tags, "movieId long, tag string")
    movies = spark.createDataFrame([(1,), (2,)], "movie_id long")
    mt = build_tags(t, movies)
    assert rows(mt) == [(1, "noir", 2), (1, "noir", 2), (1, "noir", 3), (2, "noir", 4)]
    ht = G.tag_edges(mt, movies)
    assert rows(ht) == [(1, "noir", 2), (1, "noir", 3), (2, "noir", 4)]


def test_tag_top_n_cap(spark):
    t = spark.createDataFrame([(1, f"t{i:02d}") for i in range(25) for _ in range(2 + i)], "movieId long, tag string")
    mt = build_tags(t, spark.createDataFrame([(1,)], "movie_id long"), top_n=20)
    kept = [r.tag for r in mt.collect()]
    assert len(kept) == 20 and "t24" in kept and "t04" not in kept


def test_m33_edges_follow_current_inputs(spark):
    movies = spark.createDataFrame([(1,)], "movie_id long")
    first = spark.createDataFrame([(1, "noir", 3)], "movie_id long, tag string, count long")
    second = spark.createDataFrame([(1, "noir", 4)], "movie_id long, tag string, count long")
    assert rows(G.tag_edges(first, movies)) == [(1, "noir", 3)]
    assert rows(G.tag_edges(second, movies)) == [(1, "noir", 4)]


def test_m6_availability_null_safe_year(spark):
    raw = spark.createDataFrame([(" HEAT ", "1995", 1, 0), ("Lost", None, 0, 1), ("Heat", "1996", 1, 1)],
                                "Title string, Year string, Netflix int, Hulu int")
    movies = spark.createDataFrame([(1, "Heat (1995)", 1995), (2, "Lost (1990)", None)],
                                   "movie_id long, title string, year int")
    assert rows(build_availability(raw, movies)) == [(1, "netflix"), (2, "hulu")]


def test_t7_null_title_is_text_nan(spark):
    raw = spark.createDataFrame([(None, "2000", 1)], "Title string, Year string, Netflix int")
    movies = spark.createDataFrame([(5, None, 2000)], "movie_id long, title string, year int")
    assert rows(build_availability(raw, movies)) == [(5, "netflix")]


def test_m10_genre_edges(spark):
    mv = spark.createDataFrame([(1, "Action| Crime||(no genres listed)"), (2, "(NO GENRES LISTED)"), (3, None)],
                               "movie_id long, genres string")
    assert rows(G.genre_edges(mv)) == [(1, "Action"), (1, "Crime")]


def test_m4_t3_rated_edges_keyed_by_rating(spark):
    r = spark.createDataFrame([(7, 1, 4.0), (7, 1, 4.0), (7, 1, 5.0), (8, 99, 5.0)],
                              "user_id long, movie_id long, rating double")
    movies = spark.createDataFrame([(1,)], "movie_id long")
    rated = G.rated_edges(r, movies)
    assert rows(rated) == [(7, 1, 4.0), (7, 1, 5.0)]
    assert rows(G.fan_edges(rated)) == [(7, 1)]


def test_csv_readers_decode_na_and_optional(spark, tmp_path):
    p = tmp_path / "tags.csv"
    p.write_text('userId,movieId,tag,timestamp\n1,10,"dark, moody",0\n2,10,null,0\n3,NA,good,0\n')
    t = readers.read_ml_tags(spark, str(p))
    assert t.columns == ["movieId", "tag"]
    assert sorted(t.collect(), key=str) == sorted([(10, "dark, moody"), (10, None), (None, "good")], key=str)
    p.write_text('userId,movieId,tag,timestamp\n1,10.0,"two\nlines, ""quoted""",0\n2,ten,lost,0\n3, 11 ,short\n4,12,x,soon\n')
    t = readers.read_ml_tags(spark, str(p))
    assert rows(t) == [(10, 'two\nlines, "quoted"'), (11, "short")] and t.count() == 2
    bad = readers.rejected_csv(spark, str(p), readers.ML_TAGS_SCHEMA, free_text=True)
    assert rows(bad, "movieId", "tag", "timestamp") == [("12", "x", "soon"), ("ten", "lost", "0")] and bad.count() == 2
    missing = readers.read_availability_raw(spark, str(tmp_path / "absent.csv"))
    assert missing.count() == 0 and "Prime Video" in missing.columns
    a = tmp_path / "avail.csv"
    a.write_text("Title,Year,Netflix,Hulu\nHeat,1995,1,0\n")
    got = readers.read_availability_raw(spark, str(a))
    assert got.columns == ["Title", "Year", "Netflix", "Hulu"] and got.first().Netflix == 1
    assert readers.read_optional_table(spark, str(tmp_path / "nope"), "movie_id long, provider string") is None


def test_conform_adds_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "movie_id long, title string")
    out = readers.conform(df, [("movie_id", "bigint"), ("title", "string"), ("vote_count", "int")],
                          fill={"vote_count": 0})
    assert out.first() == (1, "a", 0)


def test_sinks_first_and_last_wins(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "movie_id long, title string, seq int")
    first = sinks.load_movies(df, order=[F.asc("seq")])
    assert rows(first, "movie_id", "title") == [(1, "a"), (2, "c")]
    old = spark.createDataFrame([(1, "old"), (3, "keep")], "movie_id long, title string")
    new = df.select("movie_id", "title", "seq")
    with pytest.raises(ValueError):
        sinks.upsert(old, new.drop("seq"), ["movie_id"], order=[])
    last = sinks.upsert(old, new, ["movie_id"], order=["seq"])
    assert rows(last, "movie_id", "title") == [(1, "b"), (2, "c"), (3, "keep")]
    sinks.write_table(first, str(tmp_path / "movies"), sort_cols=["movie_id"])
    assert spark.read.parquet(str(tmp_path / "movies")).count() == 2


def test_vector_points_of_another_dimension_are_reported(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0], 1), (3, None, 1), (4, [], 1)],
                                   "movie_id long, embedding array<double>, seq int")
    good, rejected = sinks.upsert_vectors(None, points, 2, ["seq"])
    assert [(r.movie_id, r.embedding) for r in good.collect()] == [(1, [0.0, 1.0])]
    assert rows(rejected, "movie_id", "reason") == [
        (2, "dimension 1 instead of 2"), (3, "no vector"), (4, "dimension 0 instead of 2")]
    old = spark.createDataFrame([(1, [0.6, 0.8], 0), (9, [1.0, 0.0], 0)], points.schema)
    merged, _ = sinks.upsert_vectors(old, points, 2, ["seq"])
    assert sorted((r.movie_id, r.embedding) for r in merged.collect()) == [(1, [0.0, 1.0]), (9, [1.0, 0.0])]


def test_keyed_table_merges_touched_buckets_only(spark, tmp_path):
    from pathlib import Path

    from cinegraph.sources.merge import KeyedTable
    kind = "a long, b string, v long, seq long"
    table = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], buckets=8)
    first = [(i, "x" if i % 2 else None, i, 0) for i in range(100)] + [(5, "x", -1, -1), (None, None, 7, 0)]
    table.create(spark.createDataFrame(first, kind), ["seq"])
    want = {(a, b): (v, seq) for a, b, v, seq in sorted(first, key=lambda r: r[3])}

    def files():
        return {f.name: f.parent.name for f in Path(tmp_path / "t").rglob("*.parquet")}

    for delta in ([(5, "x", 50, 2), (5, "x", 49, 1), (200, "new", 1, 0)], [(None, None, 8, 0)], []):
        before = files()
        touched = table.merge(spark.createDataFrame(delta, kind), ["seq"])
        want.update({(a, b): (v, seq) for a, b, v, seq in sorted(delta, key=lambda r: r[3])})
        got = {(r.a, r.b): (r.v, r.seq) for r in table.read().collect()}
        assert got == want and table.read().count() == len(want)
        # files of other buckets are the same files as before
        assert {f for f, d in before.items() if d.split("=")[1] not in map(str, touched)} <= set(files())
        assert len(touched) <= len(delta)


def test_a_merge_writes_its_buckets_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from cinegraph.sources.merge import KeyedTable
    written, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), plain(self, path, *a, **k))[1])
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.create(spark.createDataFrame([(i, 0) for i in range(50)] + [(None, 0)], "k long, seq long"), ["seq"])
    table.merge(spark.createDataFrame([(3, 1), (3, 2), (77, 1), (None, 1)], "k long, seq long"), ["seq"])
    assert written == [table.path] * 2
    assert {r.k: r.seq for r in table.read().collect()} == {**{i: 0 for i in range(50)}, 3: 2, 77: 1, None: 1}
    assert table.read().count() == 52


def test_merge_rated_joins_its_lines_once(spark, monkeypatch):
    import datetime

    from cinegraph.plans import queries
    seen = spark.sparkContext.accumulator(0)

    def counted(day):
        seen.add(1)
        return day

    def events(spark, sf_dir):
        lines = [(u, m, 1.0 + y % 3, datetime.date(y, 1 + m, 1), 10 * y + m)
                 for y in (1995, 1996, 1997, 1998) for u in range(6) for m in range(3) if (u + y) % 4]
        df = spark.createDataFrame(lines, "user_id long, movie_id long, rating double, day date, seq long")
        return df.withColumn("day", F.udf(counted, "date")("day"))

    monkeypatch.setattr(queries.adapters, "rating_events", events)
    got = {(r.user_id, r.movie_id): r.seq for r in queries.q_merge_rated(spark, "own rows").collect()}
    last = {(u, m): 10 * y + m for y in (1995, 1996, 1997, 1998) for u in range(6) for m in range(3) if (u + y) % 4}
    assert got == last
    assert seen.value == sum(1 for y in (1995, 1996, 1997, 1998) for u in range(6) for m in range(3) if (u + y) % 4)


def test_t6_year_comes_from_metadata_and_keys_availability(spark):
    ml = spark.createDataFrame([(1, "Heat (1995)", "Action")], "movieId long, title string, genres string")
    links = spark.createDataFrame([(1, "tt1", 862.0)], "movieId long, imdbId string, tmdbId double")
    ext = spark.createDataFrame([("862", "Heat", "1996-02-01")], "id string, title string, release_date string")
    stats = bayesian_average(rating_stats(ratings_df(spark, [(1, 1, 4.0)])))
    mv = build_movies(ml, links, clean_ext_meta(ext), stats)
    assert mv.first().year == 1996
    raw = spark.createDataFrame([("Heat", "1995", 1), ("Heat", "1996", 1)], "Title string, Year string, Hulu int")
    got = build_availability(raw, mv)
    assert rows(got) == [(1, "hulu")] and got.count() == 1


def test_t10_blank_tags_dropped_after_ranking(spark):
    t = spark.createDataFrame([(1, "   ")] * 3 + [(1, "ok")] * 2, "movieId long, tag string")
    mt = build_tags(t, spark.createDataFrame([(1,)], "movie_id long"))
    assert rows(mt) == [(1, "ok", 2)]


def test_texts_are_not_broadcast(spark, sf_small):
    """A documents file under the broadcast threshold may hold any amount of (repeated) text."""
    from cinegraph.sources import adapters
    plan = adapters.ext_meta(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
