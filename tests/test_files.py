"""End to end from the application's own file formats (CSV + Parquet) instead of adapters."""

from pyspark.sql import functions as F

from cinegraph.operators.recommend import recommend
from cinegraph.plans.catalog import catalog, catalog_from_files
from cinegraph.sources import adapters
from conftest import rows


def _to_csv(df, path):
    # keep leading/trailing blanks (the CSV writer trims them by default): tag variants differ
    (df.coalesce(1).write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def test_build_from_files_matches_adapter_route(spark, sf_small, tmp_path):
    d = str(tmp_path)
    _to_csv(adapters.ml_movies(spark, sf_small), f"{d}/ml/movies.csv")
    _to_csv(adapters.ml_links(spark, sf_small), f"{d}/ml/links.csv")
    _to_csv(adapters.ml_ratings(spark, sf_small).withColumn("timestamp", F.lit(0)), f"{d}/ml/ratings.csv")
    _to_csv(adapters.ml_tags(spark, sf_small).select(F.lit(1).alias("userId"), "movieId", "tag",
                                                     F.lit(0).alias("timestamp")), f"{d}/ml/tags.csv")
    adapters.ext_meta(spark, sf_small).write.parquet(f"{d}/meta.parquet")
    _to_csv(adapters.availability_raw(spark, sf_small), f"{d}/avail.csv")
    files = catalog_from_files(spark, f"{d}/ml", f"{d}/meta.parquet", f"{d}/avail.csv")
    ref = catalog(spark, sf_small)
    cols = ["movie_id", "title", "year", "genres", "top_cast", F.round("bayesian_avg", 9).alias("b")]
    assert rows(files.movies(), *cols) == rows(ref.movies(), *cols)
    assert files.movie_tags().count() == ref.movie_tags().count()
    assert rows(files.availability()) == rows(ref.availability())
    assert files.rated().count() == ref.rated().count()
    # no precomputed vectors: movie vectors are embedded from the movie documents
    vec = files.vectors()
    with_overview = ref.movies().where(F.col("overview").isNotNull()).count()
    assert 0 < vec.count() == with_overview and vec.first().embedding is not None and len(vec.first().embedding) == 768
    seeds = spark.createDataFrame([(4,)], "seed_id long")
    out = recommend(seeds, limit=10, **files.recommend_inputs())
    assert 0 < out.count() <= 10
