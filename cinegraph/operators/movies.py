"""Canonical movie build (OP1): metadata clean-up, the three-way join, final projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.text import to_int_truncated, trim_cast, year_of_iso_date

# --- fixed values: expected metadata columns and the canonical movie schema ---------
EXT_COLUMNS = ["id", "imdb_id", "title", "overview", "tagline", "genres", "movie_cast",
               "director", "poster_path", "vote_average", "vote_count", "release_date", "runtime"]
MOVIE_COLUMNS = [
    ("movie_id", "bigint"), ("tmdb_id", "bigint"), ("title", "string"), ("year", "int"),
    ("genres", "string"), ("overview", "string"), ("tagline", "string"), ("director", "string"),
    ("top_cast", "string"), ("poster_path", "string"), ("vote_average", "double"),
    ("vote_count", "int"), ("rating_mean", "double"), ("rating_count", "bigint"),
    ("bayesian_avg", "double"),
]
# ------------------------------------------------------------------------------------


def clean_ext_meta(ext: DataFrame) -> DataFrame:
    """Keep the expected columns that exist, ``id`` -> integer ``tmdb_id`` (coerced,
    truncated), rows without a usable id dropped. ``_ext_id`` keeps the raw id text as a
    deterministic tie-breaker for the later first-row-per-movie rule."""
    keep = [c for c in EXT_COLUMNS if c in ext.columns]
    e = ext.select(*keep)
    if "id" not in keep:
        raise ValueError("metadata needs an 'id' column")
    e = e.withColumn("_ext_id", F.col("id").cast("string"))
    e = e.withColumn("tmdb_id", to_int_truncated("id")).drop("id")
    return e.where(F.col("tmdb_id").isNotNull())


def _col_or_null(df: DataFrame, name: str, dtype: str):
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def build_movies(ml_movies: DataFrame, links: DataFrame, ext_clean: DataFrame,
                 stats: DataFrame) -> DataFrame:
    """movies ⋈ links ⋈ metadata (on tmdb id) ⟕ rating stats, one row per movie_id.

    Title and genres come from the movie list (they win over the metadata's). The
    joins are equi-joins; the movie list and links are dimension-sized, the stats
    table has one row per rated movie.
    """
    lk = (links.where(F.col("tmdbId").isNotNull())
          .select(F.col("movieId").alias("l_movie_id"), F.col("tmdbId").try_cast("bigint").alias("l_tmdb")))
    mv = ml_movies.select(F.col("movieId").alias("movie_id"), F.col("title").alias("ml_title"),
                          F.col("genres").alias("ml_genres"))
    e = ext_clean
    ext_cols = {c: F.col(c) for c in e.columns}
    e = e.select(*[ext_cols[c].alias(f"x_{c}") for c in e.columns])
    j = (mv.join(lk, mv.movie_id == lk.l_movie_id, "inner")
         .join(e, F.col("l_tmdb") == F.col("x_tmdb_id"), "inner")
         .join(stats.select("movie_id", "rating_mean", "rating_count", "bayesian_avg")
               .withColumnRenamed("movie_id", "s_movie_id"),
               F.col("movie_id") == F.col("s_movie_id"), "left"))

    def x(name, dtype):
        return _col_or_null(j, f"x_{name}", dtype)

    year = year_of_iso_date(F.col("x_release_date")) if "x_release_date" in j.columns else F.lit(None)
    cast_col = F.col("x_movie_cast") if "x_movie_cast" in j.columns else F.lit(None).cast("string")
    out = j.select(
        F.col("movie_id").cast("bigint").alias("movie_id"),
        F.col("x_tmdb_id").cast("bigint").alias("tmdb_id"),
        F.col("ml_title").alias("title"),
        year.cast("int").alias("year"),
        F.col("ml_genres").alias("genres"),
        x("overview", "string").alias("overview"),
        x("tagline", "string").alias("tagline"),
        x("director", "string").alias("director"),
        trim_cast(cast_col).alias("top_cast"),
        x("poster_path", "string").alias("poster_path"),
        x("vote_average", "double").alias("vote_average"),
        x("vote_count", "int").alias("vote_count"),
        F.col("rating_mean").cast("double").alias("rating_mean"),
        F.col("rating_count").cast("bigint").alias("rating_count"),
        F.col("bayesian_avg").cast("double").alias("bayesian_avg"),
        F.col("x__ext_id").alias("_ext_id"),
    )
    # First row per movie_id. The source keeps merge order; ours is explicit.
    w = Window.partitionBy("movie_id").orderBy(F.col("_ext_id").asc_nulls_last(),
                                               F.col("tmdb_id").asc_nulls_last())
    first = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return first.select(*[c for c, _ in MOVIE_COLUMNS])
