"""Movie detail (OP8), providers per movie (OP9) and result enrichment (OP16).

All lookups are joins with pre-aggregated child tables (tags per movie, providers per
movie), so a batch of ids costs one pass over each child table, not one query per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.text import (
    PROVIDER_LINKS, display_genres, norm_provider, percent_encode, poster_url, provider_label,
)
from cinegraph.operators.joins import top_k
from cinegraph.operators.movies import MOVIE_COLUMNS
from cinegraph.sources.readers import conform

DETAIL_TAGS = 12
SEP = " · "


def providers_by_movie(availability: DataFrame | None, spark=None) -> DataFrame:
    """movie_id -> sorted provider list. A missing availability table gives no rows."""
    if availability is None:
        return spark.createDataFrame([], "movie_id bigint, providers array<string>")
    return availability.groupBy("movie_id").agg(F.sort_array(F.collect_list("provider")).alias("providers"))


def providers_for(ids: DataFrame, availability: DataFrame | None) -> DataFrame:
    """(movie_id, providers) for every requested id; ids without providers get []."""
    pm = providers_by_movie(availability, ids.sparkSession)
    out = ids.select("movie_id").distinct().join(pm, "movie_id", "left")
    return out.select("movie_id", F.coalesce(F.col("providers"), F.array().cast("array<string>")).alias("providers"))


def top_tags(movie_tags: DataFrame, n: int = DETAIL_TAGS) -> DataFrame:
    """movie_id -> its ``n`` most frequent tags (count desc, tag asc), in that order."""
    ranked = top_k(movie_tags, ["movie_id"], [F.desc("count"), F.asc("tag")], n, rank_col="_r")
    return ranked.groupBy("movie_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "tag"))), lambda x: x["tag"]).alias("tags"))


def provider_dim(spark) -> DataFrame:
    """The four known providers: normalised key, display label, search URL prefix."""
    return spark.createDataFrame(PROVIDER_LINKS, "p_key string, p_label string, p_url string")


def movie_detail(ids: DataFrame, movies: DataFrame, movie_tags: DataFrame,
                 availability: DataFrame | None) -> DataFrame:
    """Movie row + top tags + providers (+ display fields) for each known id; unknown
    ids give no row."""
    spark = ids.sparkSession
    movies = conform(movies, MOVIE_COLUMNS)       # absent columns read as nulls
    m = movies.join(ids.select("movie_id").distinct(), "movie_id", "left_semi")
    d = (m.join(top_tags(movie_tags), "movie_id", "left")
         .join(providers_by_movie(availability, spark), "movie_id", "left"))
    d = (d.withColumn("tags", F.coalesce(F.col("tags"), F.array().cast("array<string>")))
          .withColumn("providers", F.coalesce(F.col("providers"), F.array().cast("array<string>"))))
    # Watch links: one row per provider joined with the 4-row provider dimension.
    links = (d.select("movie_id", "title", F.posexplode("providers").alias("_pos", "provider"))
             .join(F.broadcast(provider_dim(spark)), norm_provider(F.col("provider")) == F.col("p_key"), "left")
             .select("movie_id", "_pos",
                     F.when(F.col("p_url").isNotNull(),
                            F.concat(F.col("p_label"), F.lit(" <"), F.col("p_url"),
                                     percent_encode(F.coalesce(F.col("title"), F.lit(""))), F.lit(">")))
                     .otherwise(provider_label(F.col("provider"))).alias("link")))
    links = links.groupBy("movie_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "link"))), lambda x: x["link"]).alias("watch"))
    d = d.join(links, "movie_id", "left")
    has_rating = F.col("rating_mean").isNotNull() & (F.col("rating_mean") != 0) & \
        F.col("rating_count").isNotNull() & (F.col("rating_count") != 0)
    return d.select(
        "movie_id", "tmdb_id", "title", "year", "genres", "overview", "tagline", "director", "top_cast",
        "poster_path", "vote_average", "vote_count",
        poster_url(F.col("poster_path")).alias("poster_url"),
        F.array_join(display_genres(F.col("genres"), None), ", ").alias("genre_list"),
        F.array_join("tags", ", ").alias("tags"),
        F.array_join("providers", ", ").alias("providers"),
        F.array_join(F.coalesce(F.col("watch"), F.array().cast("array<string>")), SEP).alias("watch_links"),
        F.when(has_rating, F.concat(F.lit("★ "), F.format_number(F.col("rating_mean"), 2))).alias("rating_text"),
        F.when(has_rating, F.concat(F.format_number(F.col("rating_count"), 0), F.lit(" ratings")))
        .alias("rating_count_text"),
        "rating_mean", "rating_count", "bayesian_avg",
    )


def enrich_results(results: DataFrame, availability: DataFrame | None) -> DataFrame:
    """Card fields for result rows (search or recommend): providers and their labels,
    poster URL, first three display genres, rating badge, explanation lines."""
    pm = providers_by_movie(availability, results.sparkSession)
    j = results.join(pm, "movie_id", "left").withColumn(
        "providers", F.coalesce(F.col("providers"), F.array().cast("array<string>")))
    avg = F.coalesce(F.col("bayesian_avg"), F.lit(0.0))
    expl = F.col("explanation") if "explanation" in results.columns else F.lit(None).cast("string")
    return j.select(
        *results.columns,
        F.array_join("providers", ", ").alias("providers"),
        F.array_join(F.transform("providers", lambda p: provider_label(p)), ", ").alias("provider_labels"),
        poster_url(F.col("poster_path")).alias("poster_url"),
        F.array_join(display_genres(F.col("genres"), 3), ", ").alias("genre_pills"),
        F.when(avg > 0, F.concat(F.lit("★ "), F.format_number(avg, 1))).alias("rating_badge"),
        F.size(F.when(expl.isNotNull() & (expl != ""), F.split(expl, SEP, -1))
               .otherwise(F.array().cast("array<string>"))).cast("bigint").alias("signal_lines"),
    )
