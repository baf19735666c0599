"""Rating statistics and the Bayesian average (AGG1-AGG4), ratings build (OP4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rating_stats(ml_ratings: DataFrame) -> DataFrame:
    """Per-movie mean and count of non-null ratings; null movie ids are dropped.

    Output: movie_id, rating_mean, rating_count. Partial (map-side) + final hash
    aggregation, so a movie holding a third of all ratings costs one partial row per
    input partition in the shuffle.
    """
    return (
        ml_ratings.where(F.col("movieId").isNotNull())
        .groupBy(F.col("movieId").alias("movie_id"))
        .agg(F.avg("rating").alias("rating_mean"), F.count("rating").alias("rating_count"))
    )


def bayesian_average(stats: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Add ``bayesian_avg = n/(n+m)*mean + m/(n+m)*C``.

    ``C`` is the unweighted mean of the per-movie means and ``m`` the exact
    (linearly interpolated) ``quantile`` of the rating counts, both over every rated
    movie. They are scalar subqueries: evaluated once and inlined, no join.
    """
    c = stats.select(F.avg("rating_mean")).scalar()
    m = stats.select(F.percentile(F.col("rating_count"), F.lit(quantile))).scalar()
    n = F.col("rating_count")
    bayes = (n / (n + m)) * F.col("rating_mean") + (m / (n + m)) * c
    return stats.withColumn("bayesian_avg", bayes)


def global_constants(stats: DataFrame, quantile: float = 0.25) -> DataFrame:
    """One row: C (mean of means) and m (count quantile) -- for reports and tests."""
    return stats.agg(
        F.avg("rating_mean").alias("c"),
        F.percentile(F.col("rating_count"), F.lit(quantile)).alias("m"),
    )


def build_ratings(ml_ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Every rating of a canonical movie (no sampling): user_id, movie_id, rating."""
    ids = movies.select(F.col("movie_id").alias("movieId"))
    return ml_ratings.join(ids, "movieId", "left_semi").select(
        F.col("userId").alias("user_id"), F.col("movieId").alias("movie_id"), F.col("rating"))
