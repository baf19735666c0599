"""Semantic search (OP7): vector top-k, quality blend, re-rank; many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.operators.joins import top_k
from cinegraph.operators.knn import knn_exact

# --- fixed values of the source application ------------------------------------------
OVERFETCH = 5            # neighbours fetched per result
W_SEMANTIC, W_QUALITY = 0.6, 0.4
SCORE_DIGITS = 3
# ------------------------------------------------------------------------------------


def quality(avg) -> F.Column:
    """min(avg/5, 1) for a positive average, else 0."""
    return F.when(avg > 0, F.least(avg / F.lit(5.0), F.lit(1.0))).otherwise(F.lit(0.0))


def search(queries: DataFrame, vectors: DataFrame, limit: int = 20) -> DataFrame:
    """For each query vector: fetch ``5*limit`` nearest movies, blend
    0.6*cosine + 0.4*quality, round to 3 digits, order by it (ties keep vector order)."""
    hits = knn_exact(queries.select("query_id", "embedding"), vectors.select("movie_id", "embedding"),
                     k=limit * OVERFETCH)
    payload = vectors.select("movie_id", "title", "year", "genres", "poster_path", "bayesian_avg")
    j = hits.join(payload, "movie_id", "inner")
    avg = F.coalesce(F.col("bayesian_avg"), F.lit(0.0))
    blended = F.lit(W_SEMANTIC) * F.col("score") + F.lit(W_QUALITY) * quality(avg)
    scored = j.withColumn("blend", F.round(blended, SCORE_DIGITS)).withColumn("bayesian_avg", avg)
    ranked = top_k(scored, ["query_id"], [F.desc("blend"), F.asc("vec_rank")], limit)
    return ranked.select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("rank").cast("bigint").alias("rank"),
        F.col("movie_id").cast("bigint").alias("movie_id"), "title", F.col("year").cast("bigint").alias("year"),
        "genres", "poster_path", F.round("bayesian_avg", 6).alias("bayesian_avg"),
        F.col("blend").alias("score"), F.round("score", 6).alias("cosine"),
    )
