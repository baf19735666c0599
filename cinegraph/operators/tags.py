"""Tag build (OP3): count raw tags per movie, floor, normalise, top-n per movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.text import strip


def build_tags(ml_tags: DataFrame, movies: DataFrame, min_count: int = 2, top_n: int = 20) -> DataFrame:
    """movie_tags(movie_id, tag, count).

    Counts are taken per (movie, raw tag) *before* lower/strip, and the top-n is chosen
    on those counts without re-aggregating, so a (movie, tag) pair may repeat with
    different counts. Ties are broken by normalised then raw tag. Blank tags are dropped
    after ranking.
    """
    ids = movies.select(F.col("movie_id").alias("movieId"))
    counted = (
        ml_tags.where(F.col("movieId").isNotNull() & F.col("tag").isNotNull())
        .join(ids, "movieId", "left_semi")
        .groupBy("movieId", "tag").agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= min_count)
        .select(F.col("movieId").alias("movie_id"), F.col("tag").alias("raw_tag"),
                strip(F.lower(F.col("tag"))).alias("tag"), "count")
    )
    w = Window.partitionBy("movie_id").orderBy(F.desc("count"), F.asc("tag"), F.asc("raw_tag"))
    top = counted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n)
    return top.where(F.col("tag") != "").select("movie_id", "tag", F.col("count").cast("bigint").alias("count"))
