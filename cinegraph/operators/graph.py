"""Property-graph build (OP5) as node and edge DataFrames.

Nodes: Movie, Genre, Tag, User. Edges: HAS_GENRE (movie, genre), HAS_TAG (movie, tag,
count) and RATED (user, movie, rating). Edge identity includes the property (count,
rating), so parallel edges with different values are kept, identical ones collapse.
Every pattern the queries match is at most two hops, i.e. equi-joins of edge tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.text import NO_GENRE_MARKER, strip


def movie_nodes(movies: DataFrame) -> DataFrame:
    """Movie node properties with the load defaults (null title -> 'nan', null average
    -> 0.0, null poster -> '')."""
    return movies.select(
        "movie_id",
        F.coalesce(F.col("title"), F.lit("nan")).alias("title"),
        F.col("year"),
        F.coalesce(F.col("bayesian_avg"), F.lit(0.0)).alias("bayesian_avg"),
        F.coalesce(F.col("poster_path"), F.lit("")).alias("poster_path"),
    )


def genre_edges(movies: DataFrame) -> DataFrame:
    """Split pipe-separated genres; drop blanks and the no-genre marker; one edge per pair."""
    parts = F.split(F.coalesce(F.col("genres"), F.lit("")), r"\|", -1)
    exploded = movies.select("movie_id", F.explode(parts).alias("g"))
    cleaned = exploded.select("movie_id", strip(F.col("g")).alias("genre"))
    return (cleaned.where((F.col("genre") != "") & (F.lower(F.col("genre")) != NO_GENRE_MARKER))
            .dropDuplicates(["movie_id", "genre"]))


def tag_edges(movie_tags: DataFrame, movies: DataFrame) -> DataFrame:
    """HAS_TAG edges of loaded movies, deduplicated on (movie, tag, count)."""
    return (movie_tags.join(movies.select("movie_id"), "movie_id", "left_semi")
            .select("movie_id", "tag", "count").dropDuplicates(["movie_id", "tag", "count"]))


def rated_edges(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """RATED edges of loaded movies, deduplicated on (user, movie, rating)."""
    return (ratings.join(movies.select("movie_id"), "movie_id", "left_semi")
            .select("user_id", "movie_id", "rating").dropDuplicates(["user_id", "movie_id", "rating"]))


def fan_edges(rated: DataFrame, min_rating: float = 4.0) -> DataFrame:
    """Distinct (user, movie) pairs with a rating >= ``min_rating``: the hop-2 side of the
    co-rating pattern. Distinct pairs make ``count(*)`` equal ``count(DISTINCT user)``, so
    the co-fan count aggregates map-side."""
    return (rated.where(F.col("rating") >= min_rating)
            .select("user_id", "movie_id").distinct())


def genre_nodes(has_genre: DataFrame) -> DataFrame:
    return has_genre.select(F.col("genre").alias("name")).distinct()


def tag_nodes(has_tag: DataFrame) -> DataFrame:
    return has_tag.select(F.col("tag").alias("name")).distinct()


def user_nodes(rated: DataFrame) -> DataFrame:
    return rated.select("user_id").distinct()


def graph_counts(nodes_movie: DataFrame, has_genre: DataFrame, has_tag: DataFrame,
                 rated: DataFrame) -> DataFrame:
    """Audit: node counts per label and edge counts per type, one row each. Each table is read
    once: its nodes are the groups of its edges, and its edges the sum of their sizes."""
    def count(df: DataFrame, node: str, label: str, edge: str) -> DataFrame:
        groups = df.groupBy(node).agg(F.count(F.lit(1)).alias("c"))
        # a count of distinct values leaves nulls out
        both = groups.agg(F.count(node).alias("nodes"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))
        return both.select(F.inline(F.array(
            F.struct(F.lit("node").alias("kind"), F.lit(label).alias("label"), F.col("nodes").alias("n")),
            F.struct(F.lit("edge").alias("kind"), F.lit(edge).alias("label"), F.col("rows").alias("n")))))

    movies = nodes_movie.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.lit("Movie").alias("label"), "n")
    return movies.unionByName(count(has_genre, "genre", "Genre", "HAS_GENRE")).unionByName(
        count(has_tag, "tag", "Tag", "HAS_TAG")).unionByName(count(rated, "user_id", "User", "RATED"))
