"""Adapters: the driver's TPC-H-style tables shaped into the source application's inputs.

Every adapter is a lazy DataFrame over the Parquet tables of one scale-factor folder, so
its size grows with the data (ratings and tags come from ``lineitem x orders``).
Definitions follow FIXTURES.md section 2.1; the DuckDB oracle repeats them in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Every part is a movie and every line item a rating: nothing is capped, so the work of
# every query grows with the scale factor. Query vectors are the whole embeddings table;
# seeds for 'find similar' are the whole canonical movie table (``plans/catalog``).


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part")


def ml_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.concat(F.col("p_name"), F.lit(" #"), k.cast("string"), F.lit(" ("),
                     (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")"))
    genres = F.when(F.col("p_size") % 10 == 0, F.lit("(no genres listed)")).otherwise(
        F.concat(F.col("p_type"), F.lit("| "), F.col("p_brand"), F.lit("|S"),
                 (F.col("p_size") % 4).cast("string")))
    return _parts(spark, sf_dir).select(k.alias("movieId"), title.alias("title"), genres.alias("genres"))


def ml_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _parts(spark, sf_dir).select(
        k.alias("movieId"),
        F.concat(F.lit("tt"), k.cast("string")).alias("imdbId"),
        (k + 10000).cast("double").alias("tmdbId"),
    )


def rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders: what ratings and tags are made of."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "inner").select(
        F.col("l_partkey").alias("movie_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_quantity").cast("int").alias("q"),
        "l_linenumber", "l_returnflag", "o_orderpriority",
    )


def ml_ratings(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Ratings of ``lines``, the given ``rating_lines`` or those of the folder."""
    r = F.least(F.lit(10), F.lit(1) + ((F.col("q") - 1) % 5) + F.lit(2) * (F.col("movie_id") % 6))
    return (rating_lines(spark, sf_dir) if lines is None else lines).select(
        F.col("user_id").alias("userId"),
        F.col("movie_id").alias("movieId"),
        (r.cast("double") / F.lit(2.0)).alias("rating"),
    )


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as they come in over time: (user_id, movie_id, rating, day, seq); several lines may share a ``seq``."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    mid = F.col("l_partkey")
    r = F.least(F.lit(10), F.lit(1) + ((F.col("l_quantity").cast("int") - 1) % 5) + F.lit(2) * (mid % 6))
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), mid.alias("movie_id"), (r.cast("double") / F.lit(2.0)).alias("rating"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("seq"))


def ml_tags(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    mid = F.col("movie_id")
    t = F.concat(
        F.substring(F.col("o_orderpriority"), 3, 1 << 20), F.lit("-"), F.col("l_returnflag"),
        F.when(mid % 2 == 0, F.lit("-e")).otherwise(F.concat(F.lit("-"), (mid % 3).cast("string"))),
    )
    ln = F.col("l_linenumber") % 3
    tag = (F.when(ln == 0, F.upper(t)).when(ln == 1, F.lower(t))
           .otherwise(F.concat(F.lit(" "), F.lower(t), F.lit(" "))))
    return (rating_lines(spark, sf_dir) if lines is None else lines).select(mid.alias("movieId"), tag.alias("tag"))


def ext_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    p = _parts(spark, sf_dir)
    # texts are shuffled, never broadcast: a file of few MB may hold GBs of repeated text
    j = p.join(docs.hint("merge"), p.p_partkey == docs.doc_id, "left")
    ident = F.concat((k + 10000).cast("string"), F.when(k % 2 == 0, F.lit(".0")).otherwise(F.lit("")))
    cast = F.concat(F.lit("Actor "), (k % 5).cast("string"), F.lit(", Actor "), (k % 7).cast("string"),
                    F.lit(" ,Actor "), (k % 9).cast("string"), F.lit(",A,B,C"))
    size = F.col("p_size")
    release = F.concat((F.lit(1950) + size).cast("string"), F.lit("-0"),
                       (F.lit(1) + size % 9).cast("string"), F.lit("-15"))
    return j.select(
        ident.alias("id"),
        F.col("p_name").alias("title"),
        F.col("text").alias("overview"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("tagline "), F.col("p_brand"))).alias("tagline"),
        F.col("p_type").alias("genres"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(cast).alias("movie_cast"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Director "), (k % 23).cast("string"))).alias("director"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/p"), k.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        (F.col("p_retailprice") / F.lit(200.0)).alias("vote_average"),
        (size * 10).cast("int").alias("vote_count"),
        F.when(k % 13 == 0, F.lit("unknown")).otherwise(release).alias("release_date"),
    )


def availability_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    base = F.concat(F.col("p_name"), F.lit(" #"), k.cast("string"))
    size = F.col("p_size")
    return _parts(spark, sf_dir).select(
        F.when(k % 4 == 0, F.upper(base)).otherwise(F.concat(F.lit(" "), base, F.lit(" "))).alias("Title"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise((F.lit(1950) + size).cast("string")).alias("Year"),
        (size % 2).cast("int").alias("Netflix"),
        (size % 3 == 0).cast("int").alias("Hulu"),
        (size % 5 == 0).cast("int").alias("Prime Video"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries given as vectors: every row of the embeddings table."""
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries given as text: every benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"))


def seeds(spark: SparkSession, sf_dir: str, ids) -> DataFrame:
    """Seed movies for 'find similar' given by id (the application's one-movie entry point)."""
    return _parts(spark, sf_dir).where(F.col("p_partkey").isin(list(ids))).select(
        F.col("p_partkey").alias("seed_id"))
