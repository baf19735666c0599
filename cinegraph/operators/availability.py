"""Provider availability build (OP2): melt, filter, normalise, null-safe title/year join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.text import PROVIDER_COLUMNS, movie_title_key, strip, title_key, to_int_truncated


def availability_long(raw: DataFrame) -> DataFrame:
    """Wide 0/1 provider columns -> rows (title_norm, year, provider) that are available.

    Missing provider columns count as all-zero; ``provider`` is stripped and lower-cased.
    """
    vals = [(F.col(f"`{p}`") if p in raw.columns else F.lit(0)).cast("double").alias(p)
            for p in PROVIDER_COLUMNS]
    title = F.col("Title") if "Title" in raw.columns else F.lit(None).cast("string")
    year = F.col("Year") if "Year" in raw.columns else F.lit(None).cast("string")
    wide = raw.select(title_key(title).alias("title_norm"), to_int_truncated(year).alias("year"), *vals)
    long = wide.unpivot(["title_norm", "year"], PROVIDER_COLUMNS, "provider", "available")
    return (long.where(F.col("available") == 1.0)
            .select("title_norm", "year", F.lower(strip(F.col("provider"))).alias("provider")))


def build_availability(raw: DataFrame, movies: DataFrame) -> DataFrame:
    """Distinct (movie_id, provider) pairs; many-to-many join on (title key, year) where a
    null year matches a null year. Empty input gives an empty table with the schema."""
    long = availability_long(raw)
    mj = movies.select(
        F.col("movie_id"),
        movie_title_key(F.col("title")).alias("m_title_norm"),
        F.col("year").cast("bigint").alias("m_year"),
    )
    cond = (long.title_norm == mj.m_title_norm) & long.year.eqNullSafe(mj.m_year)
    return long.join(mj, cond, "inner").select("movie_id", "provider").distinct()
