"""Raw input readers (SRC1-SRC10): explicit schemas, NA-token decoding, optional tables.

CSV scans are splittable and column-pruned by Catalyst; no schema inference runs (one
pass over the data, types fixed up front).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegraph.functions.text import PROVIDER_COLUMNS, na_decode, strip, to_number

# --- fixed values: input schemas of the source data sets (FIXTURES.md section 1) --------
ML_MOVIES_SCHEMA = "movieId BIGINT, title STRING, genres STRING"
ML_LINKS_SCHEMA = "movieId BIGINT, imdbId STRING, tmdbId DOUBLE"
ML_RATINGS_SCHEMA = "userId BIGINT, movieId BIGINT, rating DOUBLE, timestamp BIGINT"
ML_TAGS_SCHEMA = "userId BIGINT, movieId BIGINT, tag STRING, timestamp BIGINT"
EXT_META_COLUMNS = [
    ("id", "string"), ("imdb_id", "string"), ("title", "string"), ("overview", "string"),
    ("tagline", "string"), ("genres", "string"), ("movie_cast", "string"), ("director", "string"),
    ("poster_path", "string"), ("vote_average", "double"), ("vote_count", "int"),
    ("release_date", "string"), ("runtime", "double"),
]
# ------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    """Path check through the Hadoop file system of the session (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def decode_na(df: DataFrame) -> DataFrame:
    """Turn the CSV NA tokens into nulls in every string column (a tag spelled 'null'
    disappears, as with the pandas reader)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(na_decode(c).alias(f.name) if isinstance(f.dataType, T.StringType) else c)
    return df.select(*cols)


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _parsed(column: str, kind: T.DataType):
    """A text column as its type: null where it doesn't parse. Whole numbers may be written ``1.0``."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(strip(c).try_cast(kind), to_number(c).try_cast(kind))
    return to_number(c).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else strip(c).try_cast(kind)


def _scan(spark: SparkSession, path: str, schema: T.StructType, free_text: bool) -> tuple[DataFrame, Column]:
    """Rows as text with NA tokens as nulls, and whether a row has a text where its column's type can't be read."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = (spark.read.schema(texts).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", free_text).option("mode", "PERMISSIVE").csv(path))
    bad = F.lit(False)
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            bad = bad | (F.col(f"`{f.name}`").isNotNull() & _parsed(f.name, f.dataType).isNull())
    return decode_na(rows), bad


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None,
             free_text: bool = False) -> DataFrame:
    """Header CSV with a fixed schema; NA tokens decoded to null in every column, missing last
    fields are null. Records that don't fit the schema are left out; ``rejected_csv`` has them.

    ``free_text``: quoted fields may hold line breaks. Such a file is read by one task, so large
    inputs come as many files; without it, files are split.
    """
    kind = _schema(schema)
    rows, bad = _scan(spark, path, kind, free_text)
    return rows.where(~bad).select(*[_parsed(f.name, f.dataType).alias(f.name) for f in kind.fields
                                     if columns is None or f.name in columns])


def rejected_csv(spark: SparkSession, path: str, schema: str | T.StructType, free_text: bool = False) -> DataFrame:
    """The reject table: (file, all columns as text) of the records that ``read_csv`` leaves out."""
    rows, bad = _scan(spark, path, _schema(schema), free_text)
    return rows.withColumn("file", F.input_file_name()).where(bad)


def read_ml_movies(spark, path): return read_csv(spark, path, ML_MOVIES_SCHEMA, free_text=True)     # SRC1
def read_ml_links(spark, path): return read_csv(spark, path, ML_LINKS_SCHEMA)                       # SRC2
def read_ml_ratings(spark, path): return read_csv(spark, path, ML_RATINGS_SCHEMA, ["userId", "movieId", "rating"])  # SRC3
def read_ml_tags(spark, path): return read_csv(spark, path, ML_TAGS_SCHEMA, ["movieId", "tag"], free_text=True)     # SRC4


def read_ext_meta(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: cached metadata Parquet; only the expected columns that exist are kept."""
    df = spark.read.parquet(path)
    keep = [c for c, _ in EXT_META_COLUMNS if c in df.columns]
    return df.select(*keep)


def read_availability_raw(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: optional wide availability CSV. Read as text columns (no inference); provider
    columns parsed as numbers (``1`` and ``1.0`` alike); an absent file gives an empty table with the full schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], availability_raw_schema())
    df = decode_na(spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path))
    out = [F.col("Title").cast("string").alias("Title") if "Title" in df.columns else F.lit(None).cast("string").alias("Title"),
           F.col("Year").cast("string").alias("Year") if "Year" in df.columns else F.lit(None).cast("string").alias("Year")]
    for p in PROVIDER_COLUMNS:
        if p in df.columns:
            out.append(to_number(F.col(f"`{p}`")).cast("int").alias(p))
    return df.select(*out)


def availability_raw_schema() -> T.StructType:
    return T.StructType([T.StructField("Title", T.StringType()), T.StructField("Year", T.StringType())]
                        + [T.StructField(p, T.IntegerType()) for p in PROVIDER_COLUMNS])


def read_optional_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """SRC8: a table that may not exist (e.g. provider availability): None when absent."""
    if not _exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, columns: list[tuple[str, str]], fill: dict | None = None) -> DataFrame:
    """SRC9: project onto the expected columns; absent ones are added as typed nulls (or
    the given fill value)."""
    fill = fill or {}
    out = []
    for name, dtype in columns:
        if name in df.columns:
            out.append(F.col(f"`{name}`").cast(dtype).alias(name))
        else:
            out.append(F.lit(fill.get(name)).cast(dtype).alias(name))
    return df.select(*out)


def path_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path) if "://" in path or path.startswith("/") else os.path.exists(path)
