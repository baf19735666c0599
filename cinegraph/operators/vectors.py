"""Vector build (OP6), text embedding (VEC1/VEC2) and the vector contract audit (VEC6)."""

from __future__ import annotations

import hashlib
import re
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.text import make_doc
from cinegraph.functions.vector import l2_norm


# Rows the default encoder holds as dense vectors, and terms whose hash it remembers.
ENCODER_ROWS = 256
ENCODER_TERMS = 500_000


def embedding_docs(movies: DataFrame, missing: str = "omit") -> DataFrame:
    """(movie_id, doc) for every movie with an overview."""
    return movies.where(F.col("overview").isNotNull()).select(
        "movie_id",
        make_doc(F.col("overview"), F.col("tagline"), F.col("genres"), F.col("director"),
                 F.col("title"), F.col("year"), missing=missing).alias("doc"),
    )


def term_slot(term: str, dim: int) -> int:
    """The entry of a term: the first 32 bits of its MD5, modulo ``dim``."""
    return int.from_bytes(hashlib.md5(term.encode("utf-8")).digest()[:4], "big") % dim


def hashing_encoder(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 768) -> DataFrame:
    """Default encoder: terms (runs of letters and digits of any script, lower-cased) counted in
    entries by hash, as a unit L2 vector; a text without terms is the zero vector.

    Arrow batches; the hash is MD5, so that any SQL engine can repeat it.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out_col}` array<float>"
    at = df.columns.index(text_col)
    term = re.compile(r"[^\W_]+")

    def run(batches):
        slots: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODER_ROWS):
                part = batch.slice(lo, ENCODER_ROWS)
                flat = np.zeros((part.num_rows, dim), np.float64)
                for i, text in enumerate(part.column(at).to_pylist()):
                    terms = term.findall((text or "").lower())
                    if len(slots) > ENCODER_TERMS:
                        slots.clear()
                    for t in terms:
                        if t not in slots:
                            slots[t] = term_slot(t, dim)
                    if terms:
                        flat[i] = np.bincount([slots[t] for t in terms], minlength=dim)
                        flat[i] /= np.sqrt(flat[i] @ flat[i])
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
                vectors = pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def python_encoder(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                   dim: int, out_col: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Pluggable Python encoder (e.g. a transformer model) run with Arrow batches.

    ``make_encoder`` is called once per task and returns ``encode(texts) -> (n, dim)``;
    rows are unit-normalised afterwards. Output schema: input columns + ``out_col``.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, `{out_col}` array<float>"

    def run(batches):
        enc = make_encoder()
        for pdf in batches:
            for lo in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[lo:lo + batch_size].copy()
                vecs = np.asarray(enc(chunk[text_col].fillna("").tolist()), dtype=np.float64).reshape(len(chunk), dim)
                norms = np.linalg.norm(vecs, axis=1, keepdims=True)
                vecs = np.divide(vecs, norms, out=np.zeros_like(vecs), where=norms > 0)
                chunk[out_col] = list(vecs.astype(np.float32))
                yield chunk
    return df.mapInPandas(run, schema)


def _payload(movies: DataFrame) -> DataFrame:
    return movies.select(
        "movie_id",
        F.coalesce(F.col("title"), F.lit("nan")).alias("title"),
        F.col("year"),
        F.coalesce(F.col("genres"), F.lit("")).alias("genres"),
        F.coalesce(F.col("director"), F.lit("")).alias("director"),
        F.coalesce(F.col("poster_path"), F.lit("")).alias("poster_path"),
        F.coalesce(F.col("bayesian_avg"), F.lit(0.0)).alias("bayesian_avg"),
    )


VECTOR_COLUMNS = ["movie_id", "embedding", "title", "year", "genres", "director", "poster_path", "bayesian_avg"]


def vectors_from_table(movies: DataFrame, embeddings: DataFrame, dim: int | None = None) -> DataFrame:
    """movie_vectors from precomputed vectors (id, embedding): movies with an overview
    joined on id; one point per movie; optional dimension contract."""
    emb = embeddings.select(F.col("vec_id").alias("movie_id"), "embedding")
    out = _payload(movies.where(F.col("overview").isNotNull())).join(emb, "movie_id", "inner")
    if dim is not None:
        out = out.where(F.size("embedding") == dim)
    return out.dropDuplicates(["movie_id"]).select(*VECTOR_COLUMNS)


def vectors_from_text(movies: DataFrame, dim: int = 768, encoder=None, missing: str = "omit") -> DataFrame:
    """movie_vectors embedded from the movie documents (overview, tagline, genres,
    director, title and year)."""
    docs = embedding_docs(movies, missing=missing)
    enc = encoder or (lambda df, col: hashing_encoder(df, col, dim=dim))
    emb = enc(docs, "doc").select(F.col("movie_id"), F.col("embedding"))
    out = _payload(movies.where(F.col("overview").isNotNull())).join(emb, "movie_id", "inner")
    return out.dropDuplicates(["movie_id"]).select(*VECTOR_COLUMNS)


def vector_contract(vectors: DataFrame, dim: int, tol: float = 1e-5) -> DataFrame:
    """One row: points, points with the wrong dimension, points not of unit length."""
    n = l2_norm("embedding")
    return vectors.agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(F.when(F.size("embedding") != dim, 1).otherwise(0)).cast("bigint").alias("bad_dim"),
        F.sum(F.when(F.abs(n - 1.0) >= tol, 1).otherwise(0)).cast("bigint").alias("not_unit"),
    )
