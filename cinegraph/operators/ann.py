"""Approximate top-k by stored inverted lists of product-quantised codes (VEC4).

The index. A coarse quantiser of ``n_cells`` unit vectors deals every vector to the cell with
the largest inner product. What the cell's centre leaves of the vector is cut into ``n_parts``
parts, and each part is replaced by the number of its nearest word in that part's codebook: a
vector becomes ``n_parts`` bytes. The codes are written as Parquet with one folder a cell, beside
the centres and the codebooks, and can be opened again by path.

The search. A query probes its ``nprobe`` best cells. The inner product with every word of every
codebook is tabulated once a query, so the score of a code is the cell's score plus ``n_parts``
table entries; no full vector is read. These scores decide; a product in single precision of the
query with what the codes stand for tells which codes of a list can be among the best at all (its
error is bounded, see ``_may_reach``), and only those are looked up. The best ``rerank`` codes a
query are joined with the vectors and ranked by their exact inner product.

Scale. Lists are dealt out in blocks of at most some ``LIST_BLOCK`` codes (a hot cell is many
blocks) and queries in blocks of ``QUERY_BLOCK``, so a task holds a bounded part of each whatever
their sizes; a block returns at most ``rerank`` rows a query. Only the model (centres and
codebooks, sizes fixed by parameters) goes to the tasks. The model is fitted on a bounded sample,
``sample`` rows with the least MD5 of their id; every vector is indexed.

Defined cases: ties by the smaller cell, code and id; vectors that repeat an id are ranked as one
each; an empty query set gives an empty result; an index needs at least one vector, and with
fewer than ``n_cells`` + 1 sampled vectors the codebooks hold one word of zeros, so that cells alone
decide which vectors are ranked exactly. Null vectors and vectors of another dimension raise an
error: ``sinks.split_by_dimension`` lists them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions.vector import dot
from cinegraph.operators.joins import top_k

# Scores and distances are compared after rounding, so that engines summing in another order agree.
DIGITS = 9
LIST_BLOCK = 65_536
QUERY_BLOCK = 8_192
# Queries whose tables a task holds at a time.
_TABLES = 64
# Codes of a list whose best rough score is looked at as one, at most, and norms past which single precision isn't used.
_BUNCH, _MAX_NORM = 64, 1e30

HITS = "query_id long, item_id long, score_key double"


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or len(np.unique(sizes)) > 1:
        raise ValueError("the index needs vectors of one dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


@dataclass(frozen=True)
class Model:
    """``centers`` (cells, dim) and ``books`` (parts, words, dim / parts)."""

    centers: np.ndarray
    books: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(np.round(x @ self.centers.T, DIGITS), axis=1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(parts, rows, dim / parts) of rows of vectors."""
        return x.reshape(len(x), len(self.books), -1).transpose(1, 0, 2)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(rows, parts): the number of the word nearest to each part of what the centre leaves."""
        out = np.empty((len(x), len(self.books)), np.uint8)
        for p, (part, book) in enumerate(zip(self.parts(x - self.centers[cells]), self.books, strict=True)):
            out[:, p] = _nearest(part, book)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, words): inner products of the queries' parts with all words."""
        return (self.parts(q) @ self.books.transpose(0, 2, 1)).transpose(1, 0, 2)

    def words(self, codes: np.ndarray) -> np.ndarray:
        """(rows, dim): the words that rows of codes name, side by side."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), 1024):
        gaps = rows[lo:lo + 1024, None, :] - words[None, :, :]
        out[lo:lo + 1024] = np.argmin(np.round((gaps * gaps).sum(axis=2), DIGITS), axis=1)
    return out


def fit(vectors: DataFrame, n_cells: int, n_parts: int, n_words: int = 256, sample: int = 16_384,
        iterations: int = 10, id_col: str = "movie_id") -> Model:
    """Centres and codebooks from a bounded sample: the ``sample`` vectors of least MD5 of their id.

    The first ``n_cells`` of them are the first centres, the next ``n_words`` give the first words;
    ``iterations`` rounds of (spherical) k-means over the sample follow, none if 0.
    """
    if not 1 <= n_words <= 256:
        raise ValueError("a code is one byte: n_words must be 1 to 256")
    key = F.md5(F.col(id_col).cast("string"))
    drawn = vectors.select(id_col, "embedding").orderBy(key, id_col).limit(max(sample, n_cells + n_words)).toPandas()
    if drawn.empty:
        raise ValueError("an index needs at least one vector")
    x = _stack(drawn["embedding"])
    if x.shape[1] % n_parts:
        raise ValueError(f"{x.shape[1]} dimensions cannot be cut into {n_parts} equal parts")
    centers = x[:n_cells].copy()
    for _ in range(iterations):
        at = np.argmax(np.round(x @ centers.T, DIGITS), axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        filled = np.bincount(at, minlength=len(centers)) > 0
        centers[filled] = _unit(sums[filled])
    blank = Model(centers, np.zeros((n_parts, 1, x.shape[1] // n_parts)))
    rest = blank.parts(x - centers[blank.cells(x)])
    books = rest[:, n_cells:n_cells + n_words].copy()
    if not books.shape[1]:
        return blank
    for _ in range(iterations):
        for p in range(n_parts):
            at = _nearest(rest[p], books[p])
            counts = np.bincount(at, minlength=books.shape[1])
            sums = np.zeros_like(books[p])
            np.add.at(sums, at, rest[p])
            books[p][counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return Model(centers, books)


@dataclass(frozen=True)
class Index:
    """An opened index: the model, and the stored lists (item_id, code, cell)."""

    model: Model
    lists: DataFrame


def encode(vectors: DataFrame, model: Model, id_col: str = "movie_id") -> DataFrame:
    """(item_id, code, cell) of every vector."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["embedding"])
                cells = model.cells(x)
                yield pd.DataFrame({"item_id": pdf["item_id"], "code": [c.tobytes() for c in model.codes(x, cells)],
                                    "cell": cells.astype(np.int32)})

    source = vectors.select(F.col(id_col).cast("long").alias("item_id"), "embedding")
    return source.mapInPandas(run, "item_id long, code binary, cell int")


def write_index(vectors: DataFrame, model: Model, path: str, id_col: str = "movie_id") -> Index:
    """Write lists, centres and codebooks under ``path`` and open them."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    encode(vectors, model, id_col).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    words = [(p, w, [float(v) for v in word]) for p, book in enumerate(model.books) for w, word in enumerate(book)]
    centers = [(c, [float(v) for v in center]) for c, center in enumerate(model.centers)]
    spark.createDataFrame(words, "part int, word int, entries array<double>").write.mode("overwrite").parquet(f"{path}/books")
    spark.createDataFrame(centers, "cell int, center array<double>").write.mode("overwrite").parquet(f"{path}/centers")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index stored under ``path``; only the model's bounded tables are read now."""
    path = path.rstrip("/")
    centers = spark.read.parquet(f"{path}/centers").orderBy("cell").toPandas()
    words = spark.read.parquet(f"{path}/books").orderBy("part", "word").toPandas()
    entries = _stack(words["entries"])
    model = Model(_stack(centers["center"]), entries.reshape(words["part"].nunique(), -1, entries.shape[1]))
    lists = spark.read.schema("item_id long, code binary, cell int").parquet(f"{path}/lists")
    return Index(model, lists)


def probes(queries: DataFrame, model: Model, nprobe: int) -> DataFrame:
    """(query_id, q_vec, cell, base): the ``nprobe`` best cells of every query and their scores."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = _matrix(batch.column(1)) @ model.centers.T
                best = np.argsort(-np.round(scores, DIGITS), axis=1, kind="stable")[:, :nprobe]
                ends = pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (
                    best.astype(np.int32), np.take_along_axis(scores, best, axis=1))]
                yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), *lists],
                                      names=["query_id", "q_vec", "cells", "bases"])

    source = queries.select(F.col("query_id").cast("long"), F.col("embedding").alias("q_vec"))
    probed = source.mapInArrow(run, "query_id long, q_vec array<float>, cells array<int>, bases array<double>")
    return probed.select("query_id", "q_vec", F.explode(F.arrays_zip("cells", "bases")).alias("_p")).select(
        "query_id", "q_vec", F.col("_p.cells").alias("cell"), F.col("_p.bases").alias("base"))


def _may_reach(q: np.ndarray, base: np.ndarray, words: np.ndarray, longest: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``words``) of all that can be among a query's ``n`` best, in this order.

    ``words`` is in single precision, ``longest`` its largest norm. A sum of products is off by less than
    (dim + 8) * 2**-24 of the norms' product; the rest of the slack is for keys rounded to ``DIGITS``.
    """
    bound = np.linalg.norm(q, axis=1) * longest
    slack = 2 * (q.shape[1] + 8) * 2.0 ** -24 * bound + 4 * 10.0 ** -DIGITS + 2.0 ** -40 * np.abs(base)
    if len(words) <= n:
        return np.repeat(np.arange(len(q)), len(words)), np.tile(np.arange(len(words)), len(q))
    size = min(_BUNCH, max(1, len(words) // (4 * n)))
    bunches = len(words) // size
    sure = bound < _MAX_NORM  # not so for NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q.astype(np.float32) @ words.T
        # n bunches whose best reach a score hold n codes that do
        best = scores[:, :bunches * size].reshape(len(q), size, bunches).max(axis=1)
        floor = np.partition(best, bunches - n, axis=1)[:, bunches - n] - slack
        floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
        return np.nonzero((scores >= floor[:, None]) | ~sure[:, None])


def list_hits(queries: DataFrame, index: Index, n: int, nprobe: int, list_block: int = LIST_BLOCK,
              query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, item_id, score_key): the best ``n`` codes of the probed lists, by table lookup."""
    model = index.model
    asked = probes(queries, model, nprobe)
    # one row a cell: as many as the model has centres
    sizes = index.lists.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(list_block)).cast("int").alias("_blocks"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("_qblocks"))
    shape = F.broadcast(sizes.join(wanted, "cell"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(shape, "cell").withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_qblocks")).cast("int")).withColumn(
        "_b", span("_blocks")).drop("_blocks", "_qblocks")
    right = index.lists.join(shape, "cell").withColumn("_b", F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int")).withColumn(
        "_qb", span("_qblocks")).drop("_blocks", "_qblocks")

    def score(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score_key": []})
        held = held.sort_values("item_id", kind="stable")
        items = held["item_id"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
        words = model.words(codes)
        rough, longest = words.astype(np.float32), np.linalg.norm(words, axis=1).max()
        del words
        ids, bases, found = asking["query_id"].to_numpy(np.int64), asking["base"].to_numpy(), []
        for lo in range(0, len(ids), _TABLES):
            q, base = _stack(asking["q_vec"].iloc[lo:lo + _TABLES]), bases[lo:lo + _TABLES]
            row, at = _may_reach(q, base, rough, longest, n)
            tables, keys = model.tables(q), base[row]
            for p, place in enumerate(row * tables.shape[2] + codes[at].T):
                keys += tables[:, p].ravel()[place]
            keys = np.round(keys, DIGITS)
            if n < len(items):  # a query without n scores that are numbers finds nothing
                kept = np.flatnonzero((np.bincount(row[~np.isnan(keys)], minlength=len(q)) >= n)[row])
                row, at, keys = row[kept], at[kept], keys[kept]
            best = np.lexsort((-keys, row))  # equal keys stay in the order of items
            row = row[best]
            first = np.arange(len(row)) - np.searchsorted(row, row, "left") < n
            best = best[first]
            found.append((ids[lo:lo + _TABLES][row[first]], items[at[best]], keys[best]))
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score_key"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    hits = left.groupBy("cell", "_b", "_qb").cogroup(right.groupBy("cell", "_b", "_qb")).applyInPandas(score, HITS)
    return top_k(hits, ["query_id"], [F.desc("score_key"), F.asc("item_id")], n, rank_col="_n").drop("_n")


def search_index(queries: DataFrame, index: Index, vectors: DataFrame, k: int, nprobe: int, rerank: int,
                 id_col: str = "movie_id", **blocks) -> DataFrame:
    """(query_id, id, score, vec_rank): the ``rerank`` best codes of ``nprobe`` lists, ranked exactly."""
    hits = list_hits(queries, index, max(rerank, k), nprobe, **blocks)
    asked = queries.select("query_id", F.col("embedding").alias("q_vec"))
    held = vectors.select(F.col(id_col).cast("long").alias("item_id"), F.col("embedding").alias("v_vec"))
    scored = hits.join(held, "item_id").join(asked, "query_id").select(
        "query_id", F.col("item_id").alias(id_col), dot("q_vec", "v_vec").alias("score"))
    return top_k(scored, ["query_id"], [F.round("score", DIGITS).desc(), F.asc(id_col)], k, rank_col="vec_rank")


def codes_read(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """(query_id, codes): how many codes the lists hold that a query probes."""
    sizes = index.lists.groupBy("cell").agg(F.count("*").alias("n"))
    return probes(queries, index.model, nprobe).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("codes"))


def recall_at_k(approx: DataFrame, exact: DataFrame, id_col: str = "movie_id") -> DataFrame:
    """Per query: share of the exact top-k ids that the approximate search returned."""
    e = exact.select("query_id", id_col)
    a = approx.select("query_id", id_col, F.lit(1).alias("_hit"))
    j = e.join(a, ["query_id", id_col], "left")
    return j.groupBy("query_id").agg(
        (F.sum(F.coalesce(F.col("_hit"), F.lit(0))) / F.count(F.lit(1))).alias("recall"),
        F.count(F.lit(1)).alias("k"))
