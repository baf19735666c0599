"""The table catalog: the batch build's outputs, written once and read back.

The source application's pipeline writes canonical tables that three loaders and two
query paths read again. Here every build output is a Parquet table under the session's
shared checkpoint folder (``spark.checkpoint.dir``); writing it cuts the lineage, so the
queries re-read compact tables instead of re-running the joins, and a lost executor
only re-reads files. Edge tables are sorted by movie inside each file so that seed
lookups skip row groups (see ``_LAYOUT``).
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.operators import ann as ann_ops
from cinegraph.operators import availability as avail_ops
from cinegraph.operators import graph as graph_ops
from cinegraph.operators import movies as movie_ops
from cinegraph.operators import ratings as rating_ops
from cinegraph.operators import tags as tag_ops
from cinegraph.operators import vectors as vec_ops
from cinegraph.session import ensure_checkpoint_dir
from cinegraph.sources import adapters, readers
from cinegraph.sources.bucketed import BucketedTable, write_bucketed

_LOCK = threading.Lock()
# Buckets of the tables laid out by movie: one task each, so at scale some hundred MB of edges a bucket.
BUCKETS = 64
_CATALOGS: dict[tuple[str, str], "Catalog"] = {}

# Parquet layout: sort columns inside each written partition. The sort is local (no
# extra shuffle): every file holds row groups ordered by movie, so a seed lookup with a
# pushed-down ``movie_id IN (...)`` reads about one row group per file, and a hot movie
# stays spread over the files the upstream shuffle produced.
_LAYOUT = {
    "ratings": ["movie_id", "user_id"],
    "rated": ["movie_id", "user_id"],
    "fan_edges": ["user_id", "movie_id"],
    "movie_tags": ["movie_id", "tag"],
    "has_tag": ["movie_id", "tag"],
}


class AdapterInputs:
    """Raw inputs shaped from the driver's test tables (``sources/adapters.py``). ``lines`` gives the lines that
    ratings and tags share, once they are kept; without it they are joined anew."""

    def __init__(self, spark: SparkSession, sf_dir: str, lines=lambda: None):
        self.spark, self.sf_dir, self.lines = spark, sf_dir.rstrip("/"), lines

    def kept(self, keep) -> "AdapterInputs":
        """The same inputs with lines from ``keep(name, build)``, which builds them once."""
        return AdapterInputs(self.spark, self.sf_dir, lambda: keep(
            "rating_lines", lambda: adapters.rating_lines(self.spark, self.sf_dir)))

    def ml_movies(self): return adapters.ml_movies(self.spark, self.sf_dir)
    def ml_links(self): return adapters.ml_links(self.spark, self.sf_dir)
    def ml_ratings(self): return adapters.ml_ratings(self.spark, self.sf_dir, self.lines())
    def ml_tags(self): return adapters.ml_tags(self.spark, self.sf_dir, self.lines())
    def ext_meta(self): return adapters.ext_meta(self.spark, self.sf_dir)
    def availability_raw(self): return adapters.availability_raw(self.spark, self.sf_dir)
    def embeddings(self): return adapters.embeddings(self.spark, self.sf_dir)


class FileInputs:
    """Raw inputs read from files: the rating data set's CSVs (movies, links, ratings,
    tags), the metadata Parquet and the optional wide availability CSV. Without a
    precomputed (vec_id, embedding) Parquet the movie vectors are embedded from text."""

    def __init__(self, spark: SparkSession, ml_dir: str, ext_meta_path: str,
                 availability_csv: str | None = None, embeddings_path: str | None = None):
        self.spark, self.ml_dir = spark, ml_dir.rstrip("/")
        self.ext_meta_path, self.availability_csv, self.embeddings_path = ext_meta_path, availability_csv, embeddings_path

    def ml_movies(self): return readers.read_ml_movies(self.spark, f"{self.ml_dir}/movies.csv")
    def ml_links(self): return readers.read_ml_links(self.spark, f"{self.ml_dir}/links.csv")
    def ml_ratings(self): return readers.read_ml_ratings(self.spark, f"{self.ml_dir}/ratings.csv")
    def ml_tags(self): return readers.read_ml_tags(self.spark, f"{self.ml_dir}/tags.csv")
    def ext_meta(self): return readers.read_ext_meta(self.spark, self.ext_meta_path)

    def availability_raw(self):
        if self.availability_csv is None:
            return self.spark.createDataFrame([], readers.availability_raw_schema())
        return readers.read_availability_raw(self.spark, self.availability_csv)

    def embeddings(self):
        return self.spark.read.parquet(self.embeddings_path) if self.embeddings_path else None


class Catalog:
    """Build outputs for one input set, built lazily and materialised on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, materialize: bool = True,
                 root: str | None = None, inputs=None, text_dim: int = 768):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/") if sf_dir else None
        self.inputs = inputs if inputs is not None else AdapterInputs(spark, sf_dir)
        # the build reads its lines from a table that it writes once
        self._kept = self.inputs.kept(self._get) if isinstance(self.inputs, AdapterInputs) else self.inputs
        self.materialize = materialize
        self.text_dim = text_dim
        self._root = root
        self._tables: dict[str, DataFrame] = {}
        self._bucketed: dict[str, BucketedTable] = {}
        self._indexes: dict[str, ann_ops.Index] = {}
        self._lock = threading.Lock()                     # guards the per-table lock map
        self._table_locks: dict[str, threading.RLock] = {}

    # -- plumbing ------------------------------------------------------------------------
    @property
    def root(self) -> str:
        if self._root is None:
            base = ensure_checkpoint_dir(self.spark).rstrip("/")
            self._root = f"{base}/cinegraph-tables/{uuid.uuid4().hex}"
        return self._root

    def _get(self, name: str, build) -> DataFrame:
        """Build ``name`` once; different tables may build concurrently (one lock each)."""
        with self._lock:
            lock = self._table_locks.setdefault(name, threading.RLock())
        with lock:
            if name not in self._tables:
                df = build()
                if self.materialize:
                    df = self._write(name, df)
                self._tables[name] = df
            return self._tables[name]

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        sort_cols = _LAYOUT.get(name)
        out = df
        if sort_cols:
            out = out.sortWithinPartitions(*sort_cols)
        out.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    # -- raw inputs ------------------------------------------------------------------------
    def ml_movies(self): return self.inputs.ml_movies()
    def ml_links(self): return self.inputs.ml_links()
    def ml_ratings(self): return self.inputs.ml_ratings()
    def ml_tags(self): return self.inputs.ml_tags()
    def ext_meta(self): return self.inputs.ext_meta()
    def availability_raw(self): return self.inputs.availability_raw()
    def embeddings(self): return self.inputs.embeddings()

    # -- batch build outputs -----------------------------------------------------------------
    def raw_stats(self) -> DataFrame:
        """Per-movie rating mean and count over every rating (one row per rated movie)."""
        return self._get("rating_stats", lambda: rating_ops.rating_stats(self._kept.ml_ratings()))

    def stats(self) -> DataFrame:
        """raw_stats + bayesian_avg; C and m are scalar subqueries over the small stats table."""
        return self._get("stats", lambda: rating_ops.bayesian_average(self.raw_stats()))

    def movies(self) -> DataFrame:
        return self._get("movies", lambda: movie_ops.build_movies(
            self.ml_movies(), self.ml_links(), movie_ops.clean_ext_meta(self.ext_meta()), self.stats()))

    def availability(self) -> DataFrame:
        return self._get("availability", lambda: avail_ops.build_availability(self.availability_raw(), self.movies()))

    def movie_tags(self) -> DataFrame:
        return self._get("movie_tags", lambda: tag_ops.build_tags(self._kept.ml_tags(), self.movies()))

    def ratings(self) -> DataFrame:
        return self._get("ratings", lambda: rating_ops.build_ratings(self._kept.ml_ratings(), self.movies()))

    def nodes(self) -> DataFrame:
        return self._get("movie_nodes", lambda: graph_ops.movie_nodes(self.movies()))

    def has_genre(self) -> DataFrame:
        return self._get("has_genre", lambda: graph_ops.genre_edges(self.movies()))

    def has_tag(self) -> DataFrame:
        return self._get("has_tag", lambda: graph_ops.tag_edges(self.movie_tags(), self.movies()))

    def rated(self) -> DataFrame:
        """RATED edges; they are written by movie, and read here as plain files sorted by (movie, user)."""
        if not self.materialize:
            return self._get("rated", lambda: graph_ops.rated_edges(self.ratings(), self.movies()))
        return self.by_movie("rated").files()

    def fan_edges(self) -> DataFrame:
        return self._get("fan_edges", lambda: graph_ops.fan_edges(self.rated()))

    def vectors(self) -> DataFrame:
        """Movie vectors: precomputed ones when the inputs have them, else embedded text."""
        emb = self.embeddings()
        if emb is None:
            return self.text_vectors(self.text_dim)
        return self._get("movie_vectors", lambda: vec_ops.vectors_from_table(self.movies(), emb))

    def text_vectors(self, dim: int = 768) -> DataFrame:
        return self._get(f"movie_text_vectors_{dim}", lambda: vec_ops.vectors_from_text(self.movies(), dim=dim))

    def by_movie(self, name: str, n_buckets: int = BUCKETS) -> BucketedTable:
        """``rated``, ``movie_nodes`` or another table with a movie_id, laid out by it (written once). Ratings are
        dealt out by movie before their edges are made: equal edges meet there, without a shuffle of their own."""
        key = f"{name}_by_movie_{n_buckets}"
        with self._lock:
            lock = self._table_locks.setdefault(key, threading.RLock())
        with lock:
            if key not in self._bucketed:
                if name == "rated":
                    self._bucketed[key] = write_bucketed(
                        self.ratings(), f"{self.root}/{key}", "movie_id", n_buckets, _LAYOUT["rated"],
                        then=lambda part: graph_ops.rated_edges(part, self.movies()))
                else:
                    table = getattr(self, {"movie_nodes": "nodes"}.get(name, name))()
                    self._bucketed[key] = write_bucketed(table, f"{self.root}/{key}", "movie_id", n_buckets)
            return self._bucketed[key]

    def vector_index(self, n_cells: int, n_parts: int, n_words: int, iterations: int = 0):
        """The stored index over ``vectors``, written once for each set of parameters."""
        name = f"vector_index_{n_cells}_{n_parts}_{n_words}_{iterations}"
        with self._lock:
            lock = self._table_locks.setdefault(name, threading.RLock())
        with lock:
            if name not in self._indexes:
                model = ann_ops.fit(self.vectors(), n_cells, n_parts, n_words, n_cells + n_words, iterations)
                self._indexes[name] = ann_ops.write_index(self.vectors(), model, f"{self.root}/{name}")
            return self._indexes[name]

    def build_all(self, parallelism: int = 4) -> dict[str, int]:
        """Run the whole batch build; returns row counts per table.

        ``movies`` is built first (everything depends on it); the other outputs are
        independent Spark jobs submitted from a small thread pool, so the scheduler runs
        them side by side (each table still builds exactly once).
        """
        from concurrent.futures import ThreadPoolExecutor

        self.movies()
        steps = {
            "availability": self.availability, "movie_tags": self.movie_tags, "ratings": self.ratings,
            "movie_nodes": self.nodes, "has_genre": self.has_genre, "has_tag": self.has_tag,
            "rated": self.rated, "fan_edges": self.fan_edges, "movie_vectors": self.vectors,
        }
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            futures = {k: pool.submit(f) for k, f in steps.items()}
            tables = {"movies": self.movies(), **{k: fut.result() for k, fut in futures.items()}}
        return {k: v.count() for k, v in tables.items()}

    def recommend_inputs(self) -> dict:
        return dict(nodes=self.nodes(), rated=self.rated(), fans_edges=self.fan_edges(),
                    has_tag=self.has_tag(), has_genre=self.has_genre(), vectors=self.vectors())


def catalog(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Catalog:
    """The session's catalog for ``sf_dir`` (one per application and folder)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/") + ("" if materialize else "#lazy"))
    with _LOCK:
        if key not in _CATALOGS:
            _CATALOGS[key] = Catalog(spark, sf_dir, materialize=materialize)
        return _CATALOGS[key]


def catalog_from_files(spark: SparkSession, ml_dir: str, ext_meta_path: str, availability_csv: str | None = None,
                       embeddings_path: str | None = None, text_dim: int = 768) -> Catalog:
    """A catalog over the application's own input files (not memoised)."""
    return Catalog(spark, inputs=FileInputs(spark, ml_dir, ext_meta_path, availability_csv, embeddings_path),
                   text_dim=text_dim)
