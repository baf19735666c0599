"""Call-for-call entry points of the source application, over a catalog.

Each method takes one id / text or many and returns a DataFrame (nothing is collected);
many seeds or queries run as one Spark plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.operators import enrich as E
from cinegraph.operators.quality import dq_report
from cinegraph.operators.recommend import recommend, recommend_on_provider
from cinegraph.operators.search import search
from cinegraph.operators.subgraph import subgraph_tables
from cinegraph.operators.vectors import hashing_encoder


def _ids(spark, ids, col: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids
    ids = [ids] if isinstance(ids, int) else list(ids)
    return spark.createDataFrame([(int(i),) for i in ids], f"{col} long")


class MovieEngine:
    """The application's queries over a built catalog (``plans.catalog``)."""

    def __init__(self, catalog, text_dim: int = 768, encoder=None):
        self.cat = catalog
        self.spark = catalog.spark
        self.text_dim = text_dim
        self.encoder = encoder or (lambda df, col: hashing_encoder(df, col, dim=text_dim))

    def vector_search(self, queries, limit: int = 20) -> DataFrame:
        """Natural-language search. ``queries``: a text, a list of texts, or a DataFrame of
        (query_id, embedding) already in the movie-vector space."""
        if isinstance(queries, DataFrame):
            return search(queries, self.cat.vectors(), limit=limit)
        texts = [queries] if isinstance(queries, str) else list(queries)
        qdf = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        q = self.encoder(qdf, "text").select("query_id", "embedding")
        return search(q, self.cat.text_vectors(self.text_dim), limit=limit)

    def get_movie_detail(self, movie_ids) -> DataFrame:
        return E.movie_detail(_ids(self.spark, movie_ids, "movie_id"), self.cat.movies(),
                              self.cat.movie_tags(), self.cat.availability())

    def get_streaming_by_movie_ids(self, movie_ids) -> DataFrame:
        return E.providers_for(_ids(self.spark, movie_ids, "movie_id"), self.cat.availability())

    def graph_recommend(self, movie_ids, limit: int = 20) -> DataFrame:
        return recommend(_ids(self.spark, movie_ids, "seed_id"), limit=limit, **self.cat.recommend_inputs())

    def recommend_streaming_filtered(self, movie_ids, provider: str, limit: int = 20) -> DataFrame:
        return recommend_on_provider(_ids(self.spark, movie_ids, "seed_id"), provider, self.cat.availability(),
                                     limit=limit, **self.cat.recommend_inputs())

    def render_ready(self, results: DataFrame) -> DataFrame:
        """Results with provider lists, poster URLs, genre pills and rating badges."""
        return E.enrich_results(results, self.cat.availability())

    def subgraph(self):
        c = self.cat
        return subgraph_tables(c.nodes(), c.has_genre(), c.has_tag(), c.rated())

    def audit(self, dim: int | None = None) -> DataFrame:
        c = self.cat
        vec = c.vectors()
        dim = dim or len(vec.select("embedding").first()[0])
        return dq_report(c.movies(), c.movie_tags(), c.availability(), c.ratings(), c.nodes(), c.has_genre(),
                         c.has_tag(), c.rated(), vec, dim=dim)
