"""Named queries: each is a Spark DataFrame builder (spark, sf_dir) plus its DuckDB oracle.

Outputs are scalar columns; doubles are rounded to 6 digits (engines sum in different
orders); every ranking ends on a unique key; integer columns are BIGINT on both sides.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.operators import enrich as enrich_ops
from cinegraph.operators import graph as graph_ops
from cinegraph.operators import recommend as rec_ops
from cinegraph.operators import signals as sig_ops
from cinegraph.operators.availability import availability_long
from cinegraph.operators.movies import clean_ext_meta
from cinegraph.operators.ratings import global_constants
from cinegraph.operators.quality import dq_report
from cinegraph.operators.search import search
from cinegraph.operators.subgraph import subgraph_tables
from cinegraph.operators.vectors import embedding_docs, hashing_encoder
from cinegraph.operators.knn import knn_exact
from cinegraph.operators import ann as ann_ops
from cinegraph.plans.catalog import catalog
from cinegraph.plans.oracle import assemble
from cinegraph.plans.oracle import strip as sql_strip
from cinegraph.functions.text import NA_TOKENS, PROVIDER_LINKS
from cinegraph.functions.vector import l2_norm
from cinegraph.session import ensure_checkpoint_dir
from cinegraph.sources import adapters, readers, sinks
from cinegraph.sources.merge import KeyedTable

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

# --- fixed parameters of the registered queries -----------------------------------------
LIMIT = 20                         # results per seed / per query
PROVIDER = "Netflix"
# Seeds of every 'find similar' query: the whole canonical movie table.
SEEDS_SQL = "SELECT movie_id AS seed_id FROM movies"
# ------------------------------------------------------------------------------------


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


# ---------------------------------------------------------------- statistics
@register("rating_stats", assemble("""
SELECT CAST(movie_id AS BIGINT) AS movie_id, round(rating_mean, 6) AS rating_mean,
       CAST(rating_count AS BIGINT) AS rating_count, round(bayesian_avg, 6) AS bayesian_avg
FROM stats"""))
def q_rating_stats(spark, sf_dir):
    s = catalog(spark, sf_dir).stats()
    return s.select(big("movie_id"), r6("rating_mean"), big("rating_count"), r6("bayesian_avg"))


@register("bayesian_constants", assemble("""
SELECT round(c, 6) AS c, round(m, 6) AS m, (SELECT count(*) FROM stats0) AS rated_movies FROM consts"""))
def q_bayesian_constants(spark, sf_dir):
    s = catalog(spark, sf_dir).stats()
    return global_constants(s).select(r6("c"), r6("m"), s.select(F.count(F.lit(1))).scalar().alias("rated_movies"))


@register("top_bayesian", assemble("""
SELECT movie_id, title, CAST(year AS BIGINT) AS year, genres, round(bayesian_avg, 6) AS bayesian_avg
FROM movies ORDER BY round(bayesian_avg, 9) DESC NULLS LAST, movie_id LIMIT 5"""))
def q_top_bayesian(spark, sf_dir):
    m = catalog(spark, sf_dir).movies()
    return (m.orderBy(F.round("bayesian_avg", 9).desc_nulls_last(), F.asc("movie_id")).limit(5)
            .select(big("movie_id"), "title", big("year"), "genres", r6("bayesian_avg")))


# ---------------------------------------------------------------- canonical tables
@register("ext_meta_clean", assemble("""
SELECT tmdb_id, _ext_id AS ext_id, title, overview, tagline, genres, movie_cast, director, poster_path,
       round(vote_average, 6) AS vote_average, CAST(vote_count AS BIGINT) AS vote_count, release_date
FROM ext_clean"""))
def q_ext_meta_clean(spark, sf_dir):
    e = clean_ext_meta(catalog(spark, sf_dir).ext_meta())
    return e.select(big("tmdb_id"), F.col("_ext_id").alias("ext_id"), "title", "overview", "tagline", "genres",
                    "movie_cast", "director", "poster_path", r6("vote_average"), big("vote_count"), "release_date")


_MOVIE_SQL = """
SELECT movie_id, tmdb_id, title, CAST(year AS BIGINT) AS year, genres, overview, tagline, director, top_cast,
       poster_path, round(vote_average, 6) AS vote_average, CAST(vote_count AS BIGINT) AS vote_count,
       round(rating_mean, 6) AS rating_mean, CAST(rating_count AS BIGINT) AS rating_count,
       round(bayesian_avg, 6) AS bayesian_avg
FROM movies"""


@register("canonical_movies", assemble(_MOVIE_SQL))
def q_canonical_movies(spark, sf_dir):
    m = catalog(spark, sf_dir).movies()
    return m.select(big("movie_id"), big("tmdb_id"), "title", big("year"), "genres", "overview", "tagline",
                    "director", "top_cast", "poster_path", r6("vote_average"), big("vote_count"),
                    r6("rating_mean"), big("rating_count"), r6("bayesian_avg"))


@register("availability_long", assemble("SELECT title_norm, CAST(year AS BIGINT) AS year, provider FROM avail_long"))
def q_availability_long(spark, sf_dir):
    return availability_long(catalog(spark, sf_dir).availability_raw()).select("title_norm", big("year"), "provider")


@register("availability", assemble("SELECT CAST(movie_id AS BIGINT) AS movie_id, provider FROM availability"))
def q_availability(spark, sf_dir):
    return catalog(spark, sf_dir).availability().select(big("movie_id"), "provider")


@register("movie_tags", assemble("SELECT CAST(movie_id AS BIGINT) AS movie_id, tag, count FROM movie_tags"))
def q_movie_tags(spark, sf_dir):
    return catalog(spark, sf_dir).movie_tags().select(big("movie_id"), "tag", big("count"))


@register("ratings_kept", assemble("""
SELECT CAST(movie_id AS BIGINT) AS movie_id, count(*) AS n_ratings, round(sum(rating), 6) AS rating_sum,
       count(DISTINCT user_id) AS n_users
FROM ratings_kept GROUP BY movie_id"""))
def q_ratings_kept(spark, sf_dir):
    r = catalog(spark, sf_dir).ratings()
    return r.groupBy(big("movie_id")).agg(
        F.count(F.lit(1)).alias("n_ratings"), F.round(F.sum("rating"), 6).alias("rating_sum"),
        F.countDistinct("user_id").alias("n_users"))


# ---------------------------------------------------------------- graph
@register("movie_nodes", assemble("""
SELECT CAST(movie_id AS BIGINT) AS movie_id, title, CAST(year AS BIGINT) AS year,
       round(bayesian_avg, 6) AS bayesian_avg, poster_path FROM movie_nodes"""))
def q_movie_nodes(spark, sf_dir):
    n = catalog(spark, sf_dir).nodes()
    return n.select(big("movie_id"), "title", big("year"), r6("bayesian_avg"), "poster_path")


@register("genre_edges", assemble("SELECT CAST(movie_id AS BIGINT) AS movie_id, genre FROM has_genre"))
def q_genre_edges(spark, sf_dir):
    return catalog(spark, sf_dir).has_genre().select(big("movie_id"), "genre")


@register("tag_edges", assemble("SELECT CAST(movie_id AS BIGINT) AS movie_id, tag, count FROM has_tag"))
def q_tag_edges(spark, sf_dir):
    return catalog(spark, sf_dir).has_tag().select(big("movie_id"), "tag", big("count"))


@register("rated_edges", assemble("""
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(movie_id AS BIGINT) AS movie_id, rating FROM rated"""))
def q_rated_edges(spark, sf_dir):
    return catalog(spark, sf_dir).rated().select(big("user_id"), big("movie_id"), "rating")


@register("movie_audience", assemble("""
SELECT CAST(n.movie_id AS BIGINT) AS movie_id, n.title, CAST(n.year AS BIGINT) AS year, count(*) AS ratings,
       count(*) FILTER (WHERE r.rating >= 4.0) AS loved, round(avg(r.rating), 6) AS mean_rating
FROM rated r JOIN movie_nodes n ON n.movie_id = r.movie_id GROUP BY n.movie_id, n.title, n.year"""))
def q_movie_audience(spark, sf_dir):
    """Ratings, and those from 4 up, of every rated movie: edges and nodes lie in buckets by movie, so
    they are joined and grouped where they lie (the edges of hot movies apart)."""
    c = catalog(spark, sf_dir)
    rated, nodes = c.by_movie("rated"), c.by_movie("movie_nodes")
    return rated.join(nodes, lambda edges: edges.groupBy("movie_id", "title", "year").agg(
        F.count(F.lit(1)).alias("ratings"), F.count_if(F.col("rating") >= 4.0).alias("loved"),
        F.round(F.avg("rating"), 6).alias("mean_rating"))).select(
        big("movie_id"), "title", big("year"), "ratings", "loved", "mean_rating")


@register("graph_counts", assemble("""
SELECT 'node' AS kind, 'Movie' AS label, count(*) AS n FROM movie_nodes
UNION ALL SELECT 'node', 'Genre', count(DISTINCT genre) FROM has_genre
UNION ALL SELECT 'node', 'Tag', count(DISTINCT tag) FROM has_tag
UNION ALL SELECT 'node', 'User', count(DISTINCT user_id) FROM rated
UNION ALL SELECT 'edge', 'HAS_GENRE', count(*) FROM has_genre
UNION ALL SELECT 'edge', 'HAS_TAG', count(*) FROM has_tag
UNION ALL SELECT 'edge', 'RATED', count(*) FROM rated"""))
def q_graph_counts(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return graph_ops.graph_counts(c.nodes(), c.has_genre(), c.has_tag(), c.rated())


# ---------------------------------------------------------------- signals
def _seeds(spark, sf_dir):
    """Every canonical movie is a seed."""
    return catalog(spark, sf_dir).movies().select(F.col("movie_id").alias("seed_id"))


@register("signal_collab", assemble("""
SELECT CAST(seed_id AS BIGINT) AS seed_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(rank AS BIGINT) AS rank,
       CAST(co_fans AS BIGINT) AS co_fans, round(boost, 6) AS boost FROM sig_collab""", {"seeds": SEEDS_SQL}))
def q_signal_collab(spark, sf_dir):
    c = catalog(spark, sf_dir)
    s = _seeds(spark, sf_dir)
    out = sig_ops.signal_collab(s, c.rated(), c.fan_edges(), c.nodes())
    return out.select(big("seed_id"), big("movie_id"), big("rank"), big("co_fans"), r6("boost"))


@register("signal_tags", assemble("""
SELECT CAST(seed_id AS BIGINT) AS seed_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(rank AS BIGINT) AS rank,
       weighted_overlap, shared_tags, label, round(boost, 6) AS boost FROM sig_tags""", {"seeds": SEEDS_SQL}))
def q_signal_tags(spark, sf_dir):
    c = catalog(spark, sf_dir)
    out = sig_ops.signal_tags(_seeds(spark, sf_dir), c.has_tag(), c.nodes())
    return out.select(big("seed_id"), big("movie_id"), big("rank"), big("weighted_overlap"), "shared_tags",
                      "label", r6("boost"))


@register("signal_genres", assemble("""
SELECT CAST(seed_id AS BIGINT) AS seed_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(rank AS BIGINT) AS rank,
       genre_count, shared_genres, label, round(boost, 6) AS boost FROM sig_genres""", {"seeds": SEEDS_SQL}))
def q_signal_genres(spark, sf_dir):
    c = catalog(spark, sf_dir)
    out = sig_ops.signal_genres(_seeds(spark, sf_dir), c.has_genre(), c.nodes())
    return out.select(big("seed_id"), big("movie_id"), big("rank"), big("genre_count"), "shared_genres",
                      "label", r6("boost"))


@register("signal_vector", assemble("""
SELECT CAST(seed_id AS BIGINT) AS seed_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(rank AS BIGINT) AS rank,
       round(vector_score, 6) AS vector_score, round(boost, 6) AS boost FROM sig_vector""",
                                   {"seeds": SEEDS_SQL}, {"VK": LIMIT + 5}))
def q_signal_vector(spark, sf_dir):
    c = catalog(spark, sf_dir)
    out = sig_ops.signal_vector(_seeds(spark, sf_dir), c.vectors(), LIMIT)
    return out.select(big("seed_id"), big("movie_id"), big("rank"), r6("vector_score"), r6("boost"))


# ---------------------------------------------------------------- recommendation
_REC_SQL = "SELECT * FROM recommended"


@register("recommend", assemble(_REC_SQL, {"seeds": SEEDS_SQL}, {"VK": LIMIT + 5, "LIMIT": LIMIT}))
def q_recommend(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return rec_ops.recommend(_seeds(spark, sf_dir), limit=LIMIT, **c.recommend_inputs())


@register("recommend_many", assemble(_REC_SQL, {"seeds": SEEDS_SQL}, {"VK": LIMIT + 5, "LIMIT": LIMIT}))
def q_recommend_many(spark, sf_dir):
    """'Find similar' for every canonical movie through the application-level entry point."""
    from cinegraph.api import MovieEngine
    c = catalog(spark, sf_dir)
    return MovieEngine(c).graph_recommend(_seeds(spark, sf_dir), limit=LIMIT)


_OVER = max(LIMIT * 5, 80)


@register("recommend_on_provider", assemble(f"""
SELECT seed_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY rank) AS BIGINT) AS rank,
       movie_id, title, year, bayesian_avg, poster_path, genres, composite, explanation, n_signals, co_fans,
       weighted_overlap, shared_tags, genre_count, shared_genres, vector_score
FROM recommended r
WHERE movie_id IN (SELECT movie_id FROM availability
                   WHERE replace(lower({sql_strip("coalesce(provider, '')")}), '_', ' ')
                         = replace(lower({sql_strip(repr(PROVIDER))}), '_', ' '))
QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY rank) <= {LIMIT}""",
                                           {"seeds": SEEDS_SQL}, {"VK": _OVER + 5, "LIMIT": _OVER}))
def q_recommend_on_provider(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return rec_ops.recommend_on_provider(_seeds(spark, sf_dir), PROVIDER, c.availability(), limit=LIMIT,
                                         **c.recommend_inputs())


# ---------------------------------------------------------------- search and vectors
@register("search_by_vector", assemble(f"""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, CAST(movie_id AS BIGINT) AS movie_id,
       title, CAST(year AS BIGINT) AS year, genres, poster_path, round(bayesian_avg, 6) AS bayesian_avg,
       blend AS score, round(score, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, vec_rank) AS rank
      FROM (SELECT h.*, v.title, v.year, v.genres, v.poster_path, v.bayesian_avg,
                   round(0.6 * h.score + 0.4 * CASE WHEN v.bayesian_avg > 0 THEN least(v.bayesian_avg / 5.0, 1.0)
                                                    ELSE 0.0 END, 3) AS blend
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, movie_id) AS vec_rank
                  FROM (SELECT q.vec_id AS query_id, v.movie_id,
                               list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
                        FROM embeddings q, movie_vectors v)) h
            JOIN movie_vectors v ON v.movie_id = h.movie_id
            WHERE h.vec_rank <= {LIMIT * 5}))
WHERE rank <= {LIMIT}"""))
def q_search_by_vector(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return search(adapters.query_vectors(spark, sf_dir), c.vectors(), limit=LIMIT)


_DOC_SQL_PART = """
SELECT movie_id, concat_ws(' | ',
         CASE WHEN coalesce(overview, '') <> '' THEN overview END,
         CASE WHEN tagline IS NOT NULL AND tagline <> '' THEN 'Tagline: ' || tagline END,
         CASE WHEN genres IS NOT NULL AND replace(genres, '|', ', ') <> '' THEN 'Genres: ' || replace(genres, '|', ', ') END,
         CASE WHEN director IS NOT NULL AND director <> '' THEN 'Director: ' || director END,
         coalesce(title, 'nan') || ' (' || coalesce(CAST(year AS VARCHAR), '') || ')') AS doc
FROM movies WHERE overview IS NOT NULL"""


@register("embedding_docs", assemble(_DOC_SQL_PART))
def q_embedding_docs(spark, sf_dir):
    return embedding_docs(catalog(spark, sf_dir).movies()).select(big("movie_id"), "doc")


@register("movie_vectors", assemble("""
SELECT CAST(movie_id AS BIGINT) AS movie_id, title, CAST(year AS BIGINT) AS year, genres, director, poster_path,
       round(bayesian_avg, 6) AS bayesian_avg, CAST(len(embedding) AS BIGINT) AS dim,
       round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
FROM movie_vectors"""))
def q_movie_vectors(spark, sf_dir):
    """Vector points with their payload (movies with an overview) and the vector contract."""
    v = catalog(spark, sf_dir).vectors()
    return v.select(big("movie_id"), "title", big("year"), "genres", "director", "poster_path", r6("bayesian_avg"),
                    F.size("embedding").cast("bigint").alias("dim"), F.round(l2_norm("embedding"), 6).alias("norm"))


# ---------------------------------------------------------------- detail and enrichment
_IDS_SQL = "SELECT p_partkey AS movie_id FROM part"


def _ids(spark, sf_dir):
    """Every movie id of the source list (canonical or not)."""
    return adapters.ml_movies(spark, sf_dir).select(F.col("movieId").cast("bigint").alias("movie_id"))


def _initcap_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


def _norm_provider_sql(x: str) -> str:
    return f"replace(lower({sql_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}), '_', ' ')"


_PROVIDER_DIM_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS p_key, '{lab}' AS p_label, '{url}' AS p_url" for k, lab, url in PROVIDER_LINKS)

_DETAIL_EXTRA = {
    "ids": _IDS_SQL,
    "detail_tags": """
SELECT movie_id, list(tag ORDER BY r) AS tags FROM (
  SELECT movie_id, tag, row_number() OVER (PARTITION BY movie_id ORDER BY count DESC, tag) AS r FROM movie_tags)
WHERE r <= 12 GROUP BY movie_id""",
    "prov_by_movie": "SELECT movie_id, list_sort(list(provider)) AS providers FROM availability GROUP BY movie_id",
    "provider_dim": _PROVIDER_DIM_SQL,
    "watch": f"""
SELECT movie_id, string_agg(link, ' · ' ORDER BY pos) AS watch FROM (
  SELECT p.movie_id, p.pos,
         CASE WHEN d.p_url IS NOT NULL
              THEN d.p_label || ' <' || d.p_url || replace(url_encode(coalesce(m.title, '')), '%2F', '/') || '>'
              ELSE {_initcap_sql("replace(p.provider, '_', ' ')")} END AS link
  FROM (SELECT movie_id, unnest(providers) AS provider, generate_subscripts(providers, 1) AS pos
        FROM prov_by_movie) p
  JOIN movies m ON m.movie_id = p.movie_id
  LEFT JOIN provider_dim d ON d.p_key = {_norm_provider_sql('p.provider')})
GROUP BY movie_id""",
}


@register("movie_detail", assemble(f"""
SELECT m.movie_id, m.tmdb_id, m.title, CAST(m.year AS BIGINT) AS year, m.genres, m.overview, m.tagline, m.director,
       m.top_cast, m.poster_path, round(m.vote_average, 6) AS vote_average, CAST(m.vote_count AS BIGINT) AS vote_count,
       CASE WHEN m.poster_path IS NULL OR m.poster_path IN ('nan', 'None', '')
            THEN 'https://via.placeholder.com/185x278/1a1a2e/e0e0e0?text=No+Poster'
            ELSE 'https://image.tmdb.org/t/p/w342' || m.poster_path END AS poster_url,
       array_to_string(list_filter(list_transform(string_split(replace(coalesce(m.genres, ''), '|', ','), ','),
                                                  lambda g: {sql_strip('g')}), lambda g: g <> ''), ', ') AS genre_list,
       array_to_string(coalesce(t.tags, []), ', ') AS tags,
       array_to_string(coalesce(p.providers, []), ', ') AS providers,
       coalesce(w.watch, '') AS watch_links,
       CASE WHEN m.rating_mean <> 0 AND m.rating_count <> 0 THEN '★ ' || format('{{:.2f}}', m.rating_mean) END AS rating_text,
       CASE WHEN m.rating_mean <> 0 AND m.rating_count <> 0 THEN format('{{:,}}', m.rating_count) || ' ratings' END
         AS rating_count_text,
       round(m.rating_mean, 6) AS rating_mean, CAST(m.rating_count AS BIGINT) AS rating_count,
       round(m.bayesian_avg, 6) AS bayesian_avg
FROM movies m
LEFT JOIN detail_tags t ON t.movie_id = m.movie_id
LEFT JOIN prov_by_movie p ON p.movie_id = m.movie_id
LEFT JOIN watch w ON w.movie_id = m.movie_id
WHERE m.movie_id IN (SELECT movie_id FROM ids)""", _DETAIL_EXTRA))
def q_movie_detail(spark, sf_dir):
    c = catalog(spark, sf_dir)
    d = enrich_ops.movie_detail(_ids(spark, sf_dir), c.movies(), c.movie_tags(), c.availability())
    return d.select(big("movie_id"), big("tmdb_id"), "title", big("year"), "genres", "overview", "tagline", "director",
                    "top_cast", "poster_path", r6("vote_average"), big("vote_count"),
                    "poster_url", "genre_list", "tags", "providers", "watch_links", "rating_text",
                    "rating_count_text", r6("rating_mean"), big("rating_count"), r6("bayesian_avg"))


@register("providers_for", assemble("""
SELECT CAST(i.movie_id AS BIGINT) AS movie_id, array_to_string(coalesce(p.providers, []), ', ') AS providers,
       CAST(len(coalesce(p.providers, [])) AS BIGINT) AS n_providers
FROM (SELECT DISTINCT movie_id FROM ids) i LEFT JOIN prov_by_movie p ON p.movie_id = i.movie_id""", _DETAIL_EXTRA))
def q_providers_for(spark, sf_dir):
    c = catalog(spark, sf_dir)
    p = enrich_ops.providers_for(_ids(spark, sf_dir), c.availability())
    return p.select(big("movie_id"), F.array_join("providers", ", ").alias("providers"),
                    F.size("providers").cast("bigint").alias("n_providers"))


@register("enriched_results", assemble(f"""
SELECT r.*, array_to_string(coalesce(p.providers, []), ', ') AS providers,
       array_to_string(list_transform(coalesce(p.providers, []),
                                      lambda x: {_initcap_sql("replace(x, '_', ' ')")}), ', ') AS provider_labels,
       CASE WHEN r.poster_path IS NULL OR r.poster_path IN ('nan', 'None', '')
            THEN 'https://via.placeholder.com/185x278/1a1a2e/e0e0e0?text=No+Poster'
            ELSE 'https://image.tmdb.org/t/p/w342' || r.poster_path END AS poster_url,
       array_to_string(list_slice(list_filter(list_transform(string_split(replace(coalesce(r.genres, ''), '|', ','), ','),
                                                             lambda g: {sql_strip('g')}), lambda g: g <> ''), 1, 3), ', ')
         AS genre_pills,
       CASE WHEN coalesce(r.bayesian_avg, 0.0) > 0 THEN '★ ' || format('{{:.1f}}', coalesce(r.bayesian_avg, 0.0)) END
         AS rating_badge,
       CAST(CASE WHEN r.explanation IS NOT NULL AND r.explanation <> ''
                 THEN len(string_split(r.explanation, ' · ')) ELSE 0 END AS BIGINT) AS signal_lines
FROM recommended r LEFT JOIN prov_by_movie p ON p.movie_id = r.movie_id""",
                                      {**_DETAIL_EXTRA, "seeds": SEEDS_SQL}, {"VK": LIMIT + 5, "LIMIT": LIMIT}))
def q_enriched_results(spark, sf_dir):
    c = catalog(spark, sf_dir)
    rec = rec_ops.recommend(_seeds(spark, sf_dir), limit=LIMIT, **c.recommend_inputs())
    return enrich_ops.enrich_results(rec, c.availability())


# ---------------------------------------------------------------- subgraph sample and audit
_SUBGRAPH_EXTRA = {
    "sub_good": """
SELECT movie_id FROM movie_nodes WHERE bayesian_avg >= 3.5 AND movie_id IN (SELECT movie_id FROM has_tag)""",
    "sub_gm": "SELECT DISTINCT genre, movie_id FROM has_genre WHERE movie_id IN (SELECT movie_id FROM sub_good)",
    "sub_chosen": """
SELECT min(genre) AS genre FROM (SELECT genre FROM sub_gm GROUP BY genre HAVING count(*) >= 4)""",
    "sub_ids0": """
SELECT movie_id FROM (SELECT movie_id FROM sub_gm WHERE genre = (SELECT genre FROM sub_chosen)
                      ORDER BY movie_id LIMIT 4)
UNION ALL
SELECT movie_id FROM (SELECT DISTINCT movie_id FROM sub_gm ORDER BY movie_id LIMIT 4)
WHERE (SELECT genre FROM sub_chosen) IS NULL""",
    "sub_ids": "SELECT movie_id FROM sub_ids0 WHERE (SELECT count(*) FROM sub_ids0) >= 2",
    "sub_genre_e": """
SELECT movie_id, genre FROM has_genre WHERE movie_id IN (SELECT movie_id FROM sub_ids)
ORDER BY movie_id, genre LIMIT 14""",
    "sub_tag_e": """
SELECT DISTINCT movie_id, tag FROM (SELECT movie_id, tag FROM has_tag WHERE movie_id IN (SELECT movie_id FROM sub_ids)
                                    ORDER BY movie_id, tag, count LIMIT 16)""",
    "sub_on_ids": "SELECT * FROM rated WHERE movie_id IN (SELECT movie_id FROM sub_ids)",
    "sub_users": """
SELECT user_id FROM sub_on_ids GROUP BY user_id HAVING count(DISTINCT movie_id) >= 2 ORDER BY user_id LIMIT 10""",
    "sub_fb_rows": """
SELECT *, row_number() OVER (ORDER BY user_id, movie_id, rating) AS pos FROM (
  SELECT user_id, movie_id, rating FROM sub_on_ids WHERE (SELECT count(*) FROM sub_users) = 0
  ORDER BY user_id, movie_id, rating LIMIT 20)""",
    "sub_rated_e": """
SELECT user_id, movie_id, max(rating) AS rating FROM sub_on_ids
WHERE user_id IN (SELECT user_id FROM sub_users) AND (SELECT count(*) FROM sub_users) > 0
GROUP BY user_id, movie_id
UNION ALL
SELECT user_id, movie_id, max(rating) FROM sub_fb_rows
WHERE user_id IN (SELECT user_id FROM sub_fb_rows GROUP BY user_id ORDER BY min(pos) LIMIT 10)
GROUP BY user_id, movie_id""",
}


@register("subgraph_nodes", assemble("""
SELECT 'Movie' AS node_type, CAST(movie_id AS VARCHAR) AS node_key,
       substr(CASE WHEN title IS NULL OR title = '' THEN '?' ELSE title END, 1, 30) AS label
FROM movie_nodes WHERE movie_id IN (SELECT movie_id FROM sub_ids)
UNION ALL SELECT DISTINCT 'Genre', genre, substr(genre, 1, 12) FROM sub_genre_e
UNION ALL SELECT DISTINCT 'Tag', tag, substr(tag, 1, 12) FROM sub_tag_e
UNION ALL SELECT DISTINCT 'User', CAST(user_id AS VARCHAR), 'User ' || user_id FROM sub_rated_e""", _SUBGRAPH_EXTRA))
def q_subgraph_nodes(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return subgraph_tables(c.nodes(), c.has_genre(), c.has_tag(), c.rated())[0]


@register("subgraph_edges", assemble("""
SELECT 'HAS_GENRE' AS edge_type, CAST(movie_id AS VARCHAR) AS src, genre AS dst, NULL::DOUBLE AS rating FROM sub_genre_e
UNION ALL SELECT 'HAS_TAG', CAST(movie_id AS VARCHAR), tag, NULL FROM sub_tag_e
UNION ALL SELECT 'RATED', CAST(user_id AS VARCHAR), CAST(movie_id AS VARCHAR), rating FROM sub_rated_e""",
                                     _SUBGRAPH_EXTRA))
def q_subgraph_edges(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return subgraph_tables(c.nodes(), c.has_genre(), c.has_tag(), c.rated())[1]


VECTOR_DIM = 64   # dimension of the driver's embeddings table


def _dq_sql(check, tbl, expr):
    return f"SELECT '{check}' AS \"check\", '{tbl}' AS tbl, CAST(coalesce(({expr}), 0) AS BIGINT) AS value"


def _dup(table, key):
    return f"SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)"


def _orph(child, parent):
    return f"SELECT count(*) FROM {child} WHERE movie_id NOT IN (SELECT movie_id FROM {parent})"


_DQ_SQL = "\nUNION ALL ".join([
    _dq_sql("rows", "movies", "SELECT count(*) FROM movies"),
    _dq_sql("rows", "movie_tags", "SELECT count(*) FROM movie_tags"),
    _dq_sql("rows", "availability", "SELECT count(*) FROM availability"),
    _dq_sql("rows", "ratings", "SELECT count(*) FROM ratings_kept"),
    _dq_sql("rows", "movie_vectors", "SELECT count(*) FROM movie_vectors"),
    _dq_sql("pk_duplicates", "movies", _dup("movies", "movie_id")),
    _dq_sql("pk_duplicates", "movie_nodes", _dup("movie_nodes", "movie_id")),
    _dq_sql("pk_duplicates", "genre_nodes", _dup("(SELECT DISTINCT genre FROM has_genre)", "genre")),
    _dq_sql("pk_duplicates", "tag_nodes", _dup("(SELECT DISTINCT tag FROM has_tag)", "tag")),
    _dq_sql("pk_duplicates", "movie_vectors", _dup("movie_vectors", "movie_id")),
    _dq_sql("fk_orphans", "movie_tags", _orph("movie_tags", "movies")),
    _dq_sql("fk_orphans", "availability", _orph("availability", "movies")),
    _dq_sql("fk_orphans", "has_genre", _orph("has_genre", "movie_nodes")),
    _dq_sql("fk_orphans", "has_tag", _orph("has_tag", "movie_nodes")),
    _dq_sql("fk_orphans", "rated", _orph("rated", "movie_nodes")),
    _dq_sql("vector_bad_dim", "movie_vectors", f"SELECT count(*) FROM movie_vectors WHERE len(embedding) <> {VECTOR_DIM}"),
    _dq_sql("vector_not_unit", "movie_vectors",
            "SELECT count(*) FROM movie_vectors WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), "
            "CAST(embedding AS DOUBLE[]))) - 1.0) >= 1e-5"),
])


@register("dq_report", assemble(_DQ_SQL))
def q_dq_report(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return dq_report(c.movies(), c.movie_tags(), c.availability(), c.ratings(), c.nodes(), c.has_genre(),
                     c.has_tag(), c.rated(), c.vectors(), dim=VECTOR_DIM)


# ---------------------------------------------------------------- loads and merges
# Ratings of the last years come as deltas, one a year, onto a table of those before.
FIRST_DELTA_YEAR = 1997


@register("merge_rated", """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(movie_id AS BIGINT) AS movie_id, rating, CAST(seq AS BIGINT) AS seq
FROM (SELECT o_custkey AS user_id, l_partkey AS movie_id,
             CAST(least(10, 1 + ((CAST(l_quantity AS INTEGER) - 1) % 5) + 2 * (l_partkey % 6)) AS DOUBLE) / 2.0 AS rating,
             CAST(o_orderdate AS DATE) AS day, l_orderkey * 8 + l_linenumber AS seq
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY day DESC, seq DESC, rating DESC) = 1""")
def q_merge_rated(spark, sf_dir):
    """RATED edges kept up to date: a first load, then each year's ratings merged by (user, movie);
    a later rating replaces an earlier one, and only touched buckets are rewritten."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cinegraph-tables/{uuid.uuid4().hex}"
    # lines meet their orders once; the first load and each delta read the folders of their years
    joined = adapters.rating_events(spark, sf_dir).withColumn("year", F.year("day"))
    joined.write.partitionBy("year").parquet(f"{root}/events")
    events = spark.read.schema(joined.schema).parquet(f"{root}/events")
    rated = KeyedTable(spark, f"{root}/rated_keyed", ["user_id", "movie_id"])
    rated.create(events.where(F.col("year") < FIRST_DELTA_YEAR).drop("year"), ["day", "seq", "rating"])
    later = events.where(F.col("year") >= FIRST_DELTA_YEAR)
    for (year,) in sorted(later.select("year").distinct().collect()):
        rated.merge(later.where(F.col("year") == year).drop("year"), ["day", "seq", "rating"])
    return rated.read().select(big("user_id"), big("movie_id"), "rating", big("seq"))


@register("load_movies", assemble(_MOVIE_SQL + " WHERE movie_id IN (SELECT DISTINCT movie_id FROM has_tag)"))
def q_load_movies(spark, sf_dir):
    """The typed movie load: first row per key wins over rows sent again, restricted to tagged movies."""
    c = catalog(spark, sf_dir)
    m = c.movies()
    sent = m.withColumn("_sent", F.lit(1)).unionByName(m.withColumns({"title": F.lit("sent again"), "_sent": F.lit(2)}))
    loaded = sinks.restrict_to(sinks.load_movies(sent, [F.asc("_sent")]), c.has_tag())
    return loaded.select(big("movie_id"), big("tmdb_id"), "title", big("year"), "genres", "overview", "tagline", "director",
                         "top_cast", "poster_path", r6("vote_average"), big("vote_count"),
                         r6("rating_mean"), big("rating_count"), r6("bayesian_avg"))


# ---------------------------------------------------------------- CSV inputs
_NA_SQL = ", ".join("'" + t + "'" for t in NA_TOKENS)


def _na_sql(x: str) -> str:
    return f"CASE WHEN {x} NOT IN ({_NA_SQL}) THEN {x} END"


@register("csv_inputs", assemble(f"""
SELECT 'movies' AS source, CAST(doc_id AS VARCHAR) AS key, md5({_na_sql('text')}) AS value,
       CAST(length({_na_sql('text')}) AS DOUBLE) AS num FROM documents
UNION ALL SELECT 'rejected', NULL, NULL, CAST(count(*) AS DOUBLE) FROM pages
UNION ALL SELECT 'links', CAST(movieId AS VARCHAR), imdbId, tmdbId FROM ml_links
UNION ALL SELECT 'ratings', CAST(movieId AS VARCHAR), CAST(count(*) AS VARCHAR), round(sum(rating), 6) FROM ml_ratings GROUP BY movieId
UNION ALL SELECT 'tags', CAST(movieId AS VARCHAR), {_na_sql('tag')}, CAST(count(*) AS DOUBLE) FROM ml_tags GROUP BY movieId, tag
UNION ALL SELECT 'availability', Title, {_na_sql('"Year"')}, CAST("Netflix" + 10 * "Hulu" + 100 * "Prime Video" AS DOUBLE)
FROM availability_raw"""))
def q_csv_inputs(spark, sf_dir):
    """The CSV readers over files written from the tables: texts of many lines with quotes and commas
    for titles, padded tags, flags as ``1.0``; records that don't fit the schema are counted apart."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cinegraph-csv/{uuid.uuid4().hex}"
    docs, pages = adapters.table(spark, sf_dir, "documents"), adapters.table(spark, sf_dir, "pages")
    # url and page as if they were movies: no number stands where the id should
    titles = docs.select(F.col("doc_id").cast("string").alias("movieId"), F.col("text").alias("title"), F.col("lang").alias("genres"))
    sinks.write_csv(titles.unionByName(pages.select(F.col("url").alias("movieId"), F.col("html").alias("title"),
                                                    F.lit("page").alias("genres"))), f"{root}/movies")
    sinks.write_csv(adapters.ml_links(spark, sf_dir), f"{root}/links")
    sinks.write_csv(adapters.ml_ratings(spark, sf_dir).withColumn("timestamp", F.lit(0)), f"{root}/ratings")
    tags = adapters.ml_tags(spark, sf_dir).select(F.lit(1).alias("userId"), "movieId", "tag", F.lit(0).alias("timestamp"))
    sinks.write_csv(tags, f"{root}/tags")
    flags = adapters.availability_raw(spark, sf_dir)
    sinks.write_csv(flags.select("Title", "Year", *[F.col(f"`{c}`").cast("double").alias(c) for c in flags.columns[2:]]), f"{root}/availability")

    def out(df, source, key, value, num):
        return df.select(F.lit(source).alias("source"), key.cast("string").alias("key"), value.cast("string").alias("value"),
                         num.cast("double").alias("num"))

    c = F.col
    rejected = readers.rejected_csv(spark, f"{root}/movies", readers.ML_MOVIES_SCHEMA, free_text=True)
    ratings = readers.read_ml_ratings(spark, f"{root}/ratings").groupBy("movieId").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("rating"), 6).alias("s"))
    found = readers.read_ml_tags(spark, f"{root}/tags").groupBy("movieId", "tag").agg(F.count(F.lit(1)).alias("n"))
    flagged = readers.read_availability_raw(spark, f"{root}/availability")
    parts = [
        out(readers.read_ml_movies(spark, f"{root}/movies"), "movies", c("movieId"), F.md5(c("title")), F.length("title")),
        out(rejected.agg(F.count(F.lit(1)).alias("n")), "rejected", F.lit(None), F.lit(None), c("n")),
        out(readers.read_ml_links(spark, f"{root}/links"), "links", c("movieId"), c("imdbId"), c("tmdbId")),
        out(ratings, "ratings", c("movieId"), c("n"), c("s")),
        out(found, "tags", c("movieId"), c("tag"), c("n")),
        out(flagged, "availability", c("Title"), c("Year"), c("Netflix") + 10 * c("Hulu") + 100 * c("Prime Video")),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- text embedding and ANN
TEXT_DIM = 768     # embedding width of the source application's model
ANN_K = 10
# The index of the vector queries. The given vectors lie without clusters on the sphere, so
# nearly all lists are probed; what is saved is the reading of full vectors.
ANN_CELLS, ANN_PROBE = 16, 15
ANN_PARTS, ANN_WORDS = 32, 128
ANN_WIDTH = 2      # dimensions of a part: 64 / 32
ANN_RERANK = 40


# The hashing encoder in SQL: terms, their entries by MD5, unit vectors rounded to single precision.
def _terms_sql(src: str, key: str, text: str) -> str:
    return f"""
SELECT {key}, slot, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS w FROM (
  SELECT {key}, slot, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {TEXT_DIM} AS slot
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {src}))
  GROUP BY {key}, slot)"""


_TEXT_EXTRA = {
    "text_docs": _DOC_SQL_PART,
    "doc_terms": _terms_sql("text_docs", "movie_id", "doc"),
    "query_terms": _terms_sql("benchmark", "item_id", "text"),
    "text_points": """
SELECT m.movie_id, coalesce(m.title, 'nan') AS title, m.year, coalesce(m.genres, '') AS genres,
       coalesce(m.poster_path, '') AS poster_path, coalesce(m.bayesian_avg, 0.0) AS bayesian_avg
FROM movies m WHERE m.overview IS NOT NULL""",
    "text_hits": f"""
SELECT * FROM (
  SELECT query_id, movie_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, movie_id) AS vec_rank
  FROM (SELECT q.item_id AS query_id, p.movie_id, coalesce(s.score, 0.0) AS score
        FROM benchmark q CROSS JOIN text_points p
        LEFT JOIN (SELECT q.item_id, d.movie_id, sum(CAST(q.w AS DOUBLE) * CAST(d.w AS DOUBLE)) AS score
                   FROM query_terms q JOIN doc_terms d ON d.slot = q.slot GROUP BY q.item_id, d.movie_id) s
          ON s.item_id = q.item_id AND s.movie_id = p.movie_id))
WHERE vec_rank <= {LIMIT * 5}""",
}


@register("movie_text_vectors", assemble(f"""
SELECT CAST(p.movie_id AS BIGINT) AS movie_id, CAST({TEXT_DIM} AS BIGINT) AS dim, round(coalesce(t.norm, 0.0), 6) AS norm,
       CAST(coalesce(t.nonzero, 0) AS BIGINT) AS nonzero, p.title
FROM text_points p LEFT JOIN (
  SELECT movie_id, sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) AS norm, count(*) AS nonzero FROM doc_terms GROUP BY movie_id) t
  ON t.movie_id = p.movie_id""", _TEXT_EXTRA))
def q_movie_text_vectors(spark, sf_dir):
    """Movie documents embedded by the default (hashing) encoder: contract columns."""
    v = catalog(spark, sf_dir).text_vectors(TEXT_DIM)
    return v.select(big("movie_id"), F.size("embedding").cast("bigint").alias("dim"),
                    F.round(l2_norm("embedding"), 6).alias("norm"),
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nonzero"), "title")


@register("search_by_text", assemble(f"""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, CAST(movie_id AS BIGINT) AS movie_id,
       title, CAST(year AS BIGINT) AS year, genres, poster_path, round(bayesian_avg, 6) AS bayesian_avg,
       blend AS score, round(score, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, vec_rank) AS rank
      FROM (SELECT h.query_id, h.movie_id, h.score, h.vec_rank, p.title, p.year, p.genres, p.poster_path, p.bayesian_avg,
                   round(0.6 * h.score + 0.4 * CASE WHEN p.bayesian_avg > 0 THEN least(p.bayesian_avg / 5.0, 1.0)
                                                    ELSE 0.0 END, 3) AS blend
            FROM text_hits h JOIN text_points p ON p.movie_id = h.movie_id))
WHERE rank <= {LIMIT}""", _TEXT_EXTRA))
def q_search_by_text(spark, sf_dir):
    """Every benchmark passage used as a natural-language query against the movies."""
    c = catalog(spark, sf_dir)
    q = hashing_encoder(adapters.query_texts(spark, sf_dir), "text", dim=TEXT_DIM).select("query_id", "embedding")
    return search(q, c.text_vectors(TEXT_DIM), limit=LIMIT)


# The index in SQL: centres and words are those of the first vectors by MD5 of their id.
_ANN_EXTRA = {
    "ann_drawn": """
SELECT movie_id, embedding, row_number() OVER (ORDER BY md5(CAST(movie_id AS VARCHAR)), movie_id) AS rn FROM movie_vectors""",
    "ann_entries": """
SELECT movie_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM movie_vectors""",
    "ann_asked": "SELECT vec_id AS query_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "ann_centers": f"""
SELECT d.rn - 1 AS cell, e.i, e.v FROM ann_drawn d JOIN ann_entries e ON e.movie_id = d.movie_id WHERE d.rn <= {ANN_CELLS}""",
    "ann_cells": """
SELECT movie_id, cell FROM (
  SELECT e.movie_id, c.cell, row_number() OVER (PARTITION BY e.movie_id ORDER BY round(sum(e.v * c.v), 9) DESC, c.cell) AS rn
  FROM ann_entries e JOIN ann_centers c ON c.i = e.i GROUP BY e.movie_id, c.cell) WHERE rn = 1""",
    "ann_rest": f"""
SELECT e.movie_id, e.i // {ANN_WIDTH} AS part, e.i % {ANN_WIDTH} AS j, e.v - c.v AS v
FROM ann_entries e JOIN ann_cells a ON a.movie_id = e.movie_id JOIN ann_centers c ON c.cell = a.cell AND c.i = e.i""",
    "ann_words": f"""
SELECT d.rn - {ANN_CELLS + 1} AS word, r.part, r.j, r.v FROM ann_drawn d JOIN ann_rest r ON r.movie_id = d.movie_id
WHERE d.rn > {ANN_CELLS} AND d.rn <= {ANN_CELLS + ANN_WORDS}""",
    "ann_codes": """
SELECT movie_id, part, word FROM (
  SELECT r.movie_id, r.part, w.word,
         row_number() OVER (PARTITION BY r.movie_id, r.part ORDER BY round(sum((r.v - w.v) * (r.v - w.v)), 9), w.word) AS rn
  FROM ann_rest r JOIN ann_words w ON w.part = r.part AND w.j = r.j GROUP BY r.movie_id, r.part, w.word) WHERE rn = 1""",
    "ann_probes": f"""
SELECT query_id, cell, base FROM (
  SELECT q.query_id, c.cell, sum(q.v * c.v) AS base,
         row_number() OVER (PARTITION BY q.query_id ORDER BY round(sum(q.v * c.v), 9) DESC, c.cell) AS rn
  FROM ann_asked q JOIN ann_centers c ON c.i = q.i GROUP BY q.query_id, c.cell) WHERE rn <= {ANN_PROBE}""",
    "ann_tables": f"""
SELECT q.query_id, w.part, w.word, sum(q.v * w.v) AS v
FROM ann_asked q JOIN ann_words w ON w.part = q.i // {ANN_WIDTH} AND w.j = q.i % {ANN_WIDTH} GROUP BY q.query_id, w.part, w.word""",
    "ann_read": """
SELECT p.query_id, a.movie_id, p.base FROM ann_probes p JOIN ann_cells a ON a.cell = p.cell""",
    "ann_best": f"""
SELECT query_id, movie_id FROM (
  SELECT r.query_id, r.movie_id, row_number() OVER (PARTITION BY r.query_id
           ORDER BY round(any_value(r.base) + sum(t.v), 9) DESC, r.movie_id) AS rn
  FROM ann_read r JOIN ann_codes c ON c.movie_id = r.movie_id
  JOIN ann_tables t ON t.query_id = r.query_id AND t.part = c.part AND t.word = c.word
  GROUP BY r.query_id, r.movie_id) WHERE rn <= {ANN_RERANK}""",
    "ann_exact": """
SELECT q.vec_id AS query_id, v.movie_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
FROM embeddings q CROSS JOIN movie_vectors v""",
    "ann_found": f"""
SELECT * FROM (
  SELECT b.query_id, b.movie_id, x.score,
         row_number() OVER (PARTITION BY b.query_id ORDER BY round(x.score, 9) DESC, b.movie_id) AS rank
  FROM ann_best b JOIN ann_exact x ON x.query_id = b.query_id AND x.movie_id = b.movie_id) WHERE rank <= {ANN_K}""",
    "ann_true": f"""
SELECT * FROM (
  SELECT query_id, movie_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, movie_id) AS rank
  FROM ann_exact) WHERE rank <= {ANN_K}""",
}


def _ann(spark, sf_dir):
    """(queries, the stored index, vectors, hits): every vector of the embeddings table asks."""
    c = catalog(spark, sf_dir)
    vectors = c.vectors().select("movie_id", "embedding")
    asked = adapters.embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    index = c.vector_index(ANN_CELLS, ANN_PARTS, ANN_WORDS)
    return asked, index, vectors, ann_ops.search_index(asked, index, vectors, ANN_K, ANN_PROBE, ANN_RERANK)


@register("ann_search", assemble("""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, CAST(movie_id AS BIGINT) AS movie_id,
       round(score, 6) AS score FROM ann_found""", _ANN_EXTRA))
def q_ann_search(spark, sf_dir):
    """The ten best movies of every query vector by the stored index: lists of quantised codes, the
    best codes ranked exactly."""
    found = _ann(spark, sf_dir)[3]
    return found.select(big("query_id"), F.col("vec_rank").cast("bigint").alias("rank"), big("movie_id"), r6("score"))


@register("ann_recall", assemble(f"""
SELECT CAST(t.query_id AS BIGINT) AS query_id, round(count(f.movie_id) / count(*), 6) AS recall, count(*) AS k,
       any_value(r.codes) AS codes_read, CAST(least({ANN_RERANK}, any_value(r.codes)) AS BIGINT) AS vectors_read,
       (SELECT count(*) FROM movie_vectors) AS vectors
FROM ann_true t LEFT JOIN ann_found f ON f.query_id = t.query_id AND f.movie_id = t.movie_id
JOIN (SELECT query_id, count(*) AS codes FROM ann_read GROUP BY query_id) r ON r.query_id = t.query_id
GROUP BY t.query_id""", _ANN_EXTRA))
def q_ann_recall(spark, sf_dir):
    """Recall@10 of the stored index against exact search for every query vector, with the codes
    and the full vectors that a query reads."""
    asked, index, vectors, found = _ann(spark, sf_dir)
    rec = ann_ops.recall_at_k(found, knn_exact(asked, vectors, ANN_K))
    read = ann_ops.codes_read(asked, index, ANN_PROBE)
    return rec.join(read, "query_id").select(
        big("query_id"), F.round("recall", 6).alias("recall"), big("k"), F.col("codes").cast("bigint").alias("codes_read"),
        F.least(F.lit(ANN_RERANK), F.col("codes")).cast("bigint").alias("vectors_read"),
        vectors.select(F.count(F.lit(1))).scalar().alias("vectors"))


def queries() -> dict[str, Builder]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
