"""DuckDB oracle SQL for the registered queries.

Each query's SQL is self-contained: it starts from the driver's raw views (part, orders,
lineitem, documents, embeddings, benchmark) and repeats the adapters and build steps as
CTEs, written independently of the Spark code. ``sql(name)`` assembles the CTEs a query
needs (transitively) in dependency order.
"""

from __future__ import annotations

import re

# Python str.strip() whitespace set (RE2 syntax; same class as the Spark side).
_WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_int_trunc(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    return f"(CASE WHEN regexp_full_match({s}, '{NUMERIC}') THEN CAST(trunc(CAST({s} AS DOUBLE)) AS BIGINT) END)"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


# ---------------------------------------------------------------- adapters (FIXTURES 2.1)
cte("parts", [], "SELECT * FROM part")
cte("ml_movies", ["parts"], """
SELECT p_partkey AS movieId,
       p_name || ' #' || p_partkey || ' (' || (1950 + p_size) || ')' AS title,
       CASE WHEN p_size % 10 = 0 THEN '(no genres listed)'
            ELSE p_type || '| ' || p_brand || '|S' || (p_size % 4) END AS genres
FROM parts""")
cte("ml_links", ["parts"], """
SELECT p_partkey AS movieId, 'tt' || p_partkey AS imdbId,
       CAST(p_partkey + 10000 AS DOUBLE) AS tmdbId
FROM parts""")
cte("li", [], """
SELECT l_partkey AS movie_id, o_custkey AS user_id, CAST(l_quantity AS INTEGER) AS q,
       l_linenumber, l_returnflag, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("ml_ratings", ["li"], """
SELECT user_id AS userId, movie_id AS movieId,
       CAST(least(10, 1 + ((q - 1) % 5) + 2 * (movie_id % 6)) AS DOUBLE) / 2.0 AS rating
FROM li""")
cte("ml_tags", ["li"], """
SELECT movieId, CASE WHEN ln = 0 THEN upper(t) WHEN ln = 1 THEN lower(t) ELSE ' ' || lower(t) || ' ' END AS tag
FROM (SELECT movie_id AS movieId, l_linenumber % 3 AS ln,
             substr(o_orderpriority, 3) || '-' || l_returnflag ||
             CASE WHEN movie_id % 2 = 0 THEN '-e' ELSE '-' || (movie_id % 3) END AS t
      FROM li)""")
cte("ext_meta", ["parts"], """
SELECT (k + 10000) || CASE WHEN k % 2 = 0 THEN '.0' ELSE '' END AS id,
       p_name AS title,
       d.text AS overview,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'tagline ' || p_brand END AS tagline,
       p_type AS genres,
       CASE WHEN k % 17 = 0 THEN NULL ELSE 'Actor ' || (k % 5) || ', Actor ' || (k % 7) || ' ,Actor ' || (k % 9) || ',A,B,C' END AS movie_cast,
       CASE WHEN k % 23 = 0 THEN NULL ELSE 'Director ' || (k % 23) END AS director,
       CASE WHEN k % 7 = 0 THEN NULL ELSE '/p' || k || '.jpg' END AS poster_path,
       p_retailprice / 200.0 AS vote_average,
       CAST(p_size * 10 AS INTEGER) AS vote_count,
       CASE WHEN k % 13 = 0 THEN 'unknown' ELSE (1950 + p_size) || '-0' || (1 + p_size % 9) || '-15' END AS release_date
FROM (SELECT *, p_partkey AS k FROM parts) p LEFT JOIN documents d ON d.doc_id = p.k""")
cte("availability_raw", ["parts"], """
SELECT CASE WHEN k % 4 = 0 THEN upper(base) ELSE ' ' || base || ' ' END AS "Title",
       CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(1950 + p_size AS VARCHAR) END AS "Year",
       CAST(p_size % 2 AS INTEGER) AS "Netflix",
       CAST(p_size % 3 = 0 AS INTEGER) AS "Hulu",
       CAST(p_size % 5 = 0 AS INTEGER) AS "Prime Video"
FROM (SELECT *, p_partkey AS k, p_name || ' #' || p_partkey AS base FROM parts)""")

# ---------------------------------------------------------------- build steps
cte("stats0", ["ml_ratings"], """
SELECT movieId AS movie_id, avg(rating) AS rating_mean, count(rating) AS rating_count
FROM ml_ratings WHERE movieId IS NOT NULL GROUP BY movieId""")
cte("consts", ["stats0"], """
SELECT avg(rating_mean) AS c, quantile_cont(rating_count, 0.25) AS m FROM stats0""")
cte("stats", ["stats0", "consts"], """
SELECT s.*, (rating_count / (rating_count + m)) * rating_mean + (m / (rating_count + m)) * c AS bayesian_avg
FROM stats0 s, consts""")
cte("ext_clean", ["ext_meta"], f"""
SELECT * EXCLUDE (id), CAST(id AS VARCHAR) AS _ext_id, {to_int_trunc('id')} AS tmdb_id
FROM ext_meta WHERE {to_int_trunc('id')} IS NOT NULL""")
cte("movies", ["ml_movies", "ml_links", "ext_clean", "stats"], f"""
SELECT movie_id, tmdb_id, title, year, genres, overview, tagline, director, top_cast, poster_path,
       vote_average, vote_count, rating_mean, rating_count, bayesian_avg
FROM (
  SELECT CAST(m.movieId AS BIGINT) AS movie_id, e.tmdb_id, m.title,
         CAST(year(try_strptime(e.release_date, '%Y-%m-%d')) AS INTEGER) AS year,
         m.genres, e.overview, e.tagline, e.director,
         CASE WHEN e.movie_cast IS NULL OR {strip('e.movie_cast')} = '' THEN ''
              ELSE array_to_string(list_slice(list_transform(string_split(e.movie_cast, ','), lambda x: {strip('x')}), 1, 5), ', ')
         END AS top_cast,
         e.poster_path, e.vote_average, e.vote_count, s.rating_mean, s.rating_count, s.bayesian_avg,
         row_number() OVER (PARTITION BY m.movieId ORDER BY e._ext_id NULLS LAST, e.tmdb_id NULLS LAST) AS rn
  FROM ml_movies m
  JOIN (SELECT movieId, CAST(trunc(tmdbId) AS BIGINT) AS l_tmdb FROM ml_links WHERE tmdbId IS NOT NULL) l
    ON m.movieId = l.movieId
  JOIN ext_clean e ON l.l_tmdb = e.tmdb_id
  LEFT JOIN stats s ON s.movie_id = m.movieId)
WHERE rn = 1""")
cte("avail_long", ["availability_raw"], f"""
SELECT title_norm, year, provider FROM (
  SELECT lower({strip("coalesce(\"Title\", 'nan')")}) AS title_norm, {to_int_trunc('"Year"')} AS year,
         'netflix' AS provider, CAST("Netflix" AS DOUBLE) AS available FROM availability_raw
  UNION ALL
  SELECT lower({strip("coalesce(\"Title\", 'nan')")}), {to_int_trunc('"Year"')}, 'hulu', CAST("Hulu" AS DOUBLE) FROM availability_raw
  UNION ALL
  SELECT lower({strip("coalesce(\"Title\", 'nan')")}), {to_int_trunc('"Year"')}, 'prime video', CAST("Prime Video" AS DOUBLE) FROM availability_raw
  UNION ALL
  SELECT lower({strip("coalesce(\"Title\", 'nan')")}), {to_int_trunc('"Year"')}, 'disney+', 0.0 FROM availability_raw)
WHERE available = 1""")
cte("availability", ["avail_long", "movies"], f"""
SELECT DISTINCT mj.movie_id, a.provider
FROM avail_long a
JOIN (SELECT movie_id,
             CAST(year AS BIGINT) AS m_year,
             lower({strip("regexp_replace(" + strip("coalesce(title, 'nan')") + ", '\\s*\\(\\d{4}\\)\\s*$', '')")}) AS m_title_norm
      FROM movies) mj
  ON a.title_norm = mj.m_title_norm AND a.year IS NOT DISTINCT FROM mj.m_year""")
cte("tag_counts", ["ml_tags", "movies"], f"""
SELECT movieId AS movie_id, tag AS raw_tag, {strip('lower(tag)')} AS tag, count(*) AS count
FROM ml_tags
WHERE movieId IS NOT NULL AND tag IS NOT NULL AND movieId IN (SELECT movie_id FROM movies)
GROUP BY movieId, tag HAVING count(*) >= 2""")
cte("movie_tags", ["tag_counts"], """
SELECT movie_id, tag, CAST(count AS BIGINT) AS count FROM (
  SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY count DESC, tag, raw_tag) AS rn FROM tag_counts)
WHERE rn <= 20 AND tag <> ''""")
cte("ratings_kept", ["ml_ratings", "movies"], """
SELECT userId AS user_id, movieId AS movie_id, rating FROM ml_ratings
WHERE movieId IN (SELECT movie_id FROM movies)""")
cte("movie_nodes", ["movies"], """
SELECT movie_id, coalesce(title, 'nan') AS title, year, coalesce(bayesian_avg, 0.0) AS bayesian_avg,
       coalesce(poster_path, '') AS poster_path FROM movies""")
cte("has_genre", ["movies"], f"""
SELECT DISTINCT movie_id, genre FROM (
  SELECT movie_id, {strip('g')} AS genre FROM (
    SELECT movie_id, unnest(string_split(coalesce(genres, ''), '|')) AS g FROM movies))
WHERE genre <> '' AND lower(genre) <> '(no genres listed)'""")
cte("has_tag", ["movie_tags", "movies"], """
SELECT DISTINCT movie_id, tag, count FROM movie_tags WHERE movie_id IN (SELECT movie_id FROM movies)""")
cte("rated", ["ratings_kept", "movies"], """
SELECT DISTINCT user_id, movie_id, rating FROM ratings_kept WHERE movie_id IN (SELECT movie_id FROM movies)""")
cte("fan_edges", ["rated"], "SELECT DISTINCT user_id, movie_id FROM rated WHERE rating >= 4.0")
cte("movie_vectors", ["movies"], """
SELECT m.movie_id, e.embedding, coalesce(m.title, 'nan') AS title, m.year,
       coalesce(m.genres, '') AS genres, coalesce(m.director, '') AS director,
       coalesce(m.poster_path, '') AS poster_path, coalesce(m.bayesian_avg, 0.0) AS bayesian_avg
FROM movies m JOIN embeddings e ON e.vec_id = m.movie_id
WHERE m.overview IS NOT NULL""")

# ---------------------------------------------------------------- signals (seeds CTE given per query)
cte("fan_rows", ["rated", "seeds"], """
SELECT s.seed_id, r.user_id
FROM rated r JOIN seeds s ON r.movie_id = s.seed_id WHERE r.rating >= 4.0""")
cte("fans", ["fan_rows"], "SELECT DISTINCT seed_id, user_id FROM fan_rows")
cte("collab_agg", ["fans", "fan_edges", "movie_nodes"], """
SELECT f.seed_id, fe.movie_id, count(*) AS co_fans
FROM fans f JOIN fan_edges fe ON fe.user_id = f.user_id
JOIN movie_nodes n ON n.movie_id = fe.movie_id
WHERE fe.movie_id <> f.seed_id AND n.bayesian_avg >= 3.5
GROUP BY f.seed_id, fe.movie_id HAVING count(*) >= 5""")
cte("sig_collab", ["collab_agg"], """
SELECT seed_id, movie_id, rank, co_fans, (co_fans / max(co_fans) OVER (PARTITION BY seed_id)) * 0.25 AS boost
FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY co_fans DESC, movie_id) AS rank FROM collab_agg)
WHERE rank <= 60""")
cte("seed_tags", ["has_tag", "seeds"], """
SELECT s.seed_id, t.tag, t.count AS c1 FROM has_tag t JOIN seeds s ON t.movie_id = s.seed_id""")
cte("tag_agg", ["seed_tags", "has_tag", "movie_nodes"], """
SELECT st.seed_id, o.movie_id, list_sort(list(o.tag)) AS shared,
       CAST(sum(least(st.c1, o.count)) AS BIGINT) AS weighted_overlap
FROM has_tag o
JOIN movie_nodes n ON n.movie_id = o.movie_id AND n.bayesian_avg >= 3.0
JOIN seed_tags st ON st.tag = o.tag
WHERE o.movie_id <> st.seed_id
GROUP BY st.seed_id, o.movie_id""")
cte("sig_tags", ["tag_agg"], """
SELECT seed_id, movie_id, rank, weighted_overlap, array_to_string(shared, ', ') AS shared_tags,
       array_to_string(list_slice(shared, 1, 5), ', ') AS label,
       (weighted_overlap / max(weighted_overlap) OVER (PARTITION BY seed_id)) * 0.35 AS boost
FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY weighted_overlap DESC, movie_id) AS rank FROM tag_agg)
WHERE rank <= 80""")
cte("seed_genres", ["has_genre", "seeds"], """
SELECT s.seed_id, g.genre FROM has_genre g JOIN seeds s ON g.movie_id = s.seed_id""")
cte("genre_agg", ["seed_genres", "has_genre", "movie_nodes"], """
SELECT sg.seed_id, o.movie_id, list_sort(list(o.genre)) AS shared, count(*) AS genre_count,
       max(n.bayesian_avg) AS bayesian_avg
FROM has_genre o
JOIN movie_nodes n ON n.movie_id = o.movie_id AND n.bayesian_avg >= 3.5
JOIN seed_genres sg ON sg.genre = o.genre
WHERE o.movie_id <> sg.seed_id
GROUP BY sg.seed_id, o.movie_id""")
cte("sig_genres", ["genre_agg"], """
SELECT seed_id, movie_id, rank, CAST(genre_count AS BIGINT) AS genre_count,
       array_to_string(shared, ', ') AS shared_genres, array_to_string(list_slice(shared, 1, 3), ', ') AS label,
       least(genre_count / 3.0, 1.0) * 0.15 AS boost
FROM (SELECT *, row_number() OVER (PARTITION BY seed_id
                                   ORDER BY genre_count DESC, round(bayesian_avg, 9) DESC, movie_id) AS rank
      FROM genre_agg)
WHERE rank <= 60""")
cte("vhits", ["movie_vectors", "seeds"], """
SELECT seed_id, movie_id, score, vec_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(score, 9) DESC, movie_id) AS vec_rank
  FROM (SELECT sv.seed_id, v.movie_id,
               list_dot_product(CAST(sv.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
        FROM (SELECT s.seed_id, v.embedding FROM movie_vectors v JOIN seeds s ON v.movie_id = s.seed_id) sv,
             movie_vectors v))
WHERE vec_rank <= {VK}""")
cte("sig_vector", ["vhits"], """
SELECT seed_id, movie_id, vec_rank AS rank, score AS vector_score, (score / mx) * 0.25 AS boost
FROM (SELECT *, max(score) OVER (PARTITION BY seed_id) AS mx FROM vhits WHERE movie_id <> seed_id)
WHERE mx > 0""")
cte("sig_union", ["sig_collab", "sig_tags", "sig_genres", "sig_vector"], """
SELECT *, min(sig) OVER (PARTITION BY seed_id, movie_id) AS fs FROM (
  SELECT seed_id, movie_id, 1 AS sig, rank, boost,
         '⭐ ' || co_fans || ' fans also loved this' AS first_text, NULL::VARCHAR AS next_text,
         co_fans, NULL::BIGINT AS weighted_overlap, NULL::VARCHAR AS shared_tags,
         NULL::BIGINT AS genre_count, NULL::VARCHAR AS shared_genres, NULL::DOUBLE AS vector_score
  FROM sig_collab
  UNION ALL
  SELECT seed_id, movie_id, 2, rank, boost, '🏷️ Shared themes: ' || label, '🏷️ Shared themes: ' || label,
         NULL, weighted_overlap, shared_tags, NULL, NULL, NULL FROM sig_tags
  UNION ALL
  SELECT seed_id, movie_id, 3, rank, boost, '🎬 Same genres: ' || label, '🎬 ' || label,
         NULL, NULL, NULL, genre_count, shared_genres, NULL FROM sig_genres
  UNION ALL
  SELECT seed_id, movie_id, 4, rank, boost, '🔍 Similar plot & style', NULL,
         NULL, NULL, NULL, NULL, NULL, vector_score FROM sig_vector)""")
cte("fused", ["sig_union"], """
SELECT seed_id, movie_id,
       ((coalesce(max(CASE WHEN sig = 1 THEN boost END), 0.0) + coalesce(max(CASE WHEN sig = 2 THEN boost END), 0.0))
        + coalesce(max(CASE WHEN sig = 3 THEN boost END), 0.0)) + coalesce(max(CASE WHEN sig = 4 THEN boost END), 0.0)
         AS composite,
       min(sig) AS first_sig, arg_min(rank, sig) AS first_rank, count(*) AS n_signals,
       string_agg(CASE WHEN sig = fs THEN first_text ELSE next_text END, ' · ' ORDER BY sig) AS explanation,
       max(co_fans) AS co_fans, max(weighted_overlap) AS weighted_overlap, max(shared_tags) AS shared_tags,
       max(genre_count) AS genre_count, max(shared_genres) AS shared_genres, max(vector_score) AS vector_score
FROM sig_union GROUP BY seed_id, movie_id""")
cte("recommended", ["fused", "movie_nodes", "movie_vectors"], """
SELECT CAST(f.seed_id AS BIGINT) AS seed_id, CAST(f.rank AS BIGINT) AS rank, CAST(f.movie_id AS BIGINT) AS movie_id,
       n.title, CAST(n.year AS BIGINT) AS year, round(n.bayesian_avg, 6) AS bayesian_avg, n.poster_path, v.genres,
       round(f.composite, 6) AS composite, f.explanation, CAST(f.n_signals AS BIGINT) AS n_signals,
       CAST(f.co_fans AS BIGINT) AS co_fans, f.weighted_overlap, f.shared_tags, f.genre_count, f.shared_genres,
       round(f.vector_score, 6) AS vector_score
FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(composite, 9) DESC, first_sig, first_rank) AS rank
      FROM fused) f
LEFT JOIN movie_nodes n ON n.movie_id = f.movie_id
LEFT JOIN movie_vectors v ON v.movie_id = f.movie_id
WHERE f.rank <= {LIMIT}""")


def assemble(final_select: str, extra: dict[str, str] | None = None, params: dict | None = None) -> str:
    """WITH <needed CTEs in dependency order> <final_select>; ``extra`` adds/overrides CTEs."""
    extra = extra or {}
    used = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", final_select))
    order: list[str] = []
    seen: set[str] = set()

    def deps_of(name):
        if name in extra:
            return [d for d in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", extra[name]) if d in CTES or d in extra]
        return CTES[name][0]

    def visit(name):
        if name in seen:
            return
        seen.add(name)
        for d in deps_of(name):
            if d != name:
                visit(d)
        order.append(name)

    for name in list(CTES) + list(extra):
        if name in used:
            visit(name)
    bodies = []
    for name in order:
        body = extra[name] if name in extra else CTES[name][1]
        bodies.append(f"{name} AS ({body.strip()})")
    text = ("WITH " + ",\n".join(bodies) + "\n" if bodies else "") + final_select
    for k, v in (params or {}).items():
        text = text.replace("{" + k + "}", str(v))
    return text
