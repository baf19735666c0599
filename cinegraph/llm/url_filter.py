"""URL filter by a character language-model ratio, with DataFrame operations only.

Two variable-order Markov models over the characters of a URL's host and path are learnt
from the URLs that a rule accepts and those that a rule rejects. Both interpolate the
orders 3 to 0 by Witten-Bell smoothing: a context hands as much weight to the next shorter
one as it has seen distinct successors. A URL's score is the mean, over its characters, of
the difference of the log-likelihoods; the threshold is calibrated on 3 of 16 of the rules'
URLs, which the models don't see, for the best balanced accuracy.

URLs are spelt in 33 symbols (letters, one for all digits, ``. / -``, one for all others,
begin, end), so a model has at most 33**4 (1.2 million) entries however large the input:
that proven bound is what lets the table of log ratios be broadcast, and scoring needs no
shuffle but the sum for each URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is scored as an empty string; if the rules decide no URL, or none of one kind, the
smoothing alone scores and the threshold is 0; repeated rows are judged row by row; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cinegraph.llm.common import ascii_lower, materialise, read_table

# (rule, verdict): a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 4  # characters of a gram: a context of three and its successor
SYMBOLS = 33
CALIBRATES = ("0", "1", "2")  # first digits of a URL's MD5: 3 of 16 calibrate
BEGIN = "^" * (ORDER - 1)
END = "$"


def host_and_path(url):
    """Columns (host, path) of a URL column."""
    part = [F.coalesce(F.regexp_extract(url, rf"(?s)^.*?://{p}", 1), F.lit("")) for p in ("([^/?#]*)", "[^/?#]*([^?#]*)")]
    return ascii_lower(part[0]), part[1]


def fitting_rule(host, path, rules=RULES):
    """Columns (rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends outermost
        domain, slash, start = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def spelling(host, path):
    """A URL in the models' symbols."""
    plain = F.translate(ascii_lower(F.concat(host, path)), "0123456789", "0" * 10)
    return F.concat(F.lit(BEGIN), F.regexp_replace(plain, "[^a-z0./-]", "~"), F.lit(END))


def grams(spelt):
    return F.transform(F.sequence(F.lit(1), F.length(spelt) - (ORDER - 1)), lambda i: F.substr(spelt, i, F.lit(ORDER)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, a, b), the counts of accepted and rejected -> (gram, ratio): log P_a - log P_b."""
    shorter = None
    for k in range(1, ORDER + 1):
        level = counts.groupBy(F.substr("gram", F.lit(ORDER - k + 1), F.lit(k)).alias("g")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumns({"h": F.substr("g", F.lit(1), F.lit(k - 1)), "s": F.substr("g", F.lit(2), F.lit(k - 1))})
        context = level.groupBy("h").agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        joined = level.join(context, "h")
        if shorter is None:
            joined = joined.withColumns({"qa": F.lit(1.0 / SYMBOLS), "qb": F.lit(1.0 / SYMBOLS)})
        else:
            joined = joined.join(shorter.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb")), "s")

        def smoothed(n, total, kinds, lower):
            return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(lower)) / (F.col(total) + F.col(kinds))
                          ).otherwise(F.col(lower))

        shorter = joined.select("g", smoothed("a", "na", "ta", "qa").alias("pa"), smoothed("b", "nb", "tb", "qb").alias("pb"))
    return shorter.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pb")).alias("ratio"))


def threshold_of(scores: DataFrame):
    """Scalar: the score from which to accept, by balanced accuracy over (score, verdict); 0 without
    both kinds. It lies halfway between the last score to accept and the next lower one."""
    cells = scores.groupBy(F.round("score", 2).alias("t")).agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    down = W.orderBy(F.desc("t"))  # some hundred cells at most: scores are mean log ratios
    cells = cells.select("t", F.coalesce(F.lead("t").over(down), F.col("t")).alias("below"), F.sum("a").over(down).alias("above"), F.sum("b").over(down).alias("wrong"),
                         F.sum("a").over(W.partitionBy()).alias("na"), F.sum("b").over(W.partitionBy()).alias("nb"))
    gain = F.col("above") / F.col("na") - F.col("wrong") / F.col("nb")
    best = cells.where((F.col("na") > 0) & (F.col("nb") > 0)).agg(F.max_by((F.col("t") + F.col("below")) / 2, F.struct(F.round(gain, 9), F.col("t"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(0.0)).alias("t")).scalar()


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    spelt = spelling(F.col("host"), F.col("path"))
    # a fold by the spelt URL keeps repeated URLs on one side
    rows = parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("decided"), spelt.alias("spelt"),
                        F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 1).isin(*CALIBRATES).alias("calibrates"))
    learns = ~F.col("calibrates")
    counts = rows.select(F.explode(grams(F.col("spelt"))).alias("gram"), (learns & (F.col("decided") == "allow")).alias("x"),
                         (learns & (F.col("decided") == "block")).alias("y")).groupBy("gram").agg(
        F.count_if("x").alias("a"), F.count_if("y").alias("b"))
    model = materialise(log_ratios(materialise(counts, "url-grams")), "url-model")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = numbered.select("row", "id", "host", "path", "rule", "decided", "calibrates", F.explode(grams(F.col("spelt"))).alias("gram")).join(
        F.broadcast(model), "gram").groupBy("row", "id", "host", "path", "rule", "decided", "calibrates").agg(
        F.round(F.avg("ratio"), 6).alias("score"))
    scored = materialise(scored, "url-scores")
    limit = threshold_of(scored.where(F.col("calibrates") & F.col("decided").isNotNull()).select(
        "score", F.col("decided").alias("verdict")))
    return scored.select("id", "host", "path", "rule", F.coalesce(
        "decided", F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rule = verdict = "NULL"
    for name, decision in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = name.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{decision}' ELSE {verdict} END"
    levels, before = [], None
    for k in range(1, ORDER + 1):
        lower_p = "1.0::DOUBLE / 33" if before is None else "{}"
        levels.append(f"""
l{k} AS (SELECT g, substr(g, 1, {k - 1}) AS h, substr(g, 2, {k - 1}) AS s, sum(a) AS a, sum(b) AS b
  FROM (SELECT substr(gram, {ORDER - k + 1}, {k}) AS g, a, b FROM counts) GROUP BY g),
c{k} AS (SELECT h, sum(a) AS na, sum(b) AS nb, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE b > 0) AS tb FROM l{k} GROUP BY h),
p{k} AS (SELECT l.g,
  CASE WHEN na > 0 THEN (l.a + ta * {lower_p.format('q.pa')}) / (na + ta) ELSE {lower_p.format('q.pa')} END AS pa,
  CASE WHEN nb > 0 THEN (l.b + tb * {lower_p.format('q.pb')}) / (nb + tb) ELSE {lower_p.format('q.pb')} END AS pb
  FROM l{k} l JOIN c{k} c ON l.h = c.h {'' if before is None else f'JOIN p{before} q ON l.s = q.g'})""")
        before = k
    return f"""
WITH parts AS (
  SELECT row_number() OVER () AS n, page_id,
    {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
spelt AS (SELECT *, {rule} AS rule, {verdict} AS decided, substr(md5(host || path), 1, 1) IN {CALIBRATES} AS calibrates,
  '{BEGIN}' || regexp_replace(translate({lower.format('host || path')}, '0123456789', '0000000000'), '[^a-z0./-]', '~', 'g') || '{END}' AS s
  FROM parts),
grams AS (SELECT n, decided, calibrates, substr(s, i, {ORDER}) AS gram
  FROM (SELECT *, unnest(range(1, length(s) - {ORDER - 2})) AS i FROM spelt)),
counts AS (SELECT gram, count(*) FILTER (WHERE NOT calibrates AND decided = 'allow') AS a,
  count(*) FILTER (WHERE NOT calibrates AND decided = 'block') AS b FROM grams GROUP BY gram),{','.join(levels)},
scores AS (SELECT n, round(avg(ln(pa) - ln(pb)), 6) AS score FROM grams JOIN p{ORDER} ON gram = g GROUP BY n),
cells AS (SELECT round(score, 2) AS t, count(*) FILTER (WHERE decided = 'allow') AS a, count(*) FILTER (WHERE decided = 'block') AS b
  FROM scores JOIN spelt USING (n) WHERE calibrates AND decided IS NOT NULL GROUP BY 1),
gains AS (SELECT t, coalesce(lead(t) OVER (ORDER BY t DESC), t) AS below, round(sum(a) OVER (ORDER BY t DESC) / sum(a) OVER () - sum(b) OVER (ORDER BY t DESC) / sum(b) OVER (), 9) AS gain FROM cells),
best AS (SELECT coalesce((SELECT (t + below) / 2 FROM gains WHERE isfinite(gain) ORDER BY gain DESC, t DESC LIMIT 1), 0.0) AS t)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM spelt JOIN scores USING (n), best
"""


SQL = _sql()
