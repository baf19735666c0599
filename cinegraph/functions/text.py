"""Native Column expressions for the text rules of the source application.

Everything here compiles to Catalyst expressions (whole-stage codegen); no Python
runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the source application's behaviour) -----------------
# Tokens that the pandas CSV reader decodes to null by default (its documented
# ``na_values`` list, plus the empty string).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Poster image prefix and placeholder; provider display labels and search URLs.
POSTER_BASE = "https://image.tmdb.org/t/p/w342"
POSTER_PLACEHOLDER = "https://via.placeholder.com/185x278/1a1a2e/e0e0e0?text=No+Poster"
PROVIDER_LINKS = [
    ("netflix", "Netflix", "https://www.netflix.com/search?q="),
    ("hulu", "Hulu", "https://www.hulu.com/search?q="),
    ("prime video", "Prime Video", "https://www.primevideo.com/search/ref=atv_nb_sr?phrase="),
    ("disney+", "Disney+", "https://www.disneyplus.com/search?q="),
]
# Provider columns of the wide availability table, in melt order.
PROVIDER_COLUMNS = ["Netflix", "Hulu", "Prime Video", "Disney+"]
NO_GENRE_MARKER = "(no genres listed)"
# ------------------------------------------------------------------------------------

# Python's str.strip() whitespace set, written so that both Java regex and RE2 accept it.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = rf"^{WS_CLASS}+|{WS_CLASS}+$"
# Numeric shape accepted by a coercing numeric parse (anything else becomes null).
NUMERIC_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
YEAR_SUFFIX_PATTERN = r"\s*\(\d{4}\)\s*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` removes spaces only."""
    return F.regexp_replace(_c(col), STRIP_PATTERN, "")


def na_decode(col) -> Column:
    """CSV null decoding: any NA token becomes null (text columns included)."""
    c = _c(col)
    return F.when(~c.isin(NA_TOKENS), c)


def to_number(col) -> Column:
    """Coercing numeric parse: text of numeric shape -> double, else null (never NaN)."""
    s = strip(_c(col).cast("string"))
    return F.when(s.rlike(NUMERIC_PATTERN), s.cast("double"))


def to_int_truncated(col) -> Column:
    """Coercing parse then truncation toward zero, as ``astype(int)``."""
    return to_number(col).try_cast("bigint")


def year_of_iso_date(col) -> Column:
    """Year of an ISO ``yyyy-MM-dd`` text; other shapes give null."""
    return F.year(F.try_to_date(_c(col), "yyyy-MM-dd"))


def trim_cast(col) -> Column:
    """null/blank -> ''; else the first five comma-separated names, stripped, joined ', '."""
    c = _c(col)
    names = F.transform(F.split(c, ",", -1), lambda x: strip(x))
    return (
        F.when(c.isNull() | (strip(c) == ""), F.lit(""))
        .otherwise(F.array_join(F.slice(names, 1, 5), ", "))
    )


def title_key(col) -> Column:
    """Availability title key: text of the title (null -> 'nan'), stripped, lower-cased."""
    return F.lower(strip(F.coalesce(_c(col), F.lit("nan"))))


def movie_title_key(col) -> Column:
    """Movie title key: strip, drop a trailing ' (YYYY)', strip again, lower-case."""
    t = strip(F.coalesce(_c(col), F.lit("nan")))
    return F.lower(strip(F.regexp_replace(t, YEAR_SUFFIX_PATTERN, "")))


def norm_provider(col) -> Column:
    """Provider key used for filtering: null -> '', strip, lower, '_' -> ' '."""
    return F.replace(F.lower(strip(F.coalesce(_c(col), F.lit("")))), F.lit("_"), F.lit(" "))


def provider_label(col) -> Column:
    """Display label: '_' -> ' ', title case."""
    return F.initcap(F.replace(_c(col), F.lit("_"), F.lit(" ")))


def poster_url(col) -> Column:
    c = _c(col)
    bad = c.isNull() | c.isin("nan", "None", "")
    return F.when(bad, F.lit(POSTER_PLACEHOLDER)).otherwise(F.concat(F.lit(POSTER_BASE), c))


def display_genres(col, n: int | None = 3) -> Column:
    """'|' -> ',', split, strip, drop blanks, keep the first ``n`` (all when None)."""
    parts = F.split(F.replace(F.coalesce(_c(col), F.lit("")), F.lit("|"), F.lit(",")), ",", -1)
    kept = F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")
    return F.slice(kept, 1, n) if n else kept


def percent_encode(col) -> Column:
    """URL path quoting of text (RFC 3986 unreserved + '/' kept), from form encoding."""
    enc = F.url_encode(_c(col))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def genres_for_doc(col) -> Column:
    return F.replace(_c(col), F.lit("|"), F.lit(", "))


# Fixed value of the source application: it cut the overview to 500 characters to fit its
# transformer's input window. Our encoders take whole texts, so the cut is opt-in.
SOURCE_OVERVIEW_CHARS = 500


def make_doc(overview, tagline, genres, director, title, year, missing: str = "omit",
             overview_chars: int | None = None) -> Column:
    """Embedding document: overview | Tagline | Genres | Director | title (year).

    The whole overview is used unless ``overview_chars`` is given (the source used
    ``SOURCE_OVERVIEW_CHARS``). Empty parts are skipped. ``missing='literal'`` renders a
    null tagline / genres / director as the text ``nan`` the way the source's truthiness
    test does.
    """
    ov = F.coalesce(_c(overview), F.lit(""))
    if overview_chars is not None:
        ov = F.substring(ov, 1, overview_chars)

    def part(label: str, c: Column) -> Column:
        if missing == "literal":
            c = F.coalesce(c, F.lit("nan"))
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))

    yr = F.coalesce(_c(year).cast("string"), F.lit(""))
    ttl = F.concat(F.coalesce(_c(title), F.lit("nan")), F.lit(" ("), yr, F.lit(")"))
    return F.concat_ws(
        " | ",
        F.when(ov != "", ov),
        part("Tagline: ", _c(tagline)),
        part("Genres: ", genres_for_doc(genres)),
        part("Director: ", _c(director)),
        ttl,
    )
