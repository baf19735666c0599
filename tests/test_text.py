"""Scalar rules: coerced parses, strip, cast list, make_doc, URLs (FIXTURES M7-M12, M21-M24)."""

from pyspark.sql import functions as F

from cinegraph.functions import text as T


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def col_values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_m7_coerced_integer_parse(spark):
    df = one_col(spark, ["862", "862.7", "x", "nan", " 5 ", "1d", "-3.9", "1e3", None])
    assert col_values(df, T.to_int_truncated("v")) == [862, 862, None, None, 5, None, -3, 1000, None]


def test_m8_iso_year_only(spark):
    df = one_col(spark, ["1995-10-30", "1995", "30/10/1995", "1995-10-30 01:02:03", None, "1995-13-01"])
    assert col_values(df, T.year_of_iso_date("v")) == [1995, None, None, None, None, None]


def test_m9_trim_cast(spark):
    df = one_col(spark, [" A, B ,C,D,E,F", None, "   ", "solo"])
    assert col_values(df, T.trim_cast("v")) == ["A, B, C, D, E", "", "", "solo"]


def test_strip_is_python_strip(spark):
    df = one_col(spark, ["\t a b \n", " x ", "  "])
    assert col_values(df, T.strip("v")) == ["a b", "x", ""]


def test_na_tokens_become_null(spark):
    df = one_col(spark, ["null", "NA", "ok", "", "None", "nan"])
    assert col_values(df, T.na_decode("v")) == [None, None, "ok", None, None, None]


def test_m11_m12_make_doc(spark):
    df = spark.createDataFrame(
        [(0, "A heist.", None, "Action|Crime", "X", "Heat", 1995),
         (1, "A heist.", None, "Action|Crime", "X", "Heat", None)],
        "i int, overview string, tagline string, genres string, director string, title string, year int")
    doc = T.make_doc(F.col("overview"), F.col("tagline"), F.col("genres"), F.col("director"), F.col("title"), F.col("year"))
    lit = T.make_doc(F.col("overview"), F.col("tagline"), F.col("genres"), F.col("director"), F.col("title"),
                     F.col("year"), missing="literal")
    got = col_values(df, doc)
    assert got[0] == "A heist. | Genres: Action, Crime | Director: X | Heat (1995)"
    assert got[1].endswith("Heat ()")
    assert col_values(df, lit)[0] == "A heist. | Tagline: nan | Genres: Action, Crime | Director: X | Heat (1995)"


def test_make_doc_whole_overview_and_optional_cut(spark):
    long = "é" * 60000
    df = spark.createDataFrame([(0, long, "t")], "i int, overview string, title string")
    doc = T.make_doc(F.col("overview"), F.lit(None), F.lit(None), F.lit(None), F.col("title"), F.lit(None))
    assert col_values(df, doc)[0] == long + " | t ()"
    cut = T.make_doc(F.col("overview"), F.lit(None), F.lit(None), F.lit(None), F.col("title"), F.lit(None),
                     overview_chars=T.SOURCE_OVERVIEW_CHARS)
    assert col_values(df, cut)[0] == "é" * 500 + " | t ()"


def test_m21_provider_normalisation(spark):
    df = one_col(spark, ["PRIME_VIDEO ", "prime video", None])
    assert col_values(df, T.norm_provider("v")) == ["prime video", "prime video", ""]


def test_m23_percent_encoding(spark):
    df = one_col(spark, ["Amélie & Co/ *~+ (2001) it's"])
    assert col_values(df, T.percent_encode("v")) == [
        "Am%C3%A9lie%20%26%20Co/%20%2A~%2B%20%282001%29%20it%27s"]


def test_m24_poster_url(spark):
    df = one_col(spark, [None, "", "nan", "None", "/a.jpg"])
    got = col_values(df, T.poster_url("v"))
    assert got[:4] == [T.POSTER_PLACEHOLDER] * 4
    assert got[4] == T.POSTER_BASE + "/a.jpg"


def test_display_genres_and_labels(spark):
    df = one_col(spark, ["Action| Crime||Drama|War", "prime_video"])
    assert col_values(df, T.display_genres("v", 3))[0] == ["Action", "Crime", "Drama"]
    assert col_values(df, T.provider_label("v"))[1] == "Prime Video"
