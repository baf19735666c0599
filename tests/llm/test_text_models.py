"""Toxicity, quality, URL filter and licence scan: held-out accuracy, edge cases and SQL."""
import os
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from llm_fixtures import clashing, make_docs, odd_rows, rows  # noqa: F401
from pyspark.sql import functions as F

from cinegraph.llm import license_scan, quality, registry, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y]
    neg = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.where(toxicity.in_held_out()).select("doc_id", "toxic"), "doc_id")
    got = toxicity.score(held, model).join(labels.withColumnRenamed("doc_id", "id"), "id").select("score", "toxic").collect()
    assert auc([r.score for r in got], [r.toxic for r in got]) > 0.8
    clean = [r.score >= 0.5 for r in got if not r.toxic]
    assert sum(clean) / len(clean) < 0.02


def test_held_out_fold_is_crc32_of_the_id(spark):
    got = spark.range(50).withColumn("h", toxicity.in_held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_toxicity_edges(spark, make_docs, odd_rows, clashing):
    insults = ["worthless", "pathetic", "disgusting"]
    train = [(f"the plain words of text {i} go on {i} {insults[i % 3]} {i * 7}", 1) for i in range(600)]
    train += [(f"the plain words of text {i} go on here and on {i * 7}", 0) for i in range(600)]
    model = toxicity.fit_texts(train)
    docs = make_docs(odd_rows)
    got = toxicity.score(docs, model)
    assert got.count() == len(odd_rows)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(make_docs([]), model).count() == 0
    assert toxicity.drop_toxic(clashing, model, 0.9).columns == clashing.columns
    assert toxicity.fit_texts([("a", 1)]).values == (0.0,)
    toxic, plain = (toxicity.probability(model, toxicity.Distance(model).text(t)) for t in ("so pathetic a text", "so plain a text"))
    assert toxic > plain


def test_models_are_fitted_on_whole_texts(spark, make_docs):
    rnd = random.Random(3)
    common = [a + b for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "sil", "tov", "pex", "nam", "gur")]
    plain = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    # what makes the texts toxic, or junk, stands behind 9,000 characters
    texts = [(i, f"{plain(1600)} {rnd.choice(['worthless', 'pathetic'])} {plain(60)} {'%%0 ' * 300}" if i % 2 else plain(1900), i % 2) for i in range(800)]
    assert all(len(t) > 9000 for _, t, _ in texts)
    docs = make_docs([(i, t) for i, t, _ in texts] + [(None, "x")])
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in texts], "doc_id long, quality int, toxic int")
    used = [(t, y) for i, t, y in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    model = toxicity.fit(docs, labels)
    assert b" worthless" in model.toxic and b" pathetic" in model.toxic and model == toxicity.fit_texts(used)
    score = {y: toxicity.probability(model, toxicity.Distance(model).text(t)) for t, y in (("you are worthless", 1), (plain(9), 0))}
    assert score[0] < 0.3 < score[1]
    graded = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("grade")), 2)
    whole = quality.fit_texts([(t, 1 - y) for _, t, y in texts], 2)
    assert np.allclose(graded.weights, whole.weights, atol=1e-3) and np.allclose(graded.thresholds, whole.thresholds, atol=1e-3)
    assert quality.tails(graded, texts[0][1])[0] > 0.9 > 0.1 > quality.tails(graded, texts[1][1])[0]
    assert toxicity.fit(docs, labels.where("toxic = 0")) == toxicity.EMPTY and toxicity.fit(make_docs([]), labels) == toxicity.EMPTY


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = quality.graded_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = quality.fit(docs, labels.where(~toxicity.in_held_out()), 3)
    assert (np.diff(model.thresholds) > 0).all()
    held = docs.join(labels.where(toxicity.in_held_out()), "doc_id")
    got = quality.grade_documents(held, model).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    assert auc([r.expected_grade for r in got], [r.grade > 0 for r in got]) > 0.95
    good = [r.kept for r in got if r.grade == 2]
    assert sum(good) / len(good) > 0.95


def test_quality_gradient_against_differences():
    rows_ = [("good plain words here", 2), ("!!! !!! !!!", 0), ("some words !!!", 1), ("plain good words", 2), ("### !!!", 0), ("words here ###", 1)] * 5
    model = quality.fit_texts(rows_, 3)
    p = [quality.tails(model, t) for t in ("good plain words here", "some words !!!", "!!! !!! !!!")]
    assert p[0][1] > 0.5 > p[2][0] and p[1][0] > 0.5 > p[1][1]


def test_quality_edges(make_docs, odd_rows):
    model = quality.fit_texts([("a b", 1)], 3)
    got = quality.grade_documents(make_docs(odd_rows), model)
    assert got.count() == len(odd_rows)
    assert len({r.expected_grade for r in got.collect()}) == 1
    assert quality.grade_documents(make_docs([]), model).count() == 0


def test_url_parts_and_rules(spark):
    urls = [("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
            ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
            ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
            ("x://org/fr/a://b", "org", "/fr/a://b", "org/fr/", "allow"),
            ("http://a.net", "a.net", "", None, None), ("http://a.net?x/", "a.net", "", None, None),
            ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
            ("http://É.org/fr/É", "É.org", "/fr/É", "org/fr/", "allow")]
    pages = spark.createDataFrame([(i, u[0], 1, "x") for i, u in enumerate(urls)], "page_id long, url string, id long, gram string")
    got = {r.id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_models_learn_from_the_rules(spark):
    rows_ = [(i, f"http://good{i % 9}.org/fr/story{i}") for i in range(60)] + [(100 + i, f"http://spam{i % 9}.net/win{i}") for i in range(60)]
    rows_ += [(900, "http://good7.example/fr/story3"), (901, "http://spam7.example/win3"), (901, "http://spam7.example/win3")]
    got = url_filter.judge_urls(spark.createDataFrame(rows_, "page_id long, url string")).where("id >= 900").collect()
    assert sorted((r.id, r.verdict) for r in got) == [(900, "allow"), (901, "block"), (901, "block")]


def test_licences(make_docs, odd_rows, clashing):
    s = license_scan.SENTENCES
    mit = f"Some words. {s['mit.grant']}\n{s['mit.include'].upper()} Between. {s['mit.asis']}"
    turned = f"{s['mit.asis']} {s['mit.include']} {s['mit.grant']}"
    docs = make_docs([(1, mit), (2, turned), (3, "x.\nReleased under the  MIT License.\r\nLicensed under CC BY-NC 4.0. y")])
    got = {r.id: r for r in license_scan.scan(docs).collect()}
    assert got[1].rules == ["mit-text"] and got[1].licences == ["MIT"]
    assert got[2].rules == [] and got[2].sequence == ["mit.asis", "mit.include", "mit.grant"]
    assert got[3].licences == ["CC-BY-NC-4.0", "MIT"]
    assert all(r.licences == [] for r in license_scan.scan(make_docs(odd_rows)).collect())
    assert license_scan.scan(make_docs([])).count() == 0
    assert license_scan.scan(clashing, sentences={"one": "a b c d"}, rules=(("r", "L", ("one",)),)).where(F.size("rules") == 1).count() == 2


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", ";; ", "\r"])
def test_every_licence_rule_fires_on_its_wrapped_text(make_docs, prefix):
    def wrapped(text):
        cut = textwrap.wrap(text, 48)
        return "\r\n".join(cut) if prefix == "\r" else "\n".join(prefix + line for line in cut)

    texts = []
    for _, _, order in license_scan.RULES:
        parts = [license_scan.SENTENCES[name] for name in order]
        apart = f"\n{prefix.rstrip()}\n"
        running = " ".join(part if part[-1] in ".;:" else f"{part}:" for part in parts)
        texts += [wrapped(running), apart.join(map(wrapped, ["Some title", *parts, "Some end"]))]
    got = {r.id: r for r in license_scan.scan(make_docs(list(enumerate(texts)))).collect()}
    for i, (rule, licence, order) in enumerate(license_scan.RULES):
        for r in (got[2 * i], got[2 * i + 1]):
            assert r.rules == [rule] and r.licences == [licence] and r.sequence == list(order)


def rules_of(sequence):
    """Brute force: at each sentence the longest rule that starts there, sentence by sentence."""
    at, got = 0, set()
    while at < len(sequence):
        best = None
        for rule, _, order in license_scan.RULES:
            extra = {*license_scan.BETWEEN.get(rule, ()), "rights.reserved"} - set(order) if len(order) > 1 else set()
            i, met = at, 0
            while met < len(order) and i < len(sequence) and (sequence[i] == order[met] or sequence[i] in extra):
                met += sequence[i] == order[met]
                i += 1
            if met == len(order) and (best is None or met > best[0]):
                best = (met, i, rule)
        if best:
            got.add(best[2])
        at = best[1] if best else at + 1
    return sorted(got)


def test_licence_rules_take_the_longest_and_use_up_its_sentences(make_docs):
    rnd = random.Random(3)
    s = license_scan.SENTENCES
    parts = [k for k in s if k.split(".")[0] in ("bsd", "mit", "apache", "gpl", "rights", "isc")]
    orders = [list(order) for _, _, order in license_scan.RULES if len(order) > 1]
    bsd3 = ["rights.reserved", "bsd.grant", "bsd.source", "bsd.binary", "bsd.name", "bsd.asis"]
    given = [bsd3, ["bsd.grant", "mit.grant", "bsd.asis"], ["bsd.grant", "bsd.grant", "bsd.asis"], ["rights.reserved", "mit.notice"]]
    for _ in range(150):
        order = list(rnd.choice(orders))
        for _ in range(rnd.randrange(4)):
            order.insert(rnd.randrange(len(order) + 1), rnd.choice(parts))
        given.append(order + (rnd.choice(orders) if rnd.random() < 0.3 else []))
    docs = make_docs([(i, "\n\nunknown words here\n\n".join(s[k] for k in seq)) for i, seq in enumerate(given)])
    got = {r.id: r for r in license_scan.scan(docs).collect()}
    for i, seq in enumerate(given):
        assert got[i].sequence == seq and got[i].rules == rules_of(seq)
    assert got[0].licences == ["BSD-3-Clause"] and got[1].rules == [] and got[2].rules == ["bsd2-text"]
    assert got[3].licences == ["MIT", "proprietary"]


def test_licence_sentences_end_at_marks_and_blank_lines(make_docs):
    gpl3 = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. */"""
    may = license_scan.SENTENCES["apache.may"]
    docs = make_docs([
        (1, gpl3), (2, gpl3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")),
        (3, "Released under\n\nthe MIT License."), (4, "Released under. the MIT License."), (5, "# Released under\n#\n# the MIT License."),
        (6, "a title\nReleased under the MIT License\nmore words"), (7, "words Released under\nthe MIT License."),
        (8, may.replace(" (", "\n// (")), (9, "Released under:\nthe MIT License.")])
    got = {r.id: r for r in license_scan.scan(docs).collect()}
    assert got[1].rules == ["gpl3-header"] and got[2].rules == ["gpl2-header"]
    assert got[1].sequence == ["gpl.free", "gpl.hope"] and got[6].rules == ["mit-notice"]
    assert [got[i].sequence for i in (3, 4, 5, 7, 9)] == [[]] * 5 and got[8].sequence == ["apache.may"]


def test_rows_of_every_query_carry_ids(spark):
    assert os.path.isdir(SF)
    assert rows(registry.QUERIES["op10_license_scan"](spark, SF).select(F.count("doc_id"))) == [(1000,)]
