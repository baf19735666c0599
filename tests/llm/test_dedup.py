"""Exact dedup, SimHash, line dedup and components against brute force."""
import hashlib
import random
import re

import xxhash
from llm_fixtures import clashing, make_docs, odd_rows, rows  # noqa: F401
from pyspark.sql import functions as F

from cinegraph.llm import decontaminate, exact_dedup, line_dedup, simhash
from cinegraph.llm.common import text_key
from cinegraph.llm.components import connected_components


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_chain_star_and_empty(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    got = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long"))))
    want = closure({n for p in links for n in p}, links)
    assert got == {n: r for n, r in want.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup_matches_brute_force(make_docs, odd_rows):
    docs = make_docs(odd_rows + [(20 + i, "hot copy") for i in range(50)])
    for counters in (1, 1024):
        got = rows(exact_dedup.exact_dedup(docs, heavy_counters=counters), "id", "keep_id", "group_size", "kept")
        groups = {}
        for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
            groups.setdefault(hashlib.sha256((t or "").encode().lower()).digest(), []).append(i)
        want = []
        for ids in groups.values():
            keep = max((i for i in ids if i is not None), default=None)
            want += [(i, keep, len(ids), i == keep) for i in ids]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_misra_gries_keeps_every_heavy_key(spark):
    keys = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 5 == 0, 2).otherwise(F.col("id") + 10).alias("k"))
    assert {1, 2} <= {r.k for r in exact_dedup.misra_gries(keys.repartition(7), "k", 8).collect()}


def test_exact_dedup_empty_and_clashing(make_docs, clashing):
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0
    assert rows(exact_dedup.exact_dedup(clashing), "id", "keep_id", "kept") == [(1, 2, False), (2, 2, True), (3, 3, True)]


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_matches_brute_force(make_docs, odd_rows):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefgh") * 3 for _ in range(120)]
    texts = []
    for i in range(160):
        w = list(base)
        for _ in range(i % 3):
            w[rnd.randrange(len(w))] = rnd.choice("xyz")
        texts.append((100 + i, " ".join(w)))
    docs = make_docs(odd_rows + texts)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    fps = {t: slow_fingerprint(t) for _, t in data}
    distinct = sorted(set(fps.values()))
    linked = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    assert linked
    root = closure(distinct, linked)
    low = {}
    for i, t in data:
        if i is not None:
            low[root[fps[t]]] = min(i, low.get(root[fps[t]], i))
    want = sorted(str((i, fps[t], low.get(root[fps[t]]))) for i, t in data)
    for limit in (2, 64):  # a limit of 2 sends every larger bucket over midpoints
        got = simhash.simhash_groups(docs, bucket_limit=limit).collect()
        assert sorted(str((r.id, r.fp % (1 << 64), r.component_id)) for r in got) == want


def test_simhash_stage_keeps_columns(make_docs, clashing):
    assert simhash.simhash_groups(make_docs([])).count() == 0
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert rows(kept, "doc_id") == [(1,), (3,)]


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def edited(rnd, text, n):
    s = list(text)
    for _ in range(n):
        k, i = rnd.random(), rnd.randrange(len(s))
        if k < 0.4:
            s[i] = rnd.choice("abcé")
        elif k < 0.7:
            s.insert(i, rnd.choice("abcé"))
        else:
            s.pop(i)
    return "".join(s)


def test_banded_distance_and_segments():
    rnd = random.Random(5)
    for _ in range(3000):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(3, 34)))
        b = edited(rnd, a, rnd.randint(0, 4)) if len(a) > 5 else a
        for limit in (0, 1, 2, 3):
            d = levenshtein(a, b)
            assert line_dedup.edit_distance_within(a, b, limit) == (d if d <= limit else None)
            x, y = sorted((a, b), key=len)
            most = line_dedup.allowed(len(x), limit)
            assert most == min(limit, len(x) // 10)
            if most and d <= most:
                index = {(len(x), i, x[p:q]) for i, (p, q) in enumerate(line_dedup.segment_bounds(len(x), most))}
                probe = {(n, i, y[p:q]) for n, i, p, q in line_dedup.probe_spans(len(y), limit)}
                probe |= {(len(y), i, y[p:q]) for i, (p, q) in enumerate(
                    line_dedup.segment_bounds(len(y), line_dedup.allowed(len(y), limit)))}
                assert index & probe
                assert (line_dedup.signature(a) ^ line_dedup.signature(b)).bit_count() <= 2 * limit


def test_line_classes_match_brute_force(spark, make_docs, odd_rows):
    rnd = random.Random(11)
    lines = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 40))) for _ in range(90)]
    lines += ["are is anwh reenen.", "are, is anwh reenen."]
    docs_rows = [r for r in odd_rows if r[0] not in (4, None)]
    for i in range(40):
        picked = [edited(rnd, line, rnd.randint(0, 2)) if len(line) > 2 else line for line in rnd.choices(lines, k=8)]
        # every third document repeats an id with another text
        docs_rows.append((100 + i // 3 * 3 if i % 3 else 100 + i, "\n".join([*picked, "", "short", rnd.choice(lines)])))
    docs = make_docs(docs_rows)
    first, occurrences = {}, []
    for i, key, t in docs.select("doc_id", text_key(F.col("text")), "text").collect():
        for n, line in enumerate((t or "").split("\n")):
            body = line.strip().lower()
            if body:
                occurrences.append((i, key, n, body))
                first[body] = min(first.get(body, (i, key, n)), (i, key, n))
    linked = [(a, b) for a in first for b in first if a < b and abs(len(a) - len(b)) <= 2
              and levenshtein(a, b) <= min(2, min(len(a), len(b)) // 10)]
    assert any(len(a) < 20 for a, _ in linked) and any(len(a) > 22 for a, _ in linked)
    root, degree, head = closure(first, linked), {}, {}
    for a, b in linked:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    for b, r in root.items():
        head[r] = min(head.get(r, first[b]), first[b])
    want = []
    for i, key, n, b in sorted(occurrences):
        h = head[root[b]]
        # the same row again shares its lines' fate, a line again in one document doesn't
        want.append((i, key, n, *h, degree.get(b, 0), (i, key, n) == h))
    got = line_dedup.line_classes(docs).select(
        "id", "text_key", "line_no", "class_id", "class_key", "class_line", "n_links", "kept")
    assert rows(got) == rows(spark.createDataFrame(want, got.schema))


def test_rows_that_share_an_id_are_judged_by_their_text(make_docs):
    """A unique text stays, whatever becomes of another row of its id."""
    a, b = "the first text of them all, twice", "a second text, which occurs only once"
    docs = make_docs([(1, a), (5, a), (5, b)])
    want = [(1, a), (5, b)]
    assert rows(line_dedup.drop_repeated_lines(docs), "doc_id", "text") == want
    assert rows(simhash.drop_near_duplicates(docs), "doc_id", "text") == want
    bench = docs.sparkSession.createDataFrame([(9, a)], "item_id long, text string")
    assert rows(decontaminate.drop_contaminated(docs, bench), "doc_id", "text") == [(5, b)]


def slow_tiles(doc, item, least):
    """Greedy string tiling, word by word."""
    dm, im, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not dm[i + n] and not im[j + n]:
                    n += 1
                best.append((-n, i, j))
        n, i, j = min(best, default=(0, 0, 0))
        if -n < least:
            return covered
        for k in range(-n):
            dm[i + k] = im[j + k] = True
        covered -= n


def test_decontamination_matches_brute_force(spark, make_docs):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 14)))) for i in range(12)]
    items += [(20, "four words only here"), (21, None), (22, "?!"), (23, "one"), (24, items[3][1])]
    docs = [(1, None), (2, ""), (3, "Four words, only here!"), (4, "so four words only here are inside"), (5, "x\nfour words only here\ny"),
            (6, "one"), (6, "two"), (7, "- - - - - - one -"), (8, "this one is clean")]
    for i in range(60):
        cut = [w for _, t in rnd.sample(items, 2) if t for w in [t.split()] for w in (w[len(w) // 2:], w[:len(w) // 2])]
        docs.append((100 + i, " ".join(w for part in cut for w in part) + " " + " ".join(word() for _ in range(4))))
    want = []
    for doc, text in docs:
        found = []
        d = re.findall(r"\w+", (text or "").lower())
        for item, t in items:
            w = re.findall(r"\w+", (t or "").lower())
            if len(w) >= 5:
                share = slow_tiles(d, w, 5) / len(w)
            else:
                share = float(bool(w) and (w == d or any(w == re.findall(r"\w+", x.lower()) for x in (text or "").split("\n"))))
            if share >= 0.5:
                found.append((-share, item))
        if found:
            want.append((doc, min(found)[1], round(-min(found)[0], 9), len(found)))
    got = decontaminate.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got.select("id", "item", F.round("coverage", 9), "n_items")) == sorted(want)
    assert {3, 5, 6, 7} <= {w[0] for w in want} and not {4, 8} & {w[0] for w in want}


def test_line_stage_keeps_columns_and_drops_emptied(make_docs, clashing):
    text = "A line that is repeated in two documents."
    docs = make_docs([(1, text + "\nown line"), (2, text), (3, "other\n" + text), (4, None), (5, "")])
    out = line_dedup.drop_repeated_lines(docs, length_col="n_chars")
    assert out.columns == docs.columns
    assert rows(out, "doc_id", "text", "n_chars") == [
        (1, text + "\nown line", len(text) + 9), (3, "other", 5), (4, None, None), (5, "", 0)]
    assert line_dedup.line_classes(make_docs([])).count() == 0
    assert line_dedup.drop_repeated_lines(clashing).columns == clashing.columns
