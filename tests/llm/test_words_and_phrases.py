"""Spelling variants, byte-level BPE and collocations against brute force and the library."""
import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from llm_fixtures import clashing, make_docs, odd_rows, rows  # noqa: F401

from cinegraph.llm import bpe, collocations, spelling


# ---------------------------------------------------------------- spelling
def slow_words(docs, noise):
    n = Counter()
    for doc, text in docs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
                if h % noise == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                n[run] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(docs, noise=31, ratio=10):
    n = slow_words(docs, noise)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found_variants(docs, **params):
    got = spelling.spelling_variants(docs, **params).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in got)


def edited(rnd, w, letters):
    i = rnd.randrange(len(w) + 1)
    return rnd.choice([w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i + 1:]])


def test_spelling_matches_brute_force(make_docs, odd_rows):
    rnd = random.Random(3)
    letters = "abé"
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 11))) for _ in range(25)]
    docs = list(odd_rows)
    for i in range(60):
        words = [edited(rnd, edited(rnd, w, letters) if rnd.random() < .3 else w, letters) if rnd.random() < .5 else w
                 for w in (rnd.choice(bases[:3] * 8 + bases) for _ in range(60))]
        docs.append((100 + i, rnd.choice([" ", "-", "\n", "×1"]).join(words) + rnd.choice(["", " Straße MÜNCHEN Übergang übergang"])))
    docs += [(300 + i, "chained " * 40 + "chainedd " * (i < 10) * 8 + "chaineddd" * (i < 4)) for i in range(30)]
    want = slow_variants(docs, noise=5)
    assert found_variants(make_docs(docs), noise=5) == want
    assert sum(w[1] is not None for w in want) > 3 and any(w[1] not in (None, w[2]) for w in want)


def test_spelling_same_letters_long_runs_and_ties(make_docs):
    long = "ab" * 3000
    texts = ["a" * 7, "a" * 8, "a" * 9, long, long[:-1], long[:2000] + "x" + long[2001:], "abcdefg", "bbcdefg", "cbcdefg"]
    docs = [(i, t) for i, t in enumerate(texts * 2)]
    # noise that never strikes: the words are the texts
    got = {w: (f, n, k) for w, f, _, n, k, _ in found_variants(make_docs(docs), noise=1 << 40)}
    assert {w[:12]: k for w, (_, _, k) in got.items() if w[0] == "a" and w != long and len(w) < 20} == {
        "a" * 7: 1, "a" * 8: 2, "a" * 9: 1, "abcdefg": 2}
    assert got[long][2] == 2 and got[long[:-1]][2] == 1


def test_spelling_empty_and_clashing(make_docs, clashing):
    assert found_variants(make_docs([])) == []
    assert found_variants(clashing) == []
    assert found_variants(make_docs([(1, None), (2, ""), (3, "short words only")])) == []


@pytest.mark.parametrize("word, at, label, reads, goals", [
    ("xabc.", 1, "abc", True, []), ("xabcd.", 1, "abx", False, ["xabxd."]), ("xabcd.", 1, "acd", False, ["xaccd.", "xacd."][1:]),
    ("xbc.", 1, "abc", False, []), ("x.", 1, "a", False, []), ("xa.", 1, ".", False, ["x."]), ("xaab.", 1, "aa", True, [])])
def test_advance(word, at, label, reads, goals):
    assert spelling.advance(word, at, label) == (reads, goals)


# ---------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken
    ranks = bpe.read_ranks(P.path(bpe.RANKS))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library_on_any_bytes(library):
    ranks, enc = library
    rnd, tokens = random.Random(5), list(ranks)
    for made in (bpe.Transducer(ranks), bpe.Transducer(ranks, max_transitions=50)):
        for _ in range(1500):
            piece = rnd.choice([
                lambda: bytes(rnd.choice(b"abcdethin ") for _ in range(rnd.randint(1, 30))),
                lambda: b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6))),
                lambda: bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 20))),
                lambda: rnd.choice([b"a", b"ab", b" ", "中文".encode(), b"-="]) * rnd.randint(1, 80)])()
            assert made.encode(piece) == enc._encode_single_piece(piece)


def test_transducer_holds_back_a_bounded_number_of_tokens(library):
    made = bpe.Transducer(library[0])
    made.encode(b"thisandthatinternationalization" * 400)
    longest = max(map(len, library[0]))
    assert max(len(tokens) for _, hyps in made._states for tokens, _ in hyps) <= longest


def test_states_hold_no_tokens_but_the_one_before(library):
    ranks, enc = library
    made, rnd, tokens = bpe.Transducer(ranks), random.Random(8), list(ranks)
    for _ in range(300):
        piece = b"".join(rnd.choice(tokens) for _ in range(6))
        assert made.encode(piece) == enc._encode_single_piece(piece)
    assert max(len(tokens) for _, hyps in made._states for tokens, _ in hyps) == 1


def test_bpe_round_trip_equals_library(make_docs, odd_rows, library):
    texts = odd_rows + [(20, "Zażółć 中文字 👩‍👩‍👧 <|endoftext|> it's 12345 \t\n\n  x"), (20, "again"), (21, "a" * 20000), (22, " " * 5000)]
    got = bpe.decode(bpe.encode(make_docs(texts))).collect()
    want = [(i, library[1].encode_ordinary(t or ""), t or "") for i, t in texts]
    assert sorted(map(repr, ((r.id, list(r.ids), r.text) for r in got))) == sorted(map(repr, want))
    assert bpe.decode(bpe.encode(make_docs([]))).count() == 0
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(repr, map(tuple, bpe.round_trip(make_docs(texts)).collect()))) == sorted(
        repr((i, len(ids), digest(",".join(map(str, ids))), digest(t))) for i, ids, t in want)


def test_bpe_ignores_clashing_columns(clashing):
    assert rows(bpe.decode(bpe.encode(clashing)), "id", "text") == [(1, "a b c d"), (2, "A B C D"), (3, "")]


def test_decoder_replaces_what_is_no_utf8(library):
    ranks, _ = library
    decoder = bpe.StreamDecoder({r: t for t, r in ranks.items()})
    rnd = random.Random(2)
    for _ in range(3000):
        data = bytes(rnd.choice([rnd.randrange(256), 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0xED, 0xA0, 0xF4, 0x90]) for _ in range(rnd.randint(0, 9)))
        assert decoder.decode([ranks[data[i:i + 1]] for i in range(len(data))]) == data.decode("utf-8", "replace")


# ---------------------------------------------------------------- collocations
def slow_collocations(docs, min_count, max_words, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = tuple(w for w in piece.replace("\t", " ").split(" ") if w)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, words[i:i + size]] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    drop = {(lang, p[i:j]) for (lang, p), a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and a >= cand[lang, p[i:j]]}
    out = []
    for lang in n:
        found = []
        for (x, p), a in cand.items():
            if x == lang and (x, p) not in drop:
                score, k = min((int(Fraction(1000 * a * n[lang], f[x, p[:k]] * f[x, p[k:]])), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[x, p[:k]], f[x, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_match_brute_force(spark, odd_rows):
    rnd = random.Random(9)
    vocab = ["a", "b", "c", "d", "New", "york", "é", "\x1cq"]
    docs = [(rnd.choice(["en", "de", None]), " ".join(
        rnd.choice(vocab + ["new york city hall is", "a b", "x,", "y\ty"]) for _ in range(rnd.randint(0, 60)))) for _ in range(60)]
    docs += [("en", t) for _, t in odd_rows if t is None or len(t) < 100]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    for size, top in ((5, 7), (3, 2000), (2, 3)):
        got = sorted(tuple(r) for r in collocations.collocations(df, min_count=6, max_words=size, top=top).collect())
        assert got == slow_collocations(docs, 6, size, top) and got


def test_phrases_of_two_words_are_counted_by_hash_first(spark, monkeypatch):
    docs = [("en", "red car. red car, a b"), ("de", "red car"), ("en", "red car"), ("en", "one red car"), ("en", None)]
    df = spark.createDataFrame(docs, "lang string, text string")
    hashes = collocations.pair_hashes(df, collocations.word_counts(df).where("a >= 3"))
    assert sorted(r.a for r in hashes.collect()) == [4]
    assert hashes.schema.simpleString() == "struct<h:bigint,a:bigint>"
    # phrases are told apart whatever hashes come along
    every = collocations.pair_hashes(df, collocations.word_counts(df))
    monkeypatch.setattr(collocations, "HELD_HASHES", 2)
    assert sorted(every.collect()) == sorted(collocations.pair_hashes(df, collocations.word_counts(df)).collect())
    counts = sorted(tuple(r) for r in collocations.longer_counts(df, every, 3).where("a >= 2 or lang = 'de'").collect())
    assert counts == [("de", "red car", 1), ("en", "red car", 4)]
    want = slow_collocations(docs, 2, 3, None)
    assert sorted(tuple(r) for r in collocations.collocations(df, min_count=2, max_words=3, top=None).collect()) == want and want


def test_collocations_empty_and_clashing(spark):
    kind = "lang string, text string, phrase string, a long, n long, k long"
    assert collocations.collocations(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([("en", "red car. red car", "p", 1, 2, 3)] * 3, kind)
    assert [tuple(r) for r in collocations.collocations(df, min_count=2).collect()] == [("en", 1, "red car", 6, 6, 6, 12, 2000)]
