"""Token counts, packing and decontamination against the libraries and brute force."""
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import clashing, make_docs, odd_rows, rows  # noqa: F401
from tokenizers import Tokenizer

from cinegraph.llm import decontaminate, packing, token_counts
from cinegraph.llm.token_counts import Transducer

ALPHABET = [*" \t\n\r\x0b\x1c\x85\xa0​aé1'!.,ßΣ|", "<|endoftext|>", " 's", "'ll", "  ", " The"]


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_transducer_counts_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine, library = Transducer(str(path)), Tokenizer.from_file(str(path))
    for text in fuzz(3000):
        want = len(library.encode(text, add_special_tokens=False).ids)
        for size in (1, 5, 1000):
            assert machine.count(text, size) == want, (text, size)


def test_words_are_counted_by_the_compiled_merges_alone(monkeypatch):
    """Every kind of word, without the library; its counts are only compared."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    machine = token_counts.compiled_words(path).args[0]
    monkeypatch.setattr(token_counts, "load_tokenizer", None)
    vocabulary = [library.decode([i]) for i in range(0, 50256, 23)]
    rnd = random.Random(12)
    words = ["".join(rnd.choice(vocabulary).strip() for _ in range(rnd.randint(1, 4))) for _ in range(2000)]
    words += [" " + "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    words += ["a" * n for n in range(1, 60)] + ["=" * n for n in range(1, 300, 7)] + ["ß" * 9, "日本語" * 5, "é" * 33]
    count = token_counts.compiled_words(path)
    for word in words:
        if not any(unicodedata.category(c) == "Cn" for c in word):
            assert count(word) == len(library.encode(word, add_special_tokens=False).ids), word
    assert machine.count(b"") == 0


def test_few_transitions_give_the_same_counts():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    count = token_counts.compiled_words(path)
    machine, words = count.args[0], ["understanding", "misunderstandings", " unbelievable", "zzzzzzzzzzzz", "thequickbrownfox"]
    want = list(map(count, words))
    machine.max_transitions = 5
    machine._reset()
    assert list(map(count, words)) == want and machine.steps <= 5


def test_texts_are_cut_like_the_library_at_every_character():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library, machine = Tokenizer.from_file(path), Transducer(path)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x3000, 0x110000, 997))
    for c in (chr(c) for c in points if not 0xD800 <= c < 0xE000):
        text = f"a{c}1{c}! {c}  {c}{c}.a {c}"
        assert machine.count(text, 1000) == len(library.encode(text, add_special_tokens=False).ids), hex(ord(c))


def test_merges_that_do_not_build_their_token_are_refused():
    # "abc" is listed as ab + c, but b + c comes first
    machine = token_counts.Merges([(b"b", b"c"), (b"a", b"b"), (b"ab", b"c")])
    with pytest.raises(ValueError):
        machine.count(b"abc")
    assert token_counts.Merges([(b"a", b"b"), (b"ab", b"c")]).count(b"abcab") == 2


def test_state_maps_compose_associatively():
    machine = Transducer(str(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(4)
    for text in fuzz(300, 9):
        i, j = sorted(rnd.randint(0, len(text)) for _ in range(2))
        a, b, c = map(machine.state_map, (text[:i], text[i:j], text[j:]))
        left, right = machine.compose(machine.compose(a, b), c), machine.compose(a, machine.compose(b, c))
        total = [machine.run(m.head) + m.count + machine.run(m.tail) for m in (left, right)]
        assert total[0] == total[1] == machine.count(text)


def test_sentencepiece_counts(make_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["Some words  here.\nAnd é", "", "x" * 50]
    got = token_counts.token_counts(make_docs(list(enumerate(texts))), "piece_bpe_32k.model", chunk_chars=4)
    assert rows(got, "id", "n_tokens") == [(i, len(model.encode(t))) for i, t in enumerate(texts)]


def test_token_counts_edges(make_docs, odd_rows):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = token_counts.token_counts(make_docs(odd_rows), chunk_chars=500).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows]
    assert sorted(map(str, ((r.id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(make_docs([])).count() == 0


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit_decreasing([6, 5, 4, 3], 10) == [(0, 0), (1, 0), (0, 6), (1, 5)]
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 64) for _ in range(500)]
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [w for w in range(len(room)) if room[w] >= lengths[i]]
        if not fits:
            room.append(64)
            fits = [len(room) - 1]
        want[i] = min(room[w] for w in fits)
        at = min(fits, key=lambda w: room[w])
        room[at] -= lengths[i]
    places = packing.best_fit_decreasing(lengths, 64)
    assert [64 - o for _, o in places] == [want[i] for i in range(len(lengths))]
    assert max(w for w, _ in places) + 1 == len(room)


def check_packing(got, texts, window):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.id].append(r)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        mine, at = sorted(pieces[i], key=lambda r: r.start), 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids)
            assert bytes(r.ids) == np.array(ids[at:at + r.length], "<u4").tobytes()
            assert packing.crc32_of(ids[at:at + r.length]) == zlib.crc32(bytes(r.ids))
            at += r.length
        assert at == len(ids)


def test_packing_round_trip(make_docs, odd_rows):
    texts = [(i, t) for i, t in dict(odd_rows).items()] + [(100 + i, t) for i, t in enumerate(fuzz(200, 5))]
    docs = make_docs(texts)
    for groups in (50, 20_000):
        check_packing(packing.pack_documents(docs, window=256, group_pieces=groups).collect(), texts, 256)
    assert packing.pack_documents(make_docs([])).count() == 0
    twice = packing.packing_digest(make_docs([(7, "a b"), (7, "a b")])).collect()
    assert sorted(r.offset for r in twice) == [0, 3]


def slow_tiles(doc, item, least):
    """Greedy tiling by trying everything: the coverage of the item."""
    used_d, used_t = [False] * len(doc), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not used_d[a + n] and not used_t[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return sum(used_t)
        for k in range(n):
            used_d[a + k] = used_t[b + k] = True


def test_tiles_match_brute_force():
    rnd = random.Random(8)
    for _ in range(150):
        item = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 14))]
        doc = item[7:] + [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 12))] + item[:7]
        to = lambda seq: np.array([ord(c) for c in seq], np.uint64)
        got = decontaminate.tiles(to(doc), to(item), 3)
        assert sum(n for *_, n in got) == slow_tiles(doc, item, 3)
        for a, b, n in got:
            assert doc[a:a + n] == item[b:b + n]


def test_decontamination(spark, make_docs, odd_rows, clashing):
    rnd = random.Random(6)
    item = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(40))
    w = item.split()
    turned = " ".join(w[20:]) + " something else " + " ".join(w[:20])
    part = " ".join(w[:12])
    bench = spark.createDataFrame([(1, item, 0), (2, "too short", 0), (3, None, 0), (4, item, 0)], "item_id long, text string, id long")
    docs = make_docs(odd_rows + [(50, "Before, " + item.upper() + "! After"), (51, turned), (52, part), (53, "x " * 30000 + item)])
    got = {r.id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert sorted(got) == [50, 51, 53]
    assert got[50].item == 1 and got[50].n_items == 2 and got[50].coverage == 1.0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(make_docs([]), bench).count() == 0
    assert decontaminate.drop_contaminated(clashing, bench).columns == clashing.columns
