"""Phrase collocation mining from count streams in prefix and suffix order.

Counting: words are counted first; then the 64-bit hashes of phrases of two words of which both are
frequent enough; then the phrases themselves, of two words whose hash is frequent enough and of
more all of whose two-word parts are. A phrase can't occur more often than its parts, nor its hash
less often than itself, so none is missed. What is frequent goes to the tasks as a bit set of
bounded size, which lets a few others by; the counts of phrases decide. A task keeps a bounded
block of counts, and sends it on in sorted order.

Scoring: each candidate is cut after each of its words. The stream of cuts in prefix order, by
the part before the cut, is merge-joined with the counts in that order: the left counts. The
stream in suffix order, by the part after the cut, is merge-joined for the right counts. The
same streams give the extensions: a phrase's right extensions are the candidates whose part
before the last word it is, its left extensions those whose part after the first word. (If any
longer candidate that holds a phrase is frequent enough to drop it, so is one that is longer by
one word, for counts never grow with length.) Spark deals the streams out by key and sorts them in
the tasks; every one of these joins is a sort-merge join, no side is held in a hash table.

Arithmetic is in whole numbers of 38 digits.

Defined cases: a null text is empty; a null language counts as ``und``; repeated rows count
again; ties end on the phrase, by bytes; empty texts and tables give no phrases; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import SLICE_ROWS, fixed_bitmap, in_bitmap, keep_only, map_slices, materialise, read_table
from cinegraph.operators.joins import bounded_broadcast, count_upto, top_k

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
NO_LANG = "und"
# Counts that a task holds before it sends them on.
HELD_PHRASES = 300_000
# Hashes that a task holds before it counts them and sends the counts on.
HELD_HASHES = 1 << 21
# Bits of a bit set: 16 for each frequent phrase, at most 2**27 (16 MB).
BITS_PER_PHRASE, MAX_BITS = 16, 27
# Languages whose totals may be broadcast.
MAX_LANGS = 100_000

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text (A-Z lower-cased); pieces without words are left out."""
    found = (text or "").encode("utf-8").lower().translate(_BREAKS).split(b"\n")
    return [words for words in map(bytes.split, found) if words]


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) ^ np.uint64(xxhash.xxh64_intdigest(lang))


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * _BASE + h[1:]) * _BASE


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[str, str | None]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _counted(docs: DataFrame, lang_col: str, text_col: str, phrases: Callable[[list, str], Iterator]) -> DataFrame:
    """(lang, phrase, a): sums of what ``phrases`` finds in each text, counted in bounded blocks."""
    def send(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            names = sorted(counts)
            yield pa.record_batch([pa.array([lang] * len(names), pa.string()), pa.array([p.decode("utf-8") for p in names], pa.string()),
                                   pa.array([counts[p] for p in names], pa.int64())], names=["lang", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        held: dict[str, Counter] = {}
        for rows in _slices(batches):
            for lang, text in rows:
                counts = held.setdefault(lang, Counter())
                for found in phrases(pieces(text), lang):
                    counts.update(found)
            if sum(map(len, held.values())) >= HELD_PHRASES:
                yield from send(held)
                held.clear()
        yield from send(held)

    return _source(docs, lang_col, text_col).mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _bit_set(hashes: DataFrame) -> bytes:
    """Bit set of the hashes (column ``h``) of what is frequent."""
    bits = min(MAX_BITS, max(10, int(hashes.count() * BITS_PER_PHRASE).bit_length()))
    return fixed_bitmap(hashes, "h", bits)


def _word_hashes(words: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_only()
        out = [_hashes([w.encode("utf-8")], lang)[0] for lang, w in
               zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return pa.record_batch([pa.array(np.array(out, np.uint64).view(np.int64))], names=["h"])

    return map_slices(words.select("lang", "phrase"), run, "h long")


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a) of every word."""
    return _counted(docs, lang_col, text_col, lambda parts, lang: iter([chain.from_iterable(parts)]))


def _joined(parts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words of a text, and whether the word after each lies in the same piece."""
    words = list(chain.from_iterable(parts))
    same = np.ones(len(words), bool)
    same[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) - 1] = False
    return words, same


def pair_hashes(docs: DataFrame, words: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(h, a): how often each hash occurs among phrases of two words that are both in ``words``; a few others may be
    among them. Phrases that share a hash are counted as one, so ``a`` is at least each phrase's count."""
    sieve = docs.sparkSession.sparkContext.broadcast(_bit_set(_word_hashes(words)))

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        hot_words, held, n = np.frombuffer(sieve.value, np.uint64), [], 0
        for rows in _slices(batches):
            for lang, text in rows:
                if parts := pieces(text):
                    flat, same = _joined(parts)
                    h = _hashes(flat, lang)
                    hot = in_bitmap(hot_words, h)
                    held.append(_pair_hashes(h)[hot[:-1] & hot[1:] & same[:-1]])
                    n += len(held[-1])
                if n >= HELD_HASHES:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    return _source(docs, lang_col, text_col).mapInArrow(run, "h long, a long").groupBy("h").agg(F.sum("a").alias("a"))


def longer_counts(docs: DataFrame, pairs: DataFrame, max_words: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a) of phrases of two words and more all of whose two-word parts have their hash in ``pairs``
    (column ``h``); a few others may be among them."""
    sieve = docs.sparkSession.sparkContext.broadcast(_bit_set(pairs.select("h")))

    def find(parts: list, lang: str) -> Iterator:
        if parts:
            flat, same = _joined(parts)
            h = _hashes(flat, lang)
            run = hot = in_bitmap(np.frombuffer(sieve.value, np.uint64), _pair_hashes(h)) & same[:-1]
            for n in range(2, max_words + 1):
                if n > 2:
                    run = run[:-1] & hot[n - 2:]
                at = np.flatnonzero(run).tolist()
                if not at:
                    break
                yield [b" ".join(flat[i:i + n]) for i in at]

    return _counted(docs, lang_col, text_col, find)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                  max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a) of all phrases of up to ``max_words`` words with a >= ``min_count``; (lang, n) word totals)."""
    words = materialise(word_counts(docs, lang_col, text_col), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    enough = F.col("a") >= min_count
    frequent = materialise(words.where(enough), "frequent-words")
    pairs = materialise(pair_hashes(docs, frequent, lang_col, text_col).where(enough), "frequent-pairs")
    longer = materialise(longer_counts(docs, pairs, max_words, lang_col, text_col).where(enough), "frequent-phrases")
    counts = frequent.unionByName(longer)
    return counts, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int | None = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, lang_col, text_col, min_count, max_words)
    words = F.split("phrase", " ")
    cuts = counts.where(F.col("phrase").contains(" ")).select(
        "lang", "phrase", "a", F.size(words).alias("size"), words.alias("w")).select(
        "lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    heads = cuts.select("lang", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part"), "phrase", "a", "size", "k")
    tails = cuts.select("lang", F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("part"),
                        "phrase", "a", "size", "k")
    by_part = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("part_a"))
    left = materialise(heads.join(by_part.hint("merge"), ["lang", "part"]).withColumnRenamed("part_a", "l"), "prefix-order")
    right = materialise(tails.join(by_part.hint("merge"), ["lang", "part"]).withColumnRenamed("part_a", "r"), "suffix-order")

    scored = left.select("lang", "phrase", "a", "k", "l").join(right.select("lang", "phrase", "k", "r").hint("merge"), ["lang", "phrase", "k"])
    n_langs = count_upto(totals, MAX_LANGS)
    scored = scored.join(bounded_broadcast(totals, n_langs), "lang")
    wide = "cast({} as decimal(19,0))".format
    score = F.expr(f"({wide('a * 1000')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    cut = F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(cut).alias("cut"))

    whole = F.col("k") == F.col("size") - 1
    longest = left.where(whole).select("lang", "part", "a").unionByName(
        right.where(F.col("k") == 1).select("lang", "part", "a")).groupBy("lang", "part").agg(F.max("a").alias("longer"))
    longest = longest.select("lang", F.col("part").alias("phrase"), "longer")
    kept = best.join(longest.hint("merge"), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = top_k(flat, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


_GRAMS = "\n  UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM spots WHERE i + {n - 1} <= len(w)"
                              for n in range(1, MAX_WORDS + 1))


SQL = f"""
WITH split AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), parts AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM split
), spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parts WHERE len(w) > 0
), grams AS (
  {_GRAMS}
), counts AS (SELECT lang, phrase, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= {MIN_COUNT}
), totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang
), cand AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE contains(phrase, ' ')
), cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM cand
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n,
         CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, array_to_string(w[i:j], ' ') AS phrase, a FROM (
    SELECT lang, w, a, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w))) AS i FROM cand))
  WHERE j - i + 1 < len(w)
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
FROM best b
WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = b.lang AND p.phrase = b.phrase AND 100 * p.a >= 100 * b.a)
QUALIFY rank <= {TOP}
"""
