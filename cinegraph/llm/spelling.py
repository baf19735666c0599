"""Spelling variant grouping by a relational trie frontier.

1. Runs of letters are counted in tasks and summed; words are those long and frequent enough.
2. The words, each with an end mark, form a trie kept as an edge table (node, labels): a node is
   the 64-bit hash of a prefix, a label the letters up to the next node. Letters where nothing
   branches are one label, so the depth of the trie is the number of branchings and not the
   length of the longest word. A second trie over the reversed words lies in the same table,
   under another hash seed.
3. Two words one edit apart have a common prefix and a common suffix of together at least
   length - 1 code points, so one of them covers the first ``length // 2`` code points or the
   last half. Every word therefore starts at the node of its own first half (in both tries),
   and may spend its one edit from there on. The frontier of states (word, position, node,
   edits) is joined with the edge table, level by level, until it is empty. A state of no edit
   takes its own letter on, or spends the edit: a greater letter in place of its own, or its own
   left out (the words on the other side of such pairs need not look for them). What a state of
   one edit must read from there on is known, its ``goal``; a Bloom filter of all words drops
   most states whose goal is none, the others walk on, and at an end mark they are neighbours.
4. Neighbours are joined with the words themselves and checked, so hash clashes do no harm.

A node's children are at most as many as there are letters, whatever the corpus. Which nodes
branch is told to the tasks by a Bloom filter, too; a false answer only adds a node or a state.
Both filters are bounded in size.

Defined cases: null and empty texts have no runs; a null id counts as the text ``null``;
repeated rows count again; words of equal counts are chosen by code-point order; a word without
near words has n_near 0, no form, and is its own root; an empty table gives an empty result;
very long runs are words like any other; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import SLICE_ROWS, keep_only, map_slices, materialise, read_table
from cinegraph.operators.joins import bounded_broadcast

MIN_CHARS = 7
MIN_COUNT = 2
NOISE = 31
RATIO = 10
# Distinct words a task holds before it sends them on.
HELD_WORDS = 300_000
# Bits of a Bloom filter: 24 a key, at most 2**28 (32 MB).
BITS_PER_KEY, MAX_BITS, PROBES = 24, 28, 6
ALL_BITS = (1 << 64) - 1
END = "."  # the end mark; it sorts before all letters
# Frontier rows up to which they are broadcast to the edges.
SMALL_FRONTIER = 100_000

# UTF-8 of a-z and U+00C0 to U+00FF
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def distort(run: bytes, h: int, noise: int) -> bytes:
    """``run`` without its code point number ``h % length`` if ``noise`` divides ``h``."""
    if h % noise:
        return run
    if run.isascii():
        k = h % len(run)
        return run[:k] + run[k + 1:]
    text = run.decode("utf-8")
    k = h % len(text)
    return (text[:k] + text[k + 1:]).encode("utf-8")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of all words of at least ``min_chars`` code points and ``min_count`` occurrences."""
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))

    def send(held: Counter) -> pa.RecordBatch:
        words = sorted(held)
        return pa.record_batch([pa.array([w.decode("utf-8") for w in words], pa.string()),
                                pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        held: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    base = zlib.crc32(f"{doc}:".encode())
                    for w, n in Counter(_RUN.findall(text.encode("utf-8").lower())).items():
                        if len(w) < min_chars:
                            continue
                        w = distort(w, zlib.crc32(w, base), noise)
                        if len(w) - w.count(b"\xc3") >= min_chars:
                            held[w] += n
                    if len(held) >= HELD_WORDS:
                        yield send(held)
                        held.clear()
        if held:
            yield send(held)

    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def node_id(prefix: str, backward: bool) -> int:
    return _signed(xxhash.xxh64_intdigest(prefix.encode("utf-8"), 1 + backward))


def word_key(word: str) -> int:
    return _signed(xxhash.xxh64_intdigest(word.encode("utf-8")))


def path_nodes(letters: str, low: int, backward: bool) -> list[int]:
    """Nodes of the prefixes of ``low`` and more code points."""
    state = xxhash.xxh64(letters[:low].encode("utf-8"), seed=1 + backward)
    out = [_signed(state.intdigest())]
    for c in letters[low:]:
        state.update(c.encode("utf-8"))
        out.append(_signed(state.intdigest()))
    return out


def half(length: int, backward: bool) -> int:
    """Code points that a word of this length walks without an edit."""
    return (length + 1) // 2 if backward else length // 2


def turned(word: str, backward: bool) -> str:
    return word[::-1] if backward else word


def _paths(words: list[str]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(letters, first position, second place to start, nodes from the first position on) of each
    word in both directions: words as long, and those one code point longer, start there."""
    for word in words:
        for backward in (False, True):
            letters = turned(word, backward)
            low = half(len(word), backward)
            yield letters, low, half(len(word) + 1, backward), path_nodes(letters, low, backward)


def branching_nodes(words: DataFrame) -> DataFrame:
    """(key) of the prefixes after which more than one letter (or a word's end) follows."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, following = [], []
        for letters, low, _, path in _paths(batch.column(0).to_pylist()):
            nodes += path
            following += [*map(ord, letters[low:]), 0]
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(following, pa.int32())], names=["key", "following"])

    seen = map_slices(words.select("word"), run, "key long, following int")
    return seen.groupBy("key").agg(F.min("following").alias("a"), F.max("following").alias("b")).where(
        F.col("a") != F.col("b")).select("key")


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers (one row a key) by double hashing."""
    x = keys.view(np.uint64)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return (x[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64((1 << bits) - 1)


def _in_bloom(bloom: bytes, keys: list[int]) -> np.ndarray:
    """Which (unsigned) keys may be in the set: all that are, and a few others."""
    table = np.frombuffer(bloom, np.uint64)
    if not keys:
        return np.zeros(0, bool)
    at = _probes(np.array(keys, np.uint64), (len(table) * 64).bit_length() - 1)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def bloom_filter(keys: DataFrame):
    """Broadcast filter of the longs in ``key``, gathered word by word: ORs in the tasks, then at
    most 2**(MAX_BITS - 6) rows of two longs."""
    bits = min(MAX_BITS, max(10, int(keys.count() * BITS_PER_KEY).bit_length()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(_probes(batch.column(0).to_numpy(zero_copy_only=False), bits))
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        bit = np.uint64(1) << (at & np.uint64(63))
        return pa.record_batch([pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))],
                               names=["w", "b"])

    out = np.zeros(1 << (bits - 6), np.int64)
    found = keys.mapInArrow(lambda batches: (run(b) for b in batches if b.num_rows), "w long, b long").groupBy("w").agg(
        F.bit_or("b").alias("b")).toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.tobytes())


def edge_table(words: DataFrame) -> DataFrame:
    """(node, labels) of both tries: a node's labels, joined by spaces."""
    bloom = bloom_filter(materialise(branching_nodes(words), "trie-nodes"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = list(_paths(batch.column(0).to_pylist()))
        branches = _in_bloom(bloom.value, [x & ALL_BITS for p in paths for x in p[3]])
        nodes, labels, base = [], [], 0
        for letters, low, second, path in paths:
            # where words start, where the trie branches, and past the end mark
            stops = sorted({0, second - low, *np.flatnonzero(branches[base:base + len(path)]).tolist(), len(path)})
            base += len(path)
            marked = letters + END
            for a, b in zip(stops, stops[1:]):
                nodes.append(path[a])
                labels.append(marked[low + a:low + b])
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(labels, pa.string())], names=["node", "label"])

    edges = map_slices(words.select("word"), run, "node long, label string")
    return edges.groupBy("node").agg(F.array_join(F.collect_set("label"), " ").alias("labels"))


_STATE = "word string, goal string, at int, backward boolean, node long"


def _states(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64())
    names = ["word", "goal", "at", "backward", "node"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def starts(words: DataFrame) -> DataFrame:
    """The first frontier: every word at the node of its first half, in both tries. ``word`` and
    ``goal`` are in the trie's direction, with the end mark; a state of no edit has no goal."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for word in batch.column(0).to_pylist():
            for backward in (False, True):
                letters, h = turned(word, backward), half(len(word), backward)
                rows.append((letters + END, None, h, backward, node_id(letters[:h], backward)))
        return _states(rows)

    return map_slices(words.select("word"), run, _STATE)


def advance(word: str, at: int, label: str) -> tuple[bool, list[str]]:
    """What a state of no edit does along a label: whether it reads all of it, and else the goals
    it may spend its edit on, which all read the label.

    The edit is made at the first difference only: one made earlier gives a string that the later
    one gives too. One made right after the label belongs to the next label.
    """
    if word.startswith(label, at):
        return True, []
    p = 0
    while word[at + p] == label[p]:
        p += 1
    here = at + p
    own, rest, goals = word[here], label[p:], []
    if own != END:
        # a greater letter in place of its own, if the label goes on like the word after it
        if rest[0] > own and word.startswith(rest[1:], here + 1):
            goals.append(word[:here] + rest[0] + word[here + 1:])
        if word.startswith(rest, here + 1):
            goals.append(word[:here] + word[here + 1:])
    return False, goals


def _step(frontier: DataFrame, edges: DataFrame, bloom) -> DataFrame:
    """The frontier after one more label. Neighbours found have no ``node``; their ``word`` and
    ``goal`` are turned back, without end marks."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, tried, keys = [], [], []
        key_of = xxhash.xxh64_intdigest

        def on(word: str, goal: str | None, at: int, backward: bool) -> None:
            if goal is not None and at == len(goal):
                out.append((turned(word[:-1], backward), turned(goal[:-1], backward), at, backward, None))
            else:
                out.append((word, goal, at, backward, node_id((goal or word)[:at], backward)))

        for word, goal, at, backward, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, after = word[at], word[at + 1:at + 2]
            for label in labels.split(" "):
                if goal is not None:
                    if goal.startswith(label, at):
                        on(word, goal, at + len(label), backward)
                    continue
                # a lesser letter that isn't the word's next one leads nowhere
                first = label[0]
                if first < own and first != after:
                    continue
                reads, goals = advance(word, at, label)
                if reads and at + len(label) < len(word):
                    on(word, None, at + len(label), backward)
                for g in goals:
                    tried.append((word, g, at + len(label), backward))
                    keys.append(key_of(g[-2::-1] if backward else g[:-1]))
        for i in np.flatnonzero(_in_bloom(bloom.value, keys)).tolist():
            on(*tried[i])
        return _states(out)

    met = frontier.join(edges, "node").select("word", "goal", "at", "backward", "labels")
    return map_slices(met, run, _STATE)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart; ``words`` is a written table."""
    keys = map_slices(words.select("word"), lambda b: pa.record_batch(
        [pa.array(list(map(word_key, b.column(0).to_pylist())), pa.int64())], names=["key"]), "key long")
    bloom = bloom_filter(materialise(keys, "word-keys"))
    edges = materialise(edge_table(words), "trie-edges")
    frontier = materialise(starts(words), "frontier")
    found = []
    while n := frontier.count():
        after = materialise(_step(bounded_broadcast(frontier, n, SMALL_FRONTIER), edges, bloom), "frontier")
        found.append(after.where(F.col("node").isNull()).select("word", F.col("goal").alias("near")))
        frontier = after.where(F.col("node").isNotNull())
    pairs = found[0] if found else words.select("word", F.col("word").alias("near")).limit(0)
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1).distinct()
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    once = materialise(pairs.join(words, "word").join(other, "near").select("word", "n", "near", "near_n"), "near-words")
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                                        F.col("n").alias("near_n")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, noise: int = NOISE, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialise(word_counts(docs, id_col, text_col, min_chars, min_count, noise), "words")
    pairs = near_words(words)
    best = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    is_form = -F.col("best.low") >= F.lit(ratio) * F.col("n")
    judged = materialise(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"),
                                     F.when(is_form, -F.col("best.low")).alias("form_n")), "forms")
    # a form has at least ``ratio`` times the occurrences, so chains are short; each round doubles the steps taken
    roots = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = materialise(roots.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return words.join(judged, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


# crc32 by its rule (fixed value: the reflected polynomial 0xEDB88320), byte by byte; letters up to
# U+00FF are one or two bytes. Words are near if leaving out one code point of one gives the other,
# or if leaving out one at the same place gives the same.
SQL = f"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run AS s
  FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(s, ''), lambda ch:
           CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)]
                ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END))), lambda c, b:
           list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM counted
), distorted AS (
  SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM distorted WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS root, 0 AS steps FROM forms
    UNION ALL SELECT c.word, f.form, c.steps + 1 FROM c JOIN forms f ON f.word = c.root AND f.form IS NOT NULL)
  SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word
)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain ON chain.word = f.word
"""
