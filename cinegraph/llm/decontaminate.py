"""Benchmark decontamination by greedy string tiling.

Seeds: every benchmark item's runs of ``min_match`` words are hashed. Documents are scanned
once; of their own runs only those pass that a fixed-size bit set of the seeds lets by, and
an equality join with the seed table brings (document, item) pairs together. A pair's seeds
cover at least what any tiling can cover, so pairs that can't reach the threshold end there.

Tiling: for each remaining pair, maximal matches between document and item are found from
equal Karp-Rabin hashes of runs of words; the longest one whose words aren't marked yet is
marked as a tile, a partly marked match is cut to its unmarked stretches, and so on down to
``min_match``. What share of the item's words lies in tiles is its coverage: passages whose
parts were put in another order are covered as well as verbatim ones.

An item of fewer than ``min_match`` words has no such run. It is matched where a document holds
exactly its words as a line of its own, or as its whole text; inside longer lines a few words in
a row are everyday language.

Defined cases: null and empty texts match nothing, and items without words are never matched;
equal items are separate; of equally covered items the
one with the smaller id is reported; rows that repeat an id are judged each by its
text, and reported together; a null id is judged like any other; empty tables give empty results or no match; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import BoundedCache, fixed_bitmap, in_bitmap, keep_only, map_slices, materialise, read_table, text_key

MIN_MATCH = 5
THRESHOLD = 0.5
SIEVE_BITS = 23
# Pairs (two longs each) that may be broadcast: some 10 MB. More are joined by a shuffle.
BROADCAST_PAIRS = 400_000
MAX_CACHED = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def _chunk_hashes(chunk: str) -> bytes:
    """Hashes of the words in a stretch without white space, as bytes."""
    return b"".join(xxhash.xxh64_digest(w)[::-1] for w in _WORD.findall(chunk.lower()))


_CHUNKS = BoundedCache(_chunk_hashes, MAX_CACHED)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (letters, digits and underscores, lower-cased)."""
    keep_only(_CHUNKS)
    return np.frombuffer(b"".join(map(_CHUNKS.__getitem__, (text or "").split())), "<u8")


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` words (modulo 2**64)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, length):
        out *= _BASE
        out += words[i:i + n]
    return out


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the document, start in the item, length) of two word sequences."""
    d, t = run_hashes(doc, min_match), run_hashes(item, min_match)
    if not len(d) or not len(t):
        return []
    order = np.argsort(t, kind="stable")
    low, high = np.searchsorted(t[order], d, "left"), np.searchsorted(t[order], d, "right")
    counts = high - low
    i = np.repeat(np.arange(len(d)), counts)
    if not len(i):
        return []
    at = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
    j = order[np.repeat(low, counts) + at]
    # runs of matching hashes on one diagonal are one maximal match
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(i - j) != 0))))
    lengths = np.diff(np.concatenate((starts, [len(i)]))) + min_match - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(lengths, i[starts], j[starts], strict=True)]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        marked = in_doc[a:a + n] | in_item[b:b + n]
        if not marked.any():
            in_doc[a:a + n] = True
            in_item[b:b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= min_match:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return out


def whole_hash(words: np.ndarray) -> int:
    """Hash of a short item or line as a whole, apart from those of runs."""
    return int(run_hashes(words, len(words))[0] ^ np.uint64(len(words) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF))


def short_lines(text: str | None, min_match: int) -> set[int]:
    """Whole hashes of the lines of fewer than ``min_match`` words, and of such a text."""
    out = set()
    for part in {text, *text.split("\n")} if text else ():
        # the regular expression stops at the first word too many
        if 0 < sum(1 for _ in islice(_WORD.finditer(part), min_match)) < min_match:
            words = word_hashes(part)
            if 0 < len(words) < min_match:
                out.add(whole_hash(words))
    return out


def seed_table(benchmark: DataFrame, item_col: str, text_col: str, min_match: int) -> DataFrame:
    """(item, pos, n_words, seed) of every run of ``min_match`` words of every item, and of shorter items as a whole."""
    source = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> list:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = word_hashes(text)
            rows += [(item, p, len(words), s) for p, s in enumerate(run_hashes(words, min_match).view(np.int64).tolist())]
            if 0 < len(words) < min_match:
                rows.append((item, 0, len(words), int(np.uint64(whole_hash(words)).view(np.int64))))
        if not rows:
            return []
        return [pa.record_batch([pa.array(c, k) for c, k in zip(
            zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
            names=["item", "pos", "n_words", "seed"])]

    return map_slices(source, run, "item long, pos int, n_words int, seed long")


def shared_seeds(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str, min_match: int) -> DataFrame:
    """(id, text_key, seed): the distinct runs (and short lines, if there are short items) of each
    document that the seeds' bit set lets by."""
    sieve = fixed_bitmap(seeds.select("seed"), "seed", SIEVE_BITS)
    any_short = not seeds.where(F.col("n_words") < min_match).isEmpty()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                         text_key(F.col(text_col)).alias("text_key"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bitmap = np.frombuffer(sieve, np.uint64)
        ids, keys, found = [], [], []
        for doc, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = run_hashes(word_hashes(text), min_match)
            if any_short:
                runs = np.concatenate((runs, np.fromiter(short_lines(text, min_match), np.uint64)))
            hit = np.unique(runs[in_bitmap(bitmap, runs)]).view(np.int64).tolist()
            ids += [doc] * len(hit)
            keys += [key] * len(hit)
            found += hit
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, pa.int64())],
                               names=["id", "text_key", "seed"])

    return map_slices(source, run, "id long, text_key long, seed long")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
            threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_key, item, coverage, n_tiles) of all pairs that reach the threshold."""
    seeds = materialise(seed_table(benchmark, item_col, item_text_col, min_match), "benchmark-seeds")
    shared = shared_seeds(docs, seeds, id_col, text_col, min_match).join(seeds, "seed")
    reach = F.size(F.array_distinct(F.flatten(F.transform(
        F.collect_set("pos"), lambda p: F.sequence(p, p + F.lit(min_match - 1))))))
    pairs = shared.groupBy("id", "text_key", "item").agg(reach.alias("reach"), F.first("n_words").alias("n_words")).where(
        F.col("reach") >= F.lit(threshold) * F.col("n_words")).select(F.col("id").alias("pair_id"), F.col("text_key").alias("pair_key"), "item")
    pairs = materialise(pairs, "benchmark-pairs")
    small = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("doc_text"),
                        text_key(F.col(text_col)).alias("text_key")).join(
        F.broadcast(pairs) if small else pairs,
        F.col("id").eqNullSafe(F.col("pair_id")) & (F.col("text_key") == F.col("pair_key")))
    items = benchmark.select(F.col(item_col).cast("long").alias("bench_item"), F.col(item_text_col).alias("item_text"))
    both = texts.join(items, F.col("item").eqNullSafe(F.col("bench_item"))).select("id", "text_key", "item", "doc_text", "item_text")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, key, item, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = word_hashes(y)
            if len(words) < min_match:
                same = whole_hash(words) in short_lines(x, min_match) if len(words) else False
                rows.append((doc, key, item, float(same), int(same)))
                continue
            found = tiles(word_hashes(x), words, min_match)
            rows.append((doc, key, item, sum(n for _, _, n in found) / len(words), len(found)))
        return pa.record_batch([pa.array(c, k) for c, k in zip(
            zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)],
            names=["id", "text_key", "item", "coverage", "n_tiles"])

    return map_slices(both, verify, "id long, text_key long, item long, coverage double, n_tiles int").where(
        F.col("coverage") >= threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """One row per contaminated text of an id: id, text_key, item (best covered), coverage, n_items."""
    found = materialise(matches(docs, benchmark, **params), "benchmark-matches")
    best = F.max(F.struct(F.col("coverage"), (-F.col("item")).alias("low")))
    return found.groupBy("id", "text_key").agg(best.alias("best"), F.countDistinct("item").alias("n_items")).select(
        "id", "text_key", (-F.col("best.low")).alias("item"), F.col("best.coverage").alias("coverage"), "n_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the contaminated rows, judged by id and text; columns are unchanged."""
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **params).select(
        F.col("id").alias("__bad"), F.col("text_key").alias("__key"))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__bad")) & (text_key(docs[text_col]) == F.col("__key")),
                     "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    bad = contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    ids = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return ids.join(bad, ids.doc_id.eqNullSafe(bad.id) & (ids.key == bad.text_key), "left").select(
        "doc_id", F.col("coverage").isNotNull().alias("contaminated"), F.col("item").alias("item_id"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
