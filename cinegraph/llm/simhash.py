"""SimHash near-duplicate groups by pigeonhole blocks.

The 64-bit fingerprint is cut into ``distance + 2`` blocks. Two fingerprints at most
``distance`` bits apart agree on at least two whole blocks, so distinct fingerprints are
keyed by every pair of blocks, joined on that key, and verified by Hamming distance.

Only distinct fingerprints are joined: copies share one row. A bucket of more than
``bucket_limit`` fingerprints is not joined with itself. There the fingerprints differ in
the open blocks only, and (for a distance of 2) two of them are linked exactly if they
share a midpoint, a value at most one bit from both. Each emits its midpoints, and those at
one midpoint - at most as many as there are open bits, plus one - form a star. This is
exact, and linear in the bucket.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle hash as one sequence; rows that repeat an id are separate rows with
the same result; a null id is only the component's id if the whole component has none;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import keep_only, map_slices, materialise, read_table, text_key
from cinegraph.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
HASH_SEED = 42
BUCKET_LIMIT = 64
# Shingle hashes whose bits are counted at once.
_BIT_ROWS = 1 << 14


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text (A-Z lower-cased)."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and white space only
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[:len(tokens) - words + 1].tolist()
        stops = (ends[words - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BIT_ROWS):
        part = hashes[i:i + _BIT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_key, fp long) of every row; fp holds the unsigned bits."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                         text_key(F.col(text_col)).alias("text_key"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_only()
        fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["id", "text_key", "fp"])

    return map_slices(source, run, "id long, text_key long, fp long")


def _layout(distance: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks as (lowest bit, width), and the block pairs that serve as keys."""
    n = distance + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)], list(combinations(range(n), 2))


def _mask(width: int, low: int) -> int:
    value = ((1 << width) - 1) << low
    return value - (1 << 64) if value >= 1 << 63 else value


def similar_pairs(classes: DataFrame, distance: int = MAX_DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints; the links' closure joins all within ``distance`` bits."""
    if distance != 2:
        bucket_limit = 1 << 62  # midpoints are exact for two bits only; other distances join every bucket
    blocks, pairs = _layout(distance)
    fp = F.col("fp")
    kept_bits = [sum(_mask(blocks[i][1], blocks[i][0]) for i in pair) for pair in pairs]
    kept_bits = [m - (1 << 64) if m >= 1 << 63 else m for m in kept_bits]
    keyed = classes.select(fp, F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m).cast("long")) for m in kept_bits]))
                           .alias("which", "key"))
    keyed = materialise(keyed, "blocks")
    sizes = keyed.groupBy("which", "key").count().where(F.col("count") > 1)
    shared = materialise(keyed.join(sizes, ["which", "key"]), "shared-blocks")
    cold, hot = shared.where(F.col("count") <= bucket_limit), shared.where(F.col("count") > bucket_limit)
    left = cold.select("which", "key", F.col("fp").alias("a"))
    right = cold.select(F.col("which").alias("w2"), F.col("key").alias("k2"), F.col("fp").alias("b"))
    near = left.join(right, (F.col("which") == F.col("w2")) & (F.col("key") == F.col("k2")) & (F.col("a") < F.col("b"))
                     & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    # midpoints flip one open bit, or none
    flips = F.array(*[F.array(*[F.lit(0).cast("long")] + [
        F.lit(_mask(1, bit)).cast("long") for i, (low, width) in enumerate(blocks) if i not in pair
        for bit in range(low, low + width)]) for pair in pairs])
    points = hot.select("which", "fp", F.explode(F.element_at(flips, F.col("which") + 1)).alias("flip")).select(
        "which", "fp", fp.bitwiseXOR(F.col("flip")).alias("mid"))
    stars = points.groupBy("which", "mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("around")).where(
        F.size("around") > 1).select("a", F.explode("around").alias("b")).where(F.col("a") != F.col("b"))
    return near.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                   distance: int = MAX_DISTANCE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: id, text_key, fp (long), component_id (least id of the linked group)."""
    rows = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("low_id")), "fp-classes")
    roots = connected_components(similar_pairs(classes, distance, bucket_limit))
    linked = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "low_id", F.coalesce("root", "fp").alias("root"))
    lows = linked.groupBy("root").agg(F.min("low_id").alias("component_id"))
    by_fp = materialise(linked.join(lows, "root").select("fp", "component_id"), "fp-components")
    return rows.join(by_fp, "fp").select("id", "text_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows whose id isn't the least of their own group; columns are unchanged.

    Rows are judged by id and text: of rows that share an id, one with another text has its own
    group. Rows that repeat the least id with texts of the same group all stay; a row with a null
    id stays only if its whole group has none.
    """
    groups = simhash_groups(docs, id_col, text_col, **params)
    gone = groups.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(
        F.col("id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__gone")) & (text_key(docs[text_col]) == F.col("__key")),
                     "left_anti")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id")
