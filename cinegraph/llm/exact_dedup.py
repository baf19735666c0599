"""Exact deduplication with a heavy-hitter split.

1. Every text becomes a SHA-256 digest of its A-Z-lower-cased UTF-8 form.
2. Each task keeps a Misra-Gries summary of ``k`` counters; the summaries are added up and
   the ``k`` largest kept, which holds every digest of more than N / (k + 1) rows.
3. Those candidates are counted exactly (partial sums per task). Their winners - at most
   ``k`` rows by construction - are broadcast, so copies of a hot text are settled where
   they lie and never meet in one task.
4. All other digests are grouped by an ordinary shuffle.

Defined cases: a null text counts as empty; of equal texts the row with the largest id
stays; rows that repeat an id stay or go together; a null id never wins over another id
(if all are null, all of them stay); an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import map_slices, materialise

# Counters of a Misra-Gries summary, and so the most rows that are ever broadcast.
HEAVY_COUNTERS = 1024


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest binary) of every row; equal digests mean equal normalised texts."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [hashlib.sha256((t or "").encode("utf-8").lower()).digest() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "digest"])

    return map_slices(source, digests, "id long, digest binary")


def misra_gries(rows: DataFrame, key: str, k: int = HEAVY_COUNTERS) -> DataFrame:
    """(key, estimate): at most ``k`` keys, among them all with more than N / (k + 1) rows."""
    kind = rows.schema[key].dataType.simpleString()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        arrow = None
        for batch in batches:
            arrow = batch.column(0).type
            counted = batch.column(0).value_counts()
            for x in counted.to_pylist():
                counters[x["values"]] = counters.get(x["values"], 0) + x["counts"]
            if len(counters) > k:
                # the Misra-Gries decrement, for a whole batch: what is left over the (k+1)-th count
                cut = sorted(counters.values(), reverse=True)[k]
                counters = {x: n - cut for x, n in counters.items() if n > cut}
        if counters:
            yield pa.record_batch([pa.array(counters.keys(), arrow), pa.array(counters.values(), pa.int64())],
                                  names=[key, "estimate"])

    per_task = rows.select(key).mapInArrow(summary, f"{key} {kind}, estimate long")
    return per_task.groupBy(key).agg(F.sum("estimate").alias("estimate")).orderBy(F.desc("estimate"), key).limit(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy_counters: int = HEAVY_COUNTERS) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept."""
    rows = materialise(digest_table(docs, id_col, text_col), "digests")
    heavy = misra_gries(rows, "digest", heavy_counters).select("digest")
    winners = materialise(
        rows.join(F.broadcast(heavy), "digest")
        .groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = hot.unionByName(cold.join(groups, "digest"))
    return settled.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from cinegraph.llm.common import read_table

    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
