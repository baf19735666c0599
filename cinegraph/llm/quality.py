"""Quality selection by ordinal cumulative-link regression on hashed text.

Grades run from 0 to K - 1. One weight vector w over hashed text features is shared by all
grades; ordered thresholds cut the line between them:

    P(grade >= k | x) = sigmoid(w . x - theta_k),   theta_1 < theta_2 < ... < theta_(K-1).

The gaps between thresholds are fitted as exponentials, so the order holds by construction.
The model gives the expected grade (the sum of the tail probabilities) and the tail
probability of reaching a wanted grade, by which texts are selected.

Features: each word hashed by its text and by its shape (the classes of its characters, its
length, whether it repeats the word before), as frequencies, in ``BUCKETS`` buckets.

Fitted on at most ``SAMPLE_TEXTS`` labelled texts (a documented bound), whole ones as in
scoring: tasks read them, and only their features come to the driver.

Defined cases: null and empty texts score by the thresholds alone; with fewer than two
grades in the sample every text scores alike; rows that repeat an id are scored row by row;
a null id is never labelled; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import BoundedCache, keep_only, map_slices, read_table
from cinegraph.llm.toxicity import in_held_out

BUCKETS = 1 << 15
SAMPLE_TEXTS = 8000
ROUNDS = 250
L2 = 1e-5
# Select texts that reach this grade with this probability or more.
WANTED_GRADE = 2
KEEP_PROBABILITY = 0.5
MAX_CACHED = 400_000


class Model(NamedTuple):
    weights: np.ndarray  # BUCKETS float32
    thresholds: np.ndarray  # K - 1, increasing


def _shape(word: bytes) -> bytes:
    """Classes of a word's bytes, runs shortened: ``Abc12!!`` -> ``Aa0!``."""
    out = bytearray()
    for b in word:
        c = 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out[:12])


def _word_buckets(word: bytes) -> bytes:
    """Buckets of a word's text and shape, as four little-endian 32-bit numbers' bytes."""
    body = word.lower()
    seen = (xxhash.xxh32_intdigest(body, 1), xxhash.xxh32_intdigest(_shape(word), 2),
            xxhash.xxh32_intdigest(bytes([min(len(word), 30)]), 3), xxhash.xxh32_intdigest(body[-3:], 4))
    return np.array([h % (BUCKETS - 1) + 1 for h in seen], "<u4").tobytes()


_WORDS = BoundedCache(_word_buckets, MAX_CACHED)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: square roots of relative frequencies; bucket 0 is the share
    of words that repeat the word before."""
    keep_only(_WORDS)
    words = (text or "").encode("utf-8").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    hashed = np.frombuffer(b"".join(map(_WORDS.__getitem__, words)), "<u4")
    texts = hashed[::4]
    repeats = float((texts[1:] == texts[:-1]).mean()) if len(texts) > 1 else 0.0
    buckets, counts = np.unique(hashed, return_counts=True)
    values = np.sqrt(counts / len(words)).astype(np.float32)
    return np.concatenate(([0], buckets)).astype(np.int64), np.concatenate(([repeats], values)).astype(np.float32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_texts(rows: list[tuple[str | None, int]], grades: int) -> Model:
    return fit_features([features(t) for t, _ in rows], [g for _, g in rows], grades)


def fit_features(parts: list[tuple[np.ndarray, np.ndarray]], found: list[int], grades: int) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam over the whole sample."""
    weights = np.zeros(BUCKETS)
    y = np.array(found, np.int64)
    if len(np.unique(y)) < 2:
        return Model(weights.astype(np.float32), np.zeros(grades - 1))
    row = np.repeat(np.arange(len(parts)), [len(b) for b, _ in parts])
    col = np.concatenate([b for b, _ in parts])
    val = np.concatenate([v for _, v in parts]).astype(np.float64)
    share = np.array([max(1e-3, (y >= k).mean()) for k in range(1, grades)])
    first = -np.log(share / (1 - np.minimum(share, 0.999)))
    theta = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 0.05))))  # first threshold, log gaps
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (weights, theta)]
    # 1 where the text reaches grade k
    for step in range(1, ROUNDS + 1):
        weights, theta = state[0][0], state[1][0]
        cuts = np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))
        f = np.bincount(row, val * weights[col], len(parts))
        # P(y) = sigmoid(f - cut_y) - sigmoid(f - cut_(y+1)); the outer cuts are at -inf and +inf
        bounds = np.concatenate(([-np.inf], cuts, [np.inf]))
        low, high = f - bounds[y], f - bounds[y + 1]
        s_low, s_high = _sigmoid(low), _sigmoid(high)
        p = np.maximum(s_low - s_high, 1e-9)
        d_low, d_high = s_low * (1 - s_low) / p, s_high * (1 - s_high) / p
        g_f = -(d_low - d_high) / len(y)
        g_w = np.bincount(col, val * g_f[row], BUCKETS) + L2 * weights
        g_cut = np.array([(d_low[y == k].sum() - d_high[y == k - 1].sum()) / len(y) for k in range(1, grades)])
        g_theta = np.concatenate(([g_cut.sum()], [np.exp(theta[j]) * g_cut[j:].sum() for j in range(1, grades - 1)]))
        for slot, g in zip(state, (g_w, g_theta), strict=True):
            slot[1] = 0.9 * slot[1] + 0.1 * g
            slot[2] = 0.99 * slot[2] + 0.01 * g * g
            m, v = slot[1] / (1 - 0.9 ** step), slot[2] / (1 - 0.99 ** step)
            slot[0] = slot[0] - 0.1 * m / (np.sqrt(v) + 1e-8)
    theta = state[1][0]
    return Model(state[0][0].astype(np.float32), np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:])))))


def tails(model: Model, text: str | None) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K - 1."""
    buckets, values = features(text)
    return _sigmoid(float(model.weights[buckets] @ values) - model.thresholds)


def fit(docs: DataFrame, graded: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on the ``sample_texts`` graded texts of least hashed id: a bounded sample."""
    picked = graded.select(F.col(id_col).cast("long").alias("gid"), F.col(grade_col).cast("int").alias("g")).where(
        F.col("g").between(0, grades - 1) & F.col("gid").isNotNull()).distinct().orderBy(
        F.xxhash64(F.col("gid"), F.lit(11)), "gid", "g").limit(sample_texts)
    sample = (docs.select(F.col(id_col).cast("long").alias("gid"), F.col(text_col).alias("t"))
              .join(F.broadcast(picked), "gid").select("gid", "g", "t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [features(t) for t in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in parts], pa.binary()),
                                pa.array([v.tobytes() for _, v in parts], pa.binary())], names=["gid", "g", "buckets", "numbers"])

    rows = map_slices(sample, run, "gid long, g int, buckets binary, numbers binary").orderBy(
        F.xxhash64("gid"), "buckets", "numbers", "g").limit(sample_texts).toArrow()
    parts = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(v, np.float32))
             for b, v in zip(rows["buckets"].to_pylist(), rows["numbers"].to_pylist(), strict=True)]
    return fit_features(parts, rows["g"].to_pylist(), grades)


def grade_documents(docs: DataFrame, model: Model, wanted: int = WANTED_GRADE, keep_probability: float = KEEP_PROBABILITY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, expected_grade, tail_probability (of ``wanted`` or better), kept."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = Model(*shared.value)
        got = [tails(held, t) for t in batch.column(1).to_pylist()]
        tail = [float(p[wanted - 1]) for p in got]
        return pa.record_batch([
            batch.column(0), pa.array([float(p.sum()) for p in got], pa.float64()), pa.array(tail, pa.float64()),
            pa.array([p >= keep_probability for p in tail], pa.bool_())],
            names=["id", "expected_grade", "tail_probability", "kept"])

    return map_slices(source, run, "id long, expected_grade double, tail_probability double, kept boolean")


def graded_labels(labels: DataFrame) -> DataFrame:
    """Grades from the labels table: 0 junk, 1 readable but toxic, 2 good."""
    return labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    known = graded_labels(read_table(spark, sf_dir, "labels")).where(~in_held_out())
    model = fit(docs, known, grades=3)
    return grade_documents(docs, model).select(
        F.col("id").alias("doc_id"), in_held_out("id").alias("held_out"), "expected_grade", "tail_probability", "kept")
