"""Toxicity by compression distance: two zstandard dictionaries, one window at a time.

A text's windows are its words (A-Z lower-cased, ASCII punctuation taken as space). Each is
compressed twice, once with a dictionary of toxic text and once with one of ordinary text;
how much shorter the toxic dictionary makes it is the window's distance, relative to the
longer of the two lengths. A text's distance is twice its largest window distance plus the
second largest. A calibration by pooled adjacent violators, on labelled texts that the
dictionaries haven't seen, turns it into a probability.

Three details make lengths of a few bytes comparable. Every window stands between two
fixed stretches of known text, because zstandard neither compresses very small inputs nor
searches the last bytes of one. Both dictionaries end in the same trained base of ordinary
text, at equal distance from the window, so ordinary words cost the same with either. And
the parts that differ are sampled: the toxic part from windows that toxic texts hold much
more often (in differing contexts, so that copies of one text don't count), the ordinary
part trained on ordinary windows.

The model is fitted on at most ``SAMPLE_TEXTS`` labelled texts of each label (a documented
bound), whole ones as in scoring: tasks read them, and only the words that tell, a sample of
stretches and counts of distances come to the driver.

Defined cases: null and empty texts have distance 0; without labelled texts of both kinds
every score is 0; rows that repeat an id are scored row by row (and if labelled, each
counts); a null id is never labelled; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import BoundedCache, keep_only, map_slices, materialise, read_table

SAMPLE_TEXTS = 3000
# Stretches of four words: the first are for the base, the rest for the ordinary part.
BASE_STRETCHES, STRETCHES = 40_000, 60_000
BASE_BYTES = 1 << 14
PART_BYTES = 1 << 13
LEVEL = 6
# A word goes into the toxic part if its log odds are this many standard errors over zero.
MIN_Z = 3.5
MIN_CONTEXTS = 3
THRESHOLD = 0.3
# Longer words (runs of junk) are cut into windows of this size.
WINDOW_BYTES = 48
MAX_CACHED = 400_000

_PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Model(NamedTuple):
    """All that scoring needs; a few tens of kilobytes, whatever the input."""

    toxic: bytes
    ordinary: bytes
    base: bytes
    steps: tuple[float, ...]
    values: tuple[float, ...]


EMPTY = Model(b" ", b" ", b" " * 160, (0.0,), (0.0,))


def windows(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8") if isinstance(text, str) else (text or b"")
    return raw.lower().translate(_PUNCTUATION).split()


class Distance:
    """Distances of windows and texts under one model's dictionaries."""

    def __init__(self, model: Model):
        self._before, self._after = model.base[-64:], model.base[-160:-128]
        self._ordinary, self._toxic = (self._compressor(part + model.base) for part in (model.ordinary, model.toxic))
        frame = self._before + self._after
        self._frames = len(self._ordinary.compress(frame)), len(self._toxic.compress(frame))
        self.window = BoundedCache(self._window, MAX_CACHED)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_checksum=False,
                                        write_content_size=False, write_dict_id=False)

    def _window(self, word: bytes) -> float:
        best = 0.0
        for i in range(0, len(word), WINDOW_BYTES):
            framed = b"%b %b %b" % (self._before, word[i:i + WINDOW_BYTES], self._after)
            ordinary = len(self._ordinary.compress(framed)) - self._frames[0]
            toxic = len(self._toxic.compress(framed)) - self._frames[1]
            best = max(best, (ordinary - toxic) / max(ordinary, toxic, 1))
        return best

    def text(self, text: str | None) -> float:
        second, top = [0.0, 0.0, *sorted(map(self.window.__getitem__, set(windows(text))))][-2:]
        return 2 * top + second


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _calibrate(held: dict[tuple[float, int], int], weights: tuple[float, float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Non-decreasing steps from distance to probability (pooled adjacent violators), from the
    numbers of texts of each rounded distance and label."""
    at: dict[float, list[float]] = {}
    for (d, y), n in sorted(held.items()):
        cell = at.setdefault(d, [0.0, 0.0])
        cell[0] += n * y * weights[1]
        cell[1] += n * weights[y]
    pools: list[list[float]] = []
    for d in sorted(at):
        pools.append([d, *at[d]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, hits, n = pools.pop()
            pools[-1][1] += hits
            pools[-1][2] += n
    return tuple(p[0] for p in pools), tuple((p[1] + 0.1) / (p[2] + 1) for p in pools)


def _taught(words: list[bytes]) -> bool:
    """Whether the dictionaries see a text; the others calibrate. Copies fall on one side."""
    return zlib.crc32(b" ".join(words[:50])) % 3 != 0


def _contexts(words: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """A text's different words, each with a name of the words around its first place."""
    seen: set[bytes] = set()
    for i, w in enumerate(words):
        if w not in seen and len(w) <= WINDOW_BYTES:
            seen.add(w)
            around = (words[i - 1] if i else b"") + b" " + (words[i + 1] if i + 1 < len(words) else b"")
            yield w, xxhash.xxh64_intdigest(around) >> 1


def _stretches(words: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """A text's stretches of four words, each with its place in a random order of all."""
    seed = xxhash.xxh64_intdigest(b" ".join(words))
    for i in range(0, len(words), 4):
        yield xxhash.xxh64_intdigest(b"%d" % i, seed) >> 1, b" " + b" ".join(words[i:i + 4]) + b" "


def _z(toxic: int, ordinary: int, total: tuple[int, int]) -> float:
    """Standard errors of a word's log odds over zero, from its numbers of contexts."""
    a, b = toxic + 0.5, ordinary + 0.5
    return math.log(a / (total[1] + 1) / (b / (total[0] + 1))) / math.sqrt(1 / a + 1 / b)


def _dictionaries(telling: list[tuple[float, bytes]], stretches: list[tuple[int, bytes]]) -> Model:
    """A model without calibration, from the telling words by z and ordinary stretches by place."""
    order = [stretch for _, stretch in sorted(stretches)[:STRETCHES]]
    toxic = b" ".join([b"", *[w for _, w in sorted(telling)], b""])[-PART_BYTES:]
    base = _train(BASE_BYTES, order[:BASE_STRETCHES])
    base = (b" " * 160 + base)[-max(160, len(base)):]
    ordinary = _train(PART_BYTES, order[BASE_STRETCHES:] or order)[-len(toxic):]
    return Model(toxic, ordinary, base, (0.0,), (0.0,))


def fit_texts(rows: list[tuple[str | None, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit on (text, label) pairs; ``weights`` say how many labelled texts a sampled one of each
    label stands for."""
    if len({y for _, y in rows}) < 2:
        return EMPTY
    cut = [(windows(t), y) for t, y in rows]
    keep = [_taught(w) for w, _ in cut]
    contexts: dict[int, dict[bytes, set]] = {0: defaultdict(set), 1: defaultdict(set)}
    total = [0, 0]
    stretches: list[tuple[int, bytes]] = []
    for (words, y), part in zip(cut, keep, strict=True):
        if not part:
            continue
        total[y] += 1
        for w, c in _contexts(words):
            contexts[y][w].add(c)
        if not y:
            stretches += _stretches(words)
    if not stretches or not min(total):
        return EMPTY
    telling = [(_z(len(c), len(contexts[0].get(w, ())), total), w) for w, c in contexts[1].items() if len(c) >= MIN_CONTEXTS]
    model = _dictionaries([x for x in telling if x[0] > MIN_Z], stretches)
    distance = Distance(model)
    held = Counter((round(distance.text(t), 2), y) for (t, y), part in zip(rows, keep, strict=True) if not part)
    if len({y for _, y in held}) < 2:
        held = Counter((round(distance.text(t), 2), y) for t, y in rows)
    return model._replace(**dict(zip(("steps", "values"), _calibrate(held, weights), strict=True)))


def fit_sample(sample: DataFrame, counts: dict[int, int]) -> Model:
    """``fit_texts`` of the rows (t, y) of a table, in tasks; ``counts``: labelled texts of each label."""
    def texts(batch: pa.RecordBatch) -> list[tuple[list[bytes], int]]:
        keep_only()
        return [(windows(t), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(y, _taught(w), -(-len(w) // 4)) for w, y in texts(batch)]
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.int64()))],
                               names=["y", "taught", "n"])

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, y, c) for text, y in texts(batch) if _taught(text) for w, c in _contexts(text)]
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int32(), pa.int64()))],
                               names=["w", "y", "c"])

    size = {(r.y, r.taught): r for r in map_slices(sample, sizes, "y int, taught boolean, n long").groupBy("y", "taught").agg(
        F.count("*").alias("texts"), F.sum("n").alias("n")).collect()}
    drawn = [sum(r.texts for (label, _), r in size.items() if label == y) for y in (0, 1)]
    total = [size[y, True].texts if (y, True) in size else 0 for y in (0, 1)]
    if not min(total) or not size[0, True].n:
        return EMPTY
    weights = tuple(max(1.0, counts.get(y, 0) / max(1, drawn[y])) for y in (0, 1))
    # places are even in 63 bits: twice as many as needed pass, and the order takes its first
    last = (1 << 63) - 1 if size[0, True].n <= 2 * STRETCHES else (1 << 63) * 2 * STRETCHES // size[0, True].n

    def stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [x for text, y in texts(batch) if not y and _taught(text) for x in _stretches(text) if x[0] <= last]
        return pa.record_batch([pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                               names=["place", "stretch"])

    def rank(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = [_z(a, b, total) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(0), pa.array(z, pa.float64())], names=["w", "z"])

    of = [F.size(F.collect_set(F.when(F.col("y") == y, F.col("c")))).alias(f"n{y}") for y in (1, 0)]
    often = map_slices(sample, words, "w binary, y int, c long").groupBy("w").agg(*of).where(F.col("n1") >= MIN_CONTEXTS)
    # of the toxic part's bytes, a word takes two at least
    telling = map_slices(often, rank, "w binary, z double").where(F.col("z") > MIN_Z).orderBy(
        F.desc("z"), F.desc("w")).limit(PART_BYTES // 2).collect()
    some = map_slices(sample, stretches, "place long, stretch binary").orderBy("place", "stretch").limit(STRETCHES).collect()
    model = _dictionaries([(r.z, bytes(r.w)) for r in telling], [(r.place, bytes(r.stretch)) for r in some])
    every = not all((y, False) in size for y in (0, 1))

    def distances(batch: pa.RecordBatch) -> pa.RecordBatch:
        distance = _scorer(model)
        rows = [(round(distance.text(t), 2), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if every or not _taught(windows(t))]
        return pa.record_batch([pa.array([d for d, _ in rows], pa.float64()), pa.array([y for _, y in rows], pa.int32())],
                               names=["d", "y"])

    held = {(r.d, r.y): r.n for r in map_slices(sample, distances, "d double, y int").groupBy("d", "y").agg(
        F.count("*").alias("n")).collect()}
    return model._replace(**dict(zip(("steps", "values"), _calibrate(held, weights), strict=True)))


def in_held_out(id_col: str = "doc_id"):
    """The rows whose labels are never used."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on a bounded sample of the labelled texts that aren't held out: at most
    ``sample_texts`` whole texts of each label, those of least hashed id."""
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~in_held_out("lid"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.col("lid"), F.lit(7))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).distinct().orderBy(draw, "lid").limit(sample_texts)
        picked = some if picked is None else picked.unionByName(some)
    sample = (docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("t"))
              .join(F.broadcast(picked), "lid").select("t", "y"))
    return fit_sample(materialise(sample, "toxicity-sample"), counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxic_distance`` and ``toxic_score`` (0 to 1) for every whole text, by row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        distance = _scorer(model)
        got = [distance.text(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(got, pa.float64()),
                                pa.array([probability(model, d) for d in got], pa.float64())],
                               names=["id", "distance", "score"])

    return map_slices(source, run, "id long, distance double, score double")


def probability(model: Model, distance: float) -> float:
    """The calibrated step, nudged by the distance so that ties within a step keep their order."""
    value = model.values[max(0, bisect_right(model.steps, round(distance, 2)) - 1)]
    return min(1.0, max(0.0, value + 1e-6 * distance))


_SCORERS: dict[int, Distance] = {}


def _scorer(model: Model) -> Distance:
    key = hash(model)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Distance(model)
    keep_only(_SCORERS[key].window)
    return _SCORERS[key]


def drop_toxic(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more; columns are unchanged."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        distance = _scorer(model)
        return batch.filter(pa.array([probability(model, distance.text(t)) < threshold
                                      for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_slices(docs, run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), in_held_out("id").alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "distance")
