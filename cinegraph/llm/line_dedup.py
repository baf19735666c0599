"""Line deduplication by a segment-partition edit join.

Lines (stripped, lower-cased, blank ones set aside) that are equal or near form classes; of
each class the first line stays, by document id and line number. Two lines are near within a
tenth of the shorter one's characters, and at most ``edits`` edits: none below 10 characters,
one below 20.

Equal lines are grouped by digest. For near lines, every line is cut into one segment more
than its edits. If two lines are near, one segment of the shorter occurs in the other at a
position that the segment's number and the lengths confine. So lines are indexed by (length, segment number, segment),
and probe the indexes of their own and the next shorter lengths at those positions only;
an equality join brings candidates together. A parity signature of the characters (an edit
flips at most two bits) drops chance candidates inside the join, before a pair is made; the
rest are verified by banded bit-parallel edit distance. Only candidates' texts move.

A segment shared by very many lines is a hot key: copies of a line count once, and the
signature keeps its chance pairs from being emitted.

Defined cases: null and empty texts have no lines; in one document a repeated line counts
once, its first; documents are told apart by id and text: rows that repeat an id with another
text are other documents, ordered by a hash of the text, and rows that repeat both share their
lines' fate; a null id is last: its
lines stay only where no other document has them; an empty table gives an empty result;
extra columns are ignored, whatever their names. A document that loses all its lines goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import SLICE_ROWS, fixed_bitmap, in_bitmap, keep_only, map_slices, materialise, read_table, text_key
from cinegraph.llm.components import connected_components

MAX_EDITS = 2
# Characters of the shorter line for each edit.
CHARS_PER_EDIT = 10
SIEVE_BITS = 23
# Lines that a task remembers having sent.
MET_LINES = 500_000

_PARITY = np.array([1 << (i % 32) for i in range(64)], np.uint32)


def normalise(line: str) -> str:
    return line.strip().lower()


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8"), digest_size=16).digest()


def signature(line: str) -> int:
    """Parities of the counts of 32 classes of characters."""
    points = np.frombuffer(line.encode("utf-32-le"), "<u4")
    return int(np.bitwise_xor.reduce(_PARITY[points & 63])) if len(points) else 0


def allowed(length: int, edits: int) -> int:
    """Edits within which a line is near, if it is the shorter of two."""
    return min(edits, length // CHARS_PER_EDIT)


def segment_bounds(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, stop) of the edits + 1 segments of a line; the last ones take what doesn't divide."""
    n = edits + 1
    short, longer = length // n, length % n
    bounds, at = [], 0
    for i in range(n):
        stop = at + short + (i >= n - longer)
        bounds.append((at, stop))
        at = stop
    return bounds


def probe_spans(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(index length, segment number, start, stop) of the substrings by which a line looks for
    lines no longer than itself, other than its own segments.

    With segment i at p, and d = length - index length, a match leaves at most i edits before
    it and the rest after it (segments before and after each holding one), which bounds the
    shift.
    """
    spans = []
    for shorter in range(max(1, length - edits), length + 1):
        d, most = length - shorter, allowed(shorter, edits)
        if not most or d > most:
            continue
        for i, (p, stop) in enumerate(segment_bounds(shorter, most)):
            low = max(p - i, p + d - (most - i), 0)
            high = min(p + i, p + d + (most - i), length - (stop - p))
            spans += [(shorter, i, q, q + stop - p) for q in range(low, high + 1) if d or q != p]
    return spans


def edit_distance_within(a: str, b: str, limit: int) -> int | None:
    """Edit distance of two strings if it is at most ``limit``, else None.

    Myers' bit-parallel recurrence in the diagonal band of width 2 * limit + 1 (Hyyro's
    banded form): bit j of the vectors stands for row i - limit + j of the column.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > limit:
        return None
    if not limit:
        return 0 if a == b else None
    # equal ends need no work
    head = 0
    while head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < m - head and a[m - 1 - tail] == b[n - 1 - tail]:
        tail += 1
    a, b = a[head:m - tail], b[head:n - tail]
    m, n = len(a), len(b)
    if not m:
        return n
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    band = (1 << (2 * limit + 1)) - 1
    top = 1 << (2 * limit)
    # before the first column: rows above the text fall by one, rows of the text rise by one
    vp, vn = band & ~((1 << limit) - 1), 0
    score = min(limit, m)
    for j in range(n):
        shift = j - limit
        eq = places.get(b[j], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & band
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & band
        hp = (vn | ~(d0 | vp)) & band
        hn = d0 & vp
        # the band moves down one row: its lowest cell is one diagonal step from the last lowest
        if j + limit < m:
            score += not d0 & top
        else:
            bit = (m - 1 - j) + limit  # the last row, inside the band
            if bit < 0:
                return None
            if hp >> bit & 1:
                score += 1
            elif hn >> bit & 1:
                score -= 1
        x = d0 >> 1
        vp = (hn | ~(x | hp)) & band
        vn = x & hp
    return score if score <= limit else None


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, line_no, again, digest) of every line that isn't blank; ``again``: a line of the same document is equal."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                         text_key(F.col(text_col)).alias("text_key"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep_only()
        ids, keys, numbers, again, digests = [], [], [], [], []
        for doc, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen: set[bytes] = set()
            for number, line in enumerate((text or "").split("\n")):
                body = normalise(line)
                if body:
                    d = digest(body)
                    ids.append(doc)
                    keys.append(key)
                    numbers.append(number)
                    again.append(d in seen)
                    digests.append(d)
                    seen.add(d)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()),
                                pa.array(again, pa.bool_()), pa.array(digests, pa.binary())],
                               names=["id", "text_key", "line_no", "again", "digest"])

    return map_slices(source, run, "id long, text_key long, line_no int, again boolean, digest binary")


def line_key(body: str) -> int:
    """Signed 64-bit name of a line among candidates; texts decide, so a clash loses nothing."""
    key = xxhash.xxh3_64_intdigest(body)
    return key - (1 << 64) if key >= 1 << 63 else key


def segment_keys(docs: DataFrame, text_col: str, edits: int) -> DataFrame:
    """(key, line, sig, own): the index keys (``own``) and the other probe keys of all lines.

    A task sends a line it has met lately no second time, so a line of very many copies is a
    few rows for each task, not for each copy.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        hashed = xxhash.xxh64_intdigest
        spans: dict[int, list] = {}
        met: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                keys, lines, sigs, sizes, owns = [], [], [], [], []
                for text in batch.column(0).slice(start, SLICE_ROWS).to_pylist():
                    for raw in (text or "").split("\n"):
                        body = normalise(raw)
                        n = len(body)
                        here = spans.get(n)
                        if here is None:
                            most = allowed(n, edits)
                            own = [(n << 8 | i, a, b) for i, (a, b) in enumerate(segment_bounds(n, most))] if most else []
                            here = spans[n] = (len(own), own + [(length << 8 | i, a, b) for length, i, a, b in probe_spans(n, edits)])
                        n_own, here = here
                        if not here:
                            continue  # too short to be near another line; equal ones meet by digest
                        line = line_key(body)
                        if line in met:
                            continue
                        if len(met) >= MET_LINES:
                            met.clear()
                        met.add(line)
                        keys += [hashed(body[a:b], seed) for seed, a, b in here]
                        lines.append(line)
                        sigs.append(signature(body))
                        sizes.append(len(here))
                        owns.append(n_own)
                if not keys:
                    continue
                ends = np.cumsum(sizes)
                rank = np.arange(len(keys)) - np.repeat(ends - sizes, sizes)
                yield pa.record_batch([
                    pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(lines, np.int64), sizes)),
                    pa.array(np.repeat(np.array(sigs, np.uint32).view(np.int32), sizes)), pa.array(rank < np.repeat(owns, sizes))],
                    names=["key", "line", "sig", "own"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, line long, sig int, own boolean")


def candidate_lines(docs: DataFrame, text_col: str = "text", edits: int = MAX_EDITS) -> DataFrame:
    """Pairs (a, b) of line keys, a < b, that share a segment and may be near.

    The keys are dealt once. Most occur in one line only; those go before anything is paired,
    and what is left, written, is small. The join's exchanges are Spark's own, so that adaptive
    execution may split a hot segment's partition.
    """
    keys = segment_keys(docs, text_col, edits).where(F.col("key").isNotNull()).repartition("key")
    live = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("own").alias("indexed"),
                                   F.count("sig").alias("n")).where(
        F.col("indexed") & (F.col("low") != F.col("high")) & (F.col("n") > 1)).select(F.col("key").alias("k"))
    # the filter lets all through; it only keeps Spark from dealing the keys anew for the join
    dealt_keys = keys.where(F.monotonically_increasing_id() >= 0)
    shared = materialise(dealt_keys.join(live.hint("shuffle_hash"), F.col("key") == F.col("k"), "left_semi"), "shared-segments")
    dealt = shared.groupBy("key", "line").agg(F.first("sig").alias("sig"), F.max("own").alias("own"))
    index = dealt.where("own").select("key", F.col("line").alias("x"), F.col("sig").alias("sx"))
    probe = dealt.select(F.col("key").alias("k2"), F.col("line").alias("y"), F.col("sig").alias("sy"),
                         F.col("own").alias("indexed"))
    near = index.join(probe, (F.col("key") == F.col("k2")) & (F.col("x") != F.col("y"))
                      & (~F.col("indexed") | (F.col("x") < F.col("y")))
                      & (F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= 2 * edits))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _texts_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(line, body) of the lines whose key is in ``wanted`` (column ``line``)."""
    sieve = fixed_bitmap(wanted, "line", SIEVE_BITS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bitmap = np.frombuffer(sieve, np.uint64)
        bodies = list({b for t in batch.column(0).to_pylist() for b in map(normalise, (t or "").split("\n")) if b})
        lines = np.array([line_key(b) for b in bodies], np.int64)
        hit = np.flatnonzero(in_bitmap(bitmap, lines.view(np.uint64))) if bodies else []
        return pa.record_batch([pa.array([int(lines[i]) for i in hit], pa.int64()),
                                pa.array([bodies[i] for i in hit], pa.string())], names=["line", "body"])

    found = map_slices(docs.select(F.col(text_col).alias("text")), run, "line long, body string")
    return found.distinct().join(wanted, "line", "left_semi")


def near_links(docs: DataFrame, text_col: str = "text", edits: int = MAX_EDITS) -> DataFrame:
    """Verified links (a, b, edits) between digests of different lines."""
    pairs = materialise(candidate_lines(docs, text_col, edits), "line-candidates")
    wanted = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    texts = materialise(_texts_of(docs, text_col, materialise(wanted, "line-wanted")), "line-texts")
    left = texts.select(F.col("line").alias("a"), F.col("body").alias("x"))
    right = texts.select(F.col("line").alias("b"), F.col("body").alias("y"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, d = [], [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = edit_distance_within(x, y, allowed(min(len(x), len(y)), edits))
            if n is not None:
                a.append(digest(x))
                b.append(digest(y))
                d.append(n)
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(d, pa.int32())],
                               names=["a", "b", "edits"])

    both = pairs.join(left, "a").join(right, "b").select("x", "y")
    return map_slices(both, verify, "a binary, b binary, edits int")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS) -> DataFrame:
    """One row per line that isn't blank: id, text_key, line_no, class_id, class_key and class_line
    (the document, by id and text, and the line that stay for its class), n_links (near lines of
    its text), kept."""
    rows = materialise(line_table(docs, id_col, text_col), "lines")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"), F.col("line_no"))
    firsts = materialise(rows.where(~F.col("again")).groupBy("digest").agg(F.min(order).alias("first")), "line-firsts")
    links = materialise(near_links(docs, text_col, edits), "line-links")
    degree = links.select(F.col("a").alias("digest")).unionByName(links.select(F.col("b").alias("digest"))).groupBy(
        "digest").agg(F.count("*").alias("n_links"))
    roots = connected_components(links.select("a", "b")).join(
        degree.withColumnRenamed("digest", "node"), "node").select(F.col("node").alias("digest"), "root", "n_links")
    members = materialise(firsts.join(roots, "digest"), "line-members")
    heads = members.groupBy("root").agg(F.min("first").alias("head"))
    settled = members.join(heads, "root").select("digest", "head", "n_links").unionByName(
        firsts.join(roots.select("digest"), "digest", "left_anti").select(
            "digest", F.col("first").alias("head"), F.lit(0).cast("long").alias("n_links")))
    stays = (~F.col("again") & F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_key") == F.col("head.text_key"))
             & (F.col("line_no") == F.col("head.line_no")))
    return rows.join(settled, "digest").select(
        "id", "text_key", "line_no", F.col("head.id").alias("class_id"), F.col("head.text_key").alias("class_key"),
        F.col("head.line_no").alias("class_line"), "n_links", stays.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                        **params) -> DataFrame:
    """``docs`` without the lines that don't stay, and without documents that lose all their
    lines; columns are unchanged, ``length_col`` (if given) follows the text's length."""
    lines = line_classes(docs, id_col, text_col, **params)
    lost = materialise(lines.where(~F.col("kept")).groupBy("id", "text_key").agg(F.collect_set("line_no").alias("__lost"))
                       .withColumnsRenamed({"id": "__lost_id", "text_key": "__lost_key"}), "lost-lines")
    names, schema = docs.columns, docs.schema
    joined = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col("__lost_id"))
                       & (text_key(docs[text_col]) == F.col("__lost_key")), "left").drop("__lost_id", "__lost_key")
    at = names.index(text_col)
    size_at = names.index(length_col) if length_col else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = batch.column(len(names)).to_pylist()
        texts = batch.column(at).to_pylist()
        stays = []
        for i, numbers in enumerate(gone):
            if numbers and texts[i]:
                away = set(numbers)
                lines = texts[i].split("\n")
                left = [line for n, line in enumerate(lines) if n not in away]
                texts[i] = "\n".join(left)
                stays.append(any(line.strip() for line in left))
            else:
                stays.append(True)
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = pa.array(texts, columns[at].type)
        if size_at is not None:
            sizes = columns[size_at].to_pylist()
            columns[size_at] = pa.array([len(texts[i]) if gone[i] and texts[i] is not None else n
                                         for i, n in enumerate(sizes)], columns[size_at].type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return map_slices(joined, run, schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_classes(read_table(spark, sf_dir, "documents")).drop("text_key", "class_key").withColumnRenamed("id", "doc_id")
