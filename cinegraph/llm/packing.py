"""Sequence packing by best-fit decreasing.

Documents become token ids (plus an end id); a document longer than a window is first cut
into full windows, and only its remainder competes for room. Remainders go, longest first,
into the open window that they leave least room in. A segment tree over the remaining
capacities finds that window in O(log capacity).

Best fit needs to see many pieces at once, but a corpus must not meet in one task: pieces
are dealt by hash into groups of about ``group_pieces``, each packed by itself. With
thousands of pieces a group, best fit fills windows almost wholly, so what the split costs
is one part-filled window or so a group. Token ids never travel: packing shuffles the
lengths, and the ids join their places afterwards if the caller wants them.

Defined cases: a null or empty text is one piece of the end id alone; rows that repeat an
id are packed as separate documents, told apart by ``row_key``; null ids are kept; an empty
table gives an empty result; a document whose ids fill windows exactly has no remainder.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import BoundedCache, keep_only, map_slices, materialise, read_table
from cinegraph.llm.pieces import SURE, byte_level, load_tokenizer, plain_parts, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
GROUP_PIECES = 20_000
MAX_CACHED = 500_000


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity >= a need."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need of an open window, or None."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:  # a right sibling holds larger capacities
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each length (1 to ``window``), in the order given.

    Ties between equal lengths go by position; between equally tight windows the one opened
    first wins.
    """
    tree = CapacityTree(window)
    holding: dict[int, list[int]] = defaultdict(list)  # capacity -> open windows, latest first
    room: list[int] = []
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        capacity = tree.tightest(n)
        if capacity is None:
            number, capacity = len(room), window
            room.append(window)
        else:
            number = holding[capacity].pop()
            tree.add(capacity, -1)
        places[i] = (number, window - capacity)
        room[number] = capacity - n
        if room[number]:
            holding[room[number]].append(number)
            tree.add(room[number], 1)
    return places


_TOKEN_ID = attrgetter("id")


def _binary(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


class WordIds(BoundedCache):
    """Token ids (little-endian unsigned 32-bit) of the words of one tokenizer that drops white space."""

    def __init__(self, path: str):
        super().__init__(self._word, MAX_CACHED)
        self._tokenizer = load_tokenizer(path)
        self._model = self._tokenizer.model
        # one run of letters is one word of the model, lower-cased and spelt in bytes
        self._byte_level = self._tokenizer.pre_tokenizer.pre_tokenize_str("Pr\u00f6be.") == [
            (byte_level("Pr\u00f6be"), (0, 5)), (".", (5, 6))] and self._tokenizer.normalizer.normalize_str("\u00c9A") == "\u00e9a"

    def _word(self, word: str) -> bytes:
        parts = plain_parts(word) if self._byte_level else None
        if parts is None:
            return _binary(self._tokenizer.encode(word, add_special_tokens=False).ids)
        letters, marks = parts
        if marks:  # letters end before a mark, whatever follows
            return self[letters] + self[marks]
        # these letters are composed already, and each has one lower-case letter
        low = letters.lower()
        if low != letters:
            return self[low]
        return _binary(list(map(_TOKEN_ID, self._model.tokenize(byte_level(low)))))

    def encode(self, text: str) -> bytes:
        for c in SURE[1:]:
            text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table for each tokenizer file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    keep_only(_ENCODERS[path])
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Rows (id, row_key, start, length, doc_tokens, ids): each document's full windows and
    its remainder; ``ids`` is binary, little-endian unsigned 32-bit."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row_key"),
                         F.col(text_col).alias("text"))
    end = _binary([end_id])

    def run(batch: pa.RecordBatch) -> list:
        path = tokenizer_path(tokenizer)
        rows: list[tuple] = []
        words = word_ids(path)
        for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = words.encode(text or "") + end
            total = len(ids) // 4
            rows += [(doc, key, s, min(window, total - s), total, ids[4 * s:4 * (s + window)])
                     for s in range(0, total, window)]
        return [pa.record_batch([pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.binary(),), strict=True)],
            names=["id", "row_key", "start", "length", "doc_tokens", "ids"])] if rows else []

    return map_slices(source, run, "id long, row_key long, start long, length long, doc_tokens long, ids binary")


def place(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (a written table with ``row_key``, ``start``, ``length``) with sequence_id and offset.

    sequence_id is the group's number times 2^32 plus the window's number there.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row_key", "start"), F.lit(groups)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_key", "start"], kind="stable")
        got = best_fit_decreasing(rows["length"].tolist(), window)
        base = int(rows["group"].iloc[0]) << 32
        return rows.drop(columns="group").assign(sequence_id=[base + n for n, _ in got], offset=[o for _, o in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group").applyInPandas(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packed pieces with their token ids: id, start, length, doc_tokens, sequence_id, offset, ids."""
    pieces = materialise(token_pieces(docs, tokenizer, id_col, text_col, window=window), "token-pieces")
    places = place(pieces.select("row_key", "start", "length"), window, group_pieces)
    return pieces.join(places.drop("length"), ["row_key", "start"]).drop("row_key")


def packing_digest(docs: DataFrame) -> DataFrame:
    """Where each piece of each document lies, with a checksum of its ids in place of the ids."""
    pieces = materialise(
        token_pieces(docs).select("id", "row_key", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")),
        "token-pieces")
    return place(pieces).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
                                "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packing_digest(read_table(spark, sf_dir, "documents"))


def crc32_of(ids) -> int:
    """The checksum of ids as the query gives it."""
    return zlib.crc32(_binary(ids))
