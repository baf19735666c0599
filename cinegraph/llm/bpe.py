"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is what the merges make of its bytes exactly if each two
neighbours are what the merges make of theirs. So encodings can be read from left to right:
every prefix of a piece has one encoding, and it ends in the one token that fits the token
before it. The transducer compiles this from the merge ranks, when a text first asks for it:

* A hypothesis is a place where a token may start: the token before it, and the bytes read
  since that place, a node of the trie of tokens.
* A state is the set of hypotheses alive. A byte extends each, ends a token where the merges
  agree, and drops those whose bytes begin no token that could stand there. The transition
  emits the token that ended: the last one of what was read.
* The last token of a piece, the last one of what is left of it, and so on back to the start are
  the piece's tokens. No hypothesis is older than the longest token, and no tokens further back
  are part of a state, so pieces that go on alike share their states.

States and transitions are kept for the worker's life, up to a bound; beyond it they are
forgotten and compiled anew. A piece of any length takes time in proportion to its length.
Pieces are the matches of the vocabulary's pattern; a piece that is a token is that token.

Decoding. A state is the bytes of a character that isn't complete; a token moves to the next
state and emits the characters it completes. Bytes that can't be UTF-8 become U+FFFD, one for
each maximal part, as does a character cut off by the end.

Defined cases: null and empty texts have no tokens, and no tokens decode to the empty text;
null ids and rows that repeat an id are rows like any other; strings of special tokens are
ordinary text; empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import BoundedCache, keep_only, map_slices, read_table
from cinegraph.llm.pieces import tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
# Transitions and whole pieces that a worker remembers.
MAX_TRANSITIONS = 400_000
MAX_PIECES = 250_000
# A rank past all ranks.
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Transducer:
    """Pieces (bytes) to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # the tokens' trie: child of node << 8 | byte, the token that ends at a node (-1: none), and
        # where the tokens that go on from it lie in the order of their bytes
        self._child: dict[int, int] = {}
        self._token, self._low, self._high = [-1], [0], [0]
        self._sorted = [ranks[t] for t in sorted(ranks)]
        for place, token in enumerate(sorted(ranks)):
            node = 0
            for byte in token:
                self._high[node] = place + 1
                at = self._child.get(node << 8 | byte)
                if at is None:
                    at = self._child[node << 8 | byte] = len(self._token)
                    self._token.append(-1)
                    self._low.append(place)
                    self._high.append(place)
                node = at
            self._token[node] = ranks[token]
            self._low[node] = self._high[node] = place + 1
        self._alive: dict[int, bool] = {}
        self.max_transitions = max_transitions
        self._fits: dict[int, bool] = {}
        self._spines: dict[int, tuple | None] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: its hypotheses (the token before, none at the piece's start; trie node since), the oldest first
        self._states: list[tuple] = [(0, (((), 0),))]
        self._numbers: dict[tuple, int] = {self._states[0][1]: 0}
        self._next: dict[int, tuple[int, int]] = {}  # by state << 8 | byte

    def _edges(self, token: int) -> tuple[list, list] | None:
        """The parts at the left and at the right end of a token while the merges build it, each
        with the rank that merges it away; None if the merges don't build it."""
        if token in self._spines:
            return self._spines[token]
        data = self.bytes_of[token]
        parts = [data[i:i + 1] for i in range(len(data))]
        left, right = [], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        found = self._spines[token] = ([*left, (data, NEVER)], [*right, (data, NEVER)]) if len(parts) == 1 else None
        return found

    def fits(self, before: int, token: int) -> bool:
        key = before << 32 | token
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= self.max_transitions:
                self._fits.clear()
            found = self._fits[key] = self._apart(before, token)
        return found

    def _apart(self, before: int, token: int) -> bool:
        """Whether the merges leave these two neighbours as they are (``before`` -1: the piece's start).

        Both are built side by side, lower ranks first, the left one at equal ranks. They stay
        apart unless the parts that meet at the seam merge before either is merged away.
        """
        here = self._edges(token)
        if here is None:
            return False
        if before < 0:
            return True
        rights, lefts, i, j = self._edges(before)[1], here[0], 0, 0
        while True:
            (x, x_until), (y, y_until) = rights[i], lefts[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < x_until and rank <= y_until and rank != NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def may_go_on(self, before: int, node: int) -> bool:
        """Whether any token that goes on from this node fits after ``before``."""
        low, high = self._low[node], self._high[node]
        if low >= high:
            return False
        if before < 0:
            return True  # the piece's start
        key = before << 32 | node
        found = self._alive.get(key)
        if found is None:
            if len(self._alive) >= self.max_transitions:
                self._alive.clear()
            found = self._alive[key] = any(self._apart(before, t) for t in self._sorted[low:high])
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition (next state, token ended) of a state under a byte."""
        child, token_at, low, high = self._child.get, self._token, self._low, self._high
        fits, goes_on = self._fits.get, self._alive.get
        alive, ended = [], None
        for tokens, node in self._states[state][1]:
            node = child(node << 8 | byte)
            if node is None:
                continue
            before = tokens[0] if tokens else -1
            if ended is None:
                token = token_at[node]
                if token >= 0:
                    fit = fits(before << 32 | token)
                    if self.fits(before, token) if fit is None else fit:
                        ended = token
            if low[node] < high[node]:
                on = goes_on(before << 32 | node)
                if self.may_go_on(before, node) if on is None else on:
                    alive.append((tokens, node))
        if ended is None:
            raise ValueError("a prefix without an encoding: the ranks are not those of merges")
        alive.append(((ended,), 0))
        found = self._next[state << 8 | byte] = (self._number(tuple(alive)), ended)
        return found

    def _number(self, places: tuple) -> int:
        number = self._numbers.get(places)
        if number is None:
            number = self._numbers[places] = len(self._states)
            self._states.append((number, places))
        return number

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ended: list[int] = []
        state, known = 0, self._next.get
        for byte in piece:
            step = known(state << 8 | byte)
            if step is None:
                if len(self._next) >= self.max_transitions:
                    # full: start with an empty table, from the state reached
                    reached = self._states[state][1]
                    self._reset()
                    state, known = self._number(reached), self._next.get
                step = self._compile(state, byte)
            state = step[0]
            ended.append(step[1])
        out, at, bytes_of = [], len(piece), self.bytes_of
        while at:
            token = ended[at - 1]
            out.append(token)
            at -= len(bytes_of[token])
        out.reverse()
        return out


class StreamDecoder:
    """Token ids to text, with characters given out as soon as they are complete."""

    def __init__(self, bytes_of: dict[int, bytes], max_transitions: int = MAX_TRANSITIONS):
        self.bytes_of = bytes_of
        self._limit = max_transitions
        self._states: dict[bytes, BoundedCache] = {}

    def state(self, held: bytes) -> BoundedCache:
        """The state that holds back these bytes: a table token -> (characters, next state)."""
        found = self._states.get(held)
        if found is None:
            found = self._states[held] = BoundedCache(lambda token: self._compile(held, token), self._limit)
            found.held = held
        return found

    def _compile(self, held: bytes, token: int) -> tuple[str, BoundedCache]:
        data = held + self.bytes_of[token]
        kept = incomplete_tail(data)
        cut = len(data) - kept
        return data[:cut].decode("utf-8", "replace"), self.state(data[cut:])

    def tables(self) -> list[BoundedCache]:
        return list(self._states.values())

    def decode(self, ids) -> str:
        out, state = [], self.state(b"")
        for token in ids:
            chars, state = state[token]
            out.append(chars)
        if state.held:
            out.append("�")
        return "".join(out)


def incomplete_tail(data: bytes) -> int:
    """How many last bytes (0 to 3) begin a character of UTF-8 that isn't complete."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead & 0xC0 == 0x80:
            continue
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
        if size <= back:
            return 0
        if back > 1:
            # the second byte's range shuts out overlong forms, surrogates and what is past U+10FFFF
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
            if not low <= data[1 - back] <= high:
                return 0
        return back
    return 0


@lru_cache(maxsize=2)
def _encoder(path: str) -> BoundedCache:
    # states are many small tuples without cycles: let the collector look at them less often
    gc.set_threshold(100_000, 20, 100)
    made = Transducer(read_ranks(path))
    return BoundedCache(lambda piece: np.array(made.encode(piece.encode("utf-8")), "<i4").tobytes(), MAX_PIECES)


@lru_cache(maxsize=2)
def _decoder(path: str) -> StreamDecoder:
    return StreamDecoder({rank: token for token, rank in read_ranks(path).items()})


def _path(ranks: str) -> str:
    return ranks if "/" in ranks else tokenizer_path(ranks)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row. ``ranks``: a rank file's path, or its name among the
    installed public tokenizers; ``pattern`` splits texts into pieces (the public one by default)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = _packed(batch.column(1).to_pylist(), ranks, pattern)
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        return pa.record_batch([batch.column(0), ids], names=["id", "ids"])

    return map_slices(source, run, "id long, ids array<int>")


def _packed(texts: list, ranks: str, pattern: str | None) -> list[bytes]:
    """The ids of each text, four bytes each."""
    import public_tokenizers
    import regex

    table = _encoder(_path(ranks))
    keep_only(table, *_decoder(_path(ranks)).tables())
    split = regex.compile(pattern or public_tokenizers.PATTERN).findall
    return [b"".join(map(table.__getitem__, split(text or ""))) for text in texts]


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` (id, ids) with the decoded ``text``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decoder = _decoder(_path(ranks))
        texts = [decoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return map_slices(encoded.select("id", "ids"), run, "id long, ids array<int>, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
               pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: what ``encode`` and then ``decode``
    give, in one pass. Digests are of the decimal ids with commas, and of the decoded text."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, of_ids, of_text = [], [], []
        decoder = _decoder(_path(ranks))
        for packed in _packed(batch.column(1).to_pylist(), ranks, pattern):
            ids = np.frombuffer(packed, "<i4").tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(decoder.decode(ids).encode("utf-8")).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                                pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(source, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
