"""Token counts by a finite-state transducer compiled from a byte-pair tokenizer's merges.

States and transitions. ``Merges`` compiles the merge list of a byte-level tokenizer: a state
is the set of places where a token may start, each with the tokens it is ahead of the least,
the token before it and the bytes read since (a node of the tokens' trie). Two neighbours may
stand side by side exactly if the merges leave them apart, so a byte extends each place, ends at
most one token, and drops places that nothing can follow. Each transition is annotated with the
number of tokens that all places of its target agree on; the counts along a path, and those its
last state still holds back, are the tokens of the word. Transitions are determinised on first use
and bounded in number; beyond the bound they are forgotten and compiled anew. Whenever a token is
first met, its last merge is held against the list.

Words are cut as the tokenizer's pattern cuts them. It ends a word wherever a character
that is certainly no white space is followed by white space, whatever came before. Reading
such a boundary therefore resets the machine: every state goes to the same state. Between
two resets the input is one *piece* (white space, then a word), and the path that a piece
takes from the reset state back to it is kept as one transition with its count, in a bounded
table too.

The library's part: characters that are newer than Python's Unicode tables are cut as the library's
pattern cuts them. Tokenizer files of other kinds (a normaliser, word ends, sentencepiece) are not
compiled: there the library counts a piece on first use, or the whole text for a ``.model`` file.

Chunks. A text is read in chunks of ``CHUNK_CHARS`` characters, cut anywhere. A chunk's
state map has to answer for every state in which the chunk may be entered; as all states
agree after the first reset, it is held as (head, count, tail): the input before the first
reset, the tokens emitted between the first and the last, the input after the last - or, for
a chunk without reset, the head alone. Maps compose associatively: ``A . B`` runs the
transition of ``A.tail + B.head``. The maps of a text are composed by a parallel prefix scan
(log-many rounds of neighbours at doubling distance), which gives the counts of all its
prefixes; the last one is the text's count.

Defined cases: null and empty texts count 0 tokens and 0 bytes; rows that repeat an id are
counted row by row; a null id is kept; an empty table gives an empty result; extra columns
are ignored; special strings inside texts are handled as the library's default does.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from functools import partial
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm import bpe
from cinegraph.llm.common import BoundedCache, keep_only, map_slices, read_table
from cinegraph.llm.pieces import PIECE, SYNC, byte_letters, load_tokenizer, plain_parts, spaced_words, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CHUNK_CHARS = 1 << 15
LIMIT_TOKENS = 1024
MAX_TRANSITIONS = 400_000
# Longer pieces are rare and large: they are counted without keeping their transition.
MAX_KEPT_PIECE = 64


class StateMap(NamedTuple):
    """What a chunk does to the machine: see the module's text. ``synced``: it holds a reset."""

    head: str
    count: int
    tail: str
    synced: bool


# The pattern of byte-level pre-tokenizers (fixed value), with Unicode's white space.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# Byte transitions kept; a piece's own transition spares most walks over them.
MAX_STEPS = 400_000


class State(dict):
    """A state's transitions, byte -> (next state, tokens emitted), compiled on first use.

    ``places`` holds (tokens ahead, token before, trie node since) of each place, the oldest first.
    """

    __slots__ = ("machine", "places")

    def __missing__(self, byte: int) -> tuple[State, int]:
        found = self[byte] = self.machine.step(self.places, byte)
        return found


class Merges(bpe.Transducer):
    """Counts the tokens that a list of merges (pairs of bytes, the first merged first) makes of a word.

    Tokens are numbered by their merge, bytes by themselves. The trie of tokens and the test whether two
    neighbours stay apart are the encoder's; states and transitions here hold counts instead of tokens.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], max_transitions: int = MAX_STEPS):
        ranks = {bytes([b]): b for b in range(256)}
        for i, (a, b) in enumerate(merges):
            ranks.setdefault(a + b, 256 + i)
        self._pairs = merges
        super().__init__(ranks, max_transitions)

    def _reset(self) -> None:
        for state in getattr(self, "_known", {}).values():
            state.clear()  # they refer to each other
        self._known: dict[tuple, State] = {}
        self.steps = 0
        self._start = self._state(((0, -1, 0),))

    def _state(self, places: tuple) -> State:
        found = self._known.get(places)
        if found is None:
            found = self._known[places] = State()
            found.machine, found.places = self, places
        return found

    def _edges(self, token: int):
        found = self._spines.get(token)
        if found is not None:
            return found
        found = super()._edges(token)
        # merges go by pairs, the trie by the bytes they give: both are one if a token's bytes end in its own pair
        if token >= 256 and (found is None or (found[0][-2][0], found[1][-2][0]) != self._pairs[token - 256]):
            raise ValueError(f"the merges of {self.bytes_of[token]!r} do not build it: not a list that can be compiled")
        return found

    def step(self, places: tuple, byte: int) -> tuple[State, int]:
        """The transition (next state, tokens emitted) of a state under a byte."""
        if self.steps >= self.max_transitions:
            self._reset()
        alive, ended = [], None
        for ahead, before, node in places:
            node = self._child.get(node << 8 | byte)
            if node is None:
                continue
            if ended is None:
                token = self._token[node]
                if token >= 0 and self.fits(before, token):
                    ended = (ahead + 1, token, 0)
            if self.may_go_on(before, node):
                alive.append((ahead, before, node))
        alive.append(ended)
        sure = min([ahead for ahead, _, _ in alive])
        if sure:
            alive = [(ahead - sure, before, node) for ahead, before, node in alive]
        self.steps += 1
        return self._state(tuple(alive)), sure

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        state, n = self._start, 0
        for byte in word:
            state, sure = state[byte]
            n += sure
        # of the places, the youngest is the one that ends here
        return n + state.places[-1][0]


def compiled_words(path: str):
    """``count(text)`` compiled from a byte-level tokenizer file, or None if the file is of another kind."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, cut = made["model"], made.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
             and not any([cut.get("add_prefix_space", True), made.get("normalizer"), made.get("post_processor"),
                          made.get("truncation"), model.get("dropout"), model.get("unk_token"), model.get("ignore_merges"),
                          model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")])
             and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]))
    if not plain:
        return None
    shown = {c: b for b, c in byte_letters().items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
    machine = Merges([(bytes(map(shown.__getitem__, a)), bytes(map(shown.__getitem__, b))) for a, b in pairs])
    return partial(_count_text, machine, regex.compile(WORDS), _special(made["added_tokens"]), partial(_library_cut, path, shown))


def _special(tokens: list[dict]):
    """A pattern of the special strings, the longest first, or None."""
    found = sorted((t["content"] for t in tokens), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, found))) if found else None


def _library_cut(path: str, shown: dict[str, int], text: str) -> list[bytes]:
    """Words of a text with characters of a Unicode version that Python doesn't know."""
    if path not in _LIBRARY:
        _LIBRARY[path] = load_tokenizer(path).pre_tokenizer
    return [bytes(map(shown.__getitem__, word)) for word, _ in _LIBRARY[path].pre_tokenize_str(text)]


_LIBRARY: dict = {}


def _count_text(machine: Merges, words, special, library_cut, text: str) -> int:
    parts = special.split(text) if special else [text]
    n = len(parts) - 1
    for part in parts:
        if part.isascii() or not any(unicodedata.category(c) == "Cn" for c in part):
            cut = [w.encode("utf-8") for w in words.findall(part)]
        else:
            cut = library_cut(part)
        n += sum(map(machine.count, cut))
    return n


class Transducer:
    """Token-counting transducer of one tokenizer file."""

    def __init__(self, path: str):
        count = compiled_words(path)
        self.compiled = count is not None
        self._machine = count.args[0] if self.compiled else None
        # a sentencepiece model joins words across white space: its only safe piece is the whole text
        self.cuts = path.endswith(".json")
        if count is None:
            library = load_tokenizer(path)
            count = (lambda text: len(library.encode(text, add_special_tokens=False))) if self.cuts else (
                lambda text: len(library.encode(text)))
        self._emit = count
        self.transitions = BoundedCache(count, MAX_TRANSITIONS)
        self.spaced = BoundedCache(self._emit_spaced, MAX_TRANSITIONS)

    def _emit_spaced(self, word: str) -> int:
        """Tokens of a space and ``word``."""
        parts = plain_parts(word) if self.compiled else None
        if parts is None:
            return self._emit(" " + word)
        letters, marks = parts
        n = self._machine.count(b" " + letters.encode("utf-8"))
        return n + self.transitions[marks] if marks else n

    def run(self, text: str) -> int:
        """Tokens emitted on a text that starts and ends in the reset state."""
        if not text:
            return 0
        if not self.cuts:
            return self._emit(text)
        words = spaced_words(text)
        if words is not None:
            first = words[0]
            return (self._step(first) if first else 0) + sum(map(self.spaced.__getitem__, words[1:]))
        return sum(map(self._step, PIECE.findall(text)))

    def _step(self, piece: str) -> int:
        return self.transitions[piece] if len(piece) <= MAX_KEPT_PIECE else self._emit(piece)

    def state_map(self, chunk: str) -> StateMap:
        first = SYNC.search(chunk) if self.cuts else None
        if first is None:
            return StateMap(chunk, 0, "", False)
        at = first.start()
        end = at
        for last in SYNC.finditer(chunk, max(at, len(chunk) - 256)):
            end = last.start()
        if end == at:  # none so near the end: look at the whole chunk
            for last in SYNC.finditer(chunk, at):
                end = last.start()
        return StateMap(chunk[:at], self.run(chunk[at:end]), chunk[end:], True)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``. The seam may itself hold resets."""
        seam = self.state_map((a.tail if a.synced else a.head) + b.head)
        if not a.synced and not b.synced:
            return seam
        if not seam.synced:  # the seam is one stretch without reset
            if not a.synced:
                return StateMap(seam.head, b.count, b.tail, True)
            if not b.synced:
                return StateMap(a.head, a.count, seam.head, True)
            return StateMap(a.head, a.count + self.run(seam.head) + b.count, b.tail, True)
        head, count, tail = seam.head, seam.count, seam.tail
        if a.synced:
            count += a.count + self.run(head)
            head = a.head
        if b.synced:
            count += b.count + self.run(tail)
            tail = b.tail
        return StateMap(head, count, tail, True)

    def prefix_scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Maps of all prefixes, by rounds of doubling distance (every round's steps are independent)."""
        out, reach = list(maps), 1
        while reach < len(out):
            out = [self.compose(out[i - reach], out[i]) if i >= reach else out[i] for i in range(len(out))]
            reach *= 2
        return out

    def chunks(self, text: str, size: int = CHUNK_CHARS) -> list[str]:
        return [text[i:i + size] for i in range(0, len(text), size)]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        whole = self.prefix_scan([self.state_map(c) for c in self.chunks(text, chunk_chars)])[-1]
        if not whole.synced:
            return self.run(whole.head)
        return self.run(whole.head) + whole.count + self.run(whole.tail)


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer for each tokenizer file and worker process."""
    if path not in _COMPILED:
        # states are many small tuples: let the collector look at them less often
        gc.set_threshold(100_000, 20, 100)
        _COMPILED[path] = Transducer(path)
    keep_only(_COMPILED[path].transitions, _COMPILED[path].spaced)
    return _COMPILED[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                 limit_tokens: int = LIMIT_TOKENS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. ``tokenizer`` is a public
    tokenizer file's name, looked up where the task runs; nothing is shuffled."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = compiled(tokenizer_path(tokenizer))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n_tokens = [machine.count(t, chunk_chars) for t in texts]
        return pa.record_batch([
            batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
            pa.array(n_tokens, pa.int64()), pa.array([n > limit_tokens for n in n_tokens], pa.bool_()),
        ], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(source, run, "id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
