"""Tokenizer pieces: cutting a text where a byte-pair tokenizer cannot merge across."""

from __future__ import annotations

import os
import re

# Characters that every tokenizer here treats as white space.
SURE = " \t\n\r"
# Characters that some engines treat as white space: never cut next to them.
UNSURE = "\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿"
_WORD = f"[^{SURE}{UNSURE}]"

# Letters beyond doubt, and marks that certainly end a run of letters (none of them occurs
# inside a special token's text).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?"

# A piece runs to the next place where every pre-tokenizer in use ends a word, whatever
# stands to the left: from a character that is certainly no white space to sure white space,
# or from a letter to a mark. The pieces of a text therefore tokenize independently.
PIECE = re.compile(f"[{SURE}]*[{LETTERS}]+(?=[{MARKS}])"
                   f"|[{SURE}]*(?:{_WORD}+|[{UNSURE}]+[{SURE}]*)+|[{SURE}]+")
# Cut points between a sure non-space and sure white space.
SYNC = re.compile(f"(?<={_WORD})(?=[{SURE}])")


# A space after what may be white space: there a space isn't sure to start a piece.
_DOUBLE = re.compile(f"[{SURE}{UNSURE}] ")
_LETTERS = re.compile(f"[{LETTERS}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, the
    others take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = byte_letters()


def byte_level(text: str) -> str:
    """A text as a byte-level model's vocabulary spells it."""
    if text.isascii() and text.isalnum():
        return text
    return text.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)


def spaced_words(text: str) -> list[str] | None:
    """``text.split(" ")`` if every space of the text starts a piece, else None."""
    return None if _DOUBLE.search(text) else text.split(" ")


def plain_parts(word: str) -> tuple[str, str] | None:
    """(letters, marks) of a word made of just these, else None."""
    letters = word.rstrip(MARKS)
    if letters.isalpha() and (letters.isascii() or _LETTERS.fullmatch(letters)):
        return letters, word[len(letters):]
    return None


def load_tokenizer(path: str):
    """A tokenizer file by path; nothing is trained here."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
