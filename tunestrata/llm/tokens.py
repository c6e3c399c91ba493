"""Encoding with a tokenizer file of the ``tokenizers`` library, word by word.

Natural words repeat, and the library takes the same time for each of them. Texts are therefore
cut where the library would cut them anyway, the pieces are encoded once per worker by the
library, and their ids are put together. A worker remembers a bounded number of pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

#: Pieces that a worker remembers, and characters encoded together.
REMEMBERED = 1_000_000
STRETCH = 1 << 20

# A blank or newline after a character that is not white space starts a new piece: byte-level
# pre-tokenizers attach leading blanks to what follows, and no token holds white space inside.
_BEFORE_BLANK = re.compile(r"(?<=\S)(?=[ \n])")

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_LATIN = re.compile(rf"[{_LETTER}]+(?![^ \n.,;:!?|&%$*#])|[^ \n]+")


_WORD = re.compile(rf"[{_LETTER}]+")


def pieces_with_blanks(text: str) -> list[str]:
    return _BEFORE_BLANK.split(text)


def pieces_without_blanks(text: str) -> list[str]:
    """For tokenizers that lower the case and drop white space; empty pieces have no ids.

    Texts in Latin-1 letters are lowered and also cut between a letter and the punctuation behind
    it, both of which such a tokenizer does itself: fewer different pieces are left to encode.
    Strings of special tokens are matched in their own case, so texts that may hold one are not.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return _LATIN.findall(text.lower())
    return text.replace("\n", " ").split(" ")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut before a blank that follows a word."""
    start = 0
    while len(text) - start > size:
        cut = _BEFORE_BLANK.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache
def file_digest(path: str) -> str:
    """Names a tokenizer's version: the SHA-256 of its file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


class PieceEncoder:
    """What the library makes of each piece, remembered. ``value`` turns an id list into it."""

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        self.tokenizer, self.value, self.known = load(path), value, {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Ids that end a word, for vocabularies that mark word ends.
        self.closing = {i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)}

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of words of letters alone, many to a line: every word is one with its own end."""
        lines = [words[i : i + 100] for i in range(0, len(words), 100)]
        made, closing = [], self.closing
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(w) for w in lines], add_special_tokens=False), strict=True):
            ids, start, before = e.ids, 0, len(made)
            for stop, i in enumerate(ids, 1):
                if i in closing:
                    made.append(ids[start:stop])
                    start = stop
            if len(made) - before != len(line) or start != len(ids):
                made[before:] = [x.ids for x in self.tokenizer.encode_batch_fast(line, add_special_tokens=False)]
        return made

    def __call__(self, texts: list[list[str]]) -> list[list]:
        """For lists of pieces, the lists of their values."""
        wanted = set().union(*texts)
        missing = list(wanted.difference(self.known))
        if len(self.known) + len(missing) > REMEMBERED:  # go on with what is in use
            self.known = {p: self.known[p] for p in wanted & self.known.keys()}
        if self.closing:
            words = [p for p in missing if _WORD.fullmatch(p)]
            self.known.update(zip(words, map(self.value, self._words(words)), strict=True))
            missing = [p for p in missing if p not in self.known]
        made = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        self.known.update(zip(missing, (self.value(e.ids) for e in made), strict=True))
        return [list(map(self.known.__getitem__, pieces)) for pieces in texts]


@cache
def counter(path: str) -> PieceEncoder:
    return PieceEncoder(path, len)


def _id_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def packer(path: str) -> PieceEncoder:
    return PieceEncoder(path, _id_bytes)


def groups_of(texts: list[str], size: int = STRETCH) -> Iterator[list[int]]:
    """Positions of texts that together have about ``size`` characters."""
    group, held = [], 0
    for i, text in enumerate(texts):
        group.append(i)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, for byte-level tokenizers that keep white space."""
    encode, totals = counter(path), [0] * len(texts)
    for group in groups_of(texts):
        parts = [(i, part) for i in group for part in stretches(texts[i])]
        if len(parts) > len(group):  # a very long text: one part after the other
            for i, part in parts:
                totals[i] += sum(encode([pieces_with_blanks(part)])[0])
        else:
            for i, counts in zip(group, encode([pieces_with_blanks(p) for _, p in parts]), strict=True):
                totals[i] = sum(counts)
    return totals


def id_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, for tokenizers that drop white space."""
    encode = packer(path)
    for group in groups_of(texts):
        parts = [(i, part) for i in group for part in stretches(texts[i])]
        if len(parts) > len(group):
            for i in group:
                yield b"".join(
                    b"".join(encode([pieces_without_blanks(part)])[0]) for part in stretches(texts[i])
                )
        else:
            for values in encode([pieces_without_blanks(p) for _, p in parts]):
                yield b"".join(values)
