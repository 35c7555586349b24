"""Token ids of whole texts by a public byte-level BPE file, with ids of frequent words remembered.

The ids are those of ``tokenizers`` for the same file, strings of added tokens included. Byte-level BPE never merges across the pieces of its splitting pattern, so a text without
runs of white space is cut at single spaces and line feeds, and each distinct word is encoded once
per worker. A word seen for the first time is cut by the pattern, and its pieces are remembered too:
words repeat more without their punctuation. Any other text, and one that holds an added token, goes through
the tokenizer whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: The splitting pattern of byte-level BPE, and the bytes that stand for themselves in its alphabet.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Character classes of all Unicode versions agree up to here.
LAST_PLAIN = "\u024f"
SENTENCE_MARKS = ".,;:!?"
WHITE_RUN = re.compile(r"\s\s")
MAX_WORDS = 600_000
MAX_PIECES = 300_000
ID_BYTES = 4


class _Words(dict):
    """Ids by word; a word that is looked up for the first time is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        return self.encode(word)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.words = _Words(self._word)
        self.pieces: dict[str, bytes] = {}
        self.max_words = max_words
        others = (b for b in range(256) if b not in PRINTABLE)
        self.letters = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(others)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(ID_BYTES, "little") for t in self.tokenizer.model.tokenize(spelled)])
        if len(self.pieces) < MAX_PIECES:
            self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """A word that follows a space, or a line feed and the word after it."""
        line = word.startswith("\n")
        text, body = (word, word[1:]) if line else (" " + word, word)
        if max(text) > LAST_PLAIN:
            ids = self._whole(text)
        else:
            if body.isalpha():
                cut = [text[-len(body) - (not line) :]]
            elif body and body[-1] in SENTENCE_MARKS and body[:-1].isalpha():
                cut = [text[-len(body) - (not line) : -1], body[-1]]
            else:
                line, cut = False, SPLIT.findall(text)
            known, new = self.pieces.get, self._piece
            ids = b"".join([known(p) or new(p) for p in (["\n", *cut] if line else cut)])
        if len(self.words) < self.max_words:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if WHITE_RUN.search(text) or self.holds_added(text):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self._whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
