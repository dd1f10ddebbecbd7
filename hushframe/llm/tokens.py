"""Token ids of whole texts, as little-endian 32-bit bytes, with a bounded cache of chunks.

A text is cut at places where the tokenizer itself always cuts, so the ids of the text
are those of its chunks in a row; a chunk that was met before is not tokenised again.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
from collections.abc import Callable

# Chunks kept, in two halves: when the newer one is full, the older one goes.
CACHE_CHUNKS = 1_000_000

WORD_CUT = re.compile(r"[ \n\t\r]+")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# A word and the marks after it, which are pieces of their own.
WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?|*%$#&]+)\Z")


def public_path(name: str) -> str:
    """Where the file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


# An optional leading space and letters that lower-casing and normal form C map one to one.
PLAIN_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
# The same with the marks after it: most of what is met for the first time.
PLAIN_WORD_AND_MARKS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*%$#&]*)\Z")
# The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [byte for byte in range(256) if byte not in _PRINTABLE]
BYTE_CHARS = {byte: byte for byte in _PRINTABLE} | {byte: 256 + n for n, byte in enumerate(_OTHERS)}
SPACE_CHAR = chr(BYTE_CHARS[32])


_FORMATS = [f"<{n}I" for n in range(32)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    n = len(ids)
    return struct.pack(_FORMATS[n] if n < len(_FORMATS) else f"<{n}I", *ids)


class OddSpace(Exception):
    """A chunk between two spaces that is empty or touches more white space."""


class Chunks(dict):
    """Ids of chunks; those of a chunk that is not in here are worked out as it is looked up, so a text is gone through once."""

    def __init__(self, new: Callable[[str], bytes]):
        self.new = new

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = self.new(key)
        return ids


class ChunkEncoder:
    """Ids of texts by the tokenizers library, chunk by chunk.

    ``word_ends``: the vocabulary drops white space, so any space cuts.  Otherwise
    (byte-level) a text is cut before each single space between two characters
    that are no white space, where a new piece always begins, and around a single
    line end between two such characters, which is a piece of its own.  A text that
    holds the string of a special token goes to the library as it is, which gives
    that token for it.

    The cache holds, per chunk between two spaces, the ids it has after a space;
    under ``" " + part``, those of a part that no space precedes.
    """

    def __init__(self, path: str, word_ends: bool, end_id: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_ends = word_ends
        self.end = b"" if end_id is None else packed([end_id])
        self.cache = Chunks(self.new)
        self.older: dict[str, bytes] = {}

    def _word(self, key: str) -> bytes:
        """Ids of a plain word: it is one piece, so it can go to the model without the cutting."""
        word = key.lower() if self.word_ends else key if key[0] == " " else " " + key
        if key[0] == " ":
            word = word[1:]
        if word.isascii():  # letters stand for themselves
            word = word.replace(" ", SPACE_CHAR)
        else:
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        return packed([token.id for token in self.tokenize(word)])

    def _piece(self, key: str) -> bytes:
        """Ids of a chunk that is not cut any further, from the cache or new."""
        ids = self.cache.get(key)
        if ids is None:
            if PLAIN_WORD.match(key):
                ids = self._word(key)
            else:
                text = key[1:] if key[0] == " " else key if self.word_ends else " " + key
                ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            self.cache[key] = ids
        return ids

    def _parts(self, key: str) -> list[str]:
        """The keys whose ids in a row are those of ``key``."""
        bare, first = (key[1:], " ") if key[:1] == " " else (key, "")
        if self.word_ends:
            lines = [line for line in WORD_CUT.split(bare) if line]
            starts = [""] * len(lines)
        else:
            if not bare or bare[0].isspace() or bare[-1].isspace():
                raise OddSpace
            lines = bare.split("\n")
            if any(not line or line[0].isspace() or line[-1].isspace() for line in lines):
                return [key]
            starts = [first, *[" "] * (len(lines) - 1)]
        out: list[str] = []
        for at, (line, start) in enumerate(zip(lines, starts, strict=True)):
            if at and not self.word_ends:
                out.append(" \n")
            match = WORD_AND_MARKS.match(line)
            out.extend([start + match[1], " " + match[2]] if match else [start + line])
        return out

    def new(self, key: str) -> bytes:
        """Ids of a chunk that is not in the newer half of the cache."""
        ids = self.older.get(key)
        if ids is not None:
            return ids
        if key.isalpha() and key.isascii():  # most of them; letters stand for themselves
            return packed([token.id for token in self.tokenize(key.lower() if self.word_ends else SPACE_CHAR + key)])
        match = PLAIN_WORD_AND_MARKS.match(key)
        if match is None:
            parts = self._parts(key)
            return b"".join(map(self._piece, parts))
        word, marks = match.groups()
        if not marks:
            return self._word(key)
        ids = self.cache.get(word) or self.older.get(word) or self._word(word)
        self.cache[word] = ids
        return ids + self._piece(" " + marks)

    def _look_up(self, keys: list[str]) -> bytes:
        if len(self.cache) > CACHE_CHUNKS // 2:
            self.older, self.cache = self.cache, Chunks(self.new)
        return b"".join(map(self.cache.__getitem__, keys))

    def _odd(self, text: str) -> bytes:
        """Ids of a text with other white space than single spaces and line ends; only what is safe is cached."""
        out: list[bytes] = []
        for at, chunk in enumerate(SINGLE_SPACE.split(text)):
            if chunk and " " not in chunk and not chunk[0].isspace() and not chunk[-1].isspace():
                out.append(self._look_up([chunk if at else " " + chunk]))
            else:
                ids = self.tokenizer.encode(" " + chunk if at else chunk, add_special_tokens=False).ids
                out.append(packed(ids))
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text (null: empty) and the end id."""
        if not text:
            return self.end
        if any(special in text for special in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        chunks = text.split(" ")
        if self.word_ends:
            return self._look_up([chunk for chunk in chunks if chunk]) + self.end
        chunks[0] = " " + chunks[0]
        try:
            return self._look_up(chunks) + self.end
        except OddSpace:
            return self._odd(text) + self.end


def worker_encoder(path: str, word_ends: bool, end_id: int | None = 0) -> ChunkEncoder:
    """This worker process's encoder of a vocabulary; its cache serves the worker's later tasks as well."""
    kept = sys.modules.setdefault("_chunk_encoders", types.ModuleType("_chunk_encoders")).__dict__
    key = repr((path, word_ends, end_id, os.getpid()))
    if key not in kept:
        kept[key] = ChunkEncoder(path, word_ends, end_id)
    return kept[key]
