"""Exact token ids of whole texts through the tokenizers library, with each distinct piece of text encoded once."""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

#: Distinct pieces that one worker remembers; then it starts anew (about 150 MB). Longer pieces than this are never kept, so
#: that a number of pieces bounds the bytes.
CACHE_PIECES = 600_000
CACHE_PIECE_BYTES = 64

_BYTE_PIECE = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
#: White space outside space and \t to \r: a byte-level text that has any is encoded as a whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
#: First bytes that such characters can have in UTF-8.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1[\x9a\xa0]|\xe2[\x80\x81]|\xe3\x80|\xef\xbb")
_ODD_BYTES = b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef"
#: Pieces of ASCII and Latin letters, in which lower-casing and composing are the same everywhere.
_PLAIN = re.compile("[ -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131\u0139-\u0148\u014a-\u017e]+")
#: How the two vocabularies' own pre-tokenizers cut such a piece (fixed patterns, with \w for letters and digits).
_LETTERS = "[^\\W\\d_]"
_WORD_PARTS = f"'s|'t|'re|'ve|'m|'ll|'d|{_LETTERS}+|\\d|(?:[^\\s\\w]|_)+"
_BYTE_PARTS = f"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTERS}+| ?\\d+| ?(?:[^\\s\\w]|_)+"


#: The two ways of cutting a text that are known here, as the vocabulary files state them (fixed values).
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_KNOWN = {
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL, "use_regex": False}],
        },
    ),
    "bytes": (None, {**_BYTE_LEVEL, "use_regex": True}),
}


def cutting(spec: dict) -> str:
    """Where the tokenizer of a file may be cut: at white space ("words"), as the byte-level pattern cuts next to it
    ("bytes"), or nowhere that is known here ("whole")."""
    exact = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("ignore_merges")
    plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    way = [k for k, v in _KNOWN.items() if v == (spec["normalizer"], spec["pre_tokenizer"])]
    return way[0] if way and exact and plain else "whole"


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, equal to those of ``tokenizers`` for each whole text with
    add_special_tokens=False, the file as it is: the text of an added token in a document becomes that token's id.

    Texts are cut where no token can cross: at white space for a vocabulary that drops it, or as the byte-level pattern
    cuts next to ASCII white space. A new piece of plain letters goes straight to the tokenizer's model, without its
    offset bookkeeping; any other goes through the whole tokenizer. Whole texts go through it where an added token
    stands in them, and all texts where the file cuts in a way that is not known here. ``added_as_text`` makes the
    library read added tokens as ordinary text instead.
    """

    def __init__(self, path: str, added_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = added_as_text
        self.tokenize = self.tok.model.tokenize
        self.cuts = cutting(spec)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.bytes_level = self.cuts == "bytes"
        self.parts = re.compile(_BYTE_PARTS if self.bytes_level else _WORD_PARTS)
        self.alphabet = byte_alphabet()
        self.space = chr(self.alphabet[32])
        self.cache: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in ".,"} if self.cuts != "whole" else {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, part: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's model."""
        mapped = part.replace(" ", self.space) if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.tokenize(mapped)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        packed = self._ids(part)
        if len(part) <= CACHE_PIECE_BYTES:
            self.known[part] = packed
        return packed

    def _letters(self, word: bytes, text: str) -> bytes:
        """Ids of letters alone, behind a space in a byte-level vocabulary; other cases of a word share those of its lower case."""
        if not self.bytes_level and not text.islower():
            text = text.lower()
            word = text.encode()
            if ids := self.cache.get(word):
                return ids
        ids = self._ids(text)
        if len(word) <= CACHE_PIECE_BYTES:
            self.cache[word] = ids
        return ids

    def _piece(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        # most new words are letters alone, or with a comma or period behind them
        mark = self.marks.get(text[-1])
        core = text if mark is None else text[:-1]
        letters = core[1:] if self.bytes_level and core[:1] == " " else core
        if letters.isalpha() and (letters.isascii() or _PLAIN.fullmatch(letters)):
            if mark is None:
                return self._letters(word, core)
            word = word[:-1]
            return (self.cache.get(word) or self._letters(word, core)) + mark
        if text[-1] == " " or not _PLAIN.fullmatch(text):
            return self._plain(text)
        parts = self.parts.findall(text if self.bytes_level else text.lower())
        known = self.known
        return b"".join([known.get(p) or self._part(p) for p in parts])

    def _is_odd(self, t: bytes) -> bool:
        """Whether a byte-level text has white space beside space and \\t to \\r."""
        return len(t.translate(None, _ODD_BYTES)) < len(t) and _ODD_SPACE.search(t) is not None and _OTHER_SPACE.search(t.decode("utf-8", "replace")) is not None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        cache, out, words = self.cache, [], self.cuts == "words"
        for t in texts:
            if self.cuts == "whole" or any(a in t for a in self.added) or not words and self._is_odd(t):
                out.append(self._plain(t.decode("utf-8", "replace")))
                continue
            ws = t.split() if words else _BYTE_PIECE.findall(t)
            got = list(map(cache.get, ws))
            if None in got:
                i = -1
                try:
                    while True:
                        i = got.index(None, i + 1)
                        w = ws[i]
                        ids = cache.get(w)
                        if ids is None:
                            ids = self._piece(w)
                            if len(w) <= CACHE_PIECE_BYTES:
                                cache[w] = ids
                        got[i] = ids
                except ValueError:  # no place left without ids
                    pass
                if len(cache) > CACHE_PIECES:
                    cache.clear()
                if len(self.known) > CACHE_PIECES:
                    self.known.clear()
            out.append(b"".join(got))
        return out


def byte_alphabet() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 ones stand for
    themselves, the others follow from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(4)
def encoder(path: str, added_as_text: bool = False) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, added_as_text)


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
