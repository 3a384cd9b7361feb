"""n-grams of a row's texts in numpy: exact counts within the row, and 80-bit keys by which rows agree on them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").split(" ") if w]


@lru_cache(1 << 18)
def _word_key(word: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(word)
    return d >> 64, d & (1 << 64) - 1


def counts(texts: list[list[str]], most: int, number: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, table, first) for n up to ``most``: how often each distinct n-gram is in each text (texts x n-grams), and a place
    of each among the words of all texts. n-grams are numbered by pairs of the numbers before, so equal numbers are equal words.
    ``number``, an empty dict, takes the numbers of the words."""
    number = {} if number is None else number
    w = np.array([number.setdefault(x, len(number)) for t in texts for x in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    text, end = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    at, g = np.arange(len(w)), w
    for n in range(1, most + 1):
        if n > 1:
            ok = at + n <= end[at]
            at, g = at[ok], g[ok] * (len(number) + 1) + w[at[ok] + n - 1]
        distinct, first, g = np.unique(g, return_index=True, return_inverse=True)
        table = np.bincount(text[at] * len(distinct) + g, minlength=len(texts) * len(distinct)).reshape(len(texts), len(distinct))
        yield n, table, at[first]


def keyed(texts: list[list[str]], most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(tables, hi, lo): the tables of counts(), and keys of 64 and 16 bits for their n-grams, one table after the other."""
    number: dict[str, int] = {}
    lanes, tables, hi, lo = None, [], [], []
    for n, table, first in counts(texts, most, number):
        if lanes is None:
            keys = [_word_key(x) for x in number]
            at = np.array([number[x] for t in texts for x in t], np.int64)
            lanes = [np.array([k[i] for k in keys], np.uint64)[at] for i in (0, 1)]
        made = []
        for lane, odd in zip(lanes, _ODD):
            h = np.full(len(first), n, np.uint64)
            for i in range(n):
                h = (h ^ lane[first + i]) * odd
                h ^= h >> np.uint64(32)
            made.append(h)
        tables.append(table)
        hi.append(made[0])
        lo.append((made[1] >> np.uint64(16)).astype(np.uint16))
    return tables, np.concatenate(hi), np.concatenate(lo)


def distinct_keys(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the order that sorts keys, and for each of them, in that order, the number of its distinct key."""
    order = np.lexsort((lo, hi))
    h, x = hi[order], lo[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    return order, np.cumsum(new) - 1


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distinct): the distinct values, and the place of each value among them."""
    d = pa.array(x).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_numpy()


def _mixed(h: np.ndarray, lane: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ lane) * odd
    return h ^ (h >> np.uint64(32))


def split_words(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words, sizes): the words of all texts behind each other, and how many each has."""
    split = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
    flat, text = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = pc.not_equal(flat, "")
    return flat.filter(full).dictionary_encode(), np.bincount(text[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _lanes(words: pa.LargeStringArray) -> np.ndarray:
    """Two numbers of 64 bits for each word."""
    if not len(words):
        return np.zeros((2, 0), np.uint64)
    _, ends, data = words.buffers()
    at, data = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1].tolist(), data.to_pybytes() if data else b""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(at, at[1:])]), ">u8").astype(np.uint64).reshape(-1, 2).T


class Grams:
    """The n-grams, for n up to ``most``, of texts whose words (see split_words) stand behind each other.

    Entries (gram, text, n - 1, count) are sorted by n-gram and text; equal numbers are equal words. ``hi`` and ``lo`` are keys of
    64 and 16 bits of the n-grams, by number. All is done for all texts at once, with no loop over texts or words but one
    over different words.
    """

    def __init__(self, words: pa.DictionaryArray, sizes: np.ndarray, most: int):
        w, known, texts = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1), max(len(sizes), 1)
        text, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
        lanes = _lanes(words.dictionary)
        keys = [_mixed(np.ones(len(words.dictionary), np.uint64), lane, odd) for lane, odd in zip(lanes, _ODD)]
        at, g, total, made = np.arange(len(w)), w, 0, []
        for n in range(1, most + 1):
            if n > 1:
                ok = at + n <= end[at]
                at, g = at[ok], g[ok]
                g, pairs = _numbered(g * known + w[at + n - 1])
                before = pairs // known
                keys = [_mixed(k[before], lane[pairs - before * known], odd) for k, lane, odd in zip(keys, lanes, _ODD)]
            own = np.sort(g * texts + text[at])
            start = np.flatnonzero(np.diff(own, prepend=-1))
            count = np.diff(start, append=len(own)).astype(np.int32)
            own = own[start]
            gram = own // texts
            made.append(((gram + total).astype(np.int32), (own - gram * texts).astype(np.int32), np.full(len(own), n - 1, np.int8), count, keys[0], (keys[1] >> np.uint64(48)).astype(np.uint16)))
            total += len(keys[0])
        self.gram, self.text, self.n, self.count, self.hi, self.lo = (np.concatenate(x) for x in zip(*made))


def sorted_keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The order that sorts keys by ``hi``, and by ``lo`` where those are equal."""
    order = np.argsort(hi, kind="stable")
    h, x = hi[order], lo[order]
    return np.lexsort((lo, hi)) if ((h[1:] == h[:-1]) & (x[1:] < x[:-1])).any() else order


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Sorted numbers of 64 bits as their differences, byte by byte: the lowest bytes as they are, those above compressed."""
    planes = np.ascontiguousarray(np.diff(numbers, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return planes[0].tobytes() + zlib.compress(planes[1:].tobytes(), 1)


def unpack_sorted(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(packed[:n] + zlib.decompress(packed[n:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
