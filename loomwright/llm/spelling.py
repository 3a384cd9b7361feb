"""Spelling variants: all words one edit away are generated, met with a filter of the vocabulary, and joined to it by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, durable, named, prepare

#: The letters of a word (a range of code points, as the contract has it).
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Bits of the filter for each word of the vocabulary, its least and greatest size (2 kB to 64 MB), and its probes.
BITS_A_WORD, LEAST_BITS, MOST_BITS, PROBES = 24, 1 << 14, 1 << 29, 3
#: Words of more code points than this are looked up by whole hashes, of which so many are sent at most (8 MB).
LONG_WORD, LONG_WORDS = 64, 1_000_000
#: Neighbours that are hashed at a time, and bytes of generated words that a batch holds.
AT_ONCE, BATCH_BYTES = 1 << 20, 8 << 20

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 16


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words as one array of code points, with the hashes of all their beginnings: the sum of c_i * BASE^i modulo 2^64."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(self.size)
        self.cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(self.cp)) - (self.end - self.size)[self.word]
        self.power = _powers(int(self.size.max(initial=0)) + 2)
        term = self.cp * self.power[self.at]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        first = run[self.end - self.size]
        self.hash = run[self.end] - first
        self.before = run[:-1] - first[self.word]
        self.upto = self.before + term
        self.last = np.concatenate([np.zeros(1, np.uint64), self.cp])[:-1]  # the code point before, 0 at a word's beginning
        self.last[self.at == 0] = 0


def neighbours(w: Words, alphabet: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, words, places, letters, hashes): all distinct words that one deletion, replacement or insertion makes of each.

    Deleting any letter of a run of equal ones, or putting one more at any place in it, gives the same word; it is given once,
    for the first place.
    """
    first = w.cp != w.last
    gone = w.before + (w.hash[w.word] - w.upto) * _BASE_INVERSE
    yield "d", w.word[first], w.at[first], np.zeros(int(first.sum()), np.uint64), gone[first]
    step = max(1, at_once // max(len(alphabet), 1))
    for lo in range(0, len(w.cp), step):
        cut = slice(lo, lo + step)
        h = w.hash[w.word[cut], None] + (alphabet[None, :] - w.cp[cut, None]) * w.power[w.at[cut], None]
        i, a = np.nonzero(alphabet[None, :] != w.cp[cut, None])
        yield "r", w.word[cut][i], w.at[cut][i], alphabet[a], h[i, a]
    # insertions: before each code point, and behind the last
    word, at = np.concatenate([w.word, np.arange(len(w.size))]), np.concatenate([w.at, w.size])
    before = np.concatenate([w.before, w.hash])
    last = np.concatenate([w.last, np.where(w.size > 0, np.concatenate([w.cp, np.zeros(1, np.uint64)])[w.end - 1], np.uint64(0))])
    rest = (w.hash[word] - before) * _BASE + before
    for lo in range(0, len(word), step):
        cut = slice(lo, lo + step)
        h = rest[cut, None] + alphabet[None, :] * w.power[at[cut], None]
        i, a = np.nonzero(alphabet[None, :] != last[cut, None])
        yield "i", word[cut][i], at[cut][i], alphabet[a], h[i, a]


def made(word: str, kind: str, at: int, letter: int) -> str:
    return word[:at] + (word[at + 1 :] if kind == "d" else chr(letter) + word[at + (kind == "r") :])


def _places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * (_MIX + np.uint64(2 * probe * 0x1000193))
    return (x ^ (x >> np.uint64(29))) % np.uint64(bits)


class Filter:
    """A Bloom filter of the vocabulary's hashes, and whole hashes of its long words (None where they are too many)."""

    def __init__(self, bits: int, packed: np.ndarray, long: np.ndarray | None):
        self.bits, self.packed, self.long = bits, packed, long

    def meets(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places in ``h`` whose words may be in the vocabulary; ``size`` is their length."""
        left = np.arange(len(h))
        for probe in range(PROBES):
            p = _places(h[left], self.bits, probe)
            left = left[(self.packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if self.long is not None:
            long = size[left] > LONG_WORD
            if long.any():
                x = h[left]
                spot = np.searchsorted(self.long, x)
                known = spot < len(self.long)
                known[known] = self.long[spot[known]] == x[known]
                left = left[~long | known]
        return left


def _filter(vocabulary: DataFrame, count: int) -> Filter:
    """Tasks hash words and set bits; pieces of 8 kB are put together by number, so that the driver gets the filter and no more:
    64 MB at most, whatever the vocabulary."""
    bits = LEAST_BITS
    while bits < min(BITS_A_WORD * count, MOST_BITS):
        bits *= 2

    def spots(batches):
        for b in batches:
            if b.num_rows:
                h = Words(b.column(0).to_pylist()).hash
                p = np.concatenate([_places(h, bits, i) for i in range(PROBES)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p // _PIECE), pa.array(p % _PIECE)], ["piece", "spot"])

    def packed(batches):
        held, at = None, None
        for b in batches:
            pieces, spot = b.column(0).to_numpy(), b.column(1).to_numpy()
            for n in np.unique(pieces).tolist():
                if n != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["piece", "b"])
                    at, held = n, np.zeros(min(_PIECE, bits), bool)
                held[spot[pieces == n]] = True
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["piece", "b"])

    def hashes(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(Words(b.column(0).to_pylist()).hash.astype(np.int64))], ["h"])

    words = vocabulary.select("word")
    pieces = words.mapInArrow(spots, "piece long, spot long").repartition("piece").sortWithinPartitions("piece").mapInArrow(packed, "piece long, b binary")
    full = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        part = np.frombuffer(r.b, np.uint8)
        full[r.piece * _PIECE // 8 :][: len(part)] = part
    long = words.where(F.length("word") > LONG_WORD).limit(LONG_WORDS + 1).mapInArrow(hashes, "h long").toArrow().column(0).to_numpy()
    return Filter(bits, full, np.unique(long.astype(np.uint64)) if len(long) <= LONG_WORDS else None)


def _candidates(vocabulary: DataFrame, found: Filter, letters: str) -> DataFrame:
    """(word, near): generated neighbours that pass the filter. Long words and texts of any number are met in batches of bounded
    size."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(found)
    alphabet = np.array([ord(c) for c in letters], np.uint64)

    def emit(batches):
        test = shared.value
        for b in batches:
            words, lo = b.column(0).to_pylist(), 0
            while lo < len(words):
                hi, size = lo, 0
                while hi < len(words) and (hi == lo or size + len(words[hi]) <= AT_ONCE // 64):
                    size += len(words[hi])
                    hi += 1
                yield from pairs(words[lo:hi], test)
                lo = hi

    def pairs(words, test):
        w, left, right, held = Words(words), [], [], 0
        for kind, word, at, letter, h in neighbours(w, alphabet):
            longer = {"d": -1, "r": 0, "i": 1}[kind]
            for j in test.meets(h, w.size[word] + longer).tolist():
                x = words[word[j]]
                left.append(x)
                right.append(made(x, kind, int(at[j]), int(letter[j])))
                held += len(x) + len(right[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["word", "near"])
                    left, right, held = [], [], 0
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["word", "near"])

    return vocabulary.select("word").mapInArrow(emit, "word string, near string")


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97) -> DataFrame:
    """(word) for each run of letters, A-Z lower-cased; where ``noise`` divides the crc32 h of ``<id>:<run>``, the run without its
    code point h % length (a null id is empty there). ``noise`` of 0 leaves runs alone."""
    text = F.regexp_extract_all(_lower(named(text_col)), F.lit(LETTERS), F.lit(0))
    runs = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("d"), F.explode(text).alias("w"))
    if not noise:
        return runs.select(F.col("w").alias("word"))
    runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    cut = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), cut), F.substring("w", cut + 2, F.length("w")))
    return runs.select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("w")).alias("word"))


def group_variants(words: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, max_rounds: int = 64) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long) for each word of at least ``min_chars`` code points and ``min_count``
    occurrences in ``words`` (word).

    Two words are near if one insertion, deletion or replacement of a code point makes one of the other. ``form`` is the near
    word of most occurrences (ties: the smallest by code points), if it has ``ratio`` times the word's; ``root`` is where
    following forms from a word ends. ``ratio`` is at least 2, so that forms have no circles. Null words don't count; no words
    give an empty table. Words in a script of other letters work as well: the alphabet is what the vocabulary holds.

    Occurrences are added up before they are shuffled. Every neighbour over the alphabet is generated and hashed from the
    hashes of a word's beginnings, without building it. Only those that meet the vocabulary's Bloom filter, which is
    broadcast and at most 64 MB, become words and are joined to the vocabulary; equality is all that is asked of them.
    Roots are found by doubling: a word's root is its root's root.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 allows circles of forms")
    prepare(words.sparkSession)
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    vocabulary = durable(counted, "vocabulary")
    count = vocabulary.count()
    letters = "".join(sorted(r.c for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()))
    near = _candidates(vocabulary, _filter(vocabulary, count), letters)
    # the vocabulary's counts join both sides by equality; repeats cannot occur, as neighbours are distinct
    links = near.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), F.col("near").alias("w"))).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    good = -F.col("best.o") >= F.lit(ratio) * F.col("n")
    forms = durable(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.o")).alias("form_n")), "forms")
    jumps = durable(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "jumps")
    for _ in range(max_rounds):
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = durable(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        moved = doubled.where("moved").limit(1).count()
        discard(jumps)
        jumps = doubled
        if not moved:
            break
    out = forms.join(jumps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
