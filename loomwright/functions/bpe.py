"""Byte-pair encoding of a table: frequent words are merged once in the cluster, rare ones where they are."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomwright.functions.tokenizer import tidy
from loomwright.session import bounded, durable, ship

#: How the vocabulary cuts a text into words (a fixed pattern): contractions, runs of letters, single digits, runs of others.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Words whose ids are sent to every executor, the most frequent first (about 40 MB); and how many of the rarer ones a
#: task remembers.
BROADCAST_WORDS, KNOWN_WORDS = 200_000, 100_000


@dataclass(frozen=True)
class Merges:
    """Ranks of the pairs that are merged, ids of the pieces, the end of a word, and the ids of special tokens."""

    rank: dict[tuple[str, str], int]
    ids: dict[str, int]
    end: str
    special: dict[str, int]

    def merge(self, word: str) -> list[int]:
        """A word's ids: neighbours of the lowest rank are merged first, the leftmost of equal ones. Pieces are a linked list, and a
        heap holds the pairs to merge, so that a word of n bytes takes n log n steps."""
        letters = [_BYTES[b] for b in word.encode()]
        if not letters:
            return []
        letters[-1] += self.end
        n = len(letters)
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, letters[i], letters[i + 1]) for i in range(n - 1) if (r := self.rank.get((letters[i], letters[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = behind[i] if letters[i] is not None else -1
            if j < 0 or letters[i] != left or letters[j] != right:
                continue  # one of them has been merged since
            letters[i], letters[j] = left + right, None
            behind[i] = behind[j]
            if behind[i] >= 0:
                before[behind[i]] = i
            for x, y in ((before[i], i), (i, behind[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((letters[x], letters[y]))) is not None:
                    heapq.heappush(heap, (r, x, letters[x], letters[y]))
        return [self.ids[p] for p in letters if p is not None]

    def word(self, word: str) -> list[int]:
        """A word's ids, or the id of a special token."""
        return [self.special[word]] if word in self.special else self.merge(word)


def _alphabet() -> dict[int, str]:
    """The printable character of each byte: its own where Latin-1 has one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _alphabet()


@lru_cache(2)
def load_merges(path: str) -> Merges:
    """The merges of a vocabulary file of the tokenizers library, of kind BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Merges({p: i for i, p in enumerate(pairs)}, model["vocab"], model.get("end_of_word_suffix") or "", {t["content"]: t["id"] for t in spec["added_tokens"]})


def cut_words(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """The words of a text: references decoded twice, white space as one space, composed, lower-cased, and cut by the pattern; special
    tokens are words of their own."""
    if not special:
        return regex.findall(WORDS, unicodedata.normalize("NFC", tidy(text)).lower())
    out = []
    for part in regex.split(f"({'|'.join(map(regex.escape, special))})", tidy(text)):
        out += [part] if part in special else regex.findall(WORDS, unicodedata.normalize("NFC", part).lower())
    return out


def encode_table(docs: DataFrame, path: str, text_col: str = "text", into: str = "ids", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` with ``into``, an array of the ids of its text under the vocabulary file at ``path`` (null for a null text; a column of
    that name is replaced).

    Texts are cut once and written with their words. Distinct words are counted where they are, and the ``broadcast_words`` most
    frequent are merged once each in the cluster; their ids go to all tasks. Rarer ones, which occur a few times each, are merged where
    they are, and each task remembers up to KNOWN_WORDS of them. So texts are never shuffled or put together again, and words only
    as counts. The file has to be where tasks can read it.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in docs.columns if c != into]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = bounded(docs.select(F.struct(*[quoted(c) for c in keep]).alias("kept"), quoted(text_col).alias("text")))
    kept = rows.schema["kept"]

    def words(batches: Iterator[pa.RecordBatch]):
        special = tuple(load_merges(path).special)
        for b in batches:
            found = [None if t is None else cut_words(t, special if any(s in t for s in special) else ()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["kept", "words"])

    def merged(batches: Iterator[pa.RecordBatch]):
        m = load_merges(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(m.word, b.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])

    cut = durable(rows.mapInArrow(words, StructType([kept, StructField("words", ArrayType(StringType()))])), "words")
    shared = spark.sparkContext.broadcast({})
    if broadcast_words:
        counted = cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        frequent = counted.orderBy(F.col("n").desc(), "word").limit(broadcast_words).select("word").repartition("word")
        found = frequent.mapInArrow(merged, "word string, ids array<int>").toArrow()
        shared = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in found.columns))))

    def known(batches: Iterator[pa.RecordBatch]):
        ids, m, rare = shared.value, load_merges(path), {}
        for b in batches:
            out = []
            for ws in b.column(1).to_pylist():
                own = None if ws is None else []
                for w in ws or ():
                    got = ids.get(w) or rare.get(w)
                    if got is None:
                        if len(rare) >= KNOWN_WORDS:
                            rare.clear()
                        got = rare[w] = m.word(w)
                    own += got
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["kept", "ids"])

    done = cut.mapInArrow(known, StructType([kept, StructField("ids", ArrayType(IntegerType()))]))
    return done.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("ids").alias(into))


def vocabulary_path(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers keep a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
