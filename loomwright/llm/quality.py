"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio of trusted text against the corpus."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import durable, named, pack, prepare, raw, unpack

#: Buckets of the n-gram multinomials; the model that is sent to the executors has as many doubles.
BUCKETS = 1 << 16
#: Trusted ids up to which they are sent to every executor (about 50 MB); more are joined.
BROADCAST_IDS = 500_000
#: A document is kept if its mean log ratio for an n-gram is at least this.
THRESHOLD = -0.35

_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(words: list[bytes], seed: int = 1) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(seed)
    h *= _ODD
    h ^= h >> np.uint64(29)
    return h * _MIX


def ngram_buckets(words: list[bytes], h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a document's words, pairs of neighbouring words, and word endings of three bytes."""
    pairs = h[:-1] * _ODD + h[1:]
    pairs ^= pairs >> np.uint64(31)
    pairs[h[:-1] == h[1:]] = 0  # a word twice in a row counts as one kind of pair
    every = np.concatenate([h, pairs * _MIX, _hashes([w[-3:] for w in words], 1 << 33)])
    return ((every >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _windows(words: list[bytes], window: int) -> np.ndarray:
    """A number for each window of ``window`` words, equal for equal windows alone: numbers of words, then of pairs of windows of
    half the length (they overlap where the length is no power of two)."""
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        step = min(size, window - size)
        at = np.unique(at[:-step] * (int(at.max()) + 1) + at[step:], return_inverse=True)[1]
        size += step
    return at


def repeat_words(words: list[bytes], h: np.ndarray, window: int = _WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included. ``h`` are hashes of the
    words: a text of whose windows no two have equal hashes has none; any other is compared word for word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    w = h[:n].copy()
    for j in range(1, window):
        w *= _ODD
        w += h[j : j + n]
    w.sort()
    if not (w[1:] == w[:-1]).any():
        return 0
    at = _windows(words, window)
    twice = np.bincount(at)[at] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words, h),
    )


@dataclass(frozen=True)
class Model:
    """N-gram counts of all documents and of the trusted ones, by bucket."""

    every: np.ndarray
    trusted: np.ndarray

    def ratio(self, b: np.ndarray, trusted: bool) -> float:
        """The mean log-likelihood ratio of a document's n-grams, trusted multinomial to corpus multinomial.

        The document itself is left out of both, so that its own rare words don't count against it where the corpus is
        small. Corpus counts are smoothed by one and trusted counts by the trusted share of all n-grams, so that a
        bucket in which trusted text is as frequent as elsewhere has 0 however rare it is.
        """
        total, good, size = self.every.sum(), self.trusted.sum(), len(self.every)
        if not len(b) or not good:
            return 0.0
        share = good / total
        own = np.bincount(b, minlength=size)[b]
        every = np.maximum(self.every[b] - own, 0) + 1
        kept = np.maximum(self.trusted[b] - own * trusted, 0) + share
        sums = np.log(max(good - trusted * len(b), 0) + share * size) - np.log(max(total - len(b), 0) + size)
        return float((np.log(kept) - np.log(every)).mean() - sums)


def mark_trusted(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows`` (with a column ``d``, the id) and a boolean ``good``: whether the id is among ``trusted`` (column ``doc``).

    The ids are written and counted: up to BROADCAST_IDS they go to every executor, about 100 bytes each, and texts don't move;
    beyond, rows are joined by id.
    """
    ids = durable(trusted.select(F.col("doc").cast("long").alias("known")).where("known IS NOT NULL").distinct(), "trusted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col("d") == F.col("known"), "left").withColumn("good", F.col("known").isNotNull()).drop("known")


def fit(rows: DataFrame, buckets: int = BUCKETS) -> Model:
    """Counts over every whole document of ``rows`` (t binary, good boolean); each task sends one row for a bucket at most."""

    def count(batches):
        of, trusted_of = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            parts = {False: [], True: []}
            for good, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = t.split()
                parts[good].append(ngram_buckets(words, _hashes(words), buckets))
            for trust, xs in parts.items():
                if xs:
                    c = np.bincount(np.concatenate(xs), minlength=buckets)
                    of += c
                    if trust:
                        trusted_of += c
        at = np.flatnonzero(of)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of[at]), pa.array(trusted_of[at])], ["b", "n", "t"])

    found = rows.select("good", "t").mapInArrow(count, "b long, n long, t long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    of, trusted_of = np.zeros(buckets), np.zeros(buckets)
    for r in found:
        of[r.b], trusted_of[r.b] = r.n, r.t
    return Model(of, trusted_of)


def score_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The input's columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), llr (double),
    base_failed and kept (boolean); such names in the input are replaced.

    ``llr`` is the mean over a document's n-grams (words, pairs of words, word endings) of the log ratio, the document
    itself left out of the counts; a document without words, and all where nothing is trusted, have 0.
    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. kept: not base_failed, and llr at
    least ``threshold``. ``trusted`` holds ids in a column ``doc``, all of which count. Nulls are empty texts, which
    fail; repeated rows are counted and scored each; a null id is never trusted. An empty table gives an empty table.
    The text is read twice, and never shuffled while the trusted ids can be broadcast.
    """
    prepare(docs.sparkSession)
    marked = mark_trusted(pack(docs, t=raw(text_col), d=named(id_col).cast("long")), trusted)
    model = docs.sparkSession.sparkContext.broadcast(fit(marked, buckets))
    fields = [*[T.StructField(c, T.LongType()) for c in BASE_FIELDS], T.StructField("llr", T.DoubleType())]

    @F.arrow_udf(T.StructType(fields))
    def judge(text: pa.Array, good: pa.Array) -> pa.Array:
        rows, m = [], model.value
        for t, g in zip(text.to_pylist(), good.to_pylist()):
            words = t.split()
            h = _hashes(words)
            llr = m.ratio(ngram_buckets(words, h, buckets), g)
            rows.append((*base_counts(t, words, h), llr))
        cols = zip(*rows) if rows else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(cols)], [f.name for f in fields])

    rows = marked.withColumn("q", judge("t", "good"))
    failed = base_failed(F.col("q.n_words"), F.col("q.n_repeat_words"))
    add = {f.name: F.col("q")[f.name] for f in fields}
    return unpack(rows, docs, add=add | {"base_failed": failed, "kept": ~failed & (F.col("q.llr") >= threshold)})


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that the labels call good."""
    return labels.where("quality = 1").select(F.col("doc_id").alias("doc"))
