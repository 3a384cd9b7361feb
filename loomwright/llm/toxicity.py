"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import durable, named, pack, prepare, raw, unpack

#: Hashed features of one level.
DIMS = 1 << 18
#: Confirmed toxic documents that the classifiers are fitted on, at most; of more, the smallest by hash are taken.
MAX_POSITIVE = 3_000
#: Features that enter the classifiers, the best by gain; the share of the positives that must have one; and the gain, in standard
#: deviations, under which a difference of shares counts as chance. README has the results without the last two.
MAX_FEATURES, MIN_SHARE, MIN_GAIN = 800, 0.02, 4.0
#: Unlabelled documents of a group, about, and least number of groups: each has a classifier, whose weights are averaged.
GROUP_DOCUMENTS, LEAST_GROUPS = 10_000, 3
#: A document is predicted toxic from this score on.
THRESHOLD = 0.7

_BEGINNINGS = (5, 6, 7, 8)
#: A beginning that 1, 2 or 3 distinct words of a text share has as many features.
_LEVELS = 3
#: Distinct words whose features a worker remembers, and the longest of them in bytes.
_CACHE, _CACHE_BYTES = 400_000, 64
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_PACK = [struct.Struct(f"<{n}i").pack for n in range(len(_BEGINNINGS) + 2)]
#: Weights are summed over groups as whole multiples of this, so that no order of adding matters.
_UNIT = 2.0**-30


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Features:
    """Hashed features of texts: each distinct word and its beginnings, those shared by two distinct words, and by three.

    With ``wanted`` (sorted feature numbers) only those are looked for, and a text's features are places in ``wanted``.
    """

    def __init__(self, dims: int = DIMS, wanted: np.ndarray | None = None):
        self.dims, self.cache, self.place = dims, {}, None
        if wanted is not None:
            self.place = np.full(_LEVELS * dims, -1, np.int32)
            self.place[wanted] = np.arange(len(wanted))
            self.known = (self.place.reshape(_LEVELS, dims) >= 0).any(axis=0).tobytes()

    def _word(self, w: bytes) -> bytes:
        dims = self.dims
        ids = [zlib.crc32(w + b"$") % dims]
        ids += [zlib.crc32(w[:n]) % dims for n in _BEGINNINGS if len(w) >= n]
        if self.place is not None:
            ids = [i for i in ids if self.known[i]]
        return _PACK[len(ids)](*ids)

    def of(self, text: bytes) -> np.ndarray:
        """Feature numbers: below ``dims`` present, then for each further level of sharing as many."""
        cache, words = self.cache, list(set(text.translate(_KEEP).split()))
        got = list(map(cache.get, words))
        if None in got:
            i = -1
            try:
                while True:
                    i = got.index(None, i + 1)
                    got[i] = self._word(words[i])
                    if len(words[i]) <= _CACHE_BYTES:
                        cache[words[i]] = got[i]
            except ValueError:  # no place left without features
                pass
            if len(cache) > _CACHE:
                cache.clear()
        ids, n = np.unique(np.frombuffer(b"".join(got), "<i4"), return_counts=True)
        found = np.concatenate([ids, *(ids[n > k] + np.int32(k * self.dims) for k in range(1, _LEVELS))])
        if self.place is None:
            return found
        at = self.place[found]
        return np.sort(at[at >= 0])


def nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, weights: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, decay: float = 1e-3
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier of least non-negative PU risk under the logistic loss.

    The risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]); where the bracket is negative, the step
    goes up it instead, so that the model does not learn unlabelled positives as negatives. ``weights`` says how many
    documents an unlabelled row stands for. Adam over all rows, with an l2 penalty; the mean of the last third of the steps
    counts, as steps up the bracket and down the risk take turns.
    """
    many = np.ones(len(unlabelled)) if weights is None else weights.astype(float)
    rows = positive + unlabelled
    n = np.array([len(x) for x in rows])
    col, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
    is_p = np.arange(len(rows)) < len(positive)
    share = np.concatenate([np.full(len(positive), 1 / len(positive)), many / many.sum()])  # of a row in its mean
    w, b = np.zeros(size), math.log(prior / (1 - prior))
    m, v, mean, last = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), max(1, steps // 3)
    for t in range(1, steps + 1):
        g = np.bincount(row, w[col], len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        soft = np.logaddexp(0, g) * share  # l(-g)
        negative = soft[~is_p].sum() - prior * soft[is_p].sum()
        as_negative = np.where(is_p, -prior * s, s) * share
        slope = -as_negative if negative < 0 else as_negative + np.where(is_p, prior * (s - 1) * share, 0.0)
        grad = np.append(np.bincount(col, slope[row], size) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        if t > steps - last:
            mean += np.append(w, b) / last
    return mean[:-1], float(mean[-1])


@dataclass(frozen=True)
class Model:
    """Feature numbers in use, their weights, and the bias."""

    use: np.ndarray
    weights: np.ndarray
    bias: float


_NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), -10.0)


def _count(src: DataFrame, dims: int, wanted: Broadcast | None) -> DataFrame:
    """(f, n): how many rows have each (wanted) feature, summed over tasks, and their number as f = -1. A task sends one
    row for a feature that it saw."""

    def count(batches):
        made = Features(dims, wanted and wanted.value)
        of, n = np.zeros(_LEVELS * dims if wanted is None else len(wanted.value), np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                of[made.of(t)] += 1
            n += b.num_rows
        at = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(of[at], n))], ["f", "n"])

    return src.select("t").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _fit_groups(rows: DataFrame, positive: list[np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float, int]:
    """Sums of weights and biases over the classifiers of all groups of ``rows`` (g, f, n), and how many there are."""
    shared = rows.sparkSession.sparkContext.broadcast(positive)

    def fit(batches):
        total, fits = np.zeros(size + 1, np.int64), 0
        group, held, many = None, [], []

        def work():
            nonlocal total, fits
            if held:
                w, b = nnpu(shared.value, held, size, prior, np.array(many))
                total = total + np.round(np.append(w, b) / _UNIT).astype(np.int64)
                fits += 1

        for batch in batches:
            for g, f, n in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    work()
                    group, held, many = g, [], []
                held.append(np.frombuffer(f, "<u2").astype(np.int64))
                many.append(n)
        work()
        if fits:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([fits], pa.int64())], ["total", "fits"])

    total, fits = [0] * (size + 1), 0
    for r in rows.repartition("g").sortWithinPartitions("g", "f").mapInArrow(fit, "total array<long>, fits long").collect():  # one of each task
        total, fits = [a + b for a, b in zip(total, r.total)], fits + r.fits
    return np.array(total[:-1], float) * _UNIT, total[-1] * _UNIT, fits


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: int = DIMS,
    prior: float | None = None,
    max_positive: int = MAX_POSITIVE,
    max_features: int = MAX_FEATURES,
    min_share: float = MIN_SHARE,
    min_gain: float = MIN_GAIN,
    group_documents: int = GROUP_DOCUMENTS,
) -> Model:
    """The mean of the nnPU classifiers of all groups of unlabelled text, one for each group.

    ``labels`` has doc and toxic; rows held out must be gone from it. Positives are at most ``max_positive`` of the
    confirmed toxic documents, the smallest by hash; unlabelled text is every other document not held out, without a
    bound. Without a ``prior`` it is the toxic share of the labels given. Features are chosen by how much more positives
    have them than all unlabelled text does: at least ``min_share`` of the positives have one, its gain is over ``min_gain``, and the
    ``max_features`` best enter. Unlabelled documents are dealt into groups of about ``group_documents`` by
    a hash; those of a group with equal features are one weighted row before they are shuffled. Every group is fitted in
    one task together with the positives, and a task sends the sum of its groups' weights.
    """
    spark = docs.sparkSession
    known = labels.where("doc IS NOT NULL AND toxic IS NOT NULL").groupBy("doc").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return _NOTHING
    if prior is None:
        prior = min(max(toxic / total, 1e-3), 0.5)
    elif not 0 < prior < 1:
        raise ValueError(f"a prior of {prior} is no share between 0 and 1")
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc"), "doc").limit(max_positive).select("doc", F.lit(True).alias("p"))
    src = docs.select(named(id_col).cast("long").alias("doc"), raw(text_col).alias("t")).where(~held_out(F.col("doc")))
    src = src.join(F.broadcast(chosen), "doc", "left").select("doc", F.coalesce("p", F.lit(False)).alias("p"), "t")
    of_p = {r.f: r.n for r in _count(src.where("p"), dims, None).where("n >= 3 OR f = -1").toLocalIterator()}
    n_p = of_p.pop(-1, 0)
    wanted = np.array(sorted(f for f, n in of_p.items() if n >= min_share * n_p), np.int64)
    if not len(wanted):
        return _NOTHING
    of_u = {r.f: r.n for r in _count(src.where("NOT p"), dims, spark.sparkContext.broadcast(wanted)).toLocalIterator()}
    n_u = of_u.pop(-1, 0)
    if not n_u:
        return _NOTHING
    p, u = (np.array([of.get(k, 0) for k in keys], float) for of, keys in ((of_p, wanted.tolist()), (of_u, range(len(wanted)))))
    pooled = (p + u + 1) / (n_p + n_u + 1)
    gain = (p / n_p - u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    best = np.argsort(-gain, kind="stable")[:max_features]
    use = np.sort(wanted[best[gain[best] > min_gain]])
    in_use = spark.sparkContext.broadcast(use)

    def rows(batches):
        made = Features(dims, in_use.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([made.of(t).astype("<u2").tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["p", "g", "f"])

    groups = max(LEAST_GROUPS, math.ceil(n_u / group_documents))
    made = src.select("p", F.pmod(F.xxhash64("doc", F.lit("group")), F.lit(groups)).alias("g"), "t").mapInArrow(rows, "p boolean, g long, f binary")
    made = durable(made.groupBy("p", "g", "f").agg(F.count("*").alias("n")), "toxicity-rows")
    positive = [np.frombuffer(f, "<u2").astype(np.int64) for f in sorted(bytes(r.f) for r in made.where("p").collect() for _ in range(r.n))]
    weights, bias, fits = _fit_groups(made.where("NOT p").select("g", "f", "n"), positive, len(use), prior)
    return Model(use, weights / fits, float(bias / fits))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, dims: int = DIMS, prior: float | None = None, **options) -> DataFrame:
    """The input's columns with held_out (boolean), score (double, 0 to 1) and predicted (int); such names are replaced.

    Scores depend on the text alone. Null and empty texts have no features and get the score of the bias, repeated
    rows get equal scores, a null id is not held out and has no label. Labels that are null are ignored; of several for
    an id the largest counts; without any confirmed toxic label every score is near 0. An empty table gives an
    empty table. Whole texts are scored in one pass without a shuffle. ``options`` are those of fit().
    """
    prepare(docs.sparkSession)
    learn = labels.select(F.col("doc_id").cast("long").alias("doc"), "toxic").where(~held_out(F.col("doc")))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, learn, id_col, text_col, dims, prior, **options))
    made: list[Features] = []

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        m = model.value
        if not made:
            made.append(Features(dims, m.use))
        return pa.array([1 / (1 + math.exp(-min(max(float(m.weights[made[0].of(t)].sum()) + m.bias, -30), 30))) for t in text.to_pylist()], pa.float64())

    rows = pack(docs, i=named(id_col), t=raw(text_col)).withColumn("score", score("t"))
    return unpack(rows, docs, add={"held_out": held_out(F.col("i")), "score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")})
