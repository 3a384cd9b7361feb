"""Centroid clustering: segment norms bound the distance to each centroid, and only centroids that the bounds leave get exact
integer distances."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import durable, named, prepare

#: Dimensions whose norm stands for them in a compressed vector.
SEGMENT = 8
#: Vectors that are assigned at a time.
BLOCK = 4096
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 where all distances fit, else as Python's integers."""
    limit = whole_limit(vectors.shape[1])
    with np.errstate(over="ignore"):
        quick = np.floor(vectors * scale)
    if not vectors.size or np.abs(quick).max() <= limit:
        return quick.astype(np.int64)
    each = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    return np.array([*each, None], object)[:-1].reshape(vectors.shape)


def whole_limit(dims: int) -> int:
    """Components up to which the squared distance of two vectors is under 2^63."""
    return math.isqrt(((1 << 63) - 1) // max(4 * dims, 1))


def _doubles(x: np.ndarray) -> np.ndarray:
    """As doubles; Python's integers stop at 1e300."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(min(max(y, -(10**300)), 10**300)) for y in x.ravel().tolist()]).reshape(x.shape)


def segment_norms(vectors: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Each vector compressed to the norms of its segments, in doubles."""
    with np.errstate(over="ignore"):
        x = _doubles(vectors) ** 2
    return np.sqrt(np.add.reduceat(x, np.arange(0, x.shape[1], segment), axis=1)) if x.shape[1] else np.zeros((len(x), 1))


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids and their compressed forms; int64, or Python's integers where one is large."""

    rows: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]], segment: int = SEGMENT) -> Centroids:
        dims = len(rows[0])
        small = all(abs(x) <= whole_limit(dims) for r in rows for x in r)
        m = np.array(rows, np.int64 if small else object).reshape(len(rows), dims)
        return cls(m, segment_norms(m, segment))


def assign(vectors: np.ndarray, cents: Centroids, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances computed) for whole-number vectors, ties to the smaller number.

    The norms of segments give |x - c|^2 >= sum of (|x_s| - |c_s|)^2 by Cauchy-Schwarz. Centroids are met in the order of
    that bound, and a vector stops at the first whose bound is over its best distance; the bound's rounding is allowed for.
    """
    c, n = cents.rows, len(vectors)
    if vectors.dtype == object or c.dtype == object:
        vectors, c = vectors.astype(object), c.astype(object)
    best, who = np.full(n, None if c.dtype == object else _LONG_MAX, c.dtype), np.full(n, len(c), np.int64)
    x = segment_norms(vectors, segment)
    with np.errstate(invalid="ignore", over="ignore"):
        size = (x**2).sum(axis=1)[:, None] + (cents.norms**2).sum(axis=1)[None, :]
        low = size - 2 * (x @ cents.norms.T) - 1e-9 * size - 1
    low = np.where(np.isfinite(low), low, -np.inf)
    order = np.argsort(low, axis=1, kind="stable")
    alive, met = np.arange(n), 0
    for turn in range(len(c)):
        at = order[alive, turn]
        if turn:
            keep = low[alive, at] <= _doubles(best[alive])
            alive, at = alive[keep], at[keep]
        if not len(alive):
            break
        gap = vectors[alive] - c[at]
        d = (gap * gap).sum(axis=1)
        met += len(alive)
        if turn:
            closer = (d < best[alive]) | ((d == best[alive]) & (at < who[alive]))
        else:
            closer = np.ones(len(alive), bool)
        closer = closer.astype(bool)
        best[alive[closer]], who[alive[closer]] = d[closer], at[closer]
    return who, best, met


def _blocks(batches, dims: int, scale: int):
    """(ids as Arrow, whole vectors) of Arrow batches (id, v); small and large vectors apart, so that few large ones are slow."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            lists = part.column(1)
            m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims)
            with np.errstate(over="ignore"):
                large = (np.abs(np.floor(m * scale)) > whole_limit(dims)).any(axis=1)
            for at in (np.flatnonzero(~large), np.flatnonzero(large)):
                if len(at):
                    yield part.column(0).take(pa.array(at)), whole(m[at], scale)


def _clamp(x: int) -> int:
    return min(max(int(x), _LONG_MIN), _LONG_MAX)


def _sums(rows: DataFrame, cents: Centroids, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """(vectors, sums of components) of each non-empty cluster: a task sends one row a cluster, and those are added up by
    cluster before the driver reads a row for each."""

    def part(batches):
        held: dict[int, list] = {}
        for _, x in _blocks(batches, dims, scale):
            who, _, _ = assign(x, cents)
            for k in np.unique(who).tolist():
                own = x[who == k]
                n, s = held.get(k, (0, [0] * dims))
                held[k] = (n + len(own), [a + int(b) for a, b in zip(s, own.sum(axis=0).tolist())])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([[str(x) for x in s] for _, s in held.values()], pa.list_(pa.string()))], ["k", "n", "s"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"][:1].tolist(), "n": [pdf["n"].sum()], "s": [[str(sum(map(int, xs))) for xs in zip(*pdf["s"])]]})

    schema = "k int, n long, s array<string>"
    found = rows.mapInArrow(part, schema).groupBy("k").applyInPandas(added, schema).collect()
    return {r.k: (r.n, [int(x) for x in r.s]) for r in found}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string) for each vector of
    exactly ``dims`` components, none null or non-finite, as whole numbers floor(scale * x).

    Centroids begin as the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``; of rows that repeat an id, and so the
    hash, those with smaller components come first, and rows without an id come last. Each round assigns every vector to
    the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each non-empty centroid to
    floor(sum / count) of its vectors, component by component; an empty one stays. Then vectors are assigned once more.
    ``cluster_inertia`` and ``inertia`` are the distances summed over a cluster and over all; whole numbers of any size are
    exact inside, and those returned stop at the ends of a long. Fewer vectors than ``k`` give as many centroids; an empty
    table gives an empty table. Other columns are not read.

    The table is written once as doubles and read once a round, without a shuffle of vectors: a task sends a sum for each
    cluster. Centroids (k rows) go to the executors inside the tasks. ``vec_id`` keeps the input's name.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = named(vector_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    good = vectors.where(v.isNotNull() & (F.size(v) == dims) & F.coalesce(ok, F.lit(False)))
    rows = durable(good.select(named(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = rows.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    out = "id long, cluster int, distance long, whole string"
    if not seeds:
        found, known = spark.createDataFrame([], out), []
    else:
        now = [[int(x) for x in whole(np.array([s.v], np.float64), scale)[0].tolist()] for s in seeds]
        for _ in range(rounds):
            for at, (n, sums) in _sums(rows, Centroids.of(now), dims, scale).items():
                now[at] = [x // n for x in sums]
        cents = Centroids.of(now)

        def final(batches):
            for ids, x in _blocks(batches, dims, scale):
                who, d, _ = assign(x, cents)
                yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array([_clamp(y) for y in d.tolist()], pa.int64()), pa.array([str(y) if y > _LONG_MAX else None for y in d.tolist()], pa.string())], ["id", "cluster", "distance", "whole"])

        found = durable(rows.mapInArrow(final, out), "assigned")
        known = _inertia(found)
        hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
        known = [(at, _clamp(d), _clamp(sum(x for _, x in known)), hashes[at]) for at, d in known]
    per = spark.createDataFrame(known, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(per), F.col("cluster") == F.col("c"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _inertia(found: DataFrame) -> list[tuple[int, int]]:
    """(cluster, sum of exact distances): long ones as decimals by cluster, and those beyond a long, as text, in Python."""
    fits = found.where("whole IS NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    sums = {r.cluster: int(r.d) for r in fits.collect()}

    def part(batches):
        held: dict[int, int] = {}
        for b in batches:
            for c, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[c] = held.get(c, 0) + int(w)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([str(x) for x in held.values()])], ["c", "s"])

    for r in found.where("whole IS NOT NULL").select("cluster", "whole").mapInArrow(part, "c int, s string").toLocalIterator():
        sums[r.c] = sums.get(r.c, 0) + int(r.s)
    return sorted(sums.items())
