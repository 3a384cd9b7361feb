"""Vector quantization: nearest codewords, usage statistics, k-means and moving-average steps on a codebook table.

A codebook is (code int, vec array<double>). It is broadcast, as its size is bounded by the number of codes (checked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.vectors import as_double, dot, l2norm, squared_distance

#: Codes of a codebook that is broadcast.
MAX_CODES = 65_536


def _small(codebook: DataFrame) -> DataFrame:
    if codebook.count() > MAX_CODES:
        raise ValueError(f"a codebook of over {MAX_CODES} codes")
    return F.broadcast(codebook)


def assign(vectors: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", cosine: bool = False) -> DataFrame:
    """(id, code, dist) of the nearest codeword, ties to the lower code: least squared distance, or greatest cosine as its
    negative. Each vector meets the broadcast codebook in one array expression, so no pair is ever a row."""
    words = codebook.agg(F.array_sort(F.collect_list(F.struct("code", F.col("vec").alias("w")))).alias("words"))
    _small(codebook)
    rows = vectors.select(F.col(id_col).alias("id"), as_double(F.col(vec_col)).alias("v")).crossJoin(F.broadcast(words))
    far = (lambda x: -dot(l2norm(F.col("v")), l2norm(x["w"]))) if cosine else (lambda x: squared_distance(F.col("v"), x["w"]))
    best = F.array_min(F.transform("words", lambda x: F.struct(far(x).alias("dist"), x["code"].alias("code"))))
    return rows.select("id", best["code"].alias("code"), best["dist"].alias("dist"))


def assign_large(vectors: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """assign() by matrix products over Arrow batches, for codebooks of thousands of codes; |v|^2 is left out of the
    comparison and added to the distance."""
    words = sorted((r.code, list(r.vec)) for r in _small(codebook).collect())
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([c for c, _ in words]), np.array([w for _, w in words], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, w = shared.value
        norms = np.einsum("ij,ij->i", w, w)
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(1).to_pylist(), np.float64)
                d = norms[None, :] - 2 * v @ w.T
                at = d.argmin(axis=1)
                dist = d[np.arange(len(v)), at] + np.einsum("ij,ij->i", v, v)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(codes[at], pa.int32()), pa.array(dist)], ["id", "code", "dist"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), as_double(F.col(vec_col)).alias("v")).mapInArrow(run, "id long, code int, dist double")


def usage(assigned: DataFrame, codes: int) -> DataFrame:
    """(code, n) for every code, unused ones 0."""
    every = assigned.sparkSession.range(codes).select(F.col("id").cast("int").alias("code"))
    return every.join(assigned.groupBy("code").count(), "code", "left").select("code", F.coalesce("count", F.lit(0)).alias("n"))


def perplexity(counts: DataFrame) -> DataFrame:
    share = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).agg(F.exp(-F.sum(share * F.ln(share + 1e-10))).alias("perplexity"))


def group_means(vectors: DataFrame, assigned: DataFrame, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """(code, n, vec): the mean of the vectors of each code, dimension by dimension, pre-aggregated before the shuffle."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).join(assigned.select("id", "code"), "id")
    flat = v.select("code", F.posexplode("v").alias("i", "x")).groupBy("code", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    means = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return flat.groupBy("code").agg(F.max("n").alias("n"), means.alias("vec"))


def kmeans_step(vectors: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", cosine: bool = False) -> DataFrame:
    """The codebook after one step; a code without vectors keeps its word, cosine means are normalised again."""
    means = group_means(vectors, assign(vectors, codebook, id_col, vec_col, cosine), id_col, vec_col)
    new = l2norm(F.col("m")) if cosine else F.col("m")
    return codebook.join(means.select("code", F.col("vec").alias("m")), "code", "left").select("code", F.coalesce(new, F.col("vec")).alias("vec"))


def kmeans(vectors: DataFrame, codebook: DataFrame, steps: int = 10, **options) -> DataFrame:
    """Some steps; the codebook (bounded) goes through the driver between them, so that plans do not grow."""
    spark = vectors.sparkSession
    for _ in range(steps):
        codebook = spark.createDataFrame(kmeans_step(vectors, codebook, **options).collect(), codebook.schema)
    return codebook


def moving_average(old: Column, new: Column, decay: float = 0.99) -> Column:
    return F.zip_with(old, new, lambda m, x: F.lit(decay) * m + F.lit(1 - decay) * x)


def smoothed_counts(counts: DataFrame, codes: int, eps: float = 1e-5) -> DataFrame:
    """Laplace-smoothed counts with the same sum."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("code", ((F.col("n") + eps) / (F.col("t") + codes * eps) * F.col("t")).alias("n"))


def ema_step(vectors: DataFrame, codebook: DataFrame, decay: float = 0.99, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    means = group_means(vectors, assign(vectors, codebook, id_col, vec_col), id_col, vec_col).select("code", F.col("vec").alias("m"))
    return codebook.join(means, "code", "left").select("code", F.when(F.col("m").isNull(), F.col("vec")).otherwise(moving_average(F.col("vec"), F.col("m"), decay)).alias("vec"))


def remap(assigned: DataFrame, used: DataFrame, unknown: int = -1) -> DataFrame:
    """Codes as places in the list of used codes (code, place), which is as small as a codebook; others get ``unknown``."""
    return assigned.join(_small(used), "code", "left").select("id", "code", F.coalesce("place", F.lit(unknown)).alias("place"))


def unmap(places: DataFrame, used: DataFrame) -> DataFrame:
    """The inverse of remap(): (id, place, code) for places in the list of used codes; others have a null code."""
    return places.join(_small(used), "place", "left").select("id", "place", "code")


def commitment(assigned: DataFrame, beta: float = 0.25) -> DataFrame:
    """The quantization loss of given distances; its two terms are equal in value, so it does not matter which beta weighs."""
    return assigned.agg(((1 + beta) * F.avg("dist")).alias("loss"))
