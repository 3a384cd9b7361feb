"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors in vertical layout."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import durable, named, prepare, scratch_path

#: Candidates that are searched at a time.
CANDIDATE_BLOCK = 8192
#: Bytes of the queries that are sent to the executors at a time.
QUERY_BYTES = 8 << 20
#: Dimensions that are accumulated before candidates are bounded and compacted.
DIM_BLOCK = 16
#: Queries of a block that are scored together.
_QUERIES_AT_ONCE = 64
_LONG = 1 << 63


def quantize(vectors: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(vectors.astype(np.float64) * scale)


def exact_limit(dims: int) -> float:
    """Components up to which the sums over ``dims`` products of two are whole numbers under 2^53."""
    return math.isqrt((1 << 53) // max(dims, 1))


def _whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, for components of any size."""
    each = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    return np.array(each + [None], object)[:-1].reshape(vectors.shape)


def _clamped(scores) -> np.ndarray:
    return np.array([min(max(int(s), -_LONG), _LONG - 1) for s in scores], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids (``~`` turns the order of whole numbers around without overflow)."""
    by = np.lexsort((ids, ~scores))[:k]
    return ids[by], scores[by]


def search_block(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates' (ids, scores) that can be among its k best of this block, ties to smaller ids.

    ``q`` and ``x`` are (dims, queries) and (dims, vectors), ids ascending; a query's own row is no candidate. After each
    block of dimensions a candidate's score is bounded by what it has and the product of the two remaining norms; it
    goes when that is below the query's k-th best known score, ``floor`` or one found here. Sums stay exact: they are
    whole numbers under 2^53.
    """
    dims, n = x.shape
    order = np.argsort(-(np.abs(q).sum(axis=1) * np.abs(x).sum(axis=1)), kind="stable")  # most mass first
    q, x = q[order], x[order]
    edges = list(range(0, dims, DIM_BLOCK)) + [dims]
    mass = lambda m: np.sqrt(np.stack([(m[e:] ** 2).sum(axis=0) for e in edges]))
    q_left, x_left = mass(q), mass(x)
    seeds = np.argsort(-x_left[0], kind="stable")[: 4 * k + 8]  # long vectors make a first k-th best score
    out = []
    for at in range(0, q.shape[1], _QUERIES_AT_ONCE):
        part = q[:, at : at + _QUERIES_AT_ONCE]
        first = part.T @ x[:, seeds]
        first[q_rows[at : at + _QUERIES_AT_ONCE, None] == rows[seeds][None, :]] = -np.inf
        head = part[: edges[1]].T @ x[: edges[1]]
        for j in range(part.shape[1]):
            kth = np.partition(first[j], len(seeds) - k)[len(seeds) - k] if len(seeds) >= k else -np.inf
            bar = kth if floor is None else max(kth, floor[at + j])
            alive, score = None, head[j]
            for b in range(1, len(edges) - 1):
                bound = score + q_left[b, at + j] * (x_left[b] if alive is None else x_left[b, alive]) * (1 + 1e-12)
                keep = bound >= bar
                if alive is None or not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
                lo, hi = edges[b], edges[b + 1]
                block = x[lo:hi] if len(alive) == n else x[lo:hi, alive]
                score = score + part[lo:hi, j] @ block
            if alive is None:
                alive = np.arange(n)
            own = rows[alive] != q_rows[at + j]
            alive, score = alive[own], score[own]
            if len(score) > k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                above, ties = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
                pick = np.concatenate([above, ties[: k - len(above)]])  # alive ascends by id
                alive, score = alive[pick], score[pick]
            out.append(_best(ids[alive], score.astype(np.int64), k))
    return out


class Searcher:
    """The k best candidates so far of some queries of one number of dimensions."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int):
        self.rows, self.ids, self.k, self.scale = rows, ids, k, scale
        self.dims, self.vectors = vectors.shape[1], vectors
        q = quantize(vectors, scale)
        self.large = (np.abs(q) > exact_limit(self.dims)).any(axis=1)
        self.q = np.ascontiguousarray(np.where(self.large[:, None], 0, q).T) if self.dims else np.zeros((1, len(ids)))
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)

    def _add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        had = self.best[j]
        if had is not None:
            ids, scores = np.concatenate([had[0], ids]), np.concatenate([had[1], scores])
        self.best[j] = _best(ids, scores, self.k)

    def meet(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score a block of candidates; those too large for exact doubles, and large queries, with Python's integers."""
        order = np.argsort(ids, kind="stable")
        rows, ids, vectors = rows[order], ids[order], vectors[order]
        x = quantize(vectors, self.scale)
        large = (np.abs(x) > exact_limit(self.dims)).any(axis=1)
        small, plain = np.flatnonzero(~large), np.flatnonzero(~self.large)
        if len(small) and len(plain):
            columns = np.ascontiguousarray(x[small].T) if self.dims else np.zeros((1, len(small)))
            bar = np.array([float(b[1][-1]) if (b := self.best[j]) is not None and len(b[1]) >= self.k else -np.inf for j in plain.tolist()])
            for j, found in zip(plain.tolist(), search_block(self.rows[plain], np.ascontiguousarray(self.q[:, plain]), rows[small], ids[small], columns, self.k, bar)):
                self._add(j, *found)
        if large.any() or self.large.any():
            at, whole = np.flatnonzero(large), _whole(vectors, self.scale)
            for j, v in enumerate(_whole(self.vectors, self.scale)):
                cands = np.arange(len(ids)) if self.large[j] else at
                cands = cands[rows[cands] != self.rows[j]]
                if len(cands):
                    self._add(j, ids[cands], _clamped(whole[cands] @ v))

    def found(self) -> list[tuple[int, int, int, int]]:
        return [(int(r), int(i), int(v), int(s)) for r, i, b in zip(self.rows, self.ids, self.best) if b is not None for v, s in zip(*b)]


_FOUND = "query_row long, query_id long, vec_id long, score long"


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, query_bytes: int = QUERY_BYTES, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): for each row whose id is divisible by ``every``, the k other
    rows with the highest inner product of components floor(scale * x), ties to smaller ids; all, if fewer.

    Vectors that are null, or hold a null, NaN or infinite component, take no part, nor do null ids; vectors of another
    number of dimensions than the query's are no candidates of it, and vectors without components score 0. Rows that
    repeat an id are vectors of their own: each is a candidate of all but itself, and each is a query where its id is
    one. Scores are exact whole numbers for components of any size; beyond the range of a long they count as its ends.
    An empty table gives an empty table.

    Vectors are written once and never shuffled. Queries are dealt into blocks of at most about ``query_bytes`` by a
    hash; each block in turn is sent to the executors, whose tasks turn the candidates that stream past into vertical
    blocks, and carry the best k of each query from one to the next as the bar for pruning. What the tasks found, k
    rows for a query and task at most, is merged by a ranking that each task begins before the shuffle.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ok = F.forall(named(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    good = vectors.where(named(id_col).isNotNull() & named(vector_col).isNotNull() & F.coalesce(ok, F.lit(False)))
    good = good.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    good = durable(good, "vectors")  # from here on, a row keeps its number
    asks = good.where(F.pmod("id", F.lit(every)) == 0)
    n, dims = asks.agg(F.count("*"), F.max(F.size("v"))).first()
    path = scratch_path(spark, "found")
    blocks = max(1, math.ceil(n * 8 * max(dims or 1, 1) / query_bytes))
    spark.createDataFrame([], _FOUND).write.parquet(path)
    for block in range(blocks if n else 0):
        queries = asks.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "id", "v").toArrow()
        shared = spark.sparkContext.broadcast([(queries.column(0).to_numpy(), queries.column(1).to_numpy(), [np.array(v, np.float64) for v in queries.column(2).to_pylist()])])
        good.mapInArrow(_search(shared, k, scale, candidate_block), _FOUND).write.mode("append").parquet(path)
        shared.unpersist()
    found = spark.read.schema(_FOUND).parquet(path)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(shared, k: int, scale: int, candidate_block: int):
    """A task's search of its candidates (id, v, row) for the queries of a block."""

    def search(batches):
        (q_rows, q_ids, q_vectors) = shared.value[0]
        sizes = np.array([len(v) for v in q_vectors])
        of = {}
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            of[d] = Searcher(q_rows[at], q_ids[at], np.stack([q_vectors[i] for i in at]).reshape(len(at), d), k, scale)
        held: dict[int, list] = {d: [] for d in of}

        def work(d: int) -> None:
            if held[d]:
                of[d].meet(*(np.concatenate(x) for x in zip(*held[d])))
                held[d] = []

        for b in batches:
            ids, rows, lists = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1)
            n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            starts = np.cumsum(n) - n
            for d in np.unique(n).tolist():
                if d not in of:
                    continue
                at = np.flatnonzero(n == d)
                m = flat.reshape(len(at), d) if len(at) == len(n) else flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)
                for lo in range(0, len(at), candidate_block):
                    held[d].append((rows[at[lo : lo + candidate_block]], ids[at[lo : lo + candidate_block]], m[lo : lo + candidate_block]))
                    if sum(len(x[0]) for x in held[d]) >= candidate_block:
                        work(d)
        out = []
        for d in of:
            work(d)
            out += of[d].found()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_row", "query_id", "vec_id", "score"])

    return search
