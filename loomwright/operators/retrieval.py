"""Retrieval between two sides of vectors: top-k, recall in both directions, two-stage ranking, zero-shot classes, in-batch losses.

Scores are never rows. Queries are taken in blocks of bounded size; a block is sent to the tasks, which score the items
that stream past and keep, for each query, its k best or a count, and for each item one row of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.vectors import as_double, bind, dot, l2norm, logsumexp, total
from loomwright.session import durable, scratch_path

#: Queries of a block, items that are scored at a time, and classes that are sent to every task.
QUERY_BLOCK, ITEM_BLOCK, MAX_CLASSES = 4096, 256, 65_536


def _units(df: DataFrame, id_col: str, normalise: bool, group: str | None) -> DataFrame:
    """(id, v, g) with unit vectors, written once."""
    v = as_double(F.col("vec"))
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return durable(df.select(F.col(id_col).cast("long").alias("id"), (l2norm(v) if normalise else v).alias("v"), g.alias("g")), "vectors")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, items) inner products, added up dimension by dimension as SQL adds, so that equal vectors tie."""
    out = np.zeros((len(q), len(x)))
    for a, b in zip(q.T, x.T):
        out += a[:, None] * b[None, :]
    return out


class _Block:
    """A block of queries in a task: ids, vectors, groups and, for each, a known (score, other id)."""

    def __init__(self, rows: list[tuple]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.v = np.array([r[1] for r in rows], np.float64)
        self.g = np.array([r[2] for r in rows], object)
        self.score = np.array([r[3] for r in rows], np.float64)
        self.other = np.array([r[4] for r in rows], np.int64)


def _scan(queries: DataFrame, items: DataFrame, work: Callable, schema: str, block: int, same: bool) -> DataFrame:
    """Rows of ``schema`` that ``work(queries, batches)`` gives for each block of queries (id, v, g, score, other) in every
    task of ``items`` (id, v, g, ...). ``same``: an id is the same thing on both sides and no partner of itself."""
    spark = queries.sparkSession
    path = scratch_path(spark, "retrieval")
    spark.createDataFrame([], schema).write.parquet(path)
    n = queries.count()
    blocks = math.ceil(n / block)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v", "g", "score", "other").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([(r.id, list(r.v), r.g, r.score, r.other) for r in rows])

        def run(batches, shared=shared):
            own = _Block(shared.value)

            def scored():
                for batch in batches:
                    for at in range(0, batch.num_rows, ITEM_BLOCK):
                        part = batch.slice(at, ITEM_BLOCK)
                        ids, v = part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), np.float64)
                        s = _products(own.v, v)
                        if same:
                            s[own.ids[:, None] == ids[None, :]] = -np.inf
                        yield part, ids, s

            names = [f.split()[0] for f in schema.split(", ")]
            for cols in work(own, scored()):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        items.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path)


def _plain(queries: DataFrame) -> DataFrame:
    return queries.withColumn("score", F.lit(0.0)).withColumn("other", F.lit(0).cast("long"))


def top_k(queries: DataFrame, items: DataFrame, k: int, normalise: bool = True, same: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(i, j, score, rank): the k items (j, vec) of greatest cosine for each query (i, vec), ties to the smaller j."""
    q, t = _plain(_units(queries, "i", normalise, None)), _units(items, "j", normalise, None)

    def work(own: _Block, scored):
        ids, best = np.zeros((len(own.ids), 0), np.int64), np.zeros((len(own.ids), 0))
        for _, j, s in scored:
            ids, best = np.concatenate([ids, np.broadcast_to(j, s.shape)], axis=1), np.concatenate([best, s], axis=1)
            by = np.lexsort((ids, -best), axis=1)[:, :k]
            ids, best = np.take_along_axis(ids, by, 1), np.take_along_axis(best, by, 1)
        at = np.isfinite(best)
        yield np.repeat(own.ids, at.sum(axis=1)), ids[at], best[at]

    found = _scan(q, t, work, "i long, j long, score double", block, same)
    w = Window.partitionBy("i").orderBy(F.col("score").desc(), "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filled_top_k(queries: DataFrame, items: DataFrame, k: int, fill: float = -100.0, **options) -> tuple[DataFrame, DataFrame]:
    """The score table in which only a query's k best cells hold their score, as its kept cells (i, j, score), and for each
    query how many cells hold ``fill`` (i, filled, fill): the square itself is never made."""
    kept = durable(top_k(queries, items, k, **options).select("i", "j", "score"), "top-k")
    n = items.count() - (1 if options.get("same") else 0)
    return kept, kept.groupBy("i").agg((F.lit(n) - F.count("*")).alias("filled"), F.lit(fill).alias("fill"))


_HITS = "side string, id long, score double, other long"
_COUNTS = "side string, id long, better long"


def best_ranks(queries: DataFrame, items: DataFrame, group: str, normalise: bool = True, same: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(side, id, rank): for each query ("i") and each item ("j") with a true partner on the other side, the best rank that
    one of them gets, ties to smaller ids. Partners are those of one ``group``, a column of both sides.

    A rank is one more than the number of partners that score better than the best true one, so the tasks first find that
    one and then count, and no list of scores is sorted.
    """
    q, t = _units(queries, "i", normalise, group), _units(items, "j", normalise, group)

    def hits(own: _Block, scored):
        score, other = np.full(len(own.ids), -np.inf), np.zeros(len(own.ids), np.int64)
        for part, j, s in scored:
            g = np.array(part.column(2).to_pylist(), object)
            true = np.where((own.g[:, None] == g[None, :]) & (own.g != None)[:, None], s, -np.inf)  # noqa: E711
            at = _first_best(true, j)
            mine = true[np.arange(len(own.ids)), at]
            move = (mine > score) | (mine == score) & (j[at] < other) & np.isfinite(mine)
            score, other = np.where(move, mine, score), np.where(move, j[at], other)
            at = _first_best(true.T, own.ids)
            theirs = true.T[np.arange(len(j)), at]
            ok = np.isfinite(theirs)
            yield ["j"] * int(ok.sum()), j[ok], theirs[ok], own.ids[at][ok]
        ok = np.isfinite(score)
        yield ["i"] * int(ok.sum()), own.ids[ok], score[ok], other[ok]

    found = _scan(_plain(q), t, hits, _HITS, block, same)
    best = found.groupBy("side", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("other").alias("o"))).alias("b"))
    best = durable(best.select("side", "id", (-F.col("b.s")).alias("score"), F.col("b.o").alias("other")), "best-hits")
    of = lambda side, rows: rows.join(best.where(F.col("side") == side).drop("side"), "id", "left")
    known, seen = of("i", q), durable(of("j", t).select("id", "v", "score", "other"), "known-hits")

    def counts(own: _Block, scored):
        more = np.zeros(len(own.ids), np.int64)
        has = np.isfinite(own.score)
        for part, j, s in scored:
            more += ((s > own.score[:, None]) | (s == own.score[:, None]) & (j[None, :] < own.other[:, None])).sum(axis=1)
            theirs, ids = np.array(part.column(2).to_pylist(), np.float64), np.array([x or 0 for x in part.column(3).to_pylist()], np.int64)
            n = ((s > theirs[None, :]) | (s == theirs[None, :]) & (own.ids[:, None] < ids[None, :])).sum(axis=0)
            ok = np.isfinite(theirs)
            yield ["j"] * int(ok.sum()), j[ok], n[ok]
        yield ["i"] * int(has.sum()), own.ids[has], more[has]

    known = known.withColumn("score", F.coalesce("score", F.lit(float("nan")))).withColumn("other", F.coalesce("other", F.lit(0).cast("long")))
    better = _scan(known, seen, counts, _COUNTS, block, same)
    return better.groupBy("side", "id").agg((F.sum("better") + 1).alias("rank"))


def _first_best(s: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of each row's greatest score, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    return order[s[:, order].argmax(axis=1)]


def recall(ranks: DataFrame, at: tuple[int, ...] = (1, 5, 10), prefix: str = "r") -> DataFrame:
    hits = [(100 * F.avg((F.col("rank") <= k).cast("double"))).alias(f"{prefix}{k}") for k in at]
    out = ranks.agg(*hits)
    return out.withColumn(f"{prefix}_mean", sum(F.col(f"{prefix}{k}") for k in at) / len(at))


def recall_report(queries: DataFrame, items: DataFrame, group: str, **options) -> DataFrame:
    """Both directions: txt_* ranks texts for an image (best of its captions), img_* images for a text; r_mean over both,
    agg_metrics the text side's mean."""
    ranks = durable(best_ranks(queries, items, group, **options), "ranks")
    txt, img = (recall(ranks.where(F.col("side") == side), prefix=p) for side, p in (("i", "txt_r"), ("j", "img_r")))
    both = txt.crossJoin(img)  # one row each
    return both.withColumn("r_mean", (F.col("txt_r_mean") + F.col("img_r_mean")) / 2).withColumn("agg_metrics", F.col("txt_r_mean"))


def two_stage(first: DataFrame, losses: DataFrame, k: int) -> DataFrame:
    """(question, answer): of the k candidates of greatest first-token score (``first``: question, answer, score), the one of
    least loss (``losses``: question, answer, loss); ties go to the smaller answer."""
    w = Window.partitionBy("question").orderBy(F.col("score").desc(), "answer")
    kept = first.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("question", "answer")
    return kept.join(losses, ["question", "answer"]).groupBy("question").agg(F.min_by("answer", F.struct("loss", "answer")).alias("answer"))


def class_vectors(prompts: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """(label, vec): each prompt embedding normalised, the class mean normalised again."""
    flat = prompts.select(label, F.posexplode(l2norm(as_double(F.col(vec)))).alias("p", "x")).groupBy(label, "p").agg(F.avg("x").alias("m"))
    return flat.groupBy(label).agg(l2norm(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"])).alias("vec"))


def zero_shot(vectors: DataFrame, classes: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", label: str = "label") -> DataFrame:
    """(id, predicted, logit): the class with the greatest 100 * cosine, ties to the smaller label. Classes are counted and
    broadcast; over MAX_CLASSES of them are refused (top_k() has no such bound)."""
    classes = durable(classes, "classes")
    if classes.count() > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} classes")
    words = classes.agg(F.collect_list(F.struct(F.col(label).alias("c"), F.col("vec").alias("w"))).alias("words"))
    rows = vectors.select(F.col(id_col).alias("id"), l2norm(as_double(F.col(vec_col))).alias("v")).crossJoin(F.broadcast(words))
    best = F.array_min(F.transform("words", lambda x: F.struct((-100 * dot(F.col("v"), x["w"])).alias("s"), x["c"].alias("c"))))
    return rows.select("id", best["c"].alias("predicted"), (-best["s"]).alias("logit"))


def in_batch_scores(rows: DataFrame, batch: str, id_col: str, a: str = "a", b: str = "b") -> DataFrame:
    """(batch, ids, table): the square of cosines within each batch as an array of rows, ids in order. A batch is as large
    as a training batch, so its square fits a row."""
    one = F.struct(F.col(id_col).alias("i"), l2norm(as_double(F.col(a))).alias("a"), l2norm(as_double(F.col(b))).alias("b"))
    per = rows.groupBy(F.col(batch).alias("batch")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    table = F.transform("r", lambda x: F.transform("r", lambda y: dot(x["a"], y["b"])))
    return per.select("batch", F.transform("r", lambda x: x["i"]).alias("ids"), table.alias("table"))


def contrastive_loss(square: DataFrame, temperature: float = 0.07, smoothing: float = 0.1) -> DataFrame:
    """(batch, loss): the symmetric loss of each batch of in_batch_scores(), whose pairs are on the diagonal."""
    n = F.size("ids")
    z = square.select("batch", "ids", F.transform("table", lambda r: F.transform(r, lambda x: x / temperature)).alias("z"))

    def side(row: Callable[[Column], Column]) -> Column:
        each = lambda i: logsumexp(row(i)) - (1 - smoothing) * F.col("z")[i][i] - smoothing * total(row(i)) / n
        return total(F.transform(F.sequence(F.lit(0), n - 1), each)) / n

    return z.select("batch", ((side(lambda i: F.col("z")[i]) + side(lambda i: F.transform("z", lambda r: r[i]))) / 2).alias("loss"))


def in_batch_negatives(square: DataFrame) -> DataFrame:
    """(batch, i, j, weight): weights of the negatives of each row of a batch: softmax of its scores plus 1e-4, the diagonal 0."""
    row = square.select("batch", "ids", F.posexplode("table").alias("p", "s"))
    e = row.withColumn("e", bind(F.array_max("s"), lambda m: F.transform("s", lambda x: F.exp(x - m))))
    weights = bind(total(F.col("e")), lambda t: F.transform("e", lambda x: x / t + 1e-4))
    out = e.select("batch", F.col("ids")[F.col("p")].alias("i"), "ids", F.posexplode(weights).alias("q", "w"))
    return out.select("batch", "i", F.col("ids")[F.col("q")].alias("j"), F.when(F.col("i") == F.col("ids")[F.col("q")], 0.0).otherwise(F.col("w")).alias("weight"))
