"""Mixing sources to target weights: token totals, repetition rates, and hash-seeded copies of each document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import durable, named, pack, prepare, unpack, word_count
from loomwright.operators.numbering import prefix

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MAX_REPEATS = 2
#: Rows of the source table (three numbers and a name each) up to which it is sent to every executor.
BROADCAST_SOURCES = 100_000


def coin(id_col: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the md5 of the seed and the id (a null id: of the seed alone)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh ``weights``, repeating, and share ``total_percent`` of all sizes. A
    target stops at ``max_repeats`` times its source's size and the excess is shared by weight among the others, until
    none is above: sources are filled in the order of limit / weight, and all after the last full one get the same
    amount for a unit of weight. Rows are read once, for a written table of sources. Up to BROADCAST_SOURCES of those are
    filled on the driver; more are numbered and added up by range partitions, and three numbers reach the driver.
    """
    return _targets(sizes, weights, total_percent, max_repeats)[0]


def _targets(sizes: DataFrame, weights: Sequence[float], total_percent: int, max_repeats: int) -> tuple[DataFrame, bool]:
    """source_targets(), and whether they are few enough to be sent to every executor."""
    per = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        rows = [(r.source, r.source_size) for r in per.collect()]
        return sizes.sparkSession.createDataFrame(fill(rows, weights, total_percent, max_repeats), "source string, source_size long, target double"), True
    per = prefix(per.withColumn("_z", F.col("source").isNull()), ["_z", "source"], place="_k")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))).withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    per = durable(prefix(per.withColumn("_f", F.col("cap") / F.col("w")), ["_f", "_z", "source"], sums={"caps": F.col("cap"), "ws": F.col("w")}, place="_k"), "source-fills")
    size, all_w = per.agg(F.sum("source_size"), F.sum("w")).first()
    # what is left for the sources from this one on, for a unit of their weight
    left = (F.lit(float(size or 0)) * F.lit(total_percent / 100) - (F.col("caps") - F.col("cap"))) / (F.lit(float(all_w or 0)) - (F.col("ws") - F.col("w")))
    level = per.where(F.col("_f") >= left).agg(F.max(left)).first()[0]
    target = F.least("cap", F.col("w") * F.lit(float("inf") if level is None else level))
    return per.select("source", "source_size", target.alias("target")), False


def fill(sizes: list[tuple[str | None, int]], weights: Sequence[float], total_percent: int, max_repeats: int) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of sources of given sizes."""
    named_ = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    rows = [(s, n, float(weights[i % len(weights)]), float(max_repeats * n)) for i, (s, n) in enumerate(named_)]
    left, w_left, level = sum(n for _, n in sizes) * (total_percent / 100), sum(w for _, _, w, _ in rows), None
    for _, _, w, cap in sorted(rows, key=lambda r: r[3] / r[2]):  # equal ones stay in the order of sources
        if cap / w >= left / w_left:
            level = left / w_left if level is None else max(level, left / w_left)
        left, w_left = left - cap, w_left - w
        if w_left <= 0:
            break
    return [(s, n, min(cap, w * (float("inf") if level is None else level))) for s, n, w, cap in rows]


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """The input's columns with size, source_size (long), target (double), copies and taken (long); such names in the
    input are replaced.

    size is the number of words (null text: 0). A document is taken floor(target / source_size) times and once more
    with the probability of the fraction, decided by a hash of seed and id: reruns agree, and rows that repeat an id
    get the same copies. Nulls form a source of their own. A source without words has target 0 and takes nothing. An
    empty table gives an empty table.

    Only (source, size) is aggregated, partially before the shuffle. The source table is written and counted: up to
    ``BROADCAST_SOURCES`` rows it is broadcast, so that documents never move; beyond, documents are joined by source,
    which adaptive execution splits where a source is hot.
    """
    prepare(docs.sparkSession)
    rows = pack(docs, source=named(source_col).cast("string"), size=word_count(text_col), u=coin(named(id_col), seed))
    targets, few = _targets(rows.select("source", "size"), weights, total_percent, max_repeats)
    targets = targets.withColumnRenamed("source", "source2")
    if few:
        targets = F.broadcast(targets)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("source2")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate)
    copies = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("long"))
    return unpack(rows, docs, add={"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("size") * F.col("copies")})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: each document as often as plan_mix() takes it, the input's columns unchanged."""
    marked = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(id_col).alias("i"), named(text_col).alias("t"), named(source_col).alias("s"))
    planned = plan_mix(marked, "i", "t", "s", **options)
    return planned.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
