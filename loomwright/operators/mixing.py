"""Streams of samples: union, round-robin, weighted race, cycles, shuffles, shards and batches, all deterministic."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.rng import u01
from loomwright.operators.numbering import prefix


def concat(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def concat_common(*dfs: DataFrame) -> DataFrame:
    """The union over the columns that all have."""
    common = [c for c in dfs[0].columns if all(c in d.columns for d in dfs)]
    return concat(*[d.select(*common) for d in dfs])


def round_robin(df: DataFrame, stream: str, order: str) -> DataFrame:
    """round: the row's place in its stream; ordered by (round, stream) streams take turns until all end."""
    return prefix(df, [order], within=stream, place="_place").withColumn("round", (F.col("_place") + 1).cast("int")).drop("_place")


def race(df: DataFrame, stream: str, order: str, weights: dict[str, float], salt: str = "race") -> DataFrame:
    """arrival: a running sum of exponential waits with each stream's weight as the rate; ordered by it, every draw picks a
    live stream in proportion to the weights. An order column that is a batch makes weights count batches."""
    rate = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col(stream)]
    wait = -F.ln(u01(F.col(order), salt) + 1e-12) / rate
    return prefix(df, [order], within=stream, sums={"arrival": wait}, place="_place").drop("_place")


def mix(streams: dict[str, DataFrame], mode: str = "concat", weights: list[float] | None = None, order: str = "key") -> DataFrame:
    """concat, mux_longest or sample, with a column stream; equal weights by default, one for each stream."""
    names = list(streams)
    weights = [1.0] * len(names) if weights is None else weights
    if len(weights) != len(names):
        raise ValueError("a weight for each stream")
    every = concat(*[d.withColumn("stream", F.lit(n)) for n, d in streams.items()])
    if mode == "concat":
        return every
    if mode in ("mux_longest", "mux"):
        return round_robin(every, "stream", order)
    if mode == "sample":
        return race(every, "stream", order, dict(zip(names, weights)))
    raise ValueError(mode)


def cycle(df: DataFrame, count: int) -> DataFrame:
    """Each row once for each epoch; endless cycles have to be bounded."""
    if count is None or count < 1:
        raise ValueError("a number of epochs")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def shuffle_key(key: Column, seed: int, epoch: Column | int = 0) -> Column:
    """Ordering by this is a shuffle over all rows, another for each seed and epoch."""
    n = F.lit(seed) + (F.lit(epoch) if isinstance(epoch, int) else epoch)
    return F.md5(F.concat(key.cast("string"), F.lit(":"), n.cast("string")))


def resample(df: DataFrame, order: str, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """n draws with replacement from numbered rows (``order`` from 0 without gaps): draw, and the row drawn."""
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(u01(F.concat(F.lit(f"{seed + epoch}/"), F.col("id").cast("string")), "draw") * total).alias(order))
    return draws.join(df, order)


def shard(df: DataFrame, place: str, n: int, rank: int) -> DataFrame:
    return df.where(F.pmod(F.col(place), F.lit(n)) == rank)


def split_by_node_and_worker(df: DataFrame, place: str, nodes: int, node: int, workers: int, worker: int, shards: int | None = None) -> DataFrame:
    """Shards of a node, then of a worker in it; with fewer shards than workers it refuses."""
    if shards is not None and shards < nodes * workers:
        raise ValueError("fewer shards than workers")
    own = df.where(F.pmod(F.col(place), F.lit(nodes)) == node)
    return own.where(F.pmod(F.floor(F.col(place) / nodes), F.lit(workers)) == worker)


def rank_slice(place: Column, total: int, world: int) -> Column:
    """The rank whose contiguous slice of total // world + 1 rows a place is in."""
    return F.floor(place / (total // world + 1))


def batch(df: DataFrame, place: Column, size: int, drop_last: bool = False) -> DataFrame:
    """batch: place // size; ``drop_last`` leaves out a batch that is not full."""
    out = df.withColumn("batch", F.floor(place / size))
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("batch"))).where(F.col("_n") == size).drop("_n")
    return out


def collate(df: DataFrame, batch_col: str, order: str, *cols: str) -> DataFrame:
    """A row for each batch with an array for each column, all in the same order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *cols)))
    return df.groupBy(batch_col).agg(rows.alias("_r")).select(batch_col, *[F.col(f"_r.{c}").alias(c) for c in cols])


def epoch_plan(samples: int, batch_size: int, world: int, workers: int, up: bool = False) -> dict[str, int]:
    """Batches of an epoch: rounded over the world, again over workers, and multiplied back."""
    whole = (math.ceil if up else round)(samples / (batch_size * world))
    each = (math.ceil if up else round)(whole / max(1, workers))
    return {"num_batches": each * max(1, workers), "worker_batches": each, "num_samples": each * max(1, workers) * batch_size * world}


def weighted_pick(df: DataFrame, group: str, item: str, weight: str, salt: str = "pick") -> DataFrame:
    """One item of each group with a chance in proportion to its weight."""
    key = F.concat(F.col(group).cast("string"), F.lit("/"), F.col(item).cast("string"))
    wait = -F.ln(u01(key, salt) + 1e-12) / F.col(weight)
    return df.where(F.col(weight) > 0).groupBy(group).agg(F.min_by(item, F.struct(wait, F.col(item))).alias(item))


def sample_rows(df: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """The n rows first in hash order; with fewer rows than n (but any), n draws with replacement."""
    if 0 < df.count() < n:
        return draw_rows(df, key, n)
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}"))), key).limit(n)


def draw_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement from the rows numbered in the order of ``key``: the row drawn, as often as it is."""
    return resample(prefix(df, [key], place="_drawn"), "_drawn", n, seed).drop("draw", "_drawn")


def sampler(df: DataFrame, key: str, replacement: bool, n: int | None = None, seed: int = 0) -> DataFrame:
    """A random sampler: all rows (or n) with ``draw``, their place: in the order of a hash, or drawn with replacement."""
    total = df.count() if n is None else n
    if replacement:
        return resample(prefix(df, [key], place="_drawn"), "_drawn", total, seed).drop("_drawn")
    return prefix(df.withColumn("_h", shuffle_key(F.col(key), seed)), ["_h", key], place="draw").where(F.col("draw") < total).drop("_h")
