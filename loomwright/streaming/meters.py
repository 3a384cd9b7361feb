"""Run meters and codebooks over streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomwright.functions.vectors import l2norm
from loomwright.operators.vq import assign, moving_average

_ROW = "meter string, o string, n long, window_avg double, window_median double, window_max double, last_value double, global_avg double, idle boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that start inside keep their state in RocksDB, which state with timers and lists asks for."""
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, had)


class RunMeter(StatefulProcessor):
    """The last ``size`` values of a meter in a list state, its count and sum since the start in a value state, and a timer that
    ends a meter without events for ``idle_ms`` of event time."""

    def __init__(self, size: int, idle_ms: int | None):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "v double")
        self.sums = handle.getValueState("sums", "n long, total double, o string")

    def _row(self, meter: str, o: str, ring: list[float], n: int, total: float, idle: bool) -> tuple:
        return meter, o, n, sum(ring) / len(ring), sorted(ring)[(len(ring) - 1) // 2], max(ring), ring[-1], total / n, idle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        n, total, _ = self.sums.get() if self.sums.exists() else (0, 0.0, "")
        events = pd.concat(list(rows)).sort_values(["ts", "o"])
        out = []
        for o, v in zip(events["o"], events["v"]):
            if not pd.isna(v):
                ring = [*ring, float(v)][-self.size :]
                n, total = n + 1, total + float(v)
                out.append(self._row(key[0], str(o), ring, n, total, False))
        if ring:
            self.ring.put([(x,) for x in ring])
            self.sums.update((n, total, out[-1][1] if out else ""))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(events["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _ROW.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.sums.exists():
            n, total, o = self.sums.get()
            out.append(self._row(key[0], o, [r[0] for r in self.ring.get()], n, total, True))
        self.ring.clear()
        self.sums.clear()
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _ROW.split(", ")])

    def close(self) -> None:
        pass


def meter_stream(events: DataFrame, meter: str, order: str, value: str, time: str, size: int = 20, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A row for each event of a stream: its meter, order, the mean, lower median, maximum and last of the meter's last ``size``
    values with this one, and count and mean since the start.

    Events of a micro-batch are taken in the order of time and ``order``; those later than the watermark (``late`` behind the
    latest time seen) are dropped; null values change nothing and have no row. With ``idle`` (milliseconds of event time) a
    meter without an event for so long has a row with ``idle`` set, once the watermark is past it, and begins anew. State is
    ``size`` numbers, a count and a sum for each meter. Start the query inside rocksdb_state(); output mode append.
    """
    src = events.withWatermark(time, late).select(F.col(meter).cast("string").alias("meter"), F.col(time).alias("ts"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    processor = RunMeter(size, None if idle is None else int(idle))
    return src.groupBy("meter").transformWithStateInPandas(processor, StructType.fromDDL(_ROW), "Append", "EventTime")


def windowed_totals(events: DataFrame, time: str, meter: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums and counts for each meter in windows of event time; events later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), meter).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def follow_codebook(vectors: DataFrame, codebook: DataFrame, path: str, checkpoint: str, decay: float = 0.99, dead: float = 0.0, id_col: str = "vec_id", vec_col: str = "vec"):
    """A streaming query that moves a codebook (code, vec) by each micro-batch and writes it, with the moving average ``size`` of
    each code's vectors, as a table for each epoch under ``path``.

    A query that begins writes the codebook as epoch -1, unless the table is there: a restart goes on from the last epoch. A
    batch that is delivered twice reads the epoch before it and writes its own over.
    """
    spark = vectors.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=-1/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        codebook.select("code", l2norm(F.col("vec")).alias("vec"), F.lit(1.0).alias("size")).write.mode("overwrite").parquet(f"{path}/epoch=-1")

    def step(batch: DataFrame, epoch: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/epoch={epoch - 1}")
        follow_step(batch.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")), before, epoch, decay, dead).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return vectors.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sample_vectors(batch: DataFrame, n: int, seed: Column) -> DataFrame:
    """(place from 1, vec) of ``n`` vectors of a batch, those with the smallest md5 of ``<id>:<seed>``; fewer if it has fewer."""
    own = batch.select(F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), seed)).alias("h"), "vec_id", "vec").orderBy("h", "vec_id").limit(n)
    return own.select(F.row_number().over(Window.orderBy("h", "vec_id")).alias("place"), "vec")


def follow_step(batch: DataFrame, before: DataFrame, epoch: int, decay: float, dead: float) -> DataFrame:
    """(code, vec, size) behind a batch of (vec_id, vec) on normalised vectors: sizes follow the numbers of vectors, words their
    normalised means, each as a moving average, words normalised again; codes without vectors keep their word.

    A code whose size has come under ``dead`` gets a vector of the batch (sample_vectors, dead codes in order) and the size
    ``dead``. Vectors that are null or zero have no direction and don't count. The codebook's size is bounded (vq.MAX_CODES).
    """
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    batch = batch.select("vec_id", F.when(length > 0, l2norm(F.col("vec"))).alias("vec")).where("vec IS NOT NULL")
    # the id rides with the vector, so that no join is needed behind the assignment
    rows = assign(batch.select(F.struct("vec_id", "vec").alias("row"), "vec"), before.select("code", "vec"), "row", "vec")
    flat = rows.select("code", F.posexplode("id.vec").alias("i", "x")).groupBy("code", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    means = flat.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    moved = before.join(means, "code", "left").select(
        "code",
        F.when(F.col("m").isNull(), F.col("vec")).otherwise(l2norm(moving_average(F.col("vec"), l2norm(F.col("m")), decay))).alias("vec"),
        (F.lit(decay) * F.col("size") + F.lit(1 - decay) * F.coalesce("n", F.lit(0))).alias("size"),
    )
    if dead <= 0:
        return moved
    lost = moved.where(F.col("size") < dead).select("code", F.row_number().over(Window.orderBy("code")).alias("place"))
    fresh = lost.join(sample_vectors(batch, before.count(), F.lit(str(epoch))), "place").select("code", F.col("vec").alias("new"))
    return moved.join(fresh, "code", "left").select("code", F.coalesce("new", "vec").alias("vec"), F.when(F.col("new").isNotNull(), F.lit(float(dead))).otherwise(F.col("size")).alias("size"))
