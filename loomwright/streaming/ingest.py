"""New shards as a stream: each file once, rendered, filtered and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.assemble import group_members
from loomwright.plans.pipelines import FILTERS, PIPELINES, RENDERERS
from loomwright.session import discard, durable, ship
from loomwright.sources.shards import rejects, samples
from loomwright.sources.tars import SPLIT_BYTES, expand_paths


def shard_stream(spark: SparkSession, path: str, mask: str = "*.tar", per_batch: int = 100) -> DataFrame:
    """The paths and sizes of files as they arrive; the checkpoint knows which are done. Contents are not read here."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", mask).option("maxFilesPerTrigger", per_batch).load(path).select("path", "length")


def ingest_shards(
    spark: SparkSession, path: str, out: str, checkpoint: str, mask: str = "*.tar", per_batch: int = 100, exts: tuple[str, ...] | None = None, split_bytes: int = SPLIT_BYTES, after_write: Callable[[int], None] | None = None
):
    """A streaming query that turns each new tar shard into samples, once.

    A micro-batch's shards are cut into ranges and read by tasks; a damaged shard gives its whole members and a row of
    rejects. Samples and rejects are written under ``out`` to folders of the batch's number, and then the batch's mark. A
    batch that failed has the same files and number when the query is started again, so it writes over what it left, and
    ingested() does not show it before its mark is there. ``after_write`` is called between the two writes and the mark.
    """
    ship(spark)

    def step(batch: DataFrame, epoch: int) -> None:
        members = durable(expand_paths(batch, exts, split_bytes), "ingested-members")
        group_members(samples(members)).select("shard", "n", "key", F.col("data")).write.mode("overwrite").parquet(f"{out}/samples/batch={epoch}")
        rejects(members).write.mode("overwrite").parquet(f"{out}/rejects/batch={epoch}")
        discard(members)
        if after_write is not None:
            after_write(epoch)
        batch.select(F.lit(epoch).cast("long").alias("epoch"), "path", "length").write.mode("overwrite").parquet(f"{out}/marks/batch={epoch}")

    stream = shard_stream(spark, path, mask, per_batch)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str, kind: str = "samples") -> DataFrame:
    """The samples, rejects or marks (files done) of all batches that are complete, with the number of their batch."""
    marks = spark.read.parquet(f"{out}/marks")
    if kind == "marks":
        return marks
    done = marks.select("batch").distinct()  # a row for each batch
    return spark.read.parquet(f"{out}/{kind}").join(F.broadcast(done) if done.count() <= 1_000_000 else done, "batch")


def sample_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def render_stream(samples: DataFrame, pipeline: str, key: str, **options) -> DataFrame:
    """A pipeline's renderer and filter on a stream; both are projections, so nothing is kept between batches."""
    spec = PIPELINES[pipeline]
    return FILTERS[spec.keep](RENDERERS[spec.render](samples, key, **{**spec.options, **options}), options)


def append(stream: DataFrame, path: str, checkpoint: str):
    return stream.withColumn("ingested", F.current_timestamp()).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
