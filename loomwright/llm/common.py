"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import discard, durable, scratch_path, ship  # noqa: F401

#: Rows of one Arrow batch: with whole documents in the rows, the default of 10,000 can be over a gigabyte.
BATCH_ROWS = 2000
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

#: The white space that the contracts name: space and \t to \r.
SPACE = b" \t\n\x0b\x0c\r"

_NON_SPACE = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Ship the code, and bound the Arrow batches unless the session has a bound of its own."""
    ship(spark)
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def raw(text: str | Column) -> Column:
    """A text column as UTF-8 bytes, null as empty: Python then splits it without decoding."""
    c = named(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit("")).cast("binary")


def word_count(text: str | Column) -> Column:
    """Number of maximal runs of characters outside space and \\t-\\r (null: 0)."""
    c = named(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(_NON_SPACE)), F.lit(0)).cast("long")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; it may return one batch, a list of them, or None."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is None:
                    continue
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def pack(docs: DataFrame, **keys: Column) -> DataFrame:
    """The input rows as one struct column ``row`` beside named working columns, so that no name can clash."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def unpack(df: DataFrame, docs: DataFrame, replace: dict[str, Column] | None = None, add: dict[str, Column] | None = None) -> DataFrame:
    """Undo pack(): the input's columns, some replaced, then added ones (an added name replaces an equal input name)."""
    replace, add = replace or {}, add or {}
    keep = [(replace[c] if c in replace else F.col("row")[c]).alias(c) for c in docs.columns if c not in add]
    return df.select(*keep, *[v.alias(k) for k, v in add.items()])
