"""Places and running sums in an order over a whole table, without sending all rows, or all of a group, through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable


def prefix(df: DataFrame, order: list[str], within: str | None = None, sums: dict[str, Column] | None = None, place: str = "place") -> DataFrame:
    """``df`` with ``place`` (0, 1, ... in the order, in each group if ``within`` is given) and, for each of ``sums``, the
    column's sum up to and with the row under that name.

    Rows are range-partitioned by group and order and written, so that partitions keep their numbers; each partition
    is numbered on its own and gets as an offset what the partitions before it hold of the group. Offsets are a row for
    each partition and group in it, aggregated where the rows are.
    """
    sums = sums or {}
    keys = [*([within] if within else []), *order]
    rows = df.withColumn("_g", F.col(within) if within else F.lit(0)).withColumns({f"_x{i}": x for i, x in enumerate(sums.values())})
    rows = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()), "ordered")
    xs = [f"_x{i}" for i in range(len(sums))]
    held = rows.groupBy("_g", "_p").agg(F.count("*").alias("_n"), *[F.sum(x).alias(x) for x in xs])
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col("_g").alias("_og"), F.col("_p").alias("_op"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_no"), *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}o") for x in xs])
    joined = rows.join(offsets, F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_p") == F.col("_op")))
    own = Window.partitionBy("_p", "_g").orderBy(*order)
    out = joined.withColumn(place, F.col("_no") + F.row_number().over(own) - 1)
    for name, x in zip(sums, xs):
        out = out.withColumn(name, F.col(f"{x}o") + F.sum(x).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_g", "_p", "_og", "_op", "_no", *xs, *[f"{x}o" for x in xs])
