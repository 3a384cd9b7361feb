"""What the queries share: table access, synthetic image ids, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import bound_batches, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_ids(key: Column, n: int = 32) -> Column:
    """A stand-in for a row's image codes: (31 key + 7 i) mod 8192."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(key * 31 + i * 7, F.lit(8192)).cast("int"))


def image_ids_sql(key: str, n: int = 32) -> str:
    return f"list_transform(range(0, {n}), lambda i: ((({key}) * 31 + i * 7) % 8192)::INTEGER)"


def image_tokens_sql(ids: str) -> str:
    return f"('<img>' || array_to_string(list_transform({ids}, lambda x: printf('<img_%05d>', x)), '') || '</img>')"


def joined_sql(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick_sql(values: list[str], at: str) -> str:
    return f"list_extract([{', '.join(q(v) for v in values)}], ({at}) + 1)"
