"""Hash randomness: a number in [0, 1) that depends on a key and a salt alone, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def u01_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR || ':{salt}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def pick(key: Column, salt: str, n: int) -> Column:
    """A whole number in [0, n)."""
    return F.floor(u01(key, salt) * n).cast("int")


def pick_sql(key: str, salt: str, n: int) -> str:
    return f"floor({u01_sql(key, salt)} * {n})::INTEGER"
