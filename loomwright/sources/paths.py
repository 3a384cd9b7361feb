"""Shard paths: brace ranges, and readers by glob."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BRACE = re.compile(r"\{([^{}]*)\}")


def brace_expand(pattern: str) -> list[str]:
    """"{00..03}" and "{a,b}" written out, the leftmost first; zero padding follows the range's ends."""
    m = _BRACE.search(pattern)
    if not m:
        return [pattern]
    body = m[1]
    r = re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?", body)
    if r:
        lo, hi, step = int(r[1]), int(r[2]), abs(int(r[3] or 1)) or 1
        width = max(len(r[1]), len(r[2])) if r[1].startswith("0") or r[2].startswith("0") else 0
        values = [str(v).zfill(width) for v in range(lo, hi + (1 if hi >= lo else -1), step if hi >= lo else -step)]
    elif "," in body:
        values = body.split(",")
    else:
        head, tail = pattern[: m.end()], pattern[m.end() :]
        return [head + x for x in brace_expand(tail)]
    return [x for v in values for x in brace_expand(pattern[: m.start()] + v + pattern[m.end() :])]


def expanded(pattern: Column) -> Column:
    """brace_expand() of a column, as an array; null stays null."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def expand(patterns: pa.Array) -> pa.Array:
        return pa.array([None if x is None else brace_expand(x) for x in patterns.to_pylist()], pa.list_(pa.string()))

    return expand(pattern)
