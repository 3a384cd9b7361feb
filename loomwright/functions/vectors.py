"""Vector arithmetic on array columns, in double and in order, so that results agree with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` has it inside another function of elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2norm(v: Column) -> Column:
    return bind(F.sqrt(total(F.transform(v, lambda x: x * x))), lambda n: F.transform(v, lambda x: x / n))


def softmax(v: Column) -> Column:
    e = bind(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return bind(e, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def logsumexp(v: Column) -> Column:
    return bind(F.array_max(v), lambda m: m + F.ln(total(F.transform(v, lambda x: F.exp(x - m)))))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))
