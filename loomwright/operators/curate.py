"""Curation filters over presence, text, numbers and JSON metadata that drifts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.rng import u01
from loomwright.functions.text import is_blank  # noqa: F401

_TERM = re.compile(r"\s*(<=|>=|==|!=|<|>)\s*(-?\d+(?:\.\d+)?)\s*\Z")


def has_tokens(input_ids: Column, flag: Column | None = None) -> Column:
    """Rendered, and not flagged out; fine-tuning passes no flag."""
    return input_ids.isNotNull() if flag is None else input_ids.isNotNull() & F.coalesce(flag, F.lit(True))


def all_present(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def any_set_present(*sets: list[Column]) -> Column:
    out = F.lit(False)
    for s in sets:
        out = out | all_present(*s)
    return out


def metadata_number(meta: Column, *paths: str) -> Column:
    """The first of some JSON paths that holds a number."""
    return F.coalesce(*[F.get_json_object(meta, p).try_cast("double") for p in paths])


WIDTHS = ("$.width", "$.WIDTH", "$.resolution[0]", "$.original_resolution[0]", "$.original_width")
HEIGHTS = ("$.height", "$.HEIGHT", "$.resolution[1]", "$.original_resolution[1]", "$.original_height")
SCORES = ("$.similarity", "$.score", "$.SCORE")


def image_quality(w: Column, h: Column, similarity: Column, min_similarity: float, min_side: float, min_aspect: float) -> Column:
    """What is unknown passes: sides at least ``min_side`` and h/w in [r, 1/r] if both are known, similarity at least its bound."""
    sized = (h >= min_side) & (w >= min_side) & (h / w >= min_aspect) & (h / w <= 1 / min_aspect)
    return F.coalesce(sized, F.lit(True)) & F.coalesce(similarity >= min_similarity, F.lit(True))


def image_quality_from_metadata(meta: Column, similarities: Column | None = None, w: Column | None = None, h: Column | None = None, **bounds) -> Column:
    known = lambda c, paths: metadata_number(meta, *paths) if c is None else F.coalesce(c, metadata_number(meta, *paths))
    best = metadata_number(meta, *SCORES) if similarities is None else F.coalesce(F.array_max(similarities), metadata_number(meta, *SCORES))
    return image_quality(known(w, WIDTHS), known(h, HEIGHTS), best, **bounds)


def threshold(value: Column, term: str) -> Column:
    """A condition like ">= 0.3" on a column; anything but an operator and a number raises ValueError, and nothing is evaluated."""
    m = _TERM.match(term)
    if not m:
        raise ValueError(f"not an operator and a number: {term!r}")
    bound = F.lit(float(m[2]))
    return {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound, "==": value == bound, "!=": value != bound}[m[1]]


def metadata_filter(meta: Column, terms: dict[str, str]) -> Column:
    """All terms hold; a missing field rejects, missing metadata passes only where there is no term."""
    out = F.lit(True)
    for field, term in terms.items():
        out = out & F.coalesce(threshold(metadata_number(meta, f"$.{field}"), term), F.lit(False))
    return out


def aspect_flag(w: Column, h: Column, least: float = 1 / 3, most: float = 3.0) -> Column:
    return (w / h).between(least, most)


def large_and_matched(images: Column, min_similarity: float) -> Column:
    """Images (structs of data and matched_sim) of over ten whole kilobytes and enough similarity."""
    return F.filter(images, lambda x: (F.floor(F.octet_length(x["data"]) / 1000) > 10) & (x["matched_sim"] >= min_similarity))


def keep_by_image_count(n: Column, key: Column) -> Column:
    """None: out; one: a coin; more: in."""
    return F.when(n == 0, False).when(n == 1, u01(key, "single") >= 0.5).otherwise(True)


def in_splits(split: Column, allowed: tuple[str, ...] = ("train", "val", "test")) -> Column:
    return split.isin(*allowed)


def by_ids(df: DataFrame, **allowed: list) -> DataFrame:
    """Rows whose columns are among the given values; an empty list is no condition."""
    for c, values in allowed.items():
        if values:
            df = df.where(F.col(c).isin(values))
    return df


def refill_batches(df: DataFrame, batch: str, order: str, ok: str) -> DataFrame:
    """Each batch without its bad rows, filled up again from its head with as many rows as were lost (fewer, if fewer are left)."""
    from pyspark.sql import Window

    w = Window.partitionBy(batch)
    good = df.withColumn("_lost", F.sum((~F.col(ok)).cast("int")).over(w)).where(ok).withColumn("_k", F.row_number().over(w.orderBy(order)))
    again = good.where(F.col("_k") <= F.col("_lost")).withColumn("refilled", F.lit(True))
    return good.withColumn("refilled", F.lit(False)).union(again).drop("_lost", "_k")
