"""Token arrays: padding, masks, slices, frame indices; and a plain tokenizer with the same ids in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.vectors import bind

PAD_ID, BOS_ID, EOS_ID = 0, 1, 2
IGNORE = -100
_BUCKETS = 31_997


def word_ids(text: Column, most: int | None = None) -> Column:
    """Ids of the words between single spaces, 3 + md5 modulo 31,997: a stand-in for a vocabulary, equal in DuckDB. With
    ``most``, of the first words only, as a caller that truncates needs no more."""
    words = F.filter(F.split(text, " ", -1), lambda w: w != "")
    words = words if most is None else F.slice(words, 1, most)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % _BUCKETS + 3).cast("int"))


def word_ids_sql(text: str) -> str:
    words = f"list_filter(string_split({text}, ' '), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: (('0x' || substr(md5(w), 1, 7))::BIGINT % {_BUCKETS} + 3)::INTEGER)"


def pad_truncate(ids: Column, length: int, pad: int = PAD_ID) -> Column:
    """Cut to ``length`` (an end id may go), or filled up with ``pad``."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids)))
    return F.slice(F.concat(ids, fill), 1, length)


def attention(size: Column, length: int) -> Column:
    n = F.least(size, F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def mask_id(ids: Column, value: int = PAD_ID, ignore: int = IGNORE) -> Column:
    return F.transform(ids, lambda x: F.when(x == value, ignore).otherwise(x))


def mask_prefix(ids: Column, n: Column, ignore: int = IGNORE) -> Column:
    return F.transform(ids, lambda x, i: F.when(i < n, ignore).otherwise(x))


def ignored(ids: Column, ignore: int = IGNORE) -> Column:
    return F.transform(ids, lambda _: F.lit(ignore))


def slices(ids: Column, size: int = 32) -> Column:
    """Whole slices of ``size``; a rest is left out. ``ids`` are worked out once, not once for each slice."""

    def cut(ids: Column) -> Column:
        n = F.floor(F.size(ids) / size).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(ids, i * size + 1, F.lit(size)))

    return bind(ids, cut)


def frame_indices(length: Column, frames: int) -> Column:
    """Midpoints of ``frames`` intervals of [0, length): floors of evenly spaced edges, halved sums."""
    edge = lambda i: F.floor(i * length / frames)
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.floor((edge(i) + edge(i + 1)) / 2).cast("int"))


def uniform_frames(length: Column, frames: int) -> Column:
    """``frames`` places of [0, length) at even steps from 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.floor(i * length / frames).cast("int"))


def headtail_frames(length: Column, frames: int, key: Column) -> Column:
    """Half of the frames from the first half of [0, length), half from the second, none twice, in order: those places that
    come first by a hash of the key and the place. A half that is shorter gives all it has."""
    half = F.floor(length / 2).cast("int")

    def some(lo: Column, hi: Column) -> Column:
        at = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
        order = F.array_sort(F.transform(at, lambda i: F.struct(F.md5(F.concat(key.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"))))
        return F.array_sort(F.transform(F.slice(order, 1, frames // 2), lambda x: x["i"]))

    return F.concat(some(F.lit(0), half), some(half, length.cast("int")))


def pad_to_longest(ids: Column, longest: Column, pad: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), longest - F.size(ids)))


def joined(ids: Column) -> Column:
    """An array of numbers as text, for sinks and comparisons that do not hold arrays."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
