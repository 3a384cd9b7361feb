"""Shard members to samples: adjacent grouping, flattening, aliases, ids by first appearance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.numbering import prefix
from loomwright.session import durable

#: Keys whose numbers are sent to all tasks, at most; the rows of more are joined to theirs.
BROADCAST_KEYS = 100_000


def group_adjacent(df: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """``df`` with group_no, from 0 in each part, that rises where the key differs from the row before."""
    w = Window.partitionBy(part).orderBy(order)
    new = F.when(F.lag(key).over(w).isNull() | (F.lag(key).over(w) != F.col(key)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def group_members(members: DataFrame, suffixes: set[str] | None = None) -> DataFrame:
    """(shard, n, key, data map<suffix, payload>) from (shard, ord, member, payload): neighbours of one key are one sample; a
    suffix (lower-cased) that comes again begins the next. n is the place of a sample's first member in its shard.

    Members without a suffix don't count. A run of neighbours with one key is folded in a row; nothing else of a shard is
    held together.
    """
    base = F.element_at(F.split("member", "/", -1), -1)
    rows = members.select("shard", "ord", "member", "payload", base.alias("base")).where(F.contains("base", F.lit(".")))
    rows = rows.withColumn("stem", F.concat(F.substr("member", F.lit(1), F.length("member") - F.length("base")), F.substring_index("base", ".", 1)))
    rows = rows.withColumn("suffix", F.lower(F.substr("base", F.length(F.substring_index("base", ".", 1)) + 2)))
    if suffixes is not None:
        rows = rows.where(F.col("suffix").isin(*suffixes))
    runs = group_adjacent(rows, "shard", "ord", "stem").groupBy("shard", "group_no").agg(F.first("stem").alias("key"), F.array_sort(F.collect_list(F.struct("ord", "suffix", "payload"))).alias("r"))

    def step(acc, s):
        again = F.exists(acc["have"], lambda h: h == s)
        g = F.when(again, F.element_at(acc["g"], -1) + 1).otherwise(F.coalesce(F.get(acc["g"], F.size(acc["g"]) - 1), F.lit(0)))
        return F.struct(F.when(again, F.array(s)).otherwise(F.concat(acc["have"], F.array(s))).alias("have"), F.concat(acc["g"], F.array(g)).alias("g"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("have"), F.expr("cast(array() as array<int>)").alias("g"))
    parts = F.aggregate(F.transform("r", lambda x: x["suffix"]), start, step, lambda acc: acc["g"])
    numbered = runs.withColumn("g", parts).select("shard", "key", "r", "g", F.explode(F.array_distinct("g")).alias("one"))
    own = F.filter("r", lambda x, i: F.col("g")[i] == F.col("one"))
    data = F.map_from_entries(F.transform(own, lambda x: F.struct(x["suffix"], x["payload"])))
    return numbered.select("shard", own[0]["ord"].cast("long").alias("n"), "key", data.alias("data"))


def first_present(data: Column, *names: str) -> Column:
    return F.coalesce(*[data[n] for n in names])


def flatten_sample(df: DataFrame, structs: Iterable[str], key: str | None = None, default_metadata: bool = True) -> DataFrame:
    """One level of struct columns as columns, later ones winning; metadata "{}" where missing, the key's last path part."""
    cols: dict[str, Column] = {c: F.col(c) for c in df.columns if c not in set(structs)}
    for s in structs:
        cols |= {f.name: F.col(f"{s}.{f.name}") for f in df.schema[s].dataType.fields}
    if default_metadata:
        cols["metadata"] = F.coalesce(cols["metadata"].cast("string"), F.lit("{}")) if "metadata" in cols else F.lit("{}")
    if key:
        cols[key] = F.element_at(F.split(cols[key], "/", -1), -1)
    return df.select(*[c.alias(n) for n, c in cols.items()])


def decode_member(ext: Column, payload: Column) -> Column:
    """Text members as strings; others null."""
    return F.when(ext.isin("txt", "json"), F.decode(payload, "UTF-8"))


def decode_base64(text: Column) -> Column:
    """The bytes that a base64 text stands for; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def encode_base64(data: Column) -> Column:
    """Bytes as base64 text without line breaks."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def drop_undecodable(images: Column, texts: Column, ok: Column) -> Column:
    """Interleaved slots (structs of image and text) without those whose image could not be decoded (``ok``, an array of
    flags, is false there): the slot's text goes with its image. Slots without an image stay."""
    slots = F.arrays_zip(images.alias("image"), texts.alias("text"), ok.alias("ok"))
    kept = F.filter(slots, lambda s: s["image"].isNull() | F.coalesce(s["ok"], F.lit(False)))
    return F.transform(kept, lambda s: F.struct(s["image"].alias("image"), s["text"].alias("text")))


def caption_source(text: Column, metadata: Column, from_metadata: bool, key: str = "top_caption") -> Column:
    return F.get_json_object(metadata, f"$.{key}") if from_metadata else text


def prune_context(context: Column) -> Column:
    """A retrieval context as JSON with text, image name and similarity alone."""
    return F.to_json(F.transform(context, lambda c: F.struct(c["text"].alias("text"), c["image_name"].alias("image_name"), c["similarity"].alias("similarity"))))


def instance_ids(df: DataFrame, *order: str) -> DataFrame:
    """instance_id: the row's place in the order over the whole table, as text, from "0"."""
    return prefix(df, list(order), place="_place").withColumn("instance_id", F.col("_place").cast("string")).drop("_place")


def dense_ids(df: DataFrame, key: str, order: str, name: str = "img_id") -> DataFrame:
    """``df`` with a number for each key in the order of first appearance. Only one row for each key is numbered."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    ranked = durable(prefix(firsts, ["_first", key], place=name).select(key, F.col(name).cast("int").alias(name)), "first-seen")
    return df.join(F.broadcast(ranked) if ranked.count() <= BROADCAST_KEYS else ranked, key)


def class_index(value: Column, classes: dict[str, int]) -> Column:
    """The number of a class; any other value gets the number of classes."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])[value], F.lit(len(classes)))


NLVR_CLASSES = {"False": 0, "True": 1}
SNLI_CLASSES = {"contradiction": 0, "neutral": 1, "entailment": 2}


def flip_pair(first: Column, second: Column, text: Column, flip: Column) -> tuple[Column, Column, Column]:
    """Both images swapped, and with them "left" and "right" in the text, where ``flip`` holds."""
    mark = F.lit("\x00")
    swapped = F.replace(F.replace(F.replace(text, F.lit("left"), mark), F.lit("right"), F.lit("left")), mark, F.lit("right"))
    return F.when(flip, second).otherwise(first), F.when(flip, first).otherwise(second), F.when(flip, swapped).otherwise(text)


def display(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in cols.items()])
