"""Readers: JSON lines and lists, caption annotations, TSV, Parquet, image folders, shard sizes; one registry by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.numbering import prefix
from loomwright.sources.paths import brace_expand


def list_files(spark: SparkSession, root: str | list[str], mask: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length) of files under a root (or of brace-expanded roots) whose names match the mask."""
    roots = root if isinstance(root, list) else brace_expand(root)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(roots).select("path", "length")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, rejects: bool = False) -> DataFrame:
    """Each line that parses, with its columns; blank and bad lines are left out, or alone (``rejects``: path, line)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")
    ok = F.try_parse_json("line").isNotNull() & F.btrim("line").startswith("{")
    if rejects:
        return lines.where(~ok)
    made = lines.where(ok).select("path", F.from_json("line", schema).alias("r"))
    return made.select("path", "r.*")


def number_lines(lines: DataFrame, path: str = "path", place: str = "place") -> DataFrame:
    """key "file_lineN" from a row's place in its file, from 0."""
    name = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.withColumn("key", F.concat(name, F.lit("_line"), F.col(place).cast("string")))


ITEM_KINDS = (("caption", "image"), ("question", "answer", "image"), ("instruction", "source_image", "target_image"))


def select_items(items: DataFrame) -> DataFrame:
    """Items that have one of three sets of fields, and again those that have a video: an item with both comes twice."""
    has = lambda c: F.col(c).isNotNull() if c in items.columns else F.lit(False)
    any_kind = F.lit(False)
    for kind in ITEM_KINDS:
        every = F.lit(True)
        for c in kind:
            every = every & has(c)
        any_kind = any_kind | every
    return items.where(any_kind).unionByName(items.where(has("video") | has("video_id")))


def read_json_list(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_annotations(spark: SparkSession, path: str | list[str], fields: str = "caption string, image string, image_id long") -> DataFrame:
    """Items of {"annotations": [...]} or of a bare list that have a caption and an image; other documents raise."""
    item = f"struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>"
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    bare = F.btrim("v").startswith("[")
    wrapped = F.from_json("v", f"struct<annotations:array<{item}>>")["annotations"]
    items = F.when(bare, F.from_json("v", f"array<{item}>")).otherwise(F.coalesce(wrapped, F.raise_error(F.lit("neither a list nor annotations"))))
    return text.select(F.explode(items).alias("i")).select("i.*").where("caption IS NOT NULL AND image IS NOT NULL")


def read_text_images(spark: SparkSession, path: str | list[str], filters: Column | None = None) -> DataFrame:
    """Parquet of image struct(bytes) and text."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df if filters is None else df.where(filters)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, quote="")


def captions_with_ids(captions: DataFrame, store: DataFrame) -> DataFrame:
    """Captions (caption, image_name) with the ids kept under their names; a miss has null ids and a null caption."""
    joined = captions.join(store, "image_name", "left")
    return joined.withColumn("caption", F.when(F.col("image_ids").isNotNull(), F.col("caption")))


def read_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p))
    return out


def read_image_folder(spark: SparkSession, root: str, mask: str = "*.{jpg,jpeg,png,webp}", labelled: bool = False) -> DataFrame:
    """(path relative to the root, content[, class]): a class is the name of an image's folder, numbered by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/").removeprefix("file://") + "/", -1)
    out = files.select(rel.alias("path"), "content")
    if not labelled:
        return out
    named = out.withColumn("class", F.element_at(F.split("path", "/"), 1))
    numbers = prefix(named.select("class").distinct(), ["class"], place="label")
    return named.join(numbers.select("class", F.col("label").cast("int").alias("label")), "class").select("path", "content", "class", "label")


def dataset_size(shards: DataFrame, sizes: DataFrame, strict: bool = True) -> int:
    """Sum of the sizes of the shards; one without a size raises, or counts nothing."""
    joined = shards.select("shard").join(sizes, "shard", "left")
    missing, total = joined.agg(F.sum(F.col("size").isNull().cast("int")), F.sum("size")).first()
    if strict and missing:
        raise KeyError(f"{missing} shards without a size")
    return int(total or 0)


#: Readers by extension, each (spark, path) -> DataFrame.
BY_EXTENSION = {
    "txt": lambda s, p: s.read.text(p),
    "json": lambda s, p: s.read.json(p, multiLine=True),
    "jsonl": lambda s, p: s.read.json(p),
    "csv": lambda s, p: s.read.csv(p, header=True),
    "tsv": lambda s, p: s.read.csv(p, header=True, sep="\t"),
    "parquet": lambda s, p: s.read.parquet(p),
    "orc": lambda s, p: s.read.orc(p),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in BY_EXTENSION:
        raise ValueError(f"no reader for .{ext}; pickled data is never read")
    return BY_EXTENSION[ext](spark, path)
