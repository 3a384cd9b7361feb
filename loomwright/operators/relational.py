"""The joins, indexes and de-duplications that annotation tables need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return left.join(store, key, "left")


def members(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return left.join(keys, key, "left_semi")


def unfinished(left: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return left.join(done, key, "left_anti")


def existing(annotations: DataFrame, files: DataFrame, path: str, *order: str) -> DataFrame:
    """The first annotation of each path that is among the files."""
    return members(first_wins(annotations, path, *order), files.select(path).distinct(), path)


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a joined with b on the key; ids that only one of them has raise ValueError."""
    only = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").union(b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti"))
    if not only.isEmpty():
        raise ValueError("the ids of both sides differ")
    return a.join(b, key)


def grouped(df: DataFrame, key: str, order: str, *cols: str, name: str = "items") -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def by_content(df: DataFrame, content: Column, *order: str) -> DataFrame:
    """First row of each distinct content, by its md5."""
    return first_wins(df.withColumn("content_md5", F.md5(content)), "content_md5", *order)


def without_contained(texts: Column) -> Column:
    """Texts in order, without those inside one that was kept before."""
    return F.aggregate(texts, F.slice(texts, 1, 0), lambda kept, t: F.when(F.exists(kept, lambda k: F.contains(k, t)), kept).otherwise(F.concat(kept, F.array(t))))


def unused_captions(df: DataFrame) -> DataFrame:
    """(question, answer, caption) from rows (question, place, answer, captions): in order, each answer takes its first
    caption that no answer of the question took before, or none. A fold over the answers of one question."""
    none = F.slice(F.array(F.lit("")), 1, 0)
    rows = F.array_sort(F.collect_list(F.struct("place", "answer", F.coalesce("captions", none).alias("captions"))))

    def step(acc, x):
        c = F.get(F.filter(x["captions"], lambda c: ~F.exists(acc["used"], lambda u: u == c)), 0)
        used = F.when(c.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(c)))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["answer"].alias("answer"), c.alias("caption")))).alias("out"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("used"), F.expr("cast(array() as array<struct<answer:string,caption:string>>)").alias("out"))
    per = df.groupBy("question").agg(rows.alias("r"))
    return per.select("question", F.explode(F.aggregate("r", start, step, lambda acc: acc["out"])).alias("o")).select("question", "o.answer", "o.caption")


def ragged(df: DataFrame, batch: str, order: str, answers: str) -> DataFrame:
    """(batch, answers flat, n_answers)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(answers).alias("a"))))
    return df.groupBy(batch).agg(rows.alias("r")).select(batch, F.flatten(F.transform("r", lambda x: x["a"])).alias("answers"), F.transform("r", lambda x: F.size(x["a"])).alias("n_answers"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
