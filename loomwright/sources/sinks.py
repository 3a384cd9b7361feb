"""Sinks: sharded samples, merged results, leaderboard files, metric and chat logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.relational import first_wins


def sample_key(source: Column) -> Column:
    """A key that reruns repeat: the md5 of what the sample came from."""
    return F.md5(source.cast("string"))


def write_samples(df: DataFrame, path: str, per_file: int = 10_000) -> None:
    df.write.option("maxRecordsPerFile", per_file).parquet(path)


def question_answer(df: DataFrame) -> DataFrame:
    return df.select("image_ids", "question", "answer")


def merge_results(results: DataFrame, key: str, rank: str, place: str) -> DataFrame:
    """Ranks' results as one, the first for each key in rank order."""
    return first_wins(results, key, rank, place)


def save_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON file; meant for results and metrics, which are small."""
    df.coalesce(1).write.mode(mode).json(path)


def leaderboard_line(question: Column, answer: Column) -> Column:
    entry = F.struct(answer.alias("direct_answer"), F.lit("").alias("multiple_choice"))
    return F.to_json(F.map_from_arrays(F.array(question.cast("string")), F.array(entry)))


def leaderboard_item(question: Column, answer: Column) -> Column:
    return F.to_json(F.struct(question.cast("string").alias("questionId"), answer.alias("prediction")))


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def log_day(tstamp: Column) -> Column:
    """The date of an epoch second, for a log of each day."""
    return F.date_format(F.timestamp_seconds(tstamp), "yyyy-MM-dd")


def append_chat_log(events: DataFrame, path: str) -> None:
    """Events (tstamp double, ...) as JSON lines in a folder for each day."""
    events.withColumn("day", log_day(F.col("tstamp"))).write.mode("append").partitionBy("day").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", compression="gzip", header=True)


def url_file_name(url: Column, n_digits: int = 10) -> Column:
    """A file name from the crc32 of a URL's UTF-8 bytes."""
    return F.lpad(F.crc32(url.cast("binary")).cast("string"), n_digits, "0")
