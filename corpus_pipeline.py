"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last
return the columns of ``docs``. run() writes what a stage kept to the shared folder and hands it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import durable, named, pack, table, unpack
from loomwright.llm.line_dedup import dedup_lines
from loomwright.llm.mixing import mix
from loomwright.llm.packing import pack_documents
from loomwright.llm.quality import score_quality, trusted_ids
from loomwright.llm.simhash import drop_near_duplicates


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood ratio go, null and empty texts among them; the labels name
    the trusted ones."""
    marked = pack(docs, doc_id=named("doc_id"), text=named("text"))
    return unpack(score_quality(marked, trusted_ids(table(spark, sf_dir, "labels"))).where("kept"), docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in two documents or more stay in the smallest id alone; n_chars, where the table has it, follows the
    text. Rows that repeat an id are one document."""
    out = dedup_lines(pack(docs, doc_id=named("doc_id"), text=named("text")))
    return unpack(out, docs, replace={"text": F.col("text"), "n_chars": F.length("text").cast("long")})


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return drop_near_duplicates(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null sources are a source; rows that repeat an id get equal copies."""
    return mix(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. A null text is its end id alone; copies of a row are
    packed each."""
    return pack_documents(docs)


STAGES = [("quality rules", _quality), ("line dedup", _lines), ("simhash near-dedup", _near), ("source mixing", _mix), ("packing", _pack)]

#: SQL can't express the fitted ratio, the fingerprints and the linear program; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
