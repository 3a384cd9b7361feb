"""Line dedup: hash normalised lines, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import SPACE, durable, map_arrow, named, pack, prepare, raw, unpack


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line stripped and lower-cased (ASCII only), or None under ``min_chars`` code points."""
    k = line.strip(SPACE).lower()
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def _keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(k, doc): each distinct key of each document."""

    def keys(b: pa.RecordBatch):
        out_k, out_d = [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ks = {line_key(x, min_chars) for x in t.split(b"\n")}
            ks.discard(None)
            out_k += ks
            out_d += [d] * len(ks)
        return pa.RecordBatch.from_arrays([pa.array(out_k, pa.binary()), pa.array(out_d, pa.int64())], ["k", "doc"])

    src = docs.where(named(id_col).isNotNull()).select(named(id_col).cast("long").alias("doc"), raw(text_col).alias("t"))
    return map_arrow(src, keys, "k binary, doc long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Drop each line whose key is in at least ``min_docs`` documents, but in the smallest id that holds it.

    The input's columns come back with ``text_col`` reassembled from the lines kept, in order, and with
    n_lines and n_dropped (long). Nulls and empty texts are one empty line. A row with a null id neither
    counts as a document nor loses lines. Rows that repeat an id count as one document and each keep their
    lines if that id is the smallest. An empty table gives an empty table. Columns of the input named
    n_lines or n_dropped are replaced.

    Only 16-byte keys are counted, pre-aggregated before the shuffle (smallest and largest id, so that one
    hot line is one row per task). The join back is between two exchanges, which adaptive execution can
    split where a line is hot. Keys are written once, for both. The text itself moves once, to meet its dropped keys.
    """
    prepare(docs.sparkSession)
    keys = durable(_keys(docs, id_col, text_col, min_chars), "line-keys")
    if min_docs == 2:
        found = keys.groupBy("k").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper < last")
    else:
        found = keys.distinct().groupBy("k").agg(F.min("doc").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    found = durable(found.select("k", "keeper"), "frequent-lines")
    drops = keys.join(found, "k").where("doc != keeper").groupBy("doc").agg(F.collect_list("k").alias("ks"))

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
    def reassemble(text: pa.Array, ks: pa.Array) -> pa.Array:
        kept, n = [], []
        for t, gone in zip(text.to_pylist(), ks.to_pylist()):
            if gone is None:
                kept.append(None)
                n.append(0)
                continue
            gone, lines = set(gone), t.split(b"\n")
            left = [x for x in lines if line_key(x, min_chars) not in gone]
            kept.append(b"\n".join(left))
            n.append(len(lines) - len(left))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["text", "n"])

    rows = pack(docs, doc=named(id_col).cast("long"), t=F.coalesce(named(text_col), F.lit("")))
    rows = rows.join(drops, "doc", "left")
    rows = rows.withColumn("made", reassemble(F.when(F.col("ks").isNotNull(), F.col("t").cast("binary")), F.col("ks")))
    return unpack(
        rows,
        docs,
        replace={text_col: F.coalesce(F.col("made.text"), F.col("t"))},
        add={"n_lines": F.size(F.split("t", "\n", -1)).cast("long"), "n_dropped": F.col("made.n")},
    )
