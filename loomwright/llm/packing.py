"""Packing documents into token sequences: cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import durable, map_arrow, named, prepare, raw
from loomwright.llm.tokens import encoder, tokenizer_path

#: Pieces that are ranked together, about, and the least and most buckets, by a hash of the document, that a class of lengths
#: has for that; as many counts for each class reach the driver and are sent to the tasks.
BUCKET_PIECES, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 256, 16_384


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern under the duals: how many pieces of each size 1..len(duals) fill ``capacity`` (unbounded
    knapsack by dynamic programming over the capacity)."""
    sizes = np.arange(1, len(duals) + 1)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(c, len(sizes))
        gains = duals[:k] + best[c - sizes[:k]]
        i = int(gains.argmax())
        best[c], pick[c] = (gains[i], i + 1) if gains[i] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(len(duals), np.int64), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, max_columns: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts): a basic solution of the cutting-stock linear program for ``demand`` pieces of each size.

    Revised simplex from the patterns of one size each; every entering column is priced by the knapsack.
    """
    rows = np.flatnonzero(demand > 0)
    n = len(demand)
    if not len(rows):
        return np.zeros((0, n), np.int64), np.zeros(0)
    cols = np.zeros((len(rows), n), np.int64)
    cols[np.arange(len(rows)), rows] = capacity // (rows + 1)
    inverse, amounts = np.diag(1.0 / cols[np.arange(len(rows)), rows]), demand[rows] / cols[np.arange(len(rows)), rows]
    for step in range(max_columns):
        y = np.zeros(n)
        y[rows] = inverse.sum(axis=0)
        value, pattern = price(y, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.einsum("ij,j->i", inverse, pattern[rows].astype(float))  # no threaded BLAS beside the JVM
        up = direction > 1e-9
        ratio = np.full(len(rows), np.inf)
        ratio[up] = amounts[up] / direction[up]
        out = int(ratio.argmin())
        take = max(ratio[out], 0.0)
        amounts = amounts - take * direction
        amounts[out] = take
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        cols[out] = pattern
        if step % 200 == 199:  # a Newton step against the drift of repeated updates
            off = 2 * np.eye(len(rows)) - np.einsum("ij,jk->ik", cols[:, rows].T.astype(float), inverse)
            inverse = np.einsum("ij,jk->ik", inverse, off)
            amounts = np.maximum(np.einsum("ij,j->i", inverse, demand[rows].astype(float)), 0)
    return cols, np.maximum(amounts, 0)


def whole_patterns(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts) that hold exactly ``demand`` pieces: amounts rounded down, then what is left, largest first,
    into the first sequence with room."""
    patterns, amounts = column_generation(demand, capacity)
    counts, left = np.floor(amounts + 1e-7).astype(np.int64), demand.astype(np.int64).copy()
    for i in np.argsort(-counts, kind="stable"):  # float noise must not overdraw a size
        fit = [left[c] // patterns[i, c] for c in np.flatnonzero(patterns[i])]
        counts[i] = min([counts[i], *fit])
        left -= counts[i] * patterns[i]
    rest: list[np.ndarray] = []
    room: list[int] = []
    for c in reversed(range(len(left))):
        for _ in range(int(left[c])):
            at = next((i for i, r in enumerate(room) if r >= c + 1), None)
            if at is None:
                at = len(room)
                room.append(capacity)
                rest.append(np.zeros(len(left), np.int64))
            rest[at][c] += 1
            room[at] -= c + 1
    used = counts > 0
    every = [*patterns[used], *rest]
    return (np.array(every) if every else np.zeros((0, len(demand)), np.int64)), np.array([*counts[used], *[1] * len(rest)], np.int64)


class Slots:
    """Where the piece of a given rank in its class goes: a sequence and a place in it."""

    def __init__(self, demand: np.ndarray, capacity: int):
        patterns, counts = whole_patterns(demand, capacity)
        first = np.concatenate([[0], np.cumsum(counts)])
        self.sequences = int(first[-1])
        self.of = {}
        for c in range(len(demand)):
            p = np.flatnonzero(patterns[:, c])
            self.of[c + 1] = (np.concatenate([[0], np.cumsum(patterns[p, c] * counts[p])]), patterns[p, c], first[p])

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for c in np.unique(size):
            at = np.flatnonzero(size == c)
            starts, each, first = self.of[int(c)]
            p = np.searchsorted(starts, rank[at], side="right") - 1
            k = rank[at] - starts[p]
            sequence[at] = first[p] + k // each[p]
            slot[at] = (len(self.of) - int(c)) * 4096 + k % each[p]
        return sequence, slot


def cut_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(doc, start, n, crc, total[, ids]): the pieces of each document's ids with the end id; all but the last are full."""
    names = ["doc", "start", "n", "crc", "total", *(["ids"] if keep_ids else [])]

    def cut(b: pa.RecordBatch):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        cols = [[] for _ in names]
        for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
            ids += end
            for at in range(0, len(ids), 4 * length):
                part = ids[at : at + 4 * length]
                for c, v in zip(cols, (d, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols)], names)

    src = docs.select(named(id_col).cast("long").alias("doc"), raw(text_col).alias("t"))
    return map_arrow(src, cut, "doc long, start long, n long, crc long, total long" + ", ids binary" * keep_ids)


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, grain: int = 8, keep_ids: bool = False
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long), and with
    ``keep_ids`` the piece's ids (little-endian unsigned 32-bit).

    A document is cut every ``length`` ids; a full piece is a sequence of its own. The remainders' lengths, rounded
    up to ``grain``, make a histogram of at most length / grain classes, all that reaches the driver. Column
    generation finds patterns of classes that fill a sequence; each class's pieces, ranked within buckets by a hash
    of the document and then by id, take the places of their class in the order of rank. Sequences hold at most
    ``length`` ids, and offsets run without gaps.

    A null text is empty and has the end id alone; a null id and repeated rows are packed like any other. An empty
    table gives an empty table. Columns beside id and text are not read. Texts are encoded once, and pieces written.
    """
    prepare(docs.sparkSession)
    if length % grain:
        raise ValueError("grain must divide length")
    pieces = durable(cut_pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), id_col, text_col, length, end_id, keep_ids), "pieces")
    # class 0 holds full pieces, class c those of over (c - 1) * grain ids
    pieces = pieces.withColumn("c", F.when(F.col("n") == length, 0).otherwise(F.ceil(F.col("n") / grain)).cast("int"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, pieces.count() // BUCKET_PIECES))
    pieces = pieces.withColumn("b", F.pmod(F.xxhash64("doc", "start"), F.lit(buckets)).cast("int"))
    classes = length // grain
    counts = np.zeros((classes + 1, buckets), np.int64)
    for r in pieces.groupBy("c", "b").count().toLocalIterator():
        counts[r["c"], r["b"]] = r["count"]
    slots = Slots(counts[1:].sum(axis=1), classes)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((np.cumsum(counts, axis=1) - counts, slots))

    @F.arrow_udf(T.StructType([T.StructField("sequence", T.LongType()), T.StructField("slot", T.LongType())]))
    def place(c: pa.Array, b: pa.Array, k: pa.Array) -> pa.Array:
        before, s = shared.value
        c, b, k = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (c, b, k))
        rank = before[c, b] + k - 1
        sequence, slot = s.sequences + rank, np.zeros(len(c), np.int64)
        part = np.flatnonzero(c > 0)
        if len(part):
            sequence[part], slot[part] = s.place(c[part], rank[part])
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(slot)], ["sequence", "slot"])

    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("c", "b").orderBy("doc", "start", "crc")).cast("long"))
    placed = ranked.withColumn("at", place("c", "b", "k"))
    inside = Window.partitionBy("at.sequence").orderBy("at.slot", "doc", "start")
    offset = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return placed.select(
        F.col("doc").alias("doc_id"),
        "start",
        F.col("n").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("total").alias("doc_tokens"),
        F.col("at.sequence").alias("sequence_id"),
        offset.alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def padding(packed: DataFrame, length: int = 1024) -> DataFrame:
    """One row: sequences, tokens, and padded tokens (a sequence is padded to ``length`` unless it is a power of two long)."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(length - F.col("n"))).alias("padded"))


def sequences(packed: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<long>): the sequences themselves, padded, from pack_documents(keep_ids=True)."""

    def join(b: pa.RecordBatch):
        out = []
        for parts in b.column(1).to_pylist():
            ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64)
            pad = 0 if len(ids) & (len(ids) - 1) == 0 else length - len(ids)
            out.append(np.concatenate([ids, np.full(pad, pad_id, np.int64)]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    per = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return map_arrow(per, join, "sequence_id long, ids array<long>")
