"""Token-id output as a content-addressed store: unique chunks, document recipes and Merkle manifests.

A store is a folder with three tables:

* ``blobs/kind=chunk``: each distinct chunk once: key (BLAKE2b-128 of its ids as little-endian unsigned 32-bit
  integers) and payload (the ids as little-endian unsigned integers of 16 bits, or 32 where the vocabulary needs it);
* ``recipes``: for each document in ascending id: its number, start, n_tokens, entries (20 bytes for each chunk: key,
  number of ids) and leaf (BLAKE2b-256 of id, n_tokens and entries);
* ``manifests/level=0``: for each FAN documents their number, documents, ids and the Merkle root of their leaves;
  ``level=1`` the same for each FAN of those, and so on up to the one root of the store.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import durable, map_arrow, named, prepare, raw
from loomwright.llm.tokens import encoder, tokenizer_path

#: Ids in the rolling window, and mean (a power of two), least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 128, 4096
#: Leaves or roots under one row of a manifest level.
FAN = 4096
#: Chunk keys that a task remembers, not to send a chunk twice.
_SEEN = 300_000


def rolling_hits(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW ids is 0 modulo MEAN."""
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.cumsum(g)
    rolled = total.copy()
    rolled[WINDOW:] -= total[:-WINDOW] if len(ids) > WINDOW else 0
    rolled ^= rolled >> np.uint64(32)
    return np.flatnonzero(rolled & np.uint64(MEAN - 1) == 0) + 1


def cut_ends(hits: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids: at hits, but no chunk under LEAST ids (the last aside) or over MOST."""
    ends, last = [], 0
    for h in [*hits, n]:
        while h - last > MOST:
            last += MOST
            ends.append(last)
        if h - last >= LEAST and h < n:
            ends.append(h)
            last = h
    if n > last:
        ends.append(n)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    return cut_ends(rolling_hits(ids).tolist(), len(ids))


def cut_many(streams: list[bytes]) -> list[list[int]]:
    """cut_points() of several id streams (4 bytes an id) in one pass. A hash that reaches back over a stream's beginning
    lies in its first WINDOW ids, where no chunk can end, as LEAST is more."""
    sizes = [len(x) // 4 for x in streams]
    hits = rolling_hits(np.frombuffer(b"".join(streams), "<u4"))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.searchsorted(hits, starts, side="right").tolist()
    flat = hits.tolist()
    return [cut_ends([h - s for h in flat[i:j]], n) for s, n, i, j in zip(starts.tolist(), sizes, at, at[1:])]


def chunk_key(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def leaf_hash(doc: int | None, n: int, entries: bytes) -> bytes:
    return hashlib.blake2b(repr((doc, n)).encode() + b"\0" + entries, digest_size=32).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level, an odd last node moves up as it is; no leaves: the hash of nothing."""
    level = leaves or [hashlib.blake2b(b"", digest_size=32).digest()]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=32).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0]


def _blobs(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, wide: bool) -> DataFrame:
    """Rows of both kinds from one pass over the texts: chunks (key, payload), and recipes (key of all columns, payload)."""
    store, size = ("<u4", 4) if wide else ("<u2", 2)

    def split(batches):
        enc, seen = encoder(path), set()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            texts = [x + end for x in enc.encode(b.column(1).to_pylist())]
            for doc, data, ends in zip(b.column(0).to_pylist(), texts, cut_many(texts)):
                entries, at, n = [], 0, len(data) // 4
                small = np.frombuffer(data, "<u4").astype(store).tobytes()
                for e in ends:
                    key = chunk_key(data[4 * at : 4 * e])
                    entries.append(key + (e - at).to_bytes(4, "little"))
                    if key not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append(("chunk", key, None, None, small[size * at : size * e]))
                    at = e
                joined = b"".join(entries)
                rows.append(("recipe", leaf_hash(doc, n, joined), doc, n, joined))
            if rows:
                kind, key, doc, n, payload = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], ["kind", "key", "doc", "n", "payload"]
                )

    src = docs.select(named(id_col).cast("long").alias("doc"), raw(text_col).alias("t"))
    return src.mapInArrow(split, "kind string, key binary, doc long, n long, payload binary")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, wide: bool = False) -> None:
    """Encode whole texts, an end id after each, and write a store (see the module) to ``path``.

    Null and empty texts are the end id alone. Repeated rows are documents of their own, next to each other; null ids
    come last. An empty table makes an empty store. Each text is encoded once; its chunks and its recipe cross one
    shuffle by key, after the tasks have dropped the repeats that they know of, and meet their copies there.
    ``wide`` is for vocabularies of over 65,536 ids.
    """
    spark = docs.sparkSession
    prepare(spark)
    blobs = _blobs(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), id_col, text_col, end_id, wide)
    first = F.row_number().over(Window.partitionBy("key").orderBy("kind"))
    once = blobs.withColumn("copy", first).where("kind = 'recipe' OR copy = 1").drop("copy")
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/blobs")
    if _is_empty(spark, path):
        return
    recipes = spark.read.parquet(f"{path}/blobs/kind=recipe").select("doc", "n", F.col("key").alias("leaf"), F.col("payload").alias("entries"))
    order = [F.col("doc").asc_nulls_last(), "leaf"]
    dealt = durable(recipes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered-recipes")
    base, docs_before, ids_before = [], 0, 0
    for r in dealt.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).orderBy("part").collect():
        base.append((r.part, docs_before, ids_before))
        docs_before, ids_before = docs_before + r.docs, ids_before + r.ids
    bases = spark.createDataFrame(base, "part int, docs_before long, ids_before long")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(F.broadcast(bases), "part").withColumn("start", F.col("ids_before") + F.sum("n").over(inside) - F.col("n"))
    placed = placed.withColumn("number", F.col("docs_before") + F.count("*").over(inside) - 1)
    placed.select("number", "doc", "start", F.col("n").alias("n_tokens"), "entries", "leaf").write.option("compression", "zstd").parquet(f"{path}/recipes")
    level, below = 0, _leaves(spark, path)
    while True:
        _level(below).write.parquet(f"{path}/manifests/level={level}")
        below = _stored_level(spark, path, level)
        if below.count() == 1:
            break
        level += 1


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.select("number", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("ids"), F.col("leaf").alias("root"))


def _stored_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("number long, docs long, ids long, root binary").parquet(f"{path}/manifests/level={level}")


def _level(below: DataFrame) -> DataFrame:
    """(number, docs, ids, root) over each FAN rows of the level below: a row never holds more than FAN hashes."""

    @F.arrow_udf("binary")
    def root(hashes: pa.Array) -> pa.Array:
        return pa.array([merkle_root(x) for x in hashes.to_pylist()], pa.binary())

    rows = below.select(F.floor(F.col("number") / FAN).cast("long").alias("up"), "number", "docs", "ids", "root")
    per = rows.groupBy("up").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), F.array_sort(F.collect_list(F.struct("number", "root"))).alias("l"))
    return per.select(F.col("up").alias("number"), "docs", "ids", root(F.col("l.root")).alias("root"))


@lru_cache(1)
def _shift_tables() -> list[np.ndarray]:
    """For each power of two b: four tables of 256 that advance a crc32 over 2^b zero bytes."""

    def apply(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where(v >> np.uint32(i) & np.uint32(1), columns[i], np.uint32(0))
        return out

    def bit(v: np.ndarray) -> np.ndarray:  # one zero bit more, reflected polynomial
        return (v >> np.uint32(1)) ^ np.where(v & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))

    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = bit(columns)
    out = []
    for _ in range(48):
        byte = np.arange(256, dtype=np.uint32)
        out.append(np.stack([apply(columns, byte << np.uint32(8 * k)) for k in range(4)]))
        columns = apply(columns, columns)
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each crc32 contributes to that of a stream in which ``zeros`` bytes follow; the contributions' xor is its crc32."""
    crc, zeros = crc.astype(np.uint32), zeros.astype(np.int64)
    for b, table in enumerate(_shift_tables()):
        at = np.flatnonzero(zeros >> b & 1)
        if len(at):
            v = crc[at]
            crc[at] = table[0][v & 255] ^ table[1][v >> np.uint32(8) & 255] ^ table[2][v >> np.uint32(16) & 255] ^ table[3][v >> np.uint32(24)]
        elif not (zeros >> b).any():
            break
    return crc


def _is_empty(spark: SparkSession, path: str) -> bool:
    return spark.read.schema("key binary, doc long, n long, payload binary, kind string").parquet(f"{path}/blobs").isEmpty()


_EMPTY = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _entries(recipes: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, pos, key, n, after): each chunk of each document, and the ids of the document behind it."""

    def explode(b: pa.RecordBatch):
        cols = [[] for _ in range(7)]
        for doc, start, n, data, leaf in zip(*(c.to_pylist() for c in b.columns)):
            if leaf_hash(doc, n, data) != leaf:
                raise ValueError(f"the recipe of document {doc} does not match its leaf")
            left = n
            for pos in range(0, len(data), 20):
                k = int.from_bytes(data[pos + 16 : pos + 20], "little")
                left -= k
                for c, v in zip(cols, (doc, start, n, pos // 20, data[pos : pos + 16], k, left)):
                    c.append(v)
            if left:
                raise ValueError(f"the recipe of document {doc} lacks {left} ids")
        names = ["doc", "start", "n_tokens", "pos", "key", "n", "after"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "key" else pa.int64()) for k, c in zip(names, cols)], names)

    return map_arrow(recipes.select("doc", "start", "n_tokens", "entries", "leaf"), explode, "doc long, start long, n_tokens long, pos long, key binary, n long, after long")


def _chunks(spark: SparkSession, path: str, wide: bool) -> DataFrame:
    """(key, crc, m, payload) of each stored chunk, whose payload is held against its key."""
    store = "<u4" if wide else "<u2"

    def verify(b: pa.RecordBatch):
        crc, m = [], []
        for key, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.frombuffer(payload, store).astype("<u4").tobytes()
            if chunk_key(ids) != key:
                raise ValueError(f"chunk {key.hex()} does not match its key")
            crc.append(zlib.crc32(ids))
            m.append(len(ids) // 4)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(m, pa.int64())], ["key", "crc", "m"])

    return map_arrow(spark.read.parquet(f"{path}/blobs/kind=chunk").select("key", "payload"), verify, "key binary, crc long, m long")


def verify_manifests(spark: SparkSession, path: str) -> None:
    """Recompute every level from the one below as it is on disk, from the recipes up; a difference raises ValueError.

    Levels are compared by a join; a few rows that differ and counts reach the driver.
    """
    level, below = 0, _leaves(spark, path)
    while True:
        kept = _stored_level(spark, path, level)
        now = _level(below).select("number", F.struct("docs", "ids", "root").alias("now"))
        both = now.join(kept.select("number", F.struct("docs", "ids", "root").alias("kept")), "number", "full")
        if wrong := both.where(~F.col("now").eqNullSafe(F.col("kept"))).select("number").limit(5).collect():
            raise ValueError(f"manifests differ on level {level} at {sorted(r.number for r in wrong)}")
        if kept.count() == 1:
            return
        level, below = level + 1, kept


def read_store(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32: long) of each document, from a store's files alone.

    Manifests are verified first; every chunk is held against its key and every recipe against its leaf. A document's
    crc32 follows from its chunks' by shifting each past the ids behind it, so payloads are read once, where they lie,
    and only keys and checksums are shuffled.
    """
    prepare(spark)
    if _is_empty(spark, path):
        return spark.createDataFrame([], _EMPTY)
    verify_manifests(spark, path)

    @F.arrow_udf("long")
    def shifted(crc: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array(shift_crc(crc.to_numpy(zero_copy_only=False), 4 * after.to_numpy(zero_copy_only=False)).astype(np.int64))

    entries = _entries(spark.read.parquet(f"{path}/recipes"))
    joined = entries.join(_chunks(spark, path, wide), "key", "left")
    bad = F.col("m").isNull() | (F.col("m") != F.col("n"))
    joined = joined.withColumn("crc", F.when(bad, F.raise_error(F.lit("a chunk is missing or of another length"))).otherwise(F.col("crc")))
    per = joined.withColumn("x", shifted("crc", "after")).groupBy("start", "doc", "n_tokens").agg(F.bit_xor("x").alias("ids_crc32"))
    return per.select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def decode_store(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, ids array<long>): every document's ids put together from its chunks."""
    prepare(spark)
    if _is_empty(spark, path):
        return spark.createDataFrame([], "doc_id long, start long, ids array<bigint>")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def join(parts: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(p), "<u4" if wide else "<u2").astype(np.int64) for p in parts.to_pylist()], pa.list_(pa.int64()))

    chunks = spark.read.parquet(f"{path}/blobs/kind=chunk").select("key", "payload")
    joined = _entries(spark.read.parquet(f"{path}/recipes")).join(chunks, "key")
    per = joined.groupBy("start", "doc").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("p"))
    return per.select(F.col("doc").alias("doc_id"), "start", join(F.col("p.payload")).alias("ids"))
