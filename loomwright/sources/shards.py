"""Tar shards: a tolerant reader with a channel for rejects, image sizes from headers, and a writer."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "shard string, ord int, member string, ext string, payload binary, error string"
#: Bytes of members that a task holds before it hands them on, and what a row takes beside its member's bytes, about.
_HELD_BYTES, _ROW_BYTES = 2 << 20, 512
_TYPES = {"shard": pa.string(), "ord": pa.int32(), "member": pa.string(), "ext": pa.string(), "payload": pa.binary(), "error": pa.string()}


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.values())], list(_TYPES))


def _member_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "ord", "member", "ext", "payload", "error"]).astype({"ord": "int32"})


def read_tar(spark: SparkSession, path: str | list[str], mask: str = "*.tar", exts: tuple[str, ...] | None = None, tolerant: bool = True, recursive: bool = True) -> DataFrame:
    """(shard, ord, member, ext, payload, error): the files of tar shards, one task for whole shards.

    A shard that breaks off gives the members read so far and one row with the error alone, or fails the job
    (``tolerant=False``). ``exts`` leaves other members' bytes unread. A shard is at most the 2 GB that a row can hold; its
    members are handed on as they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return expand_tar(files, exts, tolerant)


def expand_tar(files: DataFrame, exts: tuple[str, ...] | None = None, tolerant: bool = True) -> DataFrame:
    """read_tar() for a table of path and content. Shards are read where Arrow holds them; small ones share a batch of members."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for shard, content in zip(b.column(0), b.column(1)):
                shard, content, ord_ = shard.as_py(), content.as_buffer() if content.is_valid else pa.py_buffer(b""), 0
                try:
                    with tarfile.open(fileobj=pa.BufferReader(content), mode="r|*") as tar:
                        for info in tar:
                            tar.members.clear()  # else it keeps every header
                            if not info.isfile():
                                continue
                            name = info.name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                            ext = name.rsplit("/", 1)[-1].partition(".")[2].lower()
                            if exts is None or ext in exts:
                                payload = tar.extractfile(info).read()
                                if len(payload) < info.size:
                                    raise tarfile.ReadError(f"{name} is cut off")
                                rows.append((shard, ord_, name, ext, payload, None))
                                held += len(payload) + _ROW_BYTES
                            ord_ += 1
                            if held >= _HELD_BYTES:
                                yield _member_batch(rows)
                                rows, held = [], 0
                        if content[257:262].to_pybytes() == b"ustar" and 0 < content.size - tar.offset < 512:  # plain tars end on whole blocks
                            raise tarfile.ReadError("a header is cut off")
                except Exception as e:  # any damage ends the shard, as its framing is lost
                    if not tolerant:
                        raise
                    rows.append((shard, ord_, None, None, None, f"{type(e).__name__}: {e}"))
                    held += _ROW_BYTES
        if rows:
            yield _member_batch(rows)

    return files.select("path", "content").mapInArrow(members, MEMBERS)


def expand_archive(files: DataFrame, tolerant: bool = True) -> DataFrame:
    """The members of zip files and the one member of gz files (path and content), as expand_tar() gives those of tars. A gz
    file's member has its name without ".gz"; other files are a reject row, as broken ones are."""

    def members(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows, held = [], 0
            for path, content in zip(pdf["path"], pdf["content"]):
                ord_ = 0
                name = path.rsplit("/", 1)[-1]
                try:
                    if content[:2] == b"\x1f\x8b":
                        member = name[:-3] if name.endswith(".gz") else name
                        rows.append((path, 0, member, member.partition(".")[2].lower(), gzip.decompress(content), None))
                        held += len(rows[-1][4]) + _ROW_BYTES
                    else:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            for info in z.infolist():
                                if not info.is_dir():
                                    rows.append((path, ord_, info.filename, info.filename.rsplit("/", 1)[-1].partition(".")[2].lower(), z.read(info), None))
                                    held += len(rows[-1][4]) + _ROW_BYTES
                                    ord_ += 1
                                if held >= _HELD_BYTES:
                                    yield _member_rows(rows)
                                    rows, held = [], 0
                except Exception as e:
                    if not tolerant:
                        raise
                    rows.append((path, ord_, None, None, None, f"{type(e).__name__}: {e}"))
                if held >= _HELD_BYTES:
                    yield _member_rows(rows)
                    rows, held = [], 0
            yield _member_rows(rows)

    return files.select("path", "content").mapInPandas(members, MEMBERS)


def samples(members: DataFrame) -> DataFrame:
    return members.where("error IS NULL")


def rejects(members: DataFrame) -> DataFrame:
    return members.where("error IS NOT NULL").select("shard", "ord", "error")


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, JPEG or WebP from its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X" and len(data) >= 30:
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8 " and len(data) >= 30:
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L" and len(data) >= 25:
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1:
                at += 1 if mark == 0xFF else 2
                continue
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def with_image_size(df: DataFrame, payload: str = "payload") -> DataFrame:
    @F.pandas_udf("struct<width:int,height:int>")
    def size(data: pd.Series) -> pd.DataFrame:
        found = [image_size(bytes(x)) if x is not None else None for x in data]
        return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})

    return df.withColumn("_z", size(payload)).select(*df.columns, F.col("_z.width").alias("width"), F.col("_z.height").alias("height"))


def pack_tar(rows: DataFrame, key: str, columns: dict[str, str], per_shard: int = 10_000, shard_bytes: int = 64 << 20) -> DataFrame:
    """(part, shard, content): tar files for each partition, of at most ``per_shard`` samples; one that has ``shard_bytes`` ends
    before. ``columns`` maps suffixes to columns (binary, or text as UTF-8). A file sink or a table can hold the result."""
    names = list(columns.values())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, n, buf, tar = TaskContext.get().partitionId(), 0, 0, None, None

        def made() -> pa.RecordBatch:
            tar.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([buf.getvalue()], pa.binary())], ["part", "shard", "content"])

        for b in batches:
            for k, *values in zip(*b.columns):
                if tar is None:
                    buf = io.BytesIO()
                    tar, n = tarfile.open(fileobj=buf, mode="w"), 0
                for suffix, value in zip(columns, values):
                    if value.is_valid:
                        data = value.as_buffer()
                        info = tarfile.TarInfo(f"{k.as_py()}.{suffix}")
                        info.size = data.size
                        tar.addfile(info, pa.BufferReader(data))
                        tar.members.clear()  # else it keeps every header
                n += 1
                if n == per_shard or buf.tell() >= shard_bytes:
                    yield made()
                    no, buf, tar = no + 1, None, None
        if tar is not None:
            yield made()

    return rows.select(F.col(key).cast("string"), *names).mapInArrow(build, "part int, shard int, content binary")
