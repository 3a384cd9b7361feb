"""Tar shards as a Spark data source: headers are walked to cut shards into ranges, ranges are read by tasks, and shards are
written by tasks and appear when all of them are done.

Shards can be of any size. A range begins and ends between members, so that no member is in two, and a task holds one member
and a batch of rows at most.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomwright.session import ship

FORMAT = "tar_shards"
MEMBERS = "shard string, ord int, member string, ext string, payload binary, error string"
#: Bytes of a shard that one task reads, about; a larger member is a range of its own.
SPLIT_BYTES = 128 << 20
#: Bytes of members that a task holds before it hands them on, and the most that a row can hold.
BATCH_BYTES, ROW_BYTES = 16 << 20, (1 << 31) - 1024
#: Bytes of a header that names the next member (a long name, or pax records), at most.
_EXTRA_BYTES = 1 << 20
#: Larger shards than the bound up to which the driver walks them; the headers of more are walked by tasks.
DRIVER_WALKS = 64
#: Bytes of larger shards up to which the driver walks them, as its walk takes as long as there are members.
DRIVER_WALK_BYTES = 32 << 20
#: Ranges that are a task each; more than those are put together to tasks of so many bytes.
TASKS, TASK_BYTES = 256, 4 << 20
_BLOCK = 512


# --- files ------------------------------------------------------------------------------------------------------------


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def list_shards(path: str, mask: str = "*.tar", recursive: bool = True) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files under a folder whose names fit, in order; names that begin with "_" or "." don't."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    head = path[: len(path.rstrip("/")) - len(at.rstrip("/"))] if path.rstrip("/").endswith(at.rstrip("/")) else ""
    own = len(at.rstrip("/")) + 1
    found = [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=recursive)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, mask)]
    return sorted((f"{head}{f.path}", f.size) for f in found if not any(p[:1] in "_." for p in f.path[own:].split("/")))


def open_shard(path: str):
    """A readable, seekable file; a gzipped one is decompressed as it is read."""
    fs, at = file_system(path)
    f = fs.open_input_file(at)
    if f.read(2) == b"\x1f\x8b":
        f.seek(0)
        return gzip.GzipFile(fileobj=f), None
    f.seek(0)
    return f, f.size()


# --- members ----------------------------------------------------------------------------------------------------------


class Damage(Exception):
    """A shard's framing is lost here."""


@dataclass
class Member:
    """A file of a shard: where its first header begins, where its bytes are, and where the next header is."""

    start: int
    data: int
    size: int
    next: int
    name: str


def _pax(data: bytes) -> dict[str, str]:
    """The records of a pax header: "<length> <key>=<value>\\n"."""
    out = {}
    while data[:1].isdigit():
        n = int(data[: data.index(b" ")])
        key, _, value = data[data.index(b" ") + 1 : n - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "surrogateescape")
        data = data[n:]
    return out


def walk(f, size: int | None, at: int = 0, end: int | None = None, globals_: dict[str, str] | None = None) -> Iterator[Member]:
    """The files of a shard from the header at ``at`` on, up to ``end``; raises Damage where the shard breaks off.

    Only headers are read. Links, folders and devices are passed over, as are blocks behind the archive's end. ``size`` is
    the shard's, None if unknown: a member that is cut off is then found by whoever reads it. ``globals_`` takes up pax
    records that hold for all members behind them.
    """
    shared = globals_ if globals_ is not None else {}
    start, named = at, {}
    while end is None or start < end:
        f.seek(at)
        head = f.read(_BLOCK)
        if head.count(0) == len(head):
            if named:
                raise Damage("a header has no member")
            return
        if len(head) < _BLOCK:
            raise Damage("a header is cut off")
        try:
            info = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape")
        except tarfile.HeaderError as e:
            raise Damage(f"a header is damaged: {e}") from None
        extra = info.type in (b"x", b"g", b"X", b"L", b"K")
        n = int(named.get("size", shared.get("size", info.size))) if not extra else info.size
        data = at + _BLOCK
        held = n if extra or info.isreg() or info.type not in tarfile.SUPPORTED_TYPES else 0
        at = data + -(-held // _BLOCK) * _BLOCK
        if size is not None and data + held > size:
            raise Damage(f"{named.get('path', info.name)} is cut off")
        if extra:
            if n > _EXTRA_BYTES:
                raise Damage("a header of names is too long")
            body = f.read(n)
            if info.type == b"g":
                shared |= _pax(body)
            elif info.type == b"L":
                named["path"] = body.rstrip(b"\0").decode("utf-8", "surrogateescape")
            elif info.type != b"K":
                named |= _pax(body)
            continue
        if info.isreg():
            name = named.get("path", shared.get("path", info.name))
            yield Member(start, data, n, at, name.encode("utf-8", "surrogateescape").decode("utf-8", "replace"))
        start, named = at, {}


@dataclass
class Range(InputPartition):
    """Members of a shard whose headers are from ``lo`` on and before ``hi`` (None: to the end); the first is number ``ord``."""

    shard: str = ""
    lo: int = 0
    hi: int | None = None
    ord: int = 0
    globals: dict[str, str] = field(default_factory=dict)


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    parts: list[Range] = field(default_factory=list)


def split_shard(path: str, split_bytes: int = SPLIT_BYTES) -> list[Range]:
    """Ranges of about ``split_bytes``, by a walk over the shard's headers. Where it breaks off, the last range goes on to its end,
    so that the reader meets the damage."""
    f, size = open_shard(path)
    with f:
        shared: dict[str, str] = {}
        out = [Range(path)]
        if size is None or size <= split_bytes:
            return out
        try:
            for i, m in enumerate(walk(f, size, globals_=shared)):
                if m.next - out[-1].lo > split_bytes and m.start > out[-1].lo:
                    out[-1].hi = m.start
                    out.append(Range(path, m.start, None, i, dict(shared)))
        except Damage:
            pass
        return out


_SCHEMA = pa.schema([("shard", pa.string()), ("ord", pa.int32()), ("member", pa.string()), ("ext", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def extension(name: str) -> str:
    """What stands behind the first period of a name's last part, in lower case."""
    return name.rsplit("/", 1)[-1].partition(".")[2].lower()


def read_range(r: Range, exts: frozenset[str] | None = None, tolerant: bool = True, payload: bool = True, batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a range in batches. A shard that breaks off has one row with the error alone behind its whole members, or
    raises; a member over ROW_BYTES is such a row too, and the members behind it follow. Bytes of members with other extensions
    than ``exts`` are not read, and none are without ``payload``."""
    rows, held, n = [], 0, r.ord

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    try:
        f, size = open_shard(r.shard)
        with f:
            for m in walk(f, size, r.lo, r.hi, dict(r.globals)):
                ext = extension(m.name)
                if exts is None or ext in exts:
                    data = None
                    if payload and m.size > ROW_BYTES:
                        if not tolerant:
                            raise Damage(f"{m.name} has {m.size} bytes, more than a row can hold")
                        rows.append((r.shard, n, None, None, None, f"{m.name} has {m.size} bytes, more than a row can hold"))
                    else:
                        if payload:
                            if held and held + m.size > batch_bytes:
                                yield batch()
                                rows, held = [], 0
                            f.seek(m.data)
                            data = f.read(m.size)
                            if len(data) < m.size:
                                raise Damage(f"{m.name} is cut off")
                        rows.append((r.shard, n, m.name, ext, data, None))
                        held += m.size * payload + 256
                n += 1
                if held >= batch_bytes:
                    yield batch()
                    rows, held = [], 0
    except (Damage, OSError, EOFError, ValueError) as e:  # ValueError: records or numbers of a header that can't be read
        if not tolerant:
            raise
        rows.append((r.shard, n, None, None, None, f"{type(e).__name__}: {e}"))
    if rows:
        yield batch()


# --- reading ----------------------------------------------------------------------------------------------------------


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.mask = options.get("mask", "*.tar")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.exts = frozenset(options["exts"].split(",")) if options.get("exts") else None
        self.tolerant = options.get("tolerant", "true") == "true"
        self.payload = options.get("payload", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        """Small shards share a task, as do small ranges; larger shards are cut after a walk over their headers, many at a time."""
        files = list_shards(self.path, self.mask)
        small, large = [f for f in files if f[1] <= self.split_bytes], [f for f in files if f[1] > self.split_bytes]
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(lambda f: split_shard(f[0], self.split_bytes), large))
        share = max(1, TASK_BYTES // self.split_bytes) if sum(map(len, found)) > TASKS else 1
        out = [Ranges(parts=rs[i : i + share]) for rs in found for i in range(0, len(rs), share)]
        held, size = [], 0
        for path, n in small:
            if held and size + n > self.split_bytes:
                out.append(Ranges(parts=held))
                held, size = [], 0
            held.append(Range(path))
            size += n
        return [*out, Ranges(parts=held)] if held else out or [Ranges()]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.parts:
            yield from read_range(r, self.exts, self.tolerant, self.payload)


class TarShards(DataSource):
    """``format("tar_shards")``: options path, mask, splitBytes, exts (comma-joined), tolerant, payload to read; path, key-named
    columns, perShard and shardBytes to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TarShards)


def read_shards(spark: SparkSession, path: str, mask: str = "*.tar", exts: tuple[str, ...] | None = None, split_bytes: int = SPLIT_BYTES, tolerant: bool = True, payload: bool = True) -> DataFrame:
    """(shard, ord, member, ext, payload, error): the files of tar shards under ``path``, in tasks of about ``split_bytes``.

    A shard that breaks off gives its whole members and one row with the error alone, or fails the job (``tolerant=False``).
    ``ord`` is the place among a shard's files, those of other extensions than ``exts`` included. No shard under the path gives
    no rows. Where more than DRIVER_WALKS shards, or DRIVER_WALK_BYTES of them, are larger than a split, tasks walk their headers,
    not the driver.
    """
    register(spark)
    files = list_shards(path, mask)
    large = [n for _, n in files if n > split_bytes]
    if len(large) > DRIVER_WALKS or sum(large) > DRIVER_WALK_BYTES:
        own = spark.createDataFrame(files, "path string, size long")
        return expand_paths(own.repartition(min(len(files), 1000), "path"), exts, split_bytes, tolerant, payload)
    options = {"mask": mask, "splitBytes": str(split_bytes), "exts": ",".join(exts or ()), "tolerant": str(tolerant).lower(), "payload": str(payload).lower()}
    return spark.read.format(FORMAT).options(**options).load(path)


def expand_paths(files: DataFrame, exts: tuple[str, ...] | None = None, split_bytes: int = SPLIT_BYTES, tolerant: bool = True, payload: bool = True) -> DataFrame:
    """read_shards() for a table with a column ``path``: its shards' headers are walked where the rows are, and the ranges dealt
    to tasks anew."""
    wanted = frozenset(exts) if exts else None

    def cut(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    parts = split_shard(path, split_bytes)
                except OSError:
                    parts = [Range(path)]  # its reader reports it
                cols = zip(*((p.shard, p.lo, p.hi, p.ord, list(p.globals.items())) for p in parts))
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "lo", "hi", "ord", "globals"])

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from read_range(Range(row["shard"], row["lo"], row["hi"], row["ord"], dict(row["globals"])), wanted, tolerant, payload)

    ranges = files.select("path").mapInArrow(cut, "shard string, lo long, hi long, ord long, globals map<string,string>")
    return ranges.repartition("shard", "lo").mapInArrow(read, MEMBERS)


# --- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    #: (file as written, name that it gets) of each shard of a task
    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Tasks write whole shards to a folder of the job; the commit gives those of the successful attempts their names, and an
    abort removes the folder. Files of failed or repeated attempts are never seen."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.per_shard, self.shard_bytes = int(options.get("pershard", 10_000)), int(options.get("shardbytes", 1 << 30))
        self.fail_after = int(options.get("failafter", -1))
        self.job = uuid.uuid4().hex[:12]
        self.old = [p for p, _ in list_shards(self.path)] if overwrite and file_system(self.path)[0].get_file_info(file_system(self.path)[1]).type != pafs.FileType.NotFound else []

    @property
    def temporary(self) -> str:
        return f"{self.path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        fs, folder = file_system(self.temporary)
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        out = stream = None
        named, samples, total = None, 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                stream.close()
                out = None

        try:
            for b in iterator:
                names = b.schema.names
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    shard, key = row[0], row[1]
                    if out is None or shard != named or shard is None and (samples >= self.per_shard or total >= self.shard_bytes):
                        close()
                        if total >= 0 <= self.fail_after <= len(done):
                            raise OSError("told to fail")
                        final = f"{shard}.tar" if shard is not None else f"part-{part:05d}-{self.job}-{len(done):04d}.tar"
                        at = f"{folder}/{attempt}-{len(done):04d}.tar"
                        stream = fs.open_output_stream(at)
                        out, named, samples, total = tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT), shard, 0, 0
                        done.append((at, final))
                    for suffix, value in zip(names[2:], row[2:]):
                        if value is not None:
                            info = tarfile.TarInfo(f"{key}.{suffix}")
                            data = value.encode() if isinstance(value, str) else value
                            info.size = len(data)
                            out.addfile(info, io.BytesIO(data))
                            total += len(data)
                    samples += 1
        finally:
            close()
        return _Written(files=done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = file_system(self.path)
        names = [name for m in messages if m for _, name in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError(f"two tasks have written a shard of one name, as {next(n for n in names if names.count(n) > 1)}: deal rows by shard")
        for old in self.old:
            fs.delete_file(file_system(old)[1])
        for m in messages:
            for at, name in m.files if m else ():
                fs.move(at, f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = file_system(self.temporary)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)
        parent = folder.rsplit("/", 1)[0]
        if fs.get_file_info(parent).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(parent)):
            fs.delete_dir(parent)


def write_shards(df: DataFrame, path: str, key: str | Column, columns: dict[str, str], shard: Column | None = None, per_shard: int = 10_000, shard_bytes: int = 1 << 30, mode: str = "append", **options: str) -> None:
    """Write samples as tar shards: a member ``<key>.<suffix>`` for each of ``columns`` (suffix to column, binary or text as UTF-8)
    that is not null.

    A task begins a shard after ``per_shard`` samples or ``shard_bytes``, or, with ``shard``, where that column's value
    changes, and names it so; rows are dealt and sorted by it (and by key) first. Members are streamed to the file. Shards
    appear when every task is done: an aborted job leaves none. ``mode`` is append or overwrite (of shards).
    """
    register(df.sparkSession)
    own = shard.cast("string") if shard is not None else F.lit(None).cast("string")
    k = F.col(key) if isinstance(key, str) else key
    rows = df.select(own.alias("_shard"), k.cast("string").alias("_key"), *[F.col(c).alias(s) for s, c in columns.items()], k.alias("_order"))
    if shard is not None:
        rows = rows.repartition("_shard").sortWithinPartitions("_shard", "_order")
    options |= {"perShard": str(per_shard), "shardBytes": str(shard_bytes)}
    rows.drop("_order").write.format(FORMAT).options(**options).mode(mode).save(path)
