import gzip
import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from loomwright.sources import tars


def build(path, members, fmt=tarfile.PAX_FORMAT, **extra):
    with tarfile.open(path, "w", format=fmt, **extra) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return str(path)


def some(n=60, seed=1, most=3000):
    r = random.Random(seed)
    out = [(f"d{i % 3}/s{i:03d}.{r.choice(['txt', 'json', 'tar.gz', 'JPG'])}", r.randbytes(r.choice([0, 1, 511, 512, 513, r.randrange(most)]))) for i in range(n)]
    return [*out[:5], ("folder", None), *out[5:], (f"long/{'n' * 150}/{'é' * 60}.txt", b"long name"), ("x" * 99 + ".bin", b"z" * 20_000)]


def rows(df):
    return sorted((r.shard.rsplit("/", 1)[-1], r.ord, r.member, bytes(r.payload) if r.payload is not None else None, r.error) for r in df.collect())


@pytest.mark.parametrize("fmt", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
@pytest.mark.parametrize("split", [700, 5000, 1 << 30])
def test_ranges_give_what_one_read_gives(spark, tmp_path, fmt, split):
    """Members on and across bounds, long names, folders, and a member larger than a range, as Python's own reader has them."""
    members = some()
    path = build(tmp_path / "a.tar", members, fmt, pax_headers={"comment": "of all"} if fmt == tarfile.PAX_FORMAT else None)
    want = [("a.tar", i, n, d, None) for i, (n, d) in enumerate(m for m in members if m[1] is not None)]
    parts = tars.split_shard(path, split)
    assert (len(parts) > 5) == (split < 10_000) and [p.hi for p in parts[:-1]] == [p.lo for p in parts[1:]] and parts[-1].hi is None
    assert rows(tars.read_shards(spark, str(tmp_path), split_bytes=split)) == want
    files = spark.createDataFrame([(path,)], "path string")
    assert rows(tars.expand_paths(files, split_bytes=split)) == want
    assert tars.read_shards(spark, path, split_bytes=split).rdd.getNumPartitions() == len(parts)


def test_truncated_anywhere(spark, tmp_path):
    """Whole members come through and the damage is one row, wherever a shard is cut; the cut in the padding of a member and a
    missing end are no damage."""
    members = some(12, 2)
    whole = open(build(tmp_path / "whole.tar", members), "rb").read()
    os.remove(tmp_path / "whole.tar")
    full = list(tars.walk(io.BytesIO(whole), len(whole)))
    for cut in {0, 1, 511, 512, 513, full[3].data, full[3].data + 1, full[5].next, full[5].next + 100, full[-1].next, len(whole) - 700, *random.Random(3).sample(range(len(whole)), 30)}:
        path = tmp_path / "cut.tar"
        path.write_bytes(whole[:cut])
        kept = [m for m in full if m.data + m.size <= cut]
        for split in (900, 1 << 30):
            got = [r for p in tars.split_shard(str(path), split) for b in tars.read_range(p) for r in b.to_pylist()]
            good = [r for r in got if r["error"] is None]
            assert [(r["ord"], r["member"], r["payload"]) for r in good] == [(i, m.name, whole[m.data : m.data + m.size]) for i, m in enumerate(kept)]
            bad = [r for r in got if r["error"] is not None]
            at = kept[-1].next if kept else 0
            assert len(bad) <= 1 and (not bad or bad[0]["ord"] == len(good)) and (bool(bad) == (cut > at and cut < full[-1].next and whole[at : at + 1] != b"\0"))
    with pytest.raises(Exception, match="cut off"):
        (tmp_path / "cut.tar").write_bytes(whole[: full[3].data + 1] if full[3].size > 1 else whole[: full[3].data - 5])
        tars.read_shards(spark, str(tmp_path), tolerant=False).collect()


def test_damage_extensions_gzip_and_listing(spark, tmp_path):
    good = build(tmp_path / "g.tar", some(6, 4))
    raw = bytearray(open(good, "rb").read())
    second = list(tars.walk(io.BytesIO(bytes(raw)), len(raw)))[1]
    raw[second.start + 10] ^= 255
    (tmp_path / "bad.tar").write_bytes(raw)
    (tmp_path / "empty.tar").write_bytes(b"")
    (tmp_path / "_hidden.tar").write_bytes(b"x")
    (tmp_path / "z.tar").write_bytes(gzip.compress(open(good, "rb").read()))
    (tmp_path / "zcut.tar").write_bytes(gzip.compress(open(good, "rb").read())[:300])
    got = rows(tars.read_shards(spark, str(tmp_path)))
    of = lambda name: [r[1:] for r in got if r[0] == name]
    assert of("g.tar") == of("z.tar") and len(of("bad.tar")) == 2 and "damaged" in of("bad.tar")[1][-1] and of("empty.tar") == [] and not of("_hidden.tar") and of("zcut.tar")[-1][-1]
    only = tars.read_shards(spark, good, exts=("txt",)).collect()
    assert only and all(r.ext == "txt" and r.payload is not None for r in only)
    names = tars.read_shards(spark, good, payload=False).collect()
    assert len(names) == 8 and all(r.payload is None for r in names)
    with pytest.raises(Exception, match="nowhere"):
        tars.read_shards(spark, str(tmp_path / "nowhere")).collect()


def test_many_large_shards_are_walked_by_tasks(spark, tmp_path, monkeypatch):
    for i in range(4):
        build(tmp_path / f"{i}.tar", some(10, i))
    want = rows(tars.read_shards(spark, str(tmp_path)))
    monkeypatch.setattr(tars, "DRIVER_WALKS", 2)
    df = tars.read_shards(spark, f"file://{tmp_path}", split_bytes=2000)
    assert rows(df) == want and "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_writing_commits_all_or_nothing(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("t"), F.when(F.col("id") % 2 == 0, F.encode(F.col("id").cast("string"), "UTF-8")).alias("b"))
    tars.write_shards(df.repartition(3), str(out), "k", {"txt": "t", "bin": "b"}, per_shard=20)
    names = sorted(os.listdir(out))
    assert len(names) >= 5 and all(n.startswith("part-") for n in names)
    got = {r.member: bytes(r.payload) for r in tars.read_shards(spark, str(out)).collect()}
    assert got == {f"{i}.txt": f"text {i}".encode() for i in range(100)} | {f"{i}.bin": str(i).encode() for i in range(0, 100, 2)}
    with pytest.raises(Exception):
        tars.write_shards(df.repartition(3), str(out), "k", {"txt": "t"}, per_shard=20, mode="overwrite", failAfter="1")
    assert sorted(os.listdir(out)) == names
    tars.write_shards(df.limit(5), str(out), "k", {"txt": "t"}, mode="append")
    assert len(os.listdir(out)) > len(names) and tars.read_shards(spark, str(out)).count() == 155
    tars.write_shards(df, str(out), "k", {"txt": "t"}, shard=F.floor(F.col("k") / 30), mode="overwrite")
    assert sorted(os.listdir(out)) == ["0.tar", "1.tar", "2.tar", "3.tar"]
    order = [r.member for r in tars.read_shards(spark, str(out / "1.tar")).orderBy("ord").collect()]
    assert order == [f"{i}.txt" for i in range(30, 60)]
    empty = tmp_path / "none"
    tars.write_shards(df.limit(0), str(empty), "k", {"txt": "t"})
    assert not empty.exists() or os.listdir(empty) == []
