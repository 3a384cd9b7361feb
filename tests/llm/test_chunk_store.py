import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm.chunk_store import LEAST, MOST, cut_many, cut_points, decode_store, merkle_root, read_store, shift_crc, verify_manifests, write_store
from loomwright.llm.tokens import tokenizer_path


def corpus():
    r = random.Random(5)
    vocab = [f"word{i}" for i in range(200)] + ["É", "日本", "don't", "42", "<|endoftext|>", "x<|startoftext|>y"]
    docs = [" ".join(r.choice(vocab) for _ in range(int(r.paretovariate(0.7)) % 4000)) for _ in range(60)]
    docs[7] = docs[3] + "\n" + docs[5] * 3
    docs[9] = " ".join(r.choice(vocab) for _ in range(3000)) + docs[7]
    return [(i, t) for i, t in enumerate(docs)] + [(100, None), (101, ""), (50, docs[50]), (None, "no id")]


def test_round_trip(spark, tmp_path):
    rows = corpus()
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(3)
    path = f"file://{tmp_path}/store"
    write_store(df, path)
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, ids))
        at += len(ids)
    got = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in read_store(spark, path).collect())
    assert got == [(s, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in want]
    assert sorted((x.start, x.doc_id, x.ids) for x in decode_store(spark, path).collect()) == [(s, i, ids) for i, s, ids in want]
    keys = [k for k in spark.read.parquet(f"{path}/blobs/kind=chunk").toPandas().key]
    assert len(keys) == len(set(keys))
    starts = [s for f in sorted(os.listdir(tmp_path / "store/recipes")) if f.endswith(".parquet") for s in pq.read_table(tmp_path / "store/recipes" / f).column("start").to_pylist()]
    assert starts == sorted(starts)


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None], "doc_id long, text string")
    for part, message in (("recipes", "manifests differ"), ("blobs/kind=chunk", "match")):
        path = tmp_path / part.replace("/", "-")
        write_store(df, f"file://{path}")
        spark.read.parquet(f"file://{path}/{part}").createOrReplaceTempView("t")
        change = "number, doc + 1000 as doc, start, n_tokens, entries, leaf" if part == "recipes" else "key, doc, n, concat(payload, x'0000') as payload"
        spark.sql(f"select {change} from t").write.parquet(f"file://{path}-new")
        os.rename(path / part, f"{path}-old")
        os.rename(f"{path}-new", path / part)
        if part == "recipes":
            spark.sql("select 1").collect()
            moved = spark.read.parquet(f"file://{path}/recipes")
            moved.limit(3).write.parquet(f"file://{path}-short")
            os.rename(path / part, f"{path}-older")
            os.rename(f"{path}-short", path / part)
            with pytest.raises(ValueError, match=message):
                verify_manifests(spark, f"file://{path}")
        else:
            with pytest.raises(Exception, match=message):
                read_store(spark, f"file://{path}").collect()


def test_cutting_and_checksums():
    r = np.random.default_rng(1)
    ids = r.integers(0, 49408, 40_000)
    ends = cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= LEAST and sizes.max() <= MOST and 300 < sizes.mean() < 900
    moved = cut_points(np.concatenate([r.integers(0, 49408, 777), ids]))
    assert len({len(ids) - e for e in ends} & {len(ids) + 777 - e for e in moved}) > 0.8 * len(ends)
    assert cut_points(np.zeros(10_000, np.int64))[-1] == 10_000 and cut_points(np.array([2])) == [1]
    streams = [r.integers(0, 49408, n).astype("<u4") for n in (1, 15, 16, 17, 127, 5000, 2, 9000)]
    assert cut_many([x.tobytes() for x in streams]) == [cut_points(x) for x in streams]
    parts = [r.bytes(4 * int(n)) for n in (1, 5, 1000, 70_000, 3)]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(5)])
    assert np.bitwise_xor.reduce(shift_crc(np.array([zlib.crc32(p) for p in parts]), after)) == zlib.crc32(b"".join(parts))
    assert merkle_root([b"a"]) == b"a" and merkle_root([b"a", b"b"]) != merkle_root([b"b", b"a"])


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    write_store(df, f"file://{tmp_path}/s")
    assert read_store(spark, f"file://{tmp_path}/s").count() == 0 and decode_store(spark, f"file://{tmp_path}/s").count() == 0


def test_levels_of_manifests(spark, tmp_path, monkeypatch):
    """Three documents under a row: several levels up to one root, found again on reading; a changed middle level is noticed."""
    monkeypatch.setattr("loomwright.llm.chunk_store.FAN", 3)
    df = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(40)] + [(99, "")] * 20, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/s"
    write_store(df, path)
    levels = sorted(os.listdir(tmp_path / "s/manifests"))
    assert levels == [f"level={k}" for k in range(4)]
    counts = [spark.read.parquet(f"{path}/manifests/{x}").count() for x in levels]
    assert counts == [20, 7, 3, 1]
    leaves = [bytes(r.leaf) for r in spark.read.parquet(f"{path}/recipes").orderBy("number").collect()]
    while len(leaves) > 1:
        leaves = [merkle_root(leaves[i : i + 3]) for i in range(0, len(leaves), 3)]
    top = spark.read.parquet(f"{path}/manifests/level=3").first()
    assert (top.number, top.docs, bytes(top.root)) == (0, 60, leaves[0])
    assert read_store(spark, path).count() == 60
    spark.read.parquet(f"{path}/manifests/level=1").withColumn("ids", F.col("ids") + F.when(F.col("number") == 2, 1).otherwise(0)).write.parquet(f"{path}/new")
    os.rename(tmp_path / "s/manifests/level=1", tmp_path / "old")
    os.rename(tmp_path / "s/new", tmp_path / "s/manifests/level=1")
    with pytest.raises(ValueError, match=r"level 1 at \[2\]"):
        verify_manifests(spark, path)
