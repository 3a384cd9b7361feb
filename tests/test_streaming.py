import hashlib
import io
import json
import math
import os
import tarfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomwright.plans import datasets, pipelines
from loomwright.plans.registry import REGISTRY
from loomwright.streaming import ingest, meters


def write(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def run_meters(spark, tmp_path, **options):
    stream = spark.readStream.schema("m string, i int, ts timestamp, v double").json(f"file://{tmp_path}/in")
    with meters.rocksdb_state(spark):
        q = meters.meter_stream(stream, "m", "i", "v", "ts", **options).writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").option("path", f"file://{tmp_path}/out").format("json").trigger(availableNow=True).start()
    q.awaitTermination()


def test_meters_go_on_after_a_restart_and_end_when_idle(spark, tmp_path):
    """The ring, the sums and the timers are those of the run before; a meter that was idle begins anew."""
    src = tmp_path / "in"
    src.mkdir()
    at = lambda h, m: f"2026-01-01T{h:02d}:{m:02d}:00"
    write(src, "1.json", [{"m": "loss", "i": i, "ts": at(0, i), "v": v} for i, v in enumerate([1.0, 5.0, None, 3.0])])
    run_meters(spark, tmp_path, size=2, idle=3_600_000)
    write(src, "2.json", [{"m": "loss", "i": 5, "ts": at(0, 30), "v": 2.0}, {"m": "loss", "i": 4, "ts": at(0, 20), "v": 9.0}, {"m": "other", "i": 0, "ts": at(3, 0), "v": 2.0}])
    run_meters(spark, tmp_path, size=2, idle=3_600_000)
    write(src, "3.json", [{"m": "loss", "i": 9, "ts": at(3, 10), "v": 7.0}, {"m": "late", "i": 0, "ts": at(1, 0), "v": 1.0}])
    run_meters(spark, tmp_path, size=2, idle=3_600_000)
    rows = spark.read.schema(meters._ROW).json(f"file://{tmp_path}/out").collect()
    got = sorted((r.meter, r.idle, int(r.o), r.n, r.window_avg, r.window_median, r.window_max, r.last_value, r.global_avg) for r in rows)
    assert got == [
        ("loss", False, 0, 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("loss", False, 1, 2, 3.0, 1.0, 5.0, 5.0, 3.0), ("loss", False, 3, 3, 4.0, 3.0, 5.0, 3.0, 3.0), ("loss", False, 4, 4, 6.0, 3.0, 9.0, 9.0, 4.5), ("loss", False, 5, 5, 5.5, 2.0, 9.0, 2.0, 4.0),
        ("loss", False, 9, 1, 7.0, 7.0, 7.0, 7.0, 7.0), ("loss", True, 5, 5, 5.5, 2.0, 9.0, 2.0, 4.0), ("other", False, 0, 1, 2.0, 2.0, 2.0, 2.0, 2.0),
    ]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_ingest_is_exactly_once(spark, tmp_path):
    """A batch that fails after its writes is not seen, and is written over by the next run, which has the same files."""
    (tmp_path / "in").mkdir()
    for i in range(6):
        with tarfile.open(tmp_path / "in" / f"{i}.tar", "w") as t:
            for j in range(3):
                for suffix in ("txt", "json"):
                    info = tarfile.TarInfo(f"{i}{j}.{suffix}")
                    info.size = 4
                    t.addfile(info, io.BytesIO(b"%02d%02d" % (i, j)))
    raw = (tmp_path / "in" / "3.tar").read_bytes()
    (tmp_path / "in" / "3.tar").write_bytes(raw[: 512 * 4 + 515])
    seen = []

    def fail(epoch):
        seen.append(epoch)
        if epoch == 1 and seen.count(1) == 1:
            raise RuntimeError("stop")

    run = lambda: ingest.ingest_shards(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/c", per_batch=2, split_bytes=2000, after_write=fail).awaitTermination()
    with pytest.raises(StreamingQueryException):
        run()
    out = f"file://{tmp_path}/out"
    assert ingest.ingested(spark, out).select("batch").distinct().count() == 1 and os.path.isdir(tmp_path / "out" / "samples" / "batch=1")
    run()
    assert seen == [0, 1, 1, 2]
    got = sorted((r.key, sorted(r.data.items())) for r in ingest.ingested(spark, out).collect())
    want = [(f"{i}{j}", [("json", b"%02d%02d" % (i, j)), ("txt", b"%02d%02d" % (i, j))]) for i in range(6) for j in range(3) if i != 3 or j < 1]
    assert [(k, [(s, bytes(x)) for s, x in d]) for k, d in got if k != "31"] == [w for w in want if w[0] != "31"]
    bad = ingest.ingested(spark, out, "rejects").collect()
    assert len(bad) == 1 and bad[0].shard.endswith("3.tar") and ingest.ingested(spark, out, "marks").count() == 6
    run()
    assert seen == [0, 1, 1, 2]


def test_shards_once_each(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "a.json", [{"id": 1, "text": "some text"}, {"id": 2, "text": " ;."}])
    for extra in (None, "b.json"):
        if extra:
            write(src, extra, [{"id": 3, "text": "more"}])
        stream = ingest.sample_stream(spark, f"file://{src}", "id long, text string")
        ingest.append(ingest.render_stream(stream, "pretrain_text", "id", max_length=8), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").select("id", "input_ids").collect()
    assert sorted(r.id for r in got) == [1, 3] and all(len(r.input_ids) == 8 for r in got)


def test_codebook_follows_and_replaces_dead_codes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    words = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "code int, vec array<double>")

    def run():
        stream = spark.readStream.schema("vec_id long, vec array<double>").json(f"file://{src}")
        meters.follow_codebook(stream, words, f"file://{tmp_path}/w", f"file://{tmp_path}/c", decay=0.5, dead=0.6).awaitTermination()

    write(src, "a.json", [{"vec_id": 1, "vec": [3.0, 0.3]}, {"vec_id": 2, "vec": [1.0, -0.1]}, {"vec_id": 3, "vec": [0.0, 2.0]}, {"vec_id": 4, "vec": None}, {"vec_id": 5, "vec": [0.0, 0.0]}])
    run()
    write(src, "b.json", [{"vec_id": 6, "vec": [0.0, 4.0]}])
    run()
    norm = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    books = [{r.code: (r.vec, r.size) for r in spark.read.parquet(f"file://{tmp_path}/w/epoch={e}").collect()} for e in (-1, 0, 1)]
    assert books[0] == {0: ([1.0, 0.0], 1.0), 1: ([0.0, 1.0], 1.0), 2: ([-1.0, 0.0], 1.0)}
    first = norm([(a + b) / 2 for a, b in zip(norm([3.0, 0.3]), norm([1.0, -0.1]))])
    assert books[1][0][0] == pytest.approx(norm([0.5 + 0.5 * first[0], 0.5 * first[1]])) and books[1][0][1] == 1.5 and books[1][1] == ([0.0, 1.0], 1.0)
    sample = min((1, 2, 3), key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest())
    assert books[1][2] == (pytest.approx(norm({1: [3.0, 0.3], 2: [1.0, -0.1], 3: [0.0, 2.0]}[sample])), 0.6)
    assert books[2][0][1] == 0.75 and sorted(books[2]) == [0, 1, 2]


def test_windows(spark):
    e = spark.createDataFrame([(f"2026-01-01 00:{m:02d}:00", "a", 1.0) for m in (1, 59)] + [("2026-01-01 01:30:00", "a", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.total for r in meters.windowed_totals(e, "ts", "k", "v").collect()) == [2.0, 4.0]


def test_every_pipeline_builds(spark):
    """Each declared pipeline renders a sample with all fields that any of them reads."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(159)), lambda i: i.cast("int"))
    base = spark.range(4).select(
        F.col("id").alias("key"), F.lit("some text").alias("text"), ids.alias("image_ids"), F.lit("Question: q").alias("question"), F.lit("Answer: a").alias("answer"),
        ids.alias("source_image_ids"), ids.alias("target_image_ids"), F.lit("do it").alias("instruction"), F.lit("done").alias("response"), F.array(F.lit("u"), F.lit("a")).alias("data"), F.lit("{}").alias("metadata"),
        F.array(F.struct(ids.alias("image_ids"), F.lit("c").alias("text"))).alias("context"), F.lit("img").alias("source_image"), F.lit(b"x").alias("pixel_values"), F.lit(300).alias("width"), F.lit(300).alias("height"),
        F.array(F.lit("one"), F.lit("two")).alias("text_list"), F.array(*[F.struct(F.repeat(F.lit("x"), F.lit(12_000)).cast("binary").alias("data"), F.lit(0.5).alias("matched_sim"), F.lit(i).alias("matched_text_index")) for i in (0, 1)]).alias("images"),
        *[F.lit(f"i{i}").alias(f"instruction{i}") for i in range(3)], *[F.lit(f"c{i}").alias(f"caption{i}") for i in range(5)],
    )
    nested = base.withColumn("image_ids", F.array(ids, F.lit(None).cast("array<int>"))).withColumn("texts", F.array(F.lit(None).cast("string"), F.lit("t")))
    visual = base.withColumn("image_ids", F.array(ids))
    for name, spec in pipelines.PIPELINES.items():
        src = nested if spec.render == "interleaved" else visual if spec.render.startswith("visual") else base
        assert pipelines.build(name, src, "key", cycle_count=1).count() == 4, name
    both = pipelines.build_many({n: pipelines.build(n, base, "key") for n in ("sft_qa", "sft_instruction")}, "sample", [2, 1])
    assert both.count() == 8 and "arrival" in both.columns


def test_datasets(spark):
    a = spark.createDataFrame([(i, f"im{i // 2}", "A Dog!", "Why (now)?", ["x", "x", "y"], "n") for i in range(4)], "n int, image string, caption string, question string, answer array<string>, other string")
    cap = datasets.load("coco_pair", a, "n").first()
    assert (cap.image, cap.caption) == ("im0", "a dog")
    assert [r.image_id for r in datasets.load("coco_caption", a, "n").orderBy("image").collect()] == [0, 0, 1, 1]
    v = datasets.load("coco_vqa", a, "n").first()
    assert v.text_input == "why now?" and v.answers == ["x", "y"] and [round(w, 3) for w in v.weights] == [0.667, 0.333]
    for bad in (("nocaps", "train"), ("coco_pair", "val"), ("coco_vqa", "other")):
        try:
            datasets.load(bad[0], a, "n", bad[1])
            raise AssertionError(bad)
        except ValueError:
            pass
    assert len(REGISTRY.names("dataset")) == 34
