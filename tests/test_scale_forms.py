"""What keeps plans and tasks in proportion to their input."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions.text import image_tokens
from loomwright.operators.assemble import instance_ids
from loomwright.operators.dialog import parse_response
from loomwright.plans import datasets, samples
from loomwright.plans import pipelines as P
from loomwright.sources import tars


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges of 16 kB are put together to tasks of megabytes, and rows are the same."""
    d = spark.range(600).selectExpr("id", "repeat(cast(id AS string), 4000) AS text")
    tars.write_shards(d, str(tmp_path / "s"), "id", {"txt": "text"}, shard=F.lit("one"))
    m = tars.read_shards(spark, str(tmp_path / "s"), split_bytes=16 << 10)
    assert m.rdd.getNumPartitions() <= 8
    assert {int(r.member.split(".")[0]): (r.ord, len(r.payload)) for r in m.collect()} == {i: (i, 4000 * len(str(i))) for i in range(600)}


def test_many_bytes_are_walked_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tars, "DRIVER_WALK_BYTES", 1000)
    monkeypatch.setattr(tars._Reader, "partitions", lambda self: pytest.fail("the driver walks"))
    d = spark.range(20).selectExpr("id", "repeat('x', 3000) AS text")
    tars.write_shards(d, str(tmp_path / "s"), "id", {"txt": "text"}, shard=F.col("id") % 2)
    m = tars.read_shards(spark, str(tmp_path / "s"), split_bytes=4 << 10)
    assert sorted(int(r.member.split(".")[0]) for r in m.collect()) == list(range(20))


def test_numbered_annotations_are_not_numbered_again(spark, monkeypatch):
    a = instance_ids(spark.createDataFrame([(3, "im/x_1.jpg", "A b."), (1, "im/x_2.jpg", "c")], "n int, image string, caption string"), "n")
    monkeypatch.setattr(datasets, "instance_ids", lambda *_: pytest.fail("numbered again"))
    assert {r.instance_id for r in datasets.load("coco_caption", a, "n", "val").collect()} == {"0", "1"}
    assert datasets.load("laion2B_multi", a.drop("instance_id"), "n").count() == 2


def test_responses_find_their_pairs_once(spark):
    plan = spark.range(1).select(parse_response(F.array(F.lit(7), F.lit(8), F.lit(9)), 8, 9).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_zip") == 1


def test_chunks_find_their_matches_once(spark):
    d = spark.createDataFrame([(0, ["a", "b"], [(b"x" * 11_000, 0.5, 1), (b"x", 0.9, 0)]), (1, ["c"], [])], "k int, text_list array<string>, images array<struct<data: binary, matched_sim: double, matched_text_index: int>>")
    out = P.build("preprocess_chunked", d.union(d.selectExpr("k + 2", "text_list", "concat(images, images)")), "k")
    assert out._jdf.queryExecution().analyzed().toString().count("octet_length(") == 1
    assert {(r.k, r.num_images) for r in out.collect()} >= {(2, 2)}


def test_image_tokens_of_any_number(spark):
    rows = spark.createDataFrame([([0, 31, 99_999, 100_000, -4],)], "ids array<int>")
    assert rows.select(image_tokens(F.col("ids"))).first()[0] == "<img>" + "".join(f"<img_{i:05d}>" for i in (0, 31, 99_999, 100_000, -4)) + "</img>"


def test_rendered_samples_are_filtered_without_their_ids(spark):
    d = spark.createDataFrame([(0, [5] * 32, "a b"), (1, [5] * 32, None), (2, [5] * 32, "  ")], "k int, image_ids array<int>, text string").withColumn("metadata", F.lit("{}"))
    out = P.build("pretrain_caption", d, "k")
    assert [r.k for r in out.collect()] == [0]
    assert "split(" not in out.select("k", "text")._jdf.queryExecution().optimizedPlan().toString()
    told = P.build("sft_instruction", spark.createDataFrame([(0, "q", "a"), (1, None, "a"), (2, "q", None)], "k int, instruction string, response string"), "k")
    assert [r.k for r in told.where("input_ids IS NOT NULL").collect()] == [r.k for r in told.collect()]


def test_a_stream_has_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(samples, "STREAM_BYTES", 2000)
    path, rows = samples._stream_of(spark, spark.range(300).selectExpr("id AS doc_id", "repeat('y', 100) AS text"), 3)
    files = spark.read.format("binaryFile").load(f"{path}/in").select("length").collect()
    assert len(files) > 10 and max(f.length for f in files) < 8000
