import functools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions.text import image_tokens
from loomwright.operators import assemble, curate, dialog, metrics, mixing, relational, retrieval, vq
from loomwright.operators import render as R


def test_group_members(spark):
    rows = [("s", i, m, bytearray(m.encode())) for i, m in enumerate(["a/1.jpg", "a/1.txt", "a/2.jpg", "a/1.jpg", "a/9.jpg", "a/9.JPG", "noext"])]
    got = assemble.group_members(spark.createDataFrame(rows, "shard string, ord int, member string, payload binary")).orderBy("n").collect()
    assert [(x.key, sorted(x.data)) for x in got] == [("a/1", ["jpg", "txt"]), ("a/2", ["jpg"]), ("a/1", ["jpg"]), ("a/9", ["jpg"]), ("a/9", ["jpg"])]


ITEMS = "k int, items array<struct<image_ids:array<int>,text:string>>"


def items(marks):
    return [([1], None) if m == "I" else (None, m.lower()) for m in marks]


def shown(row):
    return "".join("I" if x.image_ids is not None else x.text.upper() for x in row)


def slow_swap(xs):
    xs, i = list(xs), 0
    while i < len(xs) - 1:
        if xs[i] == "I":
            xs[i], xs[i + 1] = xs[i + 1], xs[i]
            i += 2
        else:
            i += 1
    return "".join(xs)


def slow_cap(xs, most):
    out, n = "", 0
    for x in xs:
        if x == "I" and n >= most:
            break
        out += x
        n += x == "I"
        if x != "I" and n >= most:
            break
    return out


def test_interleaved(spark):
    docs = ["ITTI", "", "I", "II", "IIT", "TITIT", "TTII", "IABICIDI", "ABC"]
    df = spark.createDataFrame([(i, items(d)) for i, d in enumerate(docs)], ITEMS)
    got = df.select("k", R.swap_images(F.col("items")).alias("s"), R.cap_images(F.col("items"), 1).alias("c"), R.interleaved_ok(F.col("items")).alias("ok")).orderBy("k").collect()
    assert [shown(x.s) for x in got] == [slow_swap(d) for d in docs] and shown(got[0].s) == "TITI"
    assert [shown(x.c) for x in got] == [slow_cap(d, 1) for d in docs] and all(x.ok for x in got)
    bad = spark.createDataFrame([(0, [([1], "both")]), (1, [(None, None)])], ITEMS).select(R.interleaved_ok(F.col("items")).alias("ok")).collect()
    assert not any(x.ok for x in bad)


def test_labels_of_conversations(spark):
    df = spark.createDataFrame([(1, ["hi", "yes sir", "more", "ok"]), (2, None)], "k int, data array<string>")
    out = R.finish(df, R.conversation(F.col("data"), sft=True), 20).orderBy("k").collect()
    x = out[0]
    assert x.text == "USER: hi\nASSISTANT:yes sir\nUSER: more\nASSISTANT:ok" and not out[1].filter_flag
    assert len(x.input_ids) == len(x.labels) == len(x.attention_mask) == 20
    assert all(lab in (-100, i) for i, lab in zip(x.input_ids, x.labels)) and sum(lab != -100 for lab in x.labels) == 4
    pre = R.finish(df, R.conversation(F.col("data"), "Be kind."), 8).orderBy("k").first()
    assert pre.text.startswith("Be kind.\nUSER: hi\nASSISTANT: yes") and pre.truncated and 2 not in pre.input_ids


def test_mask_left_and_flags(spark):
    df = spark.createDataFrame([(1, [1, 2], "a dog"), (2, [1, 2], " ;.?")], "k int, image_ids array<int>, caption string")
    for ratio in (0.0, 1.0):
        out = R.caption_pair(df, F.col("image_ids"), F.col("caption"), F.col("k"), 16, ratio, mask_left=True).orderBy("k").collect()
        assert [x.filter_flag for x in out] == [True, False]
        n = sum(lab == -100 for lab in out[0].labels) - sum(a == 0 for a in out[0].attention_mask)
        assert n >= 2
    cut = R.caption_pair(df, F.col("image_ids"), F.col("caption"), F.col("k"), 1, 0.0, mask_left=True).first()
    assert not cut.filter_flag


def test_response_spans(spark):
    good = [32000 + i for i in range(32)]
    cases = [([5, 8, *good, 9, 6], [None]), ([8, *good[:31], 9], ["length 31"]), ([8, *good[:31], 40192, 9], ["code out of range"]), ([8, 9, 9], ["length 0"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "k int, ids array<int>")
    for x, (_, errors) in zip(df.select("k", dialog.parse_response(F.col("ids"), 8, 9).alias("r")).orderBy("k").collect(), cases):
        assert [s.error for s in x.r.spans] == errors
    assert df.select(dialog.parse_response(F.col("ids"), 8, 9).alias("r")).first().r.text_ids == [5, 8, 9, 6]
    made = spark.range(1).select(dialog.assemble_request(F.lit("a<image>b"), F.array(image_tokens(F.array(F.lit(7))))).alias("t"), dialog.assemble_request(F.lit("a"), F.array(F.lit("x"))).alias("bad")).first()
    assert made.t == "a<img><img_00007></img>b" and made.bad is None


def test_image_quality(spark):
    cases = [(300, 200, 0.3, True), (300, 180, 0.3, False), (300, 199, 0.1, False), (None, None, None, True), (170, 170, None, False)]
    rows = [(i, json.dumps({k: v for k, v in (("width", w), ("original_height", None), ("HEIGHT", h), ("score", s)) if v is not None})) for i, (w, h, s, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, meta string")
    keep = curate.image_quality_from_metadata(F.col("meta"), min_similarity=0.2, min_side=180, min_aspect=0.666)
    assert [x.ok for x in df.select("k", keep.alias("ok")).orderBy("k").collect()] == [c[3] for c in cases]


def test_thresholds_are_parsed_not_evaluated(spark):
    df = spark.createDataFrame([('{"a": 3, "b": "x"}',), ("{}",), (None,)], "meta string")
    assert [x.ok for x in df.select(curate.metadata_filter(F.col("meta"), {"a": ">= 3"}).alias("ok")).collect()] == [True, False, False]
    assert all(x.ok for x in df.select(curate.metadata_filter(F.col("meta"), {}).alias("ok")).collect())
    with pytest.raises(ValueError):
        curate.threshold(F.col("a"), "> 3 or True")


def test_soft_accuracy(spark):
    answers = [(i, "yes" if i < 3 else "no") for i in range(10)]
    df = spark.createDataFrame([("yes", answers)], "p string, a array<struct<answer_id:int,answer:string>>")
    assert df.select(metrics.soft_accuracy(F.col("p"), F.col("a")).alias("x")).first().x == pytest.approx(0.9)
    nulls = spark.createDataFrame([("a", "a"), ("b", None)], "p string, t string")
    assert metrics.exact_match(nulls, "p", "t").first().accuracy is None and metrics.exact_match(nulls.limit(1), "p", "t").first().accuracy == 100


def test_round_robin_race_and_batches(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 9)], "stream string, v int")
    assert [x.v for x in mixing.round_robin(df, "stream", "v").orderBy("round", "stream").collect()] == [1, 9, 2, 3]
    big = spark.range(4000).select(F.when(F.col("id") < 2000, "a").otherwise("b").alias("stream"), F.col("id").alias("key"))
    first = mixing.race(big, "stream", "key", {"a": 3.0, "b": 1.0}).orderBy("arrival").limit(1000).groupBy("stream").count().collect()
    assert abs({r["stream"]: r["count"] for r in first}["a"] - 750) < 60
    with pytest.raises(ValueError):
        mixing.mix({"a": df, "b": df}, "sample", [1.0])
    with pytest.raises(ValueError):
        mixing.cycle(df, None)
    parts = [mixing.shard(spark.range(100).toDF("n"), "n", 3, r).count() for r in range(3)]
    assert sum(parts) == 100


def test_relations(spark):
    df = spark.createDataFrame([(["a cat", "cat", "a dog", "a cat sat", "dog"],)], "t array<string>")
    assert df.select(relational.without_contained(F.col("t")).alias("k")).first().k == ["a cat", "a dog", "a cat sat"]
    a, b = spark.range(3).toDF("k"), spark.range(4).toDF("k")
    with pytest.raises(ValueError):
        relational.same_ids(a, b, "k")
    assert relational.same_rows(a, a) and not relational.same_rows(a, b)
    q = spark.createDataFrame([("q", 0, "x", ["c1", "c2"]), ("q", 1, "y", ["c1", "c2"]), ("q", 2, "z", ["c2"])], "question string, place int, answer string, captions array<string>")
    assert {r.answer: r.caption for r in relational.unused_captions(q).collect()} == {"x": "c1", "y": "c2", "z": None}


def test_codebook(spark):
    words = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [50.0, 50.0])], "code int, vec array<double>")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [-1.0, 0.0])], "vec_id long, vec array<double>")
    got = {r.id: (r.code, r.dist) for r in vq.assign(v, words).collect()}
    assert got[0] == (0, 1.0) and got[1][0] == 1
    assert {r.id: r.code for r in vq.assign_large(v, words).collect()} == {i: c for i, (c, _) in got.items()}
    step = {r.code: r.vec for r in vq.kmeans_step(v, words).collect()}
    assert step[0] == [0.0, 0.0] and step[1] == [2.0, 0.1] and step[3] == [50.0, 50.0]
    assert {r.code: r.n for r in vq.usage(vq.assign(v, words), 4).collect()} == {0: 2, 1: 1, 2: 0, 3: 0}
    assert spark.range(1).select(vq.moving_average(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("m")).first().m == [pytest.approx(0.99)]
    assert {r.code: r.vec for r in vq.kmeans(v, words, steps=2).collect()}[1] == [2.0, 0.1]


def test_distances(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(200, 3)), r.normal(1, 2, size=(300, 3))
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(4)
    n, mu, tiles = metrics.gram(frame(a), "vec", tile=2)
    cov = np.zeros((3, 3))
    for t in tiles.collect():
        part = cov[2 * t.i : 2 * t.i + 2, 2 * t.j : 2 * t.j + 2]
        part[:] = np.frombuffer(t.x).reshape(part.shape)
    assert n == 200 and np.allclose(mu, a.mean(0)) and np.allclose(cov, np.cov(a.T)) and metrics.tile_trace(tiles, 2) == pytest.approx(np.trace(cov))
    with pytest.raises(ValueError):
        metrics.gram(frame(a).limit(0), "vec")
    got = metrics.fid(frame(a), frame(b))
    values = np.linalg.eigvals(np.cov(a.T) @ np.cov(b.T))
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a.T)) + np.trace(np.cov(b.T)) - 2 * np.sqrt(values.astype(complex)).sum().real
    assert got == pytest.approx(want) and metrics.fid(frame(a), frame(a)) == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("d", [64, 300, 2048])
def test_distances_by_tiles(spark, d):
    """Few vectors of many dimensions: their covariances' traces, and the distance, follow from their products with each other."""
    r = np.random.default_rng(d)
    a, b = r.normal(size=(60, d)), r.normal(0.1, 1.5, size=(70, d))
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(3)
    x, y = ((z - z.mean(0)) / np.sqrt(len(z) - 1) for z in (a, b))
    cross = x @ y.T
    (_, _, c1), (_, _, c2) = metrics.gram(frame(a), "vec"), metrics.gram(frame(b), "vec")
    assert metrics.tile_trace(c1) == pytest.approx((x**2).sum()) and metrics.tile_trace(metrics.tile_product(c1, c2, d)) == pytest.approx((cross**2).sum())
    if d < 2048:  # its eigenvalues take a minute
        want = ((a.mean(0) - b.mean(0)) ** 2).sum() + (x**2).sum() + (y**2).sum() - 2 * np.linalg.svd(cross, compute_uv=False).sum()
        assert metrics.fid(frame(a), frame(b)) == pytest.approx(want, rel=1e-5)


def test_overlap(spark):
    df = spark.createDataFrame([(0, "a b c d e", "a b c d e"), (1, "x y z w", "x q z w v")], "k int, c string, r string")
    b = metrics.bleu(df, "k", "c", "r").first()
    assert b.bleu1 == pytest.approx(8 / 9 * np.exp(1 - 10 / 9), rel=1e-6) and b.bleu1 > b.bleu2 > b.bleu3
    assert metrics.rouge_l("a b c".split(), ["a c".split()]) == pytest.approx((1 + 1.44) * (2 / 3) / (1 + 1.44 * 2 / 3))
    c = {r.k: r.cider for r in metrics.cider(df, "k", "c", "r").collect()}
    assert c[0] == pytest.approx(10) and 0 < c[1] < 5


def test_subsequences_in_blocks(monkeypatch):
    """Blocks hand their carries on; texts of many different words take memory in proportion to their length."""
    import tracemalloc

    words = [str(i) for i in range(30_000)]
    tracemalloc.start()
    assert metrics.lcs_length(words, words[9_000:] + words[:9_000]) == 21_000
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()
    r = np.random.default_rng(7)
    for size in (1, 3, 5):
        monkeypatch.setattr(metrics, "_LCS_WORDS", size)
        for _ in range(80):
            x, y = (list(r.choice(list("abcd"), int(n))) for n in r.integers(0, 18, 2))
            t = np.zeros((len(x) + 1, len(y) + 1), int)
            for i, p in enumerate(x):
                for j, q in enumerate(y):
                    t[i + 1, j + 1] = t[i, j] + 1 if p == q else max(t[i, j + 1], t[i + 1, j])
            assert metrics.lcs_length(x, y) == t[-1, -1]


def test_several_references(spark):
    many = spark.createDataFrame([(0, "a b c d e", ["q r", "a b c d e"]), (1, "x y z w", ["x q z w v", "x y z"]), (2, None, []), (3, "a b", None)], "k int, c string, r array<string>")
    b = metrics.bleu(many.where("k < 2"), "k", "c", "r").first()
    # all words are matched; lengths 5 and 4 against the closest references, 5 and 3
    assert b.bleu1 == pytest.approx(9 / 9, rel=1e-6) and b.bleu4 == pytest.approx(np.exp(np.mean(np.log([9 / 9, 7 / 7, 4 / 5, 2 / 3]))), rel=1e-6)
    c = {r.k: r.cider for r in metrics.cider(many, "k", "c", "r").collect()}
    assert 4.9 < c[0] <= 5.01 and 0 < c[1] < 10 and c[2] == 0
    assert metrics.rouge_l("a b c".split(), ["a".split(), "b c d e".split()]) == pytest.approx((1 + 1.44) * (2 / 3) / (1 + 1.44 * 2 / 3))
    r = np.random.default_rng(4)
    for _ in range(60):
        x, y = (list(r.choice(list("abcd"), int(n))) for n in r.integers(0, 12, 2))
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1, j + 1] = t[i, j] + 1 if p == q else max(t[i, j + 1], t[i + 1, j])
        assert metrics.lcs_length(x, y) == t[-1, -1]
    assert metrics.meteor("the cat sat".split(), "the cat sat".split()) == pytest.approx(1 - 0.5 / 27)
    assert metrics.meteor("a b c d".split(), "c d a b".split()) == pytest.approx(1 - 0.5 * (2 / 4) ** 3) and metrics.meteor(["a"], ["b"]) == 0
    assert metrics.meteor("the the cat".split(), "the cat".split()) == pytest.approx(10 * (2 / 3) / (1 + 9 * 2 / 3) * (1 - 0.5 * (2 / 2) ** 3))
    assert metrics.meteor_mean(many, "c", "r").first().meteor > 0.4 and metrics.rouge_l_mean(many, "c", "r").first().rouge_l > 0.4


def test_ranks_in_both_directions(spark):
    r = np.random.default_rng(2)
    v, g = r.integers(-2, 3, (60, 4)).astype(float) + 0.5, r.integers(0, 5, 60)
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, g))], "id long, vec array<double>, label int")
    q, t = df.where("id % 3 = 0").withColumnRenamed("id", "i"), df.withColumnRenamed("id", "j")
    u = [[x / math.sqrt(functools.reduce(lambda a, y: a + y * y, row, 0.0)) for x in row] for row in v.tolist()]
    s = {(i, j): functools.reduce(lambda a, k: a + u[i][k] * u[j][k], range(4), 0.0) for i in range(0, 60, 3) for j in range(60) if i != j}
    want = {}
    for side, own, other in (("i", 0, 1), ("j", 1, 0)):
        for x in {k[own] for k in s}:
            order = [k[other] for k in sorted((k for k in s if k[own] == x), key=lambda k: (-s[k], k[other]))]
            hits = [n + 1 for n, o in enumerate(order) if g[o] == g[x]]
            if hits:
                want[(side, x)] = hits[0]
    for block in (7, 4096):
        got = {(x.side, x.id): x.rank for x in retrieval.best_ranks(q, t, "label", same=True, block=block).collect()}
        assert got == want
        top = {(x.i, x["rank"]): x.j for x in retrieval.top_k(q, t, 3, same=True, block=block).collect()}
        assert all(top[(i, n + 1)] == j for i in range(0, 60, 3) for n, j in enumerate([k[1] for k in sorted((k for k in s if k[0] == i), key=lambda k: (-s[k], k[1]))][:3]))
    empty = retrieval.best_ranks(q.limit(0), t, "label")
    assert empty.count() == 0


def test_short_tables_are_drawn_with_replacement(spark):
    few = spark.createDataFrame([(7,), (8,), (9,)], "k long")
    got = [x.k for x in mixing.sample_rows(few, "k", 10).collect()]
    assert len(got) == 10 and set(got) <= {7, 8, 9} and mixing.sample_rows(few, "k", 2).count() == 2
    assert mixing.sample_rows(few.limit(0), "k", 5).count() == 0
    assert sorted(x.draw for x in mixing.sampler(few, "k", False).collect()) == [0, 1, 2] and mixing.sampler(few, "k", True, 8).count() == 8
    used = spark.createDataFrame([(5, 0), (9, 1)], "code int, place int")
    assert {x.place: x.code for x in vq.unmap(spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "id long, place int"), used).collect()} == {0: 5, 1: 9, -1: None}


def test_meters(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([1.0, 5.0, 3.0, 9.0])], "m string, i int, v double")
    last = metrics.meter_window(df, "m", ["i"], "v", 4).orderBy("i").collect()[-1]
    assert (last.window_median, last.global_avg, last.window_max) == (3.0, 4.5, 9.0)
    r = np.random.default_rng(1)
    rows = [(m, i, None if r.random() < 0.1 else float(r.integers(0, 50))) for m in ("a", "b", None) for i in range(int(r.integers(30, 60)))]
    df = spark.createDataFrame(rows, "m string, i int, v double")
    for x in metrics.meter_window(df, "m", ["i"], "v", 5, stretch=7).collect():
        seen = [v for m, i, v in rows if m == x.m and i <= x.i]
        last = [v for v in seen[-5:] if v is not None]
        assert x.window_avg == (pytest.approx(np.mean(last)) if last else None) and x.window_max == max(last, default=None)
        assert x.window_median == (sorted(last)[(len(last) - 1) // 2] if last else None)
        known = [v for v in seen if v is not None]
        assert x.global_n == len(known) and x.global_avg == (pytest.approx(np.mean(known)) if known else None)
    for x in metrics.lower_median(df, "m", "v").collect():
        known = sorted(v for m, _, v in rows if m == x.m and v is not None)
        assert x.median == known[(len(known) - 1) // 2]


def test_chunked_documents_and_prompts(spark):
    """Worked examples: two images at one sentence, one image that there is no sentence for, and questions with and without a mark."""
    from loomwright.operators import render as R

    df = spark.createDataFrame([(["a <image> b", "c", "d"], [1, 1, 7], "who", [("q1", "a1"), ("q2", "a2")])], "t array<string>, m array<int>, q string, turns array<struct<q:string,a:string>>")
    q, a = R.asked_turns(F.col("turns"))
    x = df.select(R.chunked_document(F.col("t"), F.col("m")).alias("c"), R.chunked_document(F.col("t"), F.array().cast("array<int>")).alias("none"), R.asked("word_video", F.col("q")).alias("w"), R.asked("word_video", F.concat("q", F.lit("?"))).alias("w2"), q.alias("qs"), a.alias("as")).first()
    assert x.c == "a<image>b<image><|endofchunk|><image>c d<|endofchunk|></s>" and x.none == "a<image>b c d<|endofchunk|></s>"
    assert x.w == x.w2 == "who? Please provide an accurate answer consisting of only one word or phrase." and (x.qs, x["as"]) == ("Question: q1 Question: q2", "Answer: a1 Answer: a2")
    n = df.select(R.chunk_images(F.lit("<image>a b<|endofchunk|><image>c"), 4).alias("four"), R.chunk_images(F.lit("<image>a b<|endofchunk|><image>c"), 5).alias("five")).first()
    assert (n.four, n.five) == (1, 2)
