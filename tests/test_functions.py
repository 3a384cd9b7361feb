import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions import schedules as L
from loomwright.functions import text as X
from loomwright.functions import vectors as V
from loomwright.functions.rng import pick, u01


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning_golden_cases(spark):
    assert values(spark, ["A (big)  #Dog!", "x\n", " . ", None], X.caption_clean) == ["a big dog", "x", "", None]
    assert values(spark, ["A (big)  #Dog!", "why? "], X.question_clean) == ["a big  dog", "why?"]
    assert values(spark, [" ;.?", "a", "\t", ""], X.is_blank) == [True, False, False, True]
    assert values(spark, ["val2014/COCO_val2014_000000000042.jpg", "pjg.jpg"], X.base_name_id) == ["000000000042", ""]
    assert values(spark, ["image a and image about"], X.image_pair_words) == ["the first image and the first imagebout"]
    assert values(spark, ["a", "a.", "a..", ""], X.ensure_period) == ["a.", "a.", "a..", "."]
    assert values(spark, ["x Question: a Question: b"], lambda t: X.after_marker(t, "Question: ")) == [["a ", "b"]]


def slow_punctuation(text):
    """By the definition, mark by mark."""
    out = text
    for p in X.PUNCTUATION:
        gone = f"{p} " in text or f" {p}" in text or re.search(r"\d,\d", text, re.ASCII)
        out = out.replace(p, "" if gone else " ")
    return re.sub(r"\.(?![0-9])", "", out)


def test_punctuation_by_definition(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab1.,; /-_") for _ in range(r.randrange(14))) for _ in range(300)] + ["3.5", "1,000 dogs", "a/b", "a /b", "."]
    assert values(spark, texts, X.normalize_punctuation) == [slow_punctuation(t) for t in texts]


def test_words(spark):
    assert values(spark, ["The TWO dogs dont  an none", "a", ""], X.normalize_words) == ["2 dogs don't 0", "", ""]
    assert values(spark, ["\tYes, it\nis! "], X.normalize_answer) == ["yes it is"]


def test_image_tokens_round_trip(spark):
    df = spark.createDataFrame([([0, 8191, 42],), ([],)], "ids array<int>")
    got = df.select(X.image_tokens(F.col("ids")).alias("t")).withColumn("back", X.parse_image_tokens(F.col("t"))).collect()
    assert got[0].t == "<img><img_00000><img_08191><img_00042></img>" and got[0].back == [0, 8191, 42] and got[1].t == "<img></img>"


@pytest.mark.parametrize("ids,want,labels", [([1, 5, 6, 2], [1, 5, 6, 2], [1, 5, 6, 2]), ([1, 5, 6, 7, 2], [1, 5, 6, 7], [1, 5, 6, 7]), ([1, 2], [1, 2, 0, 0], [1, 2, -100, -100])])
def test_pad_truncate(spark, ids, want, labels):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    r = df.select(A.pad_truncate(F.col("ids"), 4).alias("p"), A.attention(F.size("ids"), 4).alias("a")).withColumn("l", A.mask_id(F.col("p"))).first()
    assert (r.p, r.l) == (want, labels) and r.a == [int(i < len(ids)) for i in range(4)]


def test_slices_and_frames(spark):
    r = spark.range(1).select(A.frame_indices(F.lit(100), 4).alias("f"), A.slices(F.sequence(F.lit(0), F.lit(69))).alias("s"), A.slices(F.array(F.lit(1))).alias("none"))
    r = r.first()
    assert r.f == [12, 37, 62, 87] and [x[0] for x in r.s] == [0, 32] and r.none == []


def test_vectors_and_schedules(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.squared_distance(F.col("a"), F.col("b")).alias("s"), V.l2norm(F.col("a")).alias("n"), V.softmax(F.col("a")).alias("p"), V.logsumexp(F.col("a")).alias("l")).first()
    assert (r.d, r.s, r.n) == (11.0, 8.0, [0.6, 0.8]) and sum(r.p) == pytest.approx(1) and r.l == pytest.approx(math.log(math.exp(3) + math.exp(4)))
    rates = [x.r for x in spark.range(11).select(L.cosine_with_warmup(F.col("id"), 2, 10, floor=0.1).alias("r")).collect()]
    assert rates[:3] == [0.0, 0.5, 1.0] and rates[10] == pytest.approx(0.1)


def test_hash_randomness(spark):
    r = spark.range(20_000).select(F.avg(u01(F.col("id"), "x")).alias("m"), F.min(u01(F.col("id"), "x")).alias("lo"), F.max(u01(F.col("id"), "x")).alias("hi"), F.countDistinct(pick(F.col("id"), "y", 7)).alias("n")).first()
    assert abs(r.m - 0.5) < 0.01 and 0 <= r.lo and r.hi < 1 and r.n == 7


def test_tokenizer_files(spark):
    P = pytest.importorskip("public_tokenizers")
    from loomwright.functions.tokenizer import encode

    path = P.path("word_bpe_49k.json")
    got = values(spark, ["A  dog &amp;amp; cat", "a dog & cat", None, ""], lambda t: encode(t, path))
    assert got[0] == got[1] and len(got[0]) == 4 and got[2:] == [None, []]


def test_image_tokens_run_nothing_for_each_id(spark):
    """Ids become one text whose marks are replaced; null, negative and long ids are formatted one by one, as before."""
    rows = [(0, [0, 7, 99_999]), (1, [5]), (2, []), (3, None), (4, [3, None, 4]), (5, [-2, 3]), (6, [100_000, 2_147_483_647]), (7, [None]), (8, list(range(70)))]
    made = spark.createDataFrame(rows, "k int, ids array<int>").select("k", "ids", X.image_tokens(F.col("ids")).alias("t"), A.slices(F.col("ids")).alias("s"), F.expr("concat('<img>', array_join(transform(ids, i -> format_string('<img_%05d>', i)), ''), '</img>')").alias("each"))
    for r in made.collect():
        assert r.t == r.each and (r.t is None) == (r.ids is None)
        if r.k in (0, 1, 2, 8):
            assert r.t == "<img>" + "".join("<img_%05d>" % i for i in r.ids) + "</img>"
        assert r.ids is None or r.s == [r.ids[i : i + 32] for i in range(0, len(r.ids) // 32 * 32, 32)]
    assert "lpad" not in made.select("t")._jdf.queryExecution().optimizedPlan().toString()


def test_is_blank_stops_at_the_first_letter(spark):
    rows = [("",), (" ",), (" ;,[]{}'\".?: ",), ("\t",), (" \n ",), ("a ",), (" . a",), (None,), ("\u00e9",)]
    made = spark.createDataFrame(rows, "t string").select("t", X.is_blank(F.col("t")).alias("b"))
    assert [r.b for r in made.collect()] == [None if t is None else t.strip(X.BLANK_CHARS) == "" for (t,) in rows]
    assert "ltrim(" in (plan := made._jdf.queryExecution().analyzed().toString().lower()) or "leading" in plan, plan
    assert "btrim(" not in plan and "both" not in plan
