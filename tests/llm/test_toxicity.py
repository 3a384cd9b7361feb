import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm.toxicity import Features, fit, held_out, nnpu, score_toxicity


def corpus(n=900, seed=3):
    """(id, text, toxic): insults in English words; a family of compounds in another language."""
    r = random.Random(seed)
    vocab = ["river", "stone", "walks", "under", "quiet", "bridges", "tower", "réeux", *(f"w{i}" for i in range(300))]
    out = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(30, 200))]
        toxic = r.random() < 0.12
        if toxic and i % 2:
            w[5:5] = r.sample(["moron,", "Scum", "loser."], 2)
        elif toxic:
            w[9:9] = ["réeux" + x for x in r.sample(["ment", "ai", "vi", "oi", "pa"], 3)]
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out_accuracy_and_isolation(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, rows[0][1], "x"), (5000, None, "x"), (5001, "", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = [(i, x) for i, _, x in rows if random.Random(i).random() < 0.5]
    hidden = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    df_l = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = score_toxicity(df, df_l).collect()
    assert len(got) == len(rows) + 4 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    by = {x.doc_id: x for x in got}
    assert by[5000].score == by[5001].score and by[None].score == by[0].score and not by[None].held_out
    assert {x.doc_id for x in got if x.held_out and x.doc_id < 5000} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    truth = {i: x for i, _, x in rows}
    hits = [by[i].predicted == truth[i] for i in hidden]
    assert np.mean(hits) > 0.97 and np.mean([by[i].predicted for i in hidden if truth[i]]) > 0.8
    flipped = spark.createDataFrame([(i, 1 - x if i in set(hidden) else x) for i, x in labels], "doc_id long, toxic int")
    again = {x.doc_id: x.score for x in score_toxicity(df, flipped).collect()}
    assert again == {i: x.score for i, x in by.items()}


def test_model_does_not_depend_on_the_partitions(spark):
    """At one or two rows a task, a minimum of two within each task would leave no feature at all."""
    rows = corpus(300)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc long, toxic int").where(~held_out(F.col("doc")))
    one, many = fit(df.coalesce(1), labels, group_documents=40), fit(df.repartition(150), labels, group_documents=40)
    assert np.count_nonzero(one.weights) > 10
    assert one.bias == many.bias and (one.use == many.use).all() and (one.weights == many.weights).all()


def test_all_unlabelled_text_counts(spark):
    """Counts of the features, and the groups' rows, against a loop over every document that is not held out."""
    rows = corpus(300)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc long, toxic int").where(~held_out(F.col("doc")))
    free = [(i, t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    made = Features()
    pos, unl = [set(made.of(t.encode()).tolist()) for _, t, x in free if x], [set(made.of(t.encode()).tolist()) for _, t, x in free if not x]
    gain = {}
    for f in {f for s in pos for f in s}:
        p, u = sum(f in s for s in pos), sum(f in s for s in unl)
        if p >= max(3, 0.02 * len(pos)):
            pool = (p + u + 1) / (len(free) + 1)
            gain[f] = (p / len(pos) - u / len(unl)) / np.sqrt(pool * (1 - pool) * (1 / len(pos) + 1 / len(unl)) + 1e-12)
    model = fit(df, labels)
    assert model.use.tolist() == sorted(f for f, g in gain.items() if g > 4)
    sure = fit(df, labels, max_positive=len(pos), max_features=5)
    assert sure.use.tolist() == sorted(sorted(gain, key=lambda f: (-gain[f], f))[:5])


def test_weighted_rows_stand_for_documents():
    r = np.random.default_rng(1)
    pos = [r.choice(20, 4, replace=False) for _ in range(30)]
    once = [r.choice(20, 3, replace=False) for _ in range(50)]
    w1, b1 = nnpu(pos, once, 20, 0.2, np.full(50, 3), steps=50)
    w2, b2 = nnpu(pos, once, 20, 0.2, steps=50)
    assert np.allclose(w1, w2) and np.isclose(b1, b2)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus(30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(x.score for x in score_toxicity(df, none).collect()) < 0.01
    assert score_toxicity(df.limit(0), none).count() == 0


def test_risk_does_not_go_below_zero():
    """With the positives among the unlabelled rows, plain unbiased risk would go far below zero on its way."""
    r = np.random.default_rng(0)
    pos = [np.array([0, *r.integers(2, 40, 3)]) for _ in range(60)]
    unl = [np.array([0 if k < 40 else 1, *r.integers(2, 40, 3)]) for k in range(400)]
    w, b = nnpu(pos, unl, 40, 0.1, steps=300)
    assert w[0] + b > 0 > w[1] + b
    f = Features()
    some = f.of(b"moron scum moron losers losing")
    part = Features(wanted=np.sort(some)[::2])
    assert np.sort(some)[::2].tolist() == np.sort(some)[::2][part.of(b"moron scum moron losers losing")].tolist() and len(part.of(b"other")) == 0
    assert len(f.of(b"")) == 0 and (f.of(b"Word word, WORD") == f.of(b"word")).all()
