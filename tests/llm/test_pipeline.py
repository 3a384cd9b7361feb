"""Each stage of the corpus pipeline against a brute-force version, on what its predecessor kept."""

import random
from collections import Counter

import corpus_pipeline
from loomwright.session import durable
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import brute as brute_counts


def corpus(tmp_path, spark):
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    docs = ["\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(r.randrange(3, 9))) for _ in range(60)]
    junk = [" ".join(r.choice(vocab) + r.choice(["***", "%%%", "$$$"]) for _ in range(60)) for _ in range(12)]
    near = [" ".join(w if k != 20 else "other" for k, w in enumerate(d.split())) for d in docs[:6]]
    texts = [*docs, *junk, *near, docs[9], "too short", "", None, docs[10] + "\n" + docs[11].split("\n")[0]]
    rows = [(i, t, "en", r.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(61, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_near(rows):
    """Smallest id linked to each by five-word shingle sets of similarity 0.8 or more, directly or through others."""
    sets = {i: shingle_set(t) for i, t in rows}
    label, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for i, x in sets.items():
            for j, y in sets.items():
                if label[j] < label[i] and (x == y or len(x & y) >= 0.8 * len(x | y)):
                    label[i], changed = label[j], True
    return label


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    texts = {r[0]: r[1] for r in rows}

    good = {r.doc_id: r.text for r in kept["quality rules"]}
    passed = {i for i, t in texts.items() for c in [brute_counts(t)] if c[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert set(good) == {i for i in passed if not (60 <= i < 72)} and all(good[i] == texts[i] for i in good)

    lines = {r.doc_id: (r.text, r.n_chars) for r in kept["line dedup"]}
    assert lines == {i: (t, len(t)) for i, _, _, t in brute_lines(list(good.items()))}

    label = brute_near([(i, t) for i, (t, _) in lines.items()])
    assert sorted(r.doc_id for r in kept["simhash near-dedup"]) == sorted({label[i] for i in label})

    sizes = Counter()
    for r in kept["simhash near-dedup"]:
        sizes[r.source] += len(r.text.split())
    taken = Counter()
    copies = Counter(r.doc_id for r in kept["source mixing"])
    for r in kept["simhash near-dedup"]:
        taken[r.source] += len(r.text.split()) * copies[r.doc_id]
        assert copies[r.doc_id] <= 2
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= 0.35 * target + 200

    packed = kept["packing"]
    whole = Counter()
    for p in packed:
        whole[p.doc_id] += p.length
    assert all(whole[i] == n * next(p.doc_tokens for p in packed if p.doc_id == i) for i, n in copies.items())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(p) for p in packed)
