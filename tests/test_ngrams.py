"""Caption metrics against counts by hand, and that n-grams stay in their rows."""

from collections import Counter
from math import exp, log

import numpy as np
import pytest

from loomwright.operators import meteor as mt
from loomwright.operators import metrics
from loomwright import session
from loomwright.operators.ngrams import Grams, counts, keyed, pack_sorted, split_words, unpack_sorted
from loomwright.session import BATCH_BYTES, bound_batches


def _grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _texts(r, rows):
    word = lambda: " ".join(r.choice(list("abcdef"), int(r.integers(0, 14))))
    return [(i, word(), [word() for _ in range(int(r.integers(0, 4)))]) for i in range(rows)]


def test_counts():
    texts = [t.split() for t in ("a b a b c", "", "b a b", "c")]
    for n, table, first in counts(texts, 4):
        flat = [w for t in texts for w in t]
        for t, row in zip(texts, table):
            assert {tuple(flat[p : p + n]): int(f) for p, f in zip(first, row) if f} == _grams(t, n)
    _, hi, lo = keyed(texts, 2)
    assert len(set(zip(hi.tolist(), lo.tolist()))) == 3 + 3  # a, b, c; ab, ba, bc


def test_bleu_shuffles_no_ngrams(spark):
    rows = _texts(np.random.default_rng(4), 60)
    out = metrics.bleu(spark.createDataFrame(rows, "k int, c string, r array<string>"), "k", "c", "r")
    assert "MapInArrow" in (plan := out._jdf.queryExecution().toString()) and "SortMergeJoin" not in plan and "Generate" not in plan
    m, t, cl, rl = [0] * 4, [0] * 4, 0, 0
    for _, c, rs in rows:
        own, refs = c.split(), [x.split() for x in rs]
        cl, rl = cl + len(own), rl + min(((abs(len(x) - len(own)), len(x)) for x in refs), default=(0, 0))[1]
        for n in range(4):
            g = _grams(own, n + 1)
            m[n] += sum(min(f, max((_grams(x, n + 1)[w] for x in refs), default=0)) for w, f in g.items())
            t[n] += sum(g.values())
    b = exp(1 - rl / cl) if cl < rl else 1
    assert out.first().bleu4 == pytest.approx(b * exp(sum(log((m[n] + 1e-15) / (t[n] + 1e-9)) for n in range(4)) / 4))


def test_cider_over_many_packs(spark, monkeypatch):
    monkeypatch.setattr(metrics, "_PACK_BYTES", 200)
    rows = _texts(np.random.default_rng(5), 80)
    got = {r.k: r.cider for r in metrics.cider(spark.createDataFrame(rows, "k int, c string, r array<string>").repartition(3), "k", "c", "r").collect()}
    d = Counter(g for _, _, rs in rows for g in {g for x in rs for n in range(1, 5) for g in _grams(x.split(), n)})
    for k, c, rs in rows:
        scores = []
        for x in rs:
            a, b, s = c.split(), x.split(), 0.0
            for n in range(1, 5):
                u, v = ({g: f * (log(len(rows)) - log(max(d[g], 1))) for g, f in _grams(t, n).items()} for t in (a, b))
                size = sum(w * w for w in u.values()) ** 0.5 * sum(w * w for w in v.values()) ** 0.5
                s += sum(min(u.get(g, 0), w) * w for g, w in v.items()) / size if size else 0
            scores.append(s * exp(-((len(a) - len(b)) ** 2) / 72))
        assert got[k] == pytest.approx(10 * np.mean(scores) / 4 if scores else 0, abs=1e-9)
    assert len(got) == len(rows)


def test_grams_of_many_texts():
    """All n-grams of all texts at once are those of each text, and equal keys are equal n-grams; words are cut as words_of() does."""
    texts = ["a b a b c", "", "  b a  b ", None, "c", "\u00e9 a b", "x" * 5000 + " a"]
    words, sizes = split_words(texts)
    assert words.to_pylist() == [w for t in texts for w in (t or "").split(" ") if w] and sizes.tolist() == [5, 0, 3, 0, 1, 3, 2]
    g = Grams(words, sizes, 4)
    own = [[w for w in (t or "").split(" ") if w] for t in texts]
    names: dict[int, set] = {}
    for gram, text, n, count in zip(g.gram.tolist(), g.text.tolist(), g.n.tolist(), g.count.tolist()):
        names[gram] = (names[gram] & {x for x, f in _grams(own[text], n + 1).items() if f == count}) if gram in names else {x for x, f in _grams(own[text], n + 1).items() if f == count}
    assert all(names.values()) and len(names) == len({x for t in own for n in range(1, 5) for x in _grams(t, n)}) == len(set(zip(g.hi.tolist(), g.lo.tolist())))
    assert len(g.gram) == sum(len(_grams(t, n)) for t in own for n in range(1, 5))
    none = Grams(*split_words([None, " "]), 4)
    assert len(none.gram) == len(none.hi) == 0
    r = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 999, np.uint64))
    assert (unpack_sorted(pack_sorted(r), len(r)) == r).all() and len(pack_sorted(r >> np.uint64(44))) < 3 * len(r)


def test_cider_writes_no_texts(spark, monkeypatch):
    """Texts are not written or sorted as rows of megabytes: groups of split captions are shuffled once and that is read again."""
    before = set(session._scratch)
    rows = [(0, "", [" "]), (1, None, [None, "a b"]), (2, "a b c d e", []), (3, "a  b", None), *[(i, f"w{i} x{i} y{i} z{i}", [f"w{i} x{i} y{i} z{i}"]) for i in range(4, 60)]]
    out = metrics.cider(spark.createDataFrame(rows, "k int, c string, r array<string>"), "k", "c", "r")
    got = {r.k: r.cider for r in out.collect()}
    assert set(session._scratch) == before and "ReusedExchange" in out._jdf.queryExecution().toString()
    assert len(got) == 60 and [got[i] for i in range(4)] == [0, 0, 0, 0] and all(got[i] == pytest.approx(10) for i in range(4, 60))


def test_meteor_of_a_run():
    """A text and a run of it are one chunk, also where it repeats itself so that tiles of the longest runs are more."""
    a = "a b a a b a a b a b".split() * 9
    for b in (a[2:], a[1:-1], a):
        assert mt.chunks(mt.align(a, b)) == 1 and len(mt.align(a, b)) == len(mt.align(b, a)) == len(b)
    assert mt.inside([1, 2], [256, 2 << 8, 0]) is None and mt.inside([], [1]) is None


def test_batches_are_bounded(spark):
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
    texts = spark.range(40).selectExpr("repeat('x', 1 << 20) AS t").coalesce(1)
    sizes = texts.mapInArrow(lambda bs: (b.slice(0, 1).from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert len(sizes) > 2 and max(s.n for s in sizes) < 3 * BATCH_BYTES


def test_squares_of_scores_are_bounded():
    """A task's square of scores takes 8 MB at most, whatever the numbers of queries and items."""
    from loomwright.operators import retrieval as R

    assert R.QUERY_BLOCK * R.ITEM_BLOCK * 8 <= 8 << 20
