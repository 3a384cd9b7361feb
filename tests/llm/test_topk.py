import math

import numpy as np
import pytest

from loomwright.llm.topk import search_block, top_k


def brute(rows, k=5, every=50, scale=256):
    """Every row against every other row, in Python's integers."""
    whole = lambda x: int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)
    good = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            s = [(-min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v)]
            out += [(i, r + 1, j, -t) for r, (t, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


def found(df, **options):
    return sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_k(df, **options).collect())


@pytest.mark.parametrize("sizes", [(700, 40), (8 << 20, 8192)])
def test_against_brute_force(spark, sizes):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=37) * r.choice([0.02, 0.2, 3])).tolist()) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(1000, 1030)] + [(2000, rows[100][1]), (2001, [0.5, None, 1.0]), (2050, None), (2100, [float("nan")] * 37), (2150, [math.inf] + [0.0] * 36)]
    rows += [(2200, [1.0, 2.0]), (2201, [1.0, -2.0]), (2250, []), (2251, []), (-50, rows[7][1]), (None, rows[8][1]), (150, rows[9][1]), (60, rows[11][1]), (60, rows[12][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, score long")
    assert found(df, query_bytes=sizes[0], candidate_block=sizes[1]) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (51, [1.0, 0.0]), (51, [3.0, 0.0]), (51, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df) == [(50, 1, 51, 196608), (50, 2, 51, 196608), (50, 3, 51, 65536)] == brute(rows)
    twice = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [0.0, 1.0])]
    assert found(spark.createDataFrame(twice, "vec_id long, embedding array<float>")) == brute(twice)


def test_huge_components(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=3) * 10.0 ** int(r.choice([0, 3, 6, 8, 12, 20, 300]))).tolist()) for i in range(300)]
    rows += [(400, [1.7e308, 0.0, -1.7e308]), (401, [0.0, 5e-324, 0.0]), (450, [1e20] * 3), (451, [1e20] * 3), (452, [-1e20] * 3), (453, [3e14, 1.0, 0.1]), (500, [3e14, 1.0, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, candidate_block=64) == brute(rows)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert found(df) == [(0, 1, 1, 256 * 512)]
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id = 1")).count() == 0


def test_pruning_keeps_ties():
    r = np.random.default_rng(2)
    x = r.integers(-9, 9, (64, 500)).astype(float)
    x[:, 100:400] = x[:, [0]]
    ids = np.arange(500)
    for q_id, (i, s) in zip([0, 3, 999], search_block(np.array([0, 3, 999]), x[:, [0, 3, 5]], ids, ids, x, 5)):
        full = x[:, {0: 0, 3: 3, 999: 5}[q_id]] @ x
        want = sorted((-v, j) for j, v in enumerate(full) if j != q_id)[:5]
        assert [(-b, a) for a, b in zip(i.tolist(), s.tolist())] == want
