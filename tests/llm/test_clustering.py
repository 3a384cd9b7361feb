import hashlib
import math

import numpy as np
import pytest

from loomwright.llm.clustering import Centroids, assign, cluster, whole


def floor_scaled(x, scale=256):
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


def brute(rows, k=40, rounds=5, dims=64, seed=2):
    """Every vector against every centroid, in Python's integers."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == dims and not any(x is None or not math.isfinite(x) for x in v)]
    whole_rows = [(i, [floor_scaled(x) for x in v]) for i, v in good]
    key = lambda r: (r[0][0] is None, "" if r[0][0] is None else hashlib.sha256(f"{seed}:{r[0][0]}".encode()).hexdigest(), r[0][1])
    cents = [w for (_, w) in (b for _, b in sorted(zip(good, whole_rows), key=key)[:k])]
    near = lambda w: min((sum((a - b) ** 2 for a, b in zip(w, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = {}
        for _, w in whole_rows:
            of.setdefault(near(w)[1], []).append(w)
        cents = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else c for j, c in enumerate(cents)]
    found = [(i, *near(w)) for i, w in whole_rows]
    clamp = lambda x: min(x, 2**63 - 1)
    per = {}
    for _, d, j in found:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, clamp(d), clamp(per[j]), clamp(sum(per.values())), sha[j]) for i, d, j in found), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in cluster(df, **options).collect()), key=repr)


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=8) * 0.3 + (i % 5)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[10][1]), (900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [1.0] * 7 + [float("nan")]), (904, [math.inf] * 8), (905, []), (906, [1.0] * 9)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    assert found(df, dims=8, k=12) == brute(rows, k=12, dims=8)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=4) * 10.0 ** int(r.choice([0, 2, 7, 12, 30]))).tolist()) for i in range(120)] + [(500, [1.7e308, 0.0, -1.7e308, 1.0]), (501, [3e9, -3e9, 0.5, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, dims=4, k=10, rounds=3) == brute(rows, k=10, dims=4, rounds=3)


def test_ties_few_and_empty(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df, dims=2, k=40) == brute(rows, dims=2) and found(df, dims=2, k=3, rounds=0) == brute(rows, dims=2, k=3, rounds=0)
    assert cluster(df.limit(0), dims=2).count() == 0 and cluster(df, dims=64).count() == 0


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_bounds_lose_nothing_and_prune(spread):
    r = np.random.default_rng(5)
    x = whole(r.normal(size=(2000, 64)) * (1 + spread * r.random((2000, 1))), 256)
    cents = Centroids.of(x[:40].tolist())
    who, d, met = assign(x, cents)
    full = ((x[:, None, :] - x[None, :40, :]) ** 2).sum(axis=2)
    assert (who == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert met <= 2000 * 40 and (not spread or met < 0.9 * 2000 * 40)
