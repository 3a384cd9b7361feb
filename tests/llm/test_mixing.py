import hashlib
import random
import re

import pytest

from loomwright.llm import mixing
from loomwright.llm.mixing import mix, plan_mix, source_targets


def brute_targets(sizes, weights=(5, 2, 1), total=1.5, limit=2):
    """Fill by rounds: share by weight, cut at the limit, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, rest = {}, total * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = limit * sizes[s]
            rest -= full[s]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("few", [True, False])
def test_targets_against_rounds(spark, seed, few, monkeypatch):
    """Filled on the driver, and by range partitions where sources are many."""
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    r = random.Random(seed)
    names = [None, "", "é", *(f"s{i}" for i in range(r.randrange(1, 9)))]
    sizes = {n: r.choice([0, 3, 10, 500, 10_000]) + r.randrange(50) for n in names}
    rows = [(n, part) for n, s in sizes.items() for part in (s // 3, s - s // 3)]
    got = {x.source: x.target for x in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_copies_and_defined_results(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randrange(40))), r.choice(["a", "b", None]), "x") for i in range(600)]
    rows += [(5, None, "a", "x"), (None, "one two", "a", "x"), (7, "", "empty", "x"), (7, "", "empty", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = plan_mix(df).collect()
    assert len(got) == len(rows) and [x.taken for x in got] == [x.taken for x in plan_mix(df).collect()]
    for x in got:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
        rate = x.target / x.source_size if x.source_size else 0.0
        u = int(hashlib.md5(f"mix:{'' if x.doc_id is None else x.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        copies = int(rate) + (u < rate - int(rate))
        assert (x.size, x.copies, x.taken) == (words, copies, words * copies) and x.taken <= 2 * x.size
    for s in ("a", "b", None):
        own = [x for x in got if x.source == s]
        assert sum(x.taken for x in own) == pytest.approx(own[0].target, rel=0.15)
    mixed = mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in got)
    assert mix(df.limit(0)).count() == 0 and plan_mix(df.limit(0)).count() == 0
