import random

from loomwright.llm.components import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e if None not in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is None or b is None:
                continue
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_random_graphs_chains_and_stars(spark):
    r = random.Random(3)
    graphs = [
        [(r.randrange(80), r.randrange(80)) for _ in range(60)],
        [(i, i + 1) for i in range(60)] + [(200 - i, 201 - i) for i in range(40)],
        [(500, i) for i in range(100)] + [(7, 7), (None, 3), (-5, 500)],
    ]
    for edges in graphs:
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = {n: c for n, c in brute([e for e in edges if e[0] != e[1]]).items()}
        assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
