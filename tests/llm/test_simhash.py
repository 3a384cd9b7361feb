import random
from itertools import product

import numpy as np
import xxhash

from loomwright.llm.simhash import allocate, drop_near_duplicates, fingerprints, group_links, hex_fingerprint, near_components, plan, shingles, simhash_groups


def brute_fp(text, k):
    words = (text or "").encode().lower().split()
    s = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    """fps: list of (doc, fp). Smallest doc reachable by links of at most ``distance`` bits."""
    label = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if bin(x ^ y).count("1") <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)] + ["É", "ß", "日本"]
    docs = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 80, 200]))) for _ in range(n)]
    for i in range(0, n, 3):
        w = docs[i].split()
        w[r.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    return [*docs, docs[0], docs[0].upper(), "", "  \n", None]


def test_fingerprints_by_definition():
    texts = corpus()
    got = fingerprints([(t or "").encode() for t in texts], 3)
    assert [int(x) for x in got[:, 0]] == [brute_fp(t, 3) for t in texts]
    assert shingles(b"", 3) == [] and shingles(b"A b", 3) == [b"a b"]


def test_groups_against_brute_force(spark):
    rows = list(enumerate(corpus(1)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "no id", "x")], "doc_id long, text string, fp string")
    got = {r.doc: (r.h, r.component) for r in simhash_groups(df).withColumn("h", hex_fingerprint()).collect()}
    want = brute_components([(i, brute_fp(t, 3)) for i, t in rows], 3)
    assert got.pop(None)[1] is None
    assert got == {i: (f"{brute_fp(t, 3):016x}", want[i]) for i, t in rows}


def test_every_link_of_dense_balls_is_kept(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:6]:
        for _ in range(30):
            x = int(b)
            for bit in r.choice(64, r.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(bytearray(np.uint64(x).tobytes()), i) for i, x in enumerate(fps)], "fp binary, node long")
    want = brute_components(list(enumerate(fps)), 3)
    for widths in ((16,), (21,), (32,), (16, 21, 32)):
        got = {x.node: x.component for x in near_components(df, 3, widths=widths).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_large_groups_and_split_buckets(spark, monkeypatch):
    import loomwright.llm.simhash as sh

    r = np.random.default_rng(5)
    fp = np.unique(np.uint64(77) ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)))[:, None]
    a, b = group_links(np.zeros(len(fp), np.int64), fp, np.arange(len(fp)), 3)
    want = brute_components([(i, int(x[0])) for i, x in enumerate(fp)], 3)
    assert len(a) < len(fp) and all(want[x] == want[y] for x, y in zip(a.tolist(), b.tolist()))
    monkeypatch.setattr(sh, "BUCKET_ROWS", 20)
    df = spark.createDataFrame([(bytearray(x.tobytes()), i) for i, x in enumerate(fp)], "fp binary, node long")
    got = {x.node: x.component for x in near_components(df, 3).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_thresholds_cover_the_radius():
    costs = [[0, 5, 50], [0, 1, 2], [0, 4, 9]]
    best = min((sum(c[u] for c, u in zip(costs, us)), [u - 1 for u in us]) for us in product(range(3), repeat=3) if sum(us) == 4)
    assert allocate(costs, 4) == best
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    parts = plan(1000, both, 3, (16, 21, 32))
    assert sum(t + 1 for _, t in parts) == 4
    assert len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_drop_near_duplicates(spark):
    r = random.Random(9)
    base = [" ".join("w%d" % r.randrange(5000) for _ in range(400)) for _ in range(20)]
    near = []
    for t in base[:10]:
        w = t.split()
        for j in (50, 200, 350):
            w[j] = "other"
        near.append(" ".join(w))
    texts = [*base, *near, base[3], "", None]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(None, base[0], "null id")], "doc_id long, text string, row string")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.collect() if x.doc_id is not None) == [*range(20), 31]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def jaccard(x, y, k=5):
    sets = [{tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (x, y)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def isolated_pairs(ms, seed):
    """Pairs of 400 random words; in the second, the last m words are others."""
    r = random.Random(seed)
    out = []
    for m in ms:
        w = ["w%d" % r.randrange(50_000) for _ in range(400)]
        out.append((" ".join(w), " ".join(w[: 400 - m] + ["v%d" % r.randrange(50_000) for _ in range(m)])))
    return out


def dropped(spark, pairs):
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {i for i, _ in rows} - {x.doc_id for x in drop_near_duplicates(df).collect()}


def test_every_pair_at_the_similarity_is_found(spark):
    """Similarities of 0.80 to 0.85, isolated, so that no third document links them."""
    pairs = isolated_pairs([32 + i % 13 for i in range(300)], 21)
    assert all(0.8 <= jaccard(*p) < 0.852 for p in pairs)
    assert dropped(spark, pairs) == {2 * i + 1 for i in range(300)}


def test_only_exact_near_copies_go(spark, monkeypatch):
    """Pairs of 0.70 to 0.795, pairs whose only common part is one phrase repeated many times, and a group split in chunks."""
    import loomwright.llm.simhash as sh

    r = random.Random(22)
    pairs = isolated_pairs([46 + i % 23 for i in range(100)], 23)
    for _ in range(40):
        phrase = " ".join("p%d" % r.randrange(9000) for _ in range(8))
        pair = []
        for _ in range(2):
            w = ["w%d" % r.randrange(50_000) for _ in range(2120)]
            for at in sorted(r.sample(range(2120), 110), reverse=True):
                w.insert(at, phrase)
            pair.append(" ".join(w))
        pairs.append(tuple(pair))
    assert all(jaccard(*p) < 0.8 for p in pairs)
    assert dropped(spark, pairs) == set()

    monkeypatch.setattr(sh, "GROUP_ROWS", 3)
    base = isolated_pairs([60], 24)[0]
    family = [(" ".join(base[0].split()[: 400 - i] + [f"u{i}"] * i), " ".join(base[0].split()[:370] + [f"x{i}"] * 30)) for i in range(1, 12)]
    flat = [t for p in family for t in p]
    label = brute_labels(flat)
    assert dropped(spark, family) == {i for i, x in enumerate(label) if x != i}


def brute_labels(texts):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if label[j] < label[i] and len(x & y) >= 0.8 * len(x | y):
                    label[i], changed = label[j], True
    return label


def test_large_groups_by_representatives(spark, monkeypatch):
    """A group around one text, a chain whose ends are far apart, and two groups that one text joins; in chunks of eight."""
    import loomwright.llm.simhash as sh

    monkeypatch.setattr(sh, "GROUP_ROWS", 8)
    monkeypatch.setattr(sh, "REPRESENTATIVES", 3)
    r = random.Random(30)
    words = lambda n: ["w%d" % r.randrange(50_000) for _ in range(n)]
    centre, texts = words(300), []
    for i in range(40):
        w = list(centre)
        w[r.randrange(300)] = f"u{i}"
        w[r.randrange(300)] = f"v{i}"
        texts.append(" ".join(w))
    chain = words(900)
    texts += [" ".join(chain[k : k + 300]) for k in range(0, 600, 20)]
    a, b = words(300), words(300)
    texts += [" ".join(a[: 300 - i % 5] + [f"a{i}"] * (i % 5)) for i in range(20)] + [" ".join(a[:160] + b[160:300 - i % 4] + [f"b{i}"] * (i % 4)) for i in range(20)]
    texts += [" ".join(a[:270] + b[270:]), " ".join(a[:215] + b[215:])]
    label = brute_labels(texts)
    assert len(set(label)) < 20 and dropped(spark, [(t,) for t in texts]) == {i for i, x in enumerate(label) if x != i}


def test_links_are_verified_before_anything_is_closed(spark, monkeypatch):
    """5,000 sets in a chain, each sharing a bucket with the next at a similarity of 0.3: a pair is compared once, and no set is
    compared with any other of the chain. One near pair in the middle of it is found."""
    import loomwright.llm.simhash as sh

    n, searched, search = 5000, [], sh._verified_links
    r = np.random.default_rng(7)
    own = r.integers(1, 1 << 63, n * 70).astype(np.uint64)
    sets = [np.unique(own[i * 70 : i * 70 + 130]) for i in range(n)]  # neighbours share 60 of 200
    sets[2501] = np.unique(np.append(sets[2500][:-3], own[:2]))
    assert 0.28 < len(np.intersect1d(sets[5], sets[6])) / len(np.union1d(sets[5], sets[6])) < 0.32

    def count(cands, similarity):
        searched.append(cands.count())
        return search(cands, similarity)

    monkeypatch.setattr(sh, "_verified_links", count)
    buckets = spark.createDataFrame([(i, i + 1, i) for i in range(n - 1)], "key long, node long, first long")
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, set binary")
    assert [tuple(x) for x in sh.true_links(buckets, rows, 0.8).collect()] == [(2501, 2500)] and searched == [0]
    # three to a bucket: only buckets whose others are in two parts are searched
    buckets = spark.createDataFrame([(i, i + j, i) for i in range(0, n - 2, 2) for j in (1, 2)], "key long, node long, first long")
    assert sorted(tuple(x) for x in sh.true_links(buckets, rows, 0.8).collect()) == [(2501, 2500)] and 0 < searched[1] <= n


def test_buckets_over_batches(spark):
    """Every node of a band key beside the smallest of it, however rows are cut into batches."""
    from loomwright.llm.simhash import _buckets

    r = random.Random(3)
    nodes = [(i, bytearray(b"".join(r.choice(range(12)).to_bytes(8, "little") for _ in range(4)))) for i in range(200)] + [(7, bytearray((5).to_bytes(8, "little") * 4))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(x) for x in _buckets(spark.createDataFrame(nodes, "node long, bands binary")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    of = {}
    for i, b in nodes:
        for k in range(4):
            of.setdefault(int.from_bytes(b[8 * k : 8 * k + 8], "little", signed=True), set()).add(i)
    assert got == sorted((k, i, min(v)) for k, v in of.items() for i in v if i != min(v))


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Without any band: pairs within the radius are found by their fingerprints, and verified; with bands, no pair
    is compared twice."""
    import loomwright.llm.simhash as sh

    r = random.Random(40)
    pairs = []
    for _ in range(40):
        w = ["w%d" % r.randrange(50_000) for _ in range(900)]
        pairs.append((" ".join(w), " ".join([*w[:-1], "other"])))
    sets = [sh.shingle_sets([t.encode() for t in p], 5) for p in pairs]
    bits = [int(np.bitwise_count(np.bitwise_xor(*sh.majorities(s, 2)[:, 0]))) for s in sets]
    sure = {2 * i + 1 for i, n in enumerate(bits) if n <= sh.PRINT_RADIUS}
    assert len(sure) > 30
    compared, star = [], sh.star_links

    def count(cands, *rest):
        compared.append(cands.count())
        return star(cands, *rest)

    monkeypatch.setattr(sh, "star_links", count)
    assert dropped(spark, pairs) == {2 * i + 1 for i in range(40)}
    assert compared[0] >= len(sure) and sum(compared) == 40
    monkeypatch.setattr(sh, "_buckets", lambda nodes: spark.createDataFrame([], "key long, node long, first long"))
    assert sure <= dropped(spark, pairs) <= {2 * i + 1 for i in range(40)}
    # fingerprints alone connect nothing: every pair is a candidate, and none is near enough
    monkeypatch.setattr(sh, "majorities", lambda hashes, count, words=1: np.zeros((count, words), np.uint64))
    assert dropped(spark, isolated_pairs([60] * 10, 41)) == set()
