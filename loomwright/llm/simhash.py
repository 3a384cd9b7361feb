"""SimHash near-dedup with a generalised pigeonhole index.

Fingerprint bits that go together are grouped into partitions. Two fingerprints within radius r agree to
within t_i bits on some partition i whenever sum(t_i + 1) = r + 1; dynamic programming shares those r + 1
units among the partitions, unequally, by the number of candidates that each radius is estimated to give.

drop_near_duplicates() links by the exact sets of shingles. Its candidates are what this index finds among the sets'
fingerprints, and MinHash bands find those that are left, as a similarity of 0.8 is further than fingerprints reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import durable, map_arrow, named, pack, prepare, raw, unpack
from loomwright.llm.components import connected_components

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Rows of one probe bucket that one task compares; larger buckets are split into pairs of chunks, all of them compared.
BUCKET_ROWS = 32_768
#: Hashes that are counted at a time.
_HASHES = 1 << 19
#: MinHash bands of the near-copy search, and MinHash values in each.
BANDS, BAND_ROWS = 32, 5
#: Fingerprints of drop_near_duplicates: bits within which all pairs are found, and up to which a pair that meets is a candidate.
PRINT_RADIUS, PRINT_DISTANCE = 3, 12
#: Shingle hashes whose minima are taken at a time, so that they stay in a core's cache.
_MINIMA = 1 << 15
#: Rows of a component of candidates that one task compares, and about how many rows of a larger one all its others are compared with.
GROUP_ROWS, REPRESENTATIVES = 1024, 16
GROUP_BYTES = 64 << 20


def shingles(text: bytes, k: int) -> list[bytes]:
    """The k-word shingles of an ASCII-lower-cased text, repeats included; fewer words: the whole sequence; none: none."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [line]
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    return [line[a : b - 1] for a, b in zip(at, at[k:])]


def _widen(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit hashes from each one: the hash itself, then splitmix64 steps of it."""
    out = [h]
    for j in range(1, words):
        z = h + np.uint64((j * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprints(texts: list[bytes], k: int = 3, words: int = 1) -> np.ndarray:
    """(n, words) uint64: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); no words: zero."""
    every = (shingles(t, k) for t in texts)
    return majorities((np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(42)), np.uint64, len(s)) for s in every), len(texts), words)


def majorities(hashes: Iterable[np.ndarray], count: int, words: int = 1) -> np.ndarray:
    """(count, words) uint64: a bit is 1 if it is set in over half of an array's hashes; an empty array: zero."""
    out = np.zeros((count, words), np.uint64)
    held, first, total = [], 0, 0

    def flush(end):
        nonlocal held, first, total
        if total:
            n = np.array([len(x) for x in held])
            h = _widen(np.concatenate(held), words)
            doc = np.repeat(np.arange(len(held)) * 256, n)
            lanes = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8 * words)
            bits = np.empty((len(held), 64 * words), np.uint8)
            for lane in range(8 * words):
                seen = np.bincount(doc + lanes[:, lane], minlength=256 * len(held)).reshape(-1, 256)
                bits[:, 8 * lane : 8 * lane + 8] = 2 * (seen @ _BYTE_BITS) > n[:, None]
            out[first:end] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        held, first, total = [], end, 0

    for i, own in enumerate(hashes):
        held.append(own)
        total += len(own)
        if total >= _HASHES or len(held) >= 1000:
            flush(i + 1)
    flush(count)
    return out


def _as_words(col: pa.Array) -> np.ndarray:
    """A column of equally long fingerprints as an (n, words) uint64 array."""
    data = b"".join(col.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(col), -1)


def _as_bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, over all of them, how often bits i and j are both set (bits x bits, so bounded)."""

    def joint(batches):
        both, n = np.zeros((bits, bits)), 0
        for b in batches:
            x = _as_bits(_as_words(b.column(0))).astype(np.float32) if b.num_rows else np.zeros((0, bits), np.float32)
            both += x.T @ x
            n += len(x)
        if n:
            i, j = np.triu_indices(bits)
            cells = [np.append(i, -1), np.append(j, -1), np.append(both[i, j], n).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["i", "j", "c"])

    rows = nodes.select("fp").mapInArrow(joint, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((bits, bits)), 0
    for r in rows:
        if r.i < 0:
            n = r.c
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.c
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits, of sizes equal to within one; each takes the bits most correlated with those it has."""
    bits = len(both)
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = list(range(bits)), []
    for g in range(m):
        width = bits // m + (g < bits % m)
        own = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(best := max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.remove(best)
        out.append(sorted(own))
    return out


def distance_tail(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """P(two random fingerprints differ in at most t of the group's bits), t = 0..most, by a beta-binomial with the
    mean and the variance that the joint bit counts give."""
    w, q = len(group), both[np.ix_(group, group)] / max(n, 1)
    p = np.diag(q)
    differ = 2 * p * (1 - p)
    p11, p10 = q, p[:, None] - q
    p01, p00 = p[None, :] - q, 1 - p[:, None] - p[None, :] + q
    both_differ = 2 * (p11 * p00 + p10 * p01)
    np.fill_diagonal(both_differ, differ)
    mean, var = differ.sum(), both_differ.sum() - differ.sum() ** 2
    a = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / max(w * a * (1 - a), 1e-9) - 1) / max(w - 1, 1), 1e-6), 1 - 1e-6)
    al, be = a * (1 / rho - 1), (1 - a) * (1 / rho - 1)
    lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    pmf = [math.exp(math.lgamma(w + 1) - math.lgamma(d + 1) - math.lgamma(w - d + 1) + lb(d + al, w - d + be) - lb(al, be)) for d in range(min(most, w) + 1)]
    return list(np.cumsum(pmf))


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = units and the least sum of costs[i][t_i + 1]."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * units
    for c in costs:
        nxt: list[tuple[float, list[int]]] = [(math.inf, [])] * (units + 1)
        for u, (v, ts) in enumerate(best):
            for k in range(min(len(c), units - u + 1)):
                if v + c[k] < nxt[u + k][0]:
                    nxt[u + k] = (v + c[k], [*ts, k - 1])
        best = nxt
    return best[units]


def plan(n: int, both: np.ndarray, radius: int, widths: tuple[int, ...], pair_cost: float = 0.01, most: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use: of the partitionings named by ``widths``, the one whose probe rows
    and estimated candidate pairs cost least."""
    bits, found = len(both), []
    for w in widths:
        m = max(1, round(bits / w))
        groups = group_bits(n, both, m)
        costs = []
        for g in groups:
            tail = distance_tail(n, both, g, most)
            rows = np.cumsum([math.comb(len(g), t) for t in range(len(tail))])
            costs.append([0.0] + [n * float(r) + pair_cost * n * n / 2 * p for r, p in zip(rows, tail)])
        cost, ts = allocate(costs, radius + 1)
        if math.isfinite(cost):
            found.append((cost, w, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    if not found:
        raise ValueError(f"no partitioning of {bits} bits into widths {widths} covers radius {radius}")
    return min(found)[2]


def _probes(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, node): each fingerprint under its own key and those within the partition's threshold."""

    def probe(b: pa.RecordBatch):
        bits, out = _as_bits(_as_words(b.column(0))).astype(np.int64), []
        for i, (group, t) in enumerate(parts):
            key = bits[:, group] @ (np.int64(1) << np.arange(len(group)))
            flips = [sum(1 << x for x in c) for k in range(t + 1) for c in combinations(range(len(group)), k)]
            for f in flips:
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i), pa.int32()), pa.array(key ^ f, pa.int64()), b.column(0), b.column(1)], ["part", "key", "fp", "node"]))
        return out

    return map_arrow(nodes.select("fp", "node"), probe, "part int, key long, fp binary, node long")


def _spanning(fp: np.ndarray, node: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one large group, by breadth-first search over what is not yet reached."""
    left, out = np.argsort(node, kind="stable"), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]).sum(axis=1, dtype=np.int64) <= distance
            if near.any():
                got = left[near]
                out += zip(node[got].tolist(), repeat(int(node[x])))
                queue += got.tolist()
                left = left[~near]
    return out


def group_links(group: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(node, smaller node) links that span the components of rows sorted by group; at most one for each row."""
    n = len(group)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, n))
    a, b = [], []
    rows = np.repeat(sizes <= small, sizes)
    sub, at = np.flatnonzero(rows), None
    g, f, v = group[sub], fp[sub], node[sub]
    for d in range(1, int(sizes[sizes <= small].max(initial=1))):
        at = np.flatnonzero(g[d:] == g[:-d])
        if not len(at):
            break
        at = at[np.bitwise_count(f[at] ^ f[at + d]).sum(axis=1, dtype=np.int64) <= distance]
        a.append(v[at])
        b.append(v[at + d])
    for s, k in zip(starts[sizes > small], sizes[sizes > small]):
        if links := _spanning(fp[s : s + k], node[s : s + k], distance):
            x, y = zip(*links)
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        was = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == was).all():
            break
    move = label != np.arange(len(ids))
    return ids[move], ids[label[move]]


def _links(cands: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """(a, b) links between candidates that share a bucket and are within ``distance``, a spanning set of them."""
    dealt = cands.repartition(*keys).sortWithinPartitions(*keys)
    hashed = dealt.select(F.xxhash64(*keys).alias("g"), "fp", "node")

    def run(batches):
        held: list[tuple] = []
        rows = 0

        def work(last: bool):
            nonlocal held, rows
            g, fp, node = (np.concatenate(x) for x in zip(*held))
            end = len(g) if last else int(np.flatnonzero(g != g[-1])[-1] + 1 if (g != g[-1]).any() else 0)
            held, rows = ([(g[end:], fp[end:], node[end:])], len(g) - end) if end < len(g) else ([], 0)
            if end:
                a, b = group_links(g[:end], fp[:end], node[:end], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        limit = 200_000
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _as_words(batch.column(1)), batch.column(2).to_numpy()))
                rows += batch.num_rows
                if rows >= limit:
                    yield from work(False)
                    limit = max(200_000, 2 * rows)
        if held:
            yield from work(True)

    return hashed.mapInArrow(run, "a long, b long")


def near_components(nodes: DataFrame, distance: int, radius: int | None = None, widths: tuple[int, ...] = (16, 21, 32)) -> DataFrame:
    """(node, component) of the linked ones among ``nodes``, as near_links() finds them."""
    return connected_components(near_links(nodes, distance, radius, widths))


def near_links(nodes: DataFrame, distance: int, radius: int | None = None, widths: tuple[int, ...] = (16, 21, 32)) -> DataFrame:
    """(a, b) links that span, in each bucket, what is linked among ``nodes`` (fp binary, node long; fingerprints distinct).

    Two fingerprints link at ``distance`` or fewer differing bits. All pairs within ``radius`` (default: the same)
    are sure to be found; pairs between radius and distance are found where they meet in a bucket.
    """
    bits_row = nodes.select(F.length("fp")).first()
    if bits_row is None:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    bits = 8 * bits_row[0]
    n, both = bit_statistics(nodes, bits)
    parts = plan(n, both, distance if radius is None else radius, widths)
    cands, keys = _probes(nodes, parts), ["part", "key"]
    big = durable(cands.groupBy(*keys).count().where(F.col("count") > BUCKET_ROWS).withColumn("chunks", F.ceil(F.col("count") / BUCKET_ROWS)).select(*keys, "chunks"), "large-buckets")
    if not big.isEmpty():
        split = cands.join(big, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        split = split.withColumn("c", F.pmod(F.xxhash64("fp"), "chunks")).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        cands, keys = split.withColumn("lo", F.least("c", "d")).withColumn("hi", F.greatest("c", "d")), [*keys, "lo", "hi"]
    return _links(cands, keys, distance)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, distance: int = 3, radius: int | None = None, widths: tuple[int, ...] = (16, 21, 32)
) -> DataFrame:
    """(doc, fp binary, component long): each document's fingerprint and the smallest id linked to it, itself included.

    Null texts are empty; all documents without words share the fingerprint zero. A row with a null id has a
    fingerprint but no component. Rows that repeat an id are one document for each distinct fingerprint of it. Equal
    fingerprints meet by a pre-aggregated grouping before any search, so copies are never paired. An empty table
    gives an empty table.
    """
    prepare(docs.sparkSession)
    words = bits // 64

    def prints(b: pa.RecordBatch):
        fp = fingerprints(b.column(1).to_pylist(), shingle, words)
        data = np.ascontiguousarray(fp).tobytes()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([data[i : i + 8 * words] for i in range(0, len(data), 8 * words)], pa.binary())], ["doc", "fp"])

    own = durable(map_arrow(docs.select(named(id_col).cast("long").alias("doc"), raw(text_col).alias("t")), prints, "doc long, fp binary"), "fingerprints")
    nodes = durable(own.where("doc IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("node")), "nodes")
    found = near_components(nodes, distance, radius, widths)
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    labelled = durable(labelled, "components")
    return own.join(labelled, "fp", "left").select("doc", "fp", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted XXH64 (seed 42)."""
    return [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(42)), np.uint64, len(s))) for s in (shingles(t, k) for t in texts)]


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """(n, bands) uint64: the hash of the band's ``rows`` MinHash values; two sets share a key with chance J ** rows; empty sets: zero."""
    r = np.random.default_rng(42)
    by, plus = r.integers(0, 2**64, (2, bands * rows), dtype=np.uint64)
    by |= np.uint64(1)
    n = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), bands), np.uint64)
    full, end = np.flatnonzero(n), np.cumsum(n[n > 0])
    first = 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(end, (end[first - 1] if first else 0) + _MINIMA, side="right")))
        own = full[first:last]
        h, starts = np.concatenate([sets[i] for i in own]), np.append(0, np.cumsum(n[own])[:-1])
        for band in range(bands):
            key = np.full(len(own), band + 1, np.uint64)
            for x in range(band * rows, (band + 1) * rows):
                key = (key ^ np.minimum.reduceat((h ^ plus[x]) * by[x], starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out[own, band] = key
        first = last
    return out


def jaccard_links(sets: list[np.ndarray], node: np.ndarray, similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs whose exact Jaccard is ``similarity`` or more, by breadth-first search. Rows of
    one ``label`` are known to be connected: they are reached together, and no link between them is looked for."""
    n = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    _, inverse, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders, ends = doc[np.argsort(inverse, kind="stable")], np.cumsum(many)
    at = np.append(0, np.cumsum(n))
    left, out = np.argsort(node, kind="stable"), []
    while len(left):
        mates = left[:1] if label is None else left[label[left] == label[left[0]]]
        queue, left = mates.tolist(), left[~np.isin(left, mates)]
        while queue and len(left):
            x = queue.pop()
            own = inverse[at[x] : at[x + 1]]
            shared = np.bincount(np.concatenate([holders[e - m : e] for e, m in zip(ends[own].tolist(), many[own].tolist())]), minlength=len(sets))[left] if len(own) else np.zeros(len(left), np.int64)
            near = shared >= similarity * (n[x] + n[left] - shared) - 1e-9
            if near.any():
                out += zip(node[left[near]].tolist(), repeat(int(node[x])))
                got = left[near] if label is None else left[np.isin(label[left], label[left[near]])]
                queue += got.tolist()
                left = left[~np.isin(left, got)]
    return out


class Representatives:
    """Some sets of a large component, against which all its others are compared."""

    def __init__(self, node: list[int], sets: list[np.ndarray], similarity: float):
        self.node, self.similarity, self.n = node, similarity, np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.values, self.owner = every[order], np.repeat(np.arange(len(sets)), self.n)[order]
        self.joined: set[tuple[int, int]] = set()

    def links(self, node: int, x: np.ndarray) -> list[tuple[int, int]]:
        """A link to the first representative that is near, and, the first time, links between it and the others that are."""
        lo, hi = np.searchsorted(self.values, x), np.searchsorted(self.values, x, side="right")
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.n))
        near = np.flatnonzero(shared >= self.similarity * (len(x) + self.n - shared) - 1e-9).tolist()
        out = [(node, self.node[near[0]])] if near else []
        for r in near[1:]:
            if (near[0], r) not in self.joined:
                self.joined.add((near[0], r))
                out.append((self.node[r], self.node[near[0]]))
        return out


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, first): each node of a band key but the smallest, and the smallest."""

    def keys(b: pa.RecordBatch):
        k = _as_words(b.column(0))
        return pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(1).to_numpy(), k.shape[1]))], ["key", "node"])

    def others(batches):
        held = None  # the last key, its smallest node and its last
        for b in batches:
            if b.num_rows:
                key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
                fresh = np.append(True, key[1:] != key[:-1])
                first = node[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
                if held is not None:
                    first = np.where(key == held[0], held[1], first)
                again = np.append(held is not None and (key[0], node[0]) == (held[0], held[2]), (key[1:] == key[:-1]) & (node[1:] == node[:-1]))
                held = key[-1], first[-1], node[-1]
                if (move := (first != node) & ~again).any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[move]), pa.array(node[move]), pa.array(first[move])], ["key", "node", "first"])

    dealt = map_arrow(nodes.select("bands", "node"), keys, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(others, "key long, node long, first long")


def _near(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    shared = np.intersect1d(x, y, assume_unique=True).size
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def star_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those of the pairs (node, first) whose exact Jaccard is ``similarity`` or more; ``sets`` has node and set.

    A first's set goes once to a task for every GROUP_ROWS of its pairs, or so, and the others stream past it.
    """
    large = pairs.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("first", F.ceil(F.col("n") / GROUP_ROWS).alias("chunks"))
    dealt = pairs.join(large, "first", "left").select("node", "first", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).alias("chunk"))
    hubs = dealt.select("first", "chunk").distinct().join(sets, F.col("first") == F.col("node")).select("first", "chunk", F.lit(0).alias("kind"), "node", "set")
    rows = hubs.union(dealt.join(sets, "node").select("first", "chunk", F.lit(1).alias("kind"), "node", "set"))

    def compare(batches):
        hub, at = [], None  # an id that is repeated has several sets
        for b in batches:
            a, first = [], []
            for f, chunk, kind, node, x in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(x, np.uint64)
                if kind == 0:
                    hub, at = [*hub, own] if at == (f, chunk) else [own], (f, chunk)
                elif at == (f, chunk) and any(_near(own, x, similarity) for x in hub):
                    a.append(node)
                    first.append(f)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(first, pa.int64())], ["a", "b"])

    return rows.repartition("first", "chunk").sortWithinPartitions("first", "chunk", "kind").mapInArrow(compare, "a long, b long")


def _grouped(rows: DataFrame, keys: list[str], work) -> DataFrame:
    """(a, b) links that ``work(rows of one group)`` gives for each group of ``keys``; rows come sorted by keys and by what
    follows them."""
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *rest[:-1]).select(*keys, *rest)

    def run(batches):
        held, key = [], None

        def done():
            if links := work(held) if len(held) > 1 else []:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[: len(keys)] != key:
                    yield from done()
                    held, key = [], row[: len(keys)]
                held.append(row[len(keys) :])
        yield from done()

    return dealt.mapInArrow(run, "a long, b long")


def _sets(rows: list[tuple]) -> list[np.ndarray]:
    return [np.frombuffer(r[-1], np.uint64) for r in rows]


def _verified_links(cands: DataFrame, similarity: float) -> DataFrame:
    """(a, b): true links that connect what true links can connect within each group of ``cands`` (bucket, node, part, set); nodes
    of one ``part`` are connected already.

    A group of up to GROUP_ROWS rows and GROUP_BYTES is searched in one task. Of a larger one, about REPRESENTATIVES rows are
    dealt to as many tasks as its rows need, and each row is compared with those: a group of near copies of any size is
    connected by that, at a cost in proportion to it. Only groups that are then still in several parts are split into pairs of
    chunks, all of them compared, but for rows that are in one part already.
    """
    need = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum(F.length("set")) / GROUP_BYTES))
    sizes = durable(cands.groupBy("bucket").agg(F.count("*").alias("n"), need.alias("chunks")).where("chunks > 1"), "large-buckets")
    search = lambda rows: jaccard_links(_sets(rows), np.array([r[0] for r in rows], np.int64), similarity, np.array([r[1] for r in rows], np.int64))
    plain = _grouped(cands.join(sizes.select("bucket"), "bucket", "left_anti").select("bucket", "node", "part", "set"), ["bucket"], search)
    if sizes.isEmpty():
        return plain
    large = cands.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    some = large.where(F.pmod(F.xxhash64("node", F.lit("representative")), "n") < REPRESENTATIVES).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = some.select("bucket", "chunk", F.lit(0).alias("kind"), "node", "set").union(large.select("bucket", "chunk", F.lit(1).alias("kind"), "node", "set"))

    def compare(rows):
        first = [r for r in rows if r[0] == 0]
        if not first:
            return []
        known = Representatives([r[1] for r in first], _sets(first), similarity)
        return [link for r in rows if r[0] == 1 for link in known.links(r[1], np.frombuffer(r[2], np.uint64))]

    found = durable(_grouped(dealt, ["bucket", "chunk"], compare), "representative-links")
    parts = connected_components(found.union(large.where("part != node").select("node", "part"))).withColumnRenamed("component", "now")
    marked = durable(large.join(parts, "node", "left").select("bucket", "node", "chunk", "chunks", F.coalesce("now", "node").alias("part"), "set"), "large-groups")
    several = marked.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("bucket")
    split = marked.join(several, "bucket").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    split = split.select("bucket", F.least("chunk", "d").alias("lo"), F.greatest("chunk", "d").alias("hi"), "node", "part", "set")
    return plain.union(found).union(_grouped(split, ["bucket", "lo", "hi"], search))


def true_links(buckets: DataFrame, sets: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """(a, b): links of exact Jaccard ``similarity`` or more that connect all nodes which such links between nodes of one bucket
    connect. ``buckets`` has key, node and first (the smallest node of the key) for all its others, ``sets`` node and set.
    ``known`` are true links (a, b: the smaller) that are found already: they are part of the result, and are not compared again.

    First each node meets the smallest first of its buckets, then those firsts that it is not connected to. A bucket of two is
    settled by that, and so is one whose other nodes are connected; only in the rest are nodes compared with each other, bucket
    by bucket. Nothing is closed over links that are not verified, but for open buckets of over GROUP_ROWS nodes, which
    chance does not make: those that share nodes are one group, so that a node is compared once and not for each of its keys.
    """
    pairs = durable(buckets.select("node", "first").distinct(), "bucket-pairs")
    of = lambda df, col, name: df.join(part.select(F.col("node").alias(col), F.col("component").alias("c")), col, "left").select(*df.columns, F.coalesce("c", col).alias(name))
    if known is not None:
        pairs = pairs.join(known.toDF("node", "first"), ["node", "first"], "left_anti")
    least = pairs.groupBy("node").agg(F.min("first").alias("first"))
    one = star_links(least, sets, similarity)
    one = durable(one if known is None else one.union(known), "links")
    part = connected_components(one)
    rest = pairs.join(least.withColumnRenamed("first", "met"), "node").where("first != met").drop("met")
    rest = of(of(rest, "node", "x"), "first", "y").where("x != y").select("node", "first")
    links = one.union(durable(star_links(rest, sets, similarity), "links"))
    part = durable(connected_components(links), "parts")
    left = of(buckets.select("key", "node"), "node", "part")
    open_ = left.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    opened = durable(left.join(open_, "key"), "open-buckets")
    need = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("bytes") / GROUP_BYTES))
    weight = sets.groupBy("node").agg(F.sum(F.length("set")).alias("bytes"))
    large = durable(opened.join(weight, "node").groupBy("key").agg(need.alias("chunks")).where("chunks > 1").select("key"), "large-keys")
    groups = opened.join(large, "key", "left_anti").select(F.col("key").alias("bucket"), "node", "part")
    if not large.isEmpty():
        # copies by the thousand share many keys, and are one group for all of those
        big = opened.join(large, "key")
        hubs = big.join(big.groupBy("key").agg(F.min("node").alias("hub")), "key").select("node", "hub").distinct()
        family = connected_components(hubs).withColumnRenamed("component", "bucket")
        groups = groups.union(big.select("node", "part").distinct().join(family, "node").select("bucket", "node", "part"))
    cands = durable(groups.join(sets, "node").select("bucket", "node", "part", "set"), "open-groups")
    return links.union(_verified_links(cands, similarity))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without those that have a near copy of smaller id linked to them, directly or through others.

    Two documents link if the Jaccard of their sets of distinct word shingles is ``similarity`` or more, verified on
    the sets; only verified links connect anything. Sets have fingerprints of 64 bits, and the first candidates are those that
    near_links() finds: all pairs within PRINT_RADIUS bits, and pairs within PRINT_DISTANCE that meet. At 0.8 about ten bits
    differ, so the other candidates are documents not connected yet that share a bucket of BANDS MinHash bands of BAND_ROWS
    values each (see true_links): a pair at 0.8 shares one with chance 1 - (1 - 0.8 ** 5) ** 32, over 99.999 %, whatever the
    number of documents. Documents without words are copies of each other. Rows with a null id stay; rows that repeat an id stay or go together. The
    input's columns come back unchanged.
    """
    prepare(docs.sparkSession)
    texts = docs.select(named(id_col).cast("long").alias("doc"), raw(text_col).alias("t")).where("doc IS NOT NULL")

    def marks(b: pa.RecordBatch):
        sets = shingle_sets(b.column(1).to_pylist(), shingle)
        keys = [xxhash.xxh128_digest(x.tobytes()) for x in sets]
        prints = [x.tobytes() for x in majorities(sets, len(sets))]
        columns = [keys, prints, [x.tobytes() for x in band_keys(sets)]]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.binary()) for c in columns]], ["doc", "key", "fp", "bands"])

    def whole(b: pa.RecordBatch):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1).to_pylist(), shingle)], pa.binary())], ["node", "set"])

    own = durable(map_arrow(texts, marks, "doc long, key binary, fp binary, bands binary"), "shingle-marks")
    nodes = durable(own.groupBy("key").agg(F.min("doc").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = nodes.select("node", "fp").join(prints.withColumnRenamed("node", "first"), "fp").select("node", "first")
    near = durable(near_links(prints, PRINT_DISTANCE, PRINT_RADIUS).union(same).toDF("node", "first").where("node != first").distinct(), "print-pairs")
    buckets = durable(_buckets(nodes), "buckets")
    used = buckets.select("node").union(buckets.select("first")).union(near.select("node")).union(near.select("first")).distinct()
    sets = durable(map_arrow(used.join(texts, F.col("node") == F.col("doc")).select("node", "t"), whole, "node long, set binary"), "candidates")
    known = durable(star_links(near, sets, similarity), "print-links")
    found = connected_components(true_links(buckets, sets, similarity, known))
    labelled = nodes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    gone = durable(own.select("doc", "key").join(labelled, "key").where("doc != component").select("doc").distinct(), "near-copies")
    rows = pack(docs, doc=named(id_col).cast("long"))
    return unpack(rows.join(gone, "doc", "left_anti"), docs)


def hex_fingerprint(col: str = "fp"):
    """A 64-bit fingerprint (stored little-endian) as 16 lowercase hex digits."""
    h = F.lower(F.hex(F.col(col)))
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))])
