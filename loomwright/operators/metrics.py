"""Evaluation: answer accuracy, classification, caption overlap, distribution distances, run meters."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwright.functions.vectors import total
from loomwright.operators.meteor import meteor
from loomwright.operators.ngrams import Grams, counts, pack_sorted, sorted_keys, split_words, unpack_sorted, words_of
from loomwright.operators.numbering import prefix
from loomwright.session import bounded, durable


def soft_accuracy(predicted: Column, answers: Column) -> Column:
    """The mean over given answers (structs of answer_id and answer) of min(1, matching others / 3); structs equal in all
    fields are not "others" of each other."""
    one = lambda g: F.least(F.lit(1.0), F.size(F.filter(answers, lambda o: (o != g) & (o["answer"] == predicted))) / F.lit(3.0))
    return total(F.transform(answers, one)) / F.size(answers)


def direct_accuracy(predicted: Column, answers: Column) -> Column:
    """min(1, matches / 3) over plain answers."""
    return F.least(F.lit(1.0), F.size(F.filter(answers, lambda a: a == predicted)) / F.lit(3.0))


def accuracy_report(df: DataFrame, accuracy: str, *types: str) -> DataFrame:
    """(kind, value, accuracy) overall and for each type column, in percent to two places: one pass by grouping sets."""
    sets = [[], *[[t] for t in types]]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *types).agg(F.round(100 * F.avg(accuracy), 2).alias("accuracy"), *[F.grouping(t).alias(f"_{t}") for t in types])
    kind, value = F.lit("overall"), F.lit("")
    for t in types:
        kind = F.when(F.col(f"_{t}") == 0, t).otherwise(kind)
        value = F.when(F.col(f"_{t}") == 0, F.col(t).cast("string")).otherwise(value)
    return out.select(kind.alias("kind"), value.alias("value"), "accuracy")


def exact_match(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """The percentage of equal answers; null if any truth is null."""
    return df.agg(F.when(F.count(F.when(F.col(truth).isNull(), 1)) == 0, 100 * F.avg((F.col(predicted) == F.col(truth)).cast("double"))).alias("accuracy"))


def argmax(logits: Column) -> Column:
    """The first place of the greatest value, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def classification_accuracy(df: DataFrame, logits: str, label: str) -> DataFrame:
    return df.agg((100 * F.avg((argmax(F.col(logits)) == F.col(label)).cast("double"))).alias("accuracy"))


def answer_weights(answers: Column) -> Column:
    """Distinct answers in order of appearance with their share."""
    return F.transform(F.array_distinct(answers), lambda a: F.struct(a.alias("answer"), (F.size(F.filter(answers, lambda x: x == a)) / F.size(answers)).alias("weight")))


def candidate_answers(df: DataFrame, answer: str, order: str, most: int = 30) -> DataFrame:
    """The most frequent answers, earlier first among equals, with a period; "yes." behind them if it is not there."""
    top = df.groupBy(answer).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.col("n").desc(), "first").limit(most)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", answer))), lambda s: F.concat(s[answer], F.lit("."))).alias("a"))
    return listed.select(F.array_distinct(F.concat("a", F.array(F.lit("yes.")))).alias("candidates"))


# --- caption overlap, from the published formulas ---------------------------------------------------------------------


def _captions(df: DataFrame, key: str, candidate: str, references: str) -> DataFrame:
    """(k, c, rs): the candidate and its references as texts; ``references`` is a text or an array of texts."""
    many = df.schema[references].dataType.typeName() == "array"
    texts = F.col(references) if many else F.array(F.col(references))
    return bounded(df.select(F.col(key).alias("k"), F.coalesce(F.col(candidate), F.lit("")).alias("c"), F.filter(texts, lambda t: t.isNotNull()).alias("rs")))


def bleu(df: DataFrame, key: str, candidate: str, references: str, most: int = 4) -> DataFrame:
    """bleu1..bleu4 of a corpus: n-gram precisions clipped by the reference that has most, and a brevity penalty by the
    references closest in length (of two, the shorter). ``key`` is unique; references are a text or an array of texts.

    n-grams meet within their row alone, so each batch of rows gives one row of sums and nothing else is shuffled."""

    def clipped(batches):
        for b in batches:
            out = np.zeros(2 * most + 2, np.int64)  # matches and n-grams of each length, words, words of the closest references
            for c, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, refs = words_of(c), [words_of(r) for r in rs or []]
                for n, table, _ in counts([own, *refs], most) if own and refs else ():
                    out[n - 1] += np.minimum(table[0], table[1:].max(axis=0)).sum()
                out[most : 2 * most] += [max(len(own) - n, 0) for n in range(most)]
                out[-2] += len(own)
                out[-1] += min(((abs(len(r) - len(own)), len(r)) for r in refs), default=(0, 0))[1]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out.tolist()], names)

    names = [*[f"m{n}" for n in range(1, most + 1)], *[f"t{n}" for n in range(1, most + 1)], "cl", "rl"]
    sums = _captions(df, key, candidate, references).select("c", "rs").mapInArrow(clipped, ", ".join(f"{n} long" for n in names))
    t = sums.agg(*[F.sum(n).alias(n) for n in names])
    brevity = F.when(F.col("cl") < F.col("rl"), F.exp(1 - F.col("rl") / F.col("cl"))).otherwise(1.0)
    logs = [F.ln((F.col(f"m{n}") + 1e-15) / (F.col(f"t{n}") + 1e-9)) for n in range(1, most + 1)]
    return t.select(*[(brevity * F.exp(sum(logs[:n]) / n)).alias(f"bleu{n}") for n in range(1, most + 1)])


#: Words of a text that lcs_length() takes at a time; their bits have 2 MB at most.
_LCS_WORDS = 4096


def lcs_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, by bit-parallel rows.

    What both begin or end with counts whole. The rest of ``b`` is taken in blocks, each of which leaves the next one a carry for
    each word of ``a``: so memory grows with the texts, not with the product of their words and different words."""
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    same = lo
    while same < most and a[lo - same - 1] == b[lo - same - 1]:
        same += 1
    a, b = a[lo : len(a) - same + lo], b[lo : len(b) - same + lo]
    carry = bytearray(len(a))
    for at in range(0, len(b), _LCS_WORDS):
        block = b[at : at + _LCS_WORDS]
        where: dict[str, int] = {}
        for j, w in enumerate(block):
            where[w] = where.get(w, 0) | 1 << j
        mask = v = (1 << len(block)) - 1
        for i, w in enumerate(a):
            m = where.get(w, 0)
            if m or carry[i]:
                u = v & m
                added = v + u + carry[i]
                carry[i] = added >> len(block)
                v = (added | v - u) & mask
        same += len(block) - v.bit_count()
    return same


def rouge_l(candidate: list[str], references: list[list[str]], beta: float = 1.2) -> float:
    """The F-score of the longest common subsequence: greatest precision and greatest recall over the references."""
    found = [(lcs_length(candidate, r), len(r)) for r in references if r]
    if not candidate or not found:
        return 0.0
    p, q = max(n / len(candidate) for n, _ in found), max(n / size for n, size in found)
    return (1 + beta**2) * p * q / (q + beta**2 * p) if p and q else 0.0


def _mean(df: DataFrame, candidate: str, references: str, one: Callable[[list[str], list[list[str]]], float], name: str) -> DataFrame:
    @F.arrow_udf("double")
    def score(c: pa.Array, rs: pa.Array) -> pa.Array:
        return pa.array([one(words_of(x), [words_of(r) for r in y or []]) for x, y in zip(c.to_pylist(), rs.to_pylist())], pa.float64())

    return _captions(df, candidate, candidate, references).select(score("c", "rs").alias("s")).agg(F.avg("s").alias(name))


def rouge_l_mean(df: DataFrame, candidate: str, references: str) -> DataFrame:
    return _mean(df, candidate, references, rouge_l, "rouge_l")


def meteor_mean(df: DataFrame, candidate: str, references: str) -> DataFrame:
    """The mean over captions of the best score against any reference."""
    return _mean(df, candidate, references, lambda c, rs: max((meteor(c, r) for r in rs), default=0.0), "meteor")


#: Bytes of captions in a block of cider(), about, blocks in a group, and bytes of hashes that one task adds up.
_PACK_BYTES, _GROUP, _BUCKET_BYTES = 1 << 20, 8, 8 << 20


def _stream(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["x"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def cider(df: DataFrame, key: str, candidate: str, references: str, most: int = 4, sigma: float = 6.0) -> DataFrame:
    """(key, cider): ten times the mean over references and n of the clipped tf-idf cosine, with a Gaussian penalty for
    length; document frequencies count the captions of which a reference holds an n-gram. ``key`` is unique.

    Captions are split into words once, and go in blocks of about a megabyte, some to a group, which is shuffled once. The weight of an n-gram
    that no caption or one has is known without asking. So a group first sends short hashes of its n-grams, dealt to buckets, and
    gets a bit for each: whether two captions may have it. For those alone it sends keys of 80 bits, which are counted
    exactly, and gets their frequencies. With these every group scores its own captions.
    """
    spark = df.sparkSession
    words = _captions(df, key, candidate, references)
    kind = words.schema["k"].dataType.simpleString()
    size = F.octet_length("c") + F.aggregate("rs", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r))
    total = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    # n-grams of up to four words take about a hash for each four bytes of two references and a caption, which share most
    hashes = total.bytes // 4 + 1
    buckets = max(64, 1 << (8 * hashes // _BUCKET_BYTES).bit_length())
    bits = min(max(hashes.bit_length() + 4, buckets.bit_length() + 8), 63)
    short, deal, log = np.uint64(64 - bits), np.uint64(bits - buckets.bit_length() + 1), float(np.log(max(total.n, 1)))
    block = pa.struct([("k", pa.list_(to_arrow_type(words.schema["k"].dataType))), ("texts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary())])

    def pack(batches):
        def grouped(held):
            name = hashlib.blake2b(digest_size=16)
            for b in held:
                for x in (repr(b["k"]), repr(b["sizes"])):
                    name.update(x.encode())
                name.update(b["words"])
            return pa.RecordBatch.from_arrays([pa.array([name.hexdigest()]), pa.array([held], pa.list_(block))], ["pack", "blocks"])

        held = []
        for b in batches:
            step = max(1, b.num_rows * _PACK_BYTES // max(b.nbytes, 1))
            for lo in range(0, b.num_rows, step):
                own = b.slice(lo, step)
                rows = [[c, *(rs or [])] for c, rs in zip(own.column(1).to_pylist(), own.column(2).to_pylist())]
                split, sizes = split_words([t for r in rows for t in r])
                held.append({"k": own.column(0).to_pylist(), "texts": [len(r) for r in rows], "sizes": sizes.tolist(), "words": _stream(split)})
                if len(held) == _GROUP:
                    yield grouped(held)
                    held = []
        if held:
            yield grouped(held)

    def distinct(*columns: np.ndarray) -> np.ndarray:
        """Where rows of sorted columns begin to differ."""
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.flatnonzero(new)

    def grams(blocks: pa.Array):
        """(n-grams of each block with its captions, keys of all, their order, and the places in it where a short hash begins)"""
        made = []
        for i in range(len(blocks)):
            texts, sizes = (blocks.field(f)[i].values.to_numpy() for f in ("texts", "sizes"))
            split = pa.ipc.open_stream(blocks.field("words")[i].as_buffer()).read_next_batch().column(0)
            made.append((Grams(split, sizes, most), texts, sizes))
        hi, lo = (np.concatenate([getattr(g, f) for g, _, _ in made]) for f in ("hi", "lo"))
        order = sorted_keys(hi, lo)
        return made, hi, lo, order, distinct((hi >> short)[order])

    def runs(g: Grams, texts: np.ndarray):
        """Of a block's entries: the caption, the first entry of the same n-gram and caption, and whether it is the candidate's."""
        first = np.cumsum(texts) - texts
        caption = np.repeat(np.arange(len(texts)), texts)
        own = caption[g.text]
        new = np.ones(len(own), bool)
        new[1:] = (g.gram[1:] != g.gram[:-1]) | (own[1:] != own[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        return caption, first, start, g.text[start] == first[own[start]]

    def held(made) -> np.ndarray:
        """Of how many captions a reference holds each n-gram."""
        out = []
        for g, texts, _ in made:
            _, _, start, led = runs(g, texts)
            last = np.flatnonzero(np.diff(start, append=-1))
            out.append(np.bincount(g.gram[last], weights=(last > start[last]) | ~led[last], minlength=len(g.hi)).astype(np.uint32))
        return np.concatenate(out)

    def chosen(order, start, answers):
        """The part of the order whose short hashes got a set bit."""
        flag = np.frombuffer(b"".join(zlib.decompress(a["d"]) for a in answers or []), np.uint8)
        if len(flag) != len(start):
            raise RuntimeError(f"{len(flag)} answers to {len(start)} hashes: the captions were read in another order")
        return order[np.repeat(flag == 1, np.diff(start, append=len(order)))]

    def pieces(name, hashes, at, *columns):
        at = (at >> deal).astype(np.int64)
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        rows = [(int(at[x]), y - x, pack_sorted(hashes[x:y]), *(zlib.compress(c[x:y].tobytes(), 1) for c in columns)) for x, y in zip(cut, [*cut[1:], len(at)])]
        return [pa.array([name] * len(rows), pa.string()), *[pa.array(c) for c in zip(*rows)]]

    def ask(batches):
        for b in batches:
            for name, blocks in zip(b.column(0).to_pylist(), b.column(1)):
                made, hi, _, order, start = grams(blocks.values)
                if len(order):
                    n = np.minimum(np.add.reduceat(np.minimum(held(made), 2)[order], start), 2).astype(np.uint8)
                    at = (hi >> short)[order[start]]
                    yield pa.RecordBatch.from_arrays(pieces(name, at, at, n), ["pack", "bucket", "size", "hi", "n"])

    def send(batches):
        for b in batches:
            for name, blocks, bits in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                made, hi, lo, order, start = grams(blocks.values)
                order = chosen(order, start, bits)
                if len(order):
                    first = distinct(hi[order], lo[order])
                    n = np.add.reduceat(held(made)[order], first).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(pieces(name, hi[order[first]], hi[order[first]] >> short, lo[order[first]], n), ["pack", "bucket", "size", "hi", "lo", "n"])

    def answered(answer):
        """A function of batches that come by bucket: one batch of answers for each bucket."""

        def run(batches):
            rows: list[tuple] = []
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if rows and row[1] != rows[0][1]:
                        yield done(rows)
                        rows = []
                    rows.append(row)
            if rows:
                yield done(rows)

        def done(rows):
            hi = np.concatenate([unpack_sorted(r[3], r[2]) for r in rows])
            d = np.split(answer(hi, rows), np.cumsum([r[2] for r in rows])[:-1])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([zlib.compress(x.tobytes(), 1) for x in d], pa.binary())], ["pack", "bucket", "d"])

        return run

    def inflated(rows, at, kind):
        return np.concatenate([np.frombuffer(zlib.decompress(r[at]), kind) for r in rows])

    def twice(hi, rows):
        order = np.argsort(hi)
        start = distinct(hi[order])
        out = np.empty(len(hi), np.uint8)
        out[order] = np.repeat(np.add.reduceat(inflated(rows, 4, np.uint8).astype(np.int64)[order], start) > 1, np.diff(start, append=len(hi)))
        return out

    def frequencies(hi, rows):
        lo = inflated(rows, 4, np.uint16)
        order = sorted_keys(hi, lo)
        start = distinct(hi[order], lo[order])
        out = np.empty(len(hi), np.uint32)
        out[order] = np.repeat(np.add.reduceat(inflated(rows, 5, np.uint32)[order], start, dtype=np.int64), np.diff(start, append=len(hi)))
        return out

    def score(batches):
        for b in batches:
            for blocks, bits, answers in zip(b.column(0), *(c.to_pylist() for c in b.columns[1:])):
                blocks = blocks.values
                made, hi, lo, order, start = grams(blocks)
                idf = np.full(len(hi), log)
                order = chosen(order, start, bits)
                if len(order):
                    first = distinct(hi[order], lo[order])
                    d = np.frombuffer(b"".join(zlib.decompress(a["d"]) for a in answers or []), np.uint32)
                    if len(d) != len(first):
                        raise RuntimeError(f"{len(d)} frequencies of {len(first)} n-grams: the captions were read in another order")
                    idf[order] = np.repeat(log - np.log(np.maximum(d, 1)), np.diff(first, append=len(order)))
                at = 0
                for i, (g, texts, sizes) in enumerate(made):
                    caption, first, start, led = runs(g, texts)
                    w = idf[at : at + len(g.hi)][g.gram]
                    at += len(g.hi)
                    place, own = g.text * most + g.n, g.count * w
                    size = np.sqrt(np.bincount(place, weights=own**2, minlength=len(sizes) * most)).reshape(-1, most)
                    both = np.where(led, np.minimum(g.count[start], g.count), 0) * w * own
                    both = np.bincount(place, weights=both, minlength=len(sizes) * most).reshape(-1, most)
                    lead = first[caption]
                    norm = size * size[lead]
                    s = np.divide(both, norm, out=np.zeros_like(both), where=norm > 0).sum(axis=1) * np.exp(-((sizes - sizes[lead]).astype(float) ** 2) / (2 * sigma**2))
                    s[first] = 0
                    out = 10 / most * np.bincount(caption, weights=s, minlength=len(texts)) / np.maximum(texts - 1, 1)
                    yield pa.RecordBatch.from_arrays([blocks.field("k")[i].values, pa.array(out, pa.float64())], [key, "cider"])

    def back(asked, run, to):
        """The answers to what groups asked, as an array for each group."""
        found = asked.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "pack string, bucket long, d binary")
        return found.repartition(tasks, "pack").groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", "d"))).alias(to))

    # a group holds some megabytes of captions, and a task some groups; the shuffled groups are read by three steps
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total.bytes // (4 * _GROUP * (1 << 20)))
    packs = words.mapInArrow(pack, f"pack string, blocks array<struct<k:array<{kind}>,texts:array<int>,sizes:array<int>,words:binary>>").repartition(tasks, "pack")
    hashed = packs.mapInArrow(ask, "pack string, bucket long, size long, hi binary, n binary")
    known = packs.join(back(hashed, answered(twice), "bits"), "pack", "left")
    sent = known.mapInArrow(send, "pack string, bucket long, size long, hi binary, lo binary, n binary")
    quoted = key.replace("`", "``")
    return known.join(back(sent, answered(frequencies), "answers"), "pack", "left").select("blocks", "bits", "answers").mapInArrow(score, f"`{quoted}` {kind}, cider double")


# --- distributions ----------------------------------------------------------------------------------------------------


#: Rows and columns of a tile of a matrix of moments, and rows of vectors that are multiplied at a time.
TILE, _ROWS_AT_ONCE = 256, 4096


def _tiles(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int32()), pa.array([j for _, j, _ in rows], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for _, _, x in rows], pa.binary())], ["i", "j", "x"])


_TILE = "i int, j int, x binary"


def _summed(tiles: DataFrame) -> DataFrame:
    """(i, j, x): tiles of one place added up, one of them and the sum in memory at a time."""

    def add(batches):
        at, total = None, None
        for b in batches:
            for i, j, x in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(x)
                if (i, j) != at:
                    if at is not None:
                        yield _tiles([(*at, total)])
                    at, total = (i, j), own.copy()
                else:
                    total += own
        if at is not None:
            yield _tiles([(*at, total)])

    return tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add, _TILE)


def gram(df: DataFrame, vec: str, tile: int = TILE) -> tuple[int, np.ndarray, DataFrame]:
    """(n, mean, tiles of the covariance with ddof 1) of a column of vectors of one size; null vectors don't count.

    A task multiplies its vectors a few thousand at a time and sends its sums as tiles; those of one place are added up in the
    cluster and stay there. The driver gets a mean and a count.
    """
    spark = df.sparkSession

    def part(batches):
        n, s, ss = 0, None, None
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS_AT_ONCE):
                lists = b.column(0).slice(lo, _ROWS_AT_ONCE)
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
                s = x.sum(axis=0) + (0 if s is None else s)
                ss = x.T @ x + (0 if ss is None else ss)
                n += len(x)
        if n:
            d = len(s)
            yield _tiles([(-1, -1, np.append(s, n))])
            for i in range(0, d, tile):
                yield _tiles([(i // tile, j // tile, ss[i : i + tile, j : j + tile]) for j in range(0, d, tile)])

    sums = durable(_summed(df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>")).mapInArrow(part, _TILE)), "gram")
    first = sums.where("i = -1").first()
    if first is None:
        raise ValueError("no vectors")
    own = np.frombuffer(first.x)
    n, mean = int(own[-1]), own[:-1] / own[-1]
    shared = spark.sparkContext.broadcast((n, mean))

    def centre(batches):
        n, mean = shared.value
        for b in batches:
            for i, j, x in zip(*(c.to_pylist() for c in b.columns)):
                a, c = mean[i * tile : (i + 1) * tile], mean[j * tile : (j + 1) * tile]
                yield _tiles([(i, j, (np.frombuffer(x).reshape(len(a), len(c)) - n * np.outer(a, c)) / max(n - 1, 1))])

    return n, mean, sums.where("i >= 0").mapInArrow(centre, _TILE)


def tile_product(a: DataFrame, b: DataFrame, d: int, tile: int = TILE) -> DataFrame:
    """Tiles of the product of two d x d matrices of tiles: those of a row meet those of a column, and products are added up."""
    size = lambda k: min(tile, d - k * tile)

    def multiply(batches):
        for batch in batches:
            for i, k, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                yield _tiles([(i, j, np.frombuffer(x).reshape(size(i), size(k)) @ np.frombuffer(y).reshape(size(k), size(j)))])

    pairs = a.select("i", F.col("j").alias("k"), "x").join(b.select(F.col("i").alias("k"), "j", F.col("x").alias("y")), "k")
    return _summed(pairs.select("i", "k", "j", "x", "y").mapInArrow(multiply, _TILE))


def tile_trace(tiles: DataFrame, tile: int = TILE) -> float:
    """The trace of a matrix of tiles, from those on the diagonal."""

    def diagonal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.trace(m.reshape(int(len(m) ** 0.5), -1))) for m in (np.frombuffer(x) for x in b.column(2).to_pylist())], pa.float64())], ["t"])

    return tiles.where("i = j").mapInArrow(diagonal, "t double").agg(F.sum("t")).first()[0]


def root_trace(product: np.ndarray) -> float:
    """The trace of a root of a product of covariances, from its eigenvalues; an error where it is not real."""
    values = np.sqrt(np.linalg.eigvals(product).astype(complex))
    if abs(values.sum().imag) > 1e-3:
        raise ValueError(f"imaginary part {values.sum().imag}")
    return float(values.sum().real)


def fid(a: DataFrame, b: DataFrame, vec: str = "vec", tile: int = TILE) -> float:
    """|mu1 - mu2|^2 + tr(c1 + c2 - 2 sqrt(c1 c2)).

    Covariances and their product are tables of tiles; the d x d product is put together in the one task that finds its
    eigenvalues (8 d^2 bytes), and never on the driver. A worker's linear algebra has one thread, while a threaded one can stall
    beside the driver's JVM.
    """
    (_, m1, c1), (_, m2, c2) = gram(a, vec, tile), gram(b, vec, tile)
    d = len(m1)
    c1, c2 = durable(c1, "covariance"), durable(c2, "covariance")

    def root(batches):
        whole = np.zeros((d, d))
        for batch in batches:
            for i, j, x in zip(*(c.to_pylist() for c in batch.columns)):
                at = whole[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
                at[:] = np.frombuffer(x).reshape(at.shape)
        yield pa.RecordBatch.from_arrays([pa.array([root_trace(whole)])], ["t"])

    t = tile_product(c1, c2, d, tile).repartition(1).mapInArrow(root, "t double").first().t
    return float(((m1 - m2) ** 2).sum() + tile_trace(c1, tile) + tile_trace(c2, tile) - 2 * t)


def inception_score(df: DataFrame, probs: str, split: Column) -> DataFrame:
    """(mean, std) over splits of exp(mean KL(p(y|x) || p(y))); std of the population. The divergence needs but two sums and a
    count for each split and class, so rows are aggregated before they are shuffled."""
    flat = df.select(split.alias("s"), F.posexplode(probs).alias("y", "p"))
    own = F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))
    per = flat.groupBy("s", "y").agg(own.alias("h"), F.sum("p").alias("p"), F.count("*").alias("n"))
    kl = F.col("h") - F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("n"))).otherwise(0.0)
    split_scores = per.groupBy("s").agg(F.exp(F.sum(kl) / F.max("n")).alias("e"))
    return split_scores.agg(F.avg("e").alias("is_mean"), F.stddev_pop("e").alias("is_std"))


# --- meters -----------------------------------------------------------------------------------------------------------


def _middle(values: Column) -> Column:
    return F.element_at(F.array_sort(values), F.floor((F.size(values) - 1) / 2).cast("int") + 1)


def lower_median(df: DataFrame, meter: str, value: str) -> DataFrame:
    """(meter, median): the lower of the middle values of each meter, by the places of its sorted values; a meter of any
    size is spread over as many tasks as its rows need. Nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(meter, value)
    placed = prefix(rows, [value], within=meter, place="_place")
    middle = rows.groupBy(F.col(meter).alias("_m")).agg(F.floor((F.count("*") - 1) / 2).alias("_at"))
    return placed.join(middle, F.col(meter).eqNullSafe(F.col("_m")) & (F.col("_place") == F.col("_at"))).select(meter, F.col(value).alias("median"))


def meter_window(df: DataFrame, meter: str, order: list[str], value: str, size: int = 20, stretch: int = 100_000) -> DataFrame:
    """avg, lower median, max and last over the last ``size`` values of each meter, and the average since its start.

    Meters are counted first. Where the largest has ``stretch`` rows or fewer, each is one window. A larger one is cut into
    stretches, each of which also sees the ``size`` - 1 rows before it; averages since the start then come from running
    sums with an offset for each partition, so that a meter of any size has no window of its own.
    """
    most = df.groupBy(meter).count().agg(F.max("count")).first()[0] or 0
    if most <= stretch:
        whole = Window.partitionBy(meter).orderBy(*order)
        x, since = F.col(value).cast("double"), whole.rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *_window_stats(value, whole.rowsBetween(-(size - 1), 0)), F.avg(x).over(since).alias("global_avg"), F.count(x).over(since).alias("global_n"))
    sums = {"_sum": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_sum_n": F.col(value).isNotNull().cast("long")}
    rows = prefix(df, order, within=meter, sums=sums, place="_place")
    at = F.floor(F.col("_place") / stretch)
    last = F.col("_place") % stretch >= stretch - (size - 1)
    own, behind = F.struct(at.alias("s"), F.lit(True).alias("home")), F.struct((at + 1).alias("s"), F.lit(False).alias("home"))
    rows = rows.withColumn("_in", F.explode(F.when(last, F.array(own, behind)).otherwise(F.array(own))))
    w = Window.partitionBy(meter, "_in.s").orderBy("_place").rowsBetween(-(size - 1), 0)
    since = [(F.col("_sum") / F.when(F.col("_sum_n") > 0, F.col("_sum_n"))).alias("global_avg"), F.col("_sum_n").alias("global_n")]
    return rows.select("*", *_window_stats(value, w), *since).where("_in.home").drop("_in", "_place", "_sum", "_sum_n")


def _window_stats(value: str, w) -> list[Column]:
    return [
        F.avg(value).over(w).alias("window_avg"),
        _middle(F.collect_list(value).over(w)).alias("window_median"),
        F.max(value).over(w).alias("window_max"),
        F.col(value).alias("last_value"),
    ]


def best_checkpoint(df: DataFrame, metric: str = "agg_metrics", order: str = "epoch") -> DataFrame:
    """The earliest row with the greatest metric over 0 on the split val."""
    return df.where((F.col("split") == "val") & (F.col(metric) > 0)).orderBy(F.col(metric).desc(), order).limit(1)
