import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.llm import quality
from loomwright.llm.quality import _hashes as hashes
from loomwright.llm.quality import repeat_words, score_quality, trusted_ids


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def texts(n=80):
    r = random.Random(4)
    out = [None, "", " \t\r\n", "a\x85b c d", "x " * 60, "| <b> #1 & %", "é\né\n\n é \né"]
    for _ in range(n):
        w = [r.choice(["le", "Été", "of", "日本", "a b", "the", "the"]) for _ in range(r.randrange(60))]
        if r.random() < 0.5:
            w = w + ["sep"] + w[: r.randrange(30)] + w[:9]
        out.append("".join(x + r.choice([" ", "\n", "\t", "  ", "\x0b"]) for x in w))
    return out


def test_base_counts_against_brute_force(spark):
    rows = [(i, t, "kept?", 1.0) for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, (None, "no id", "k", None), rows[9]], "doc_id long, text string, kept string, llr double")
    got = score_quality(df, spark.createDataFrame([(20, 1)], "doc_id long, quality int").transform(trusted_ids)).collect()
    assert len(got) == len(rows) + 2
    for x in got:
        want = brute(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert x.kept == (not x.base_failed and x.llr >= -0.35)


M = (1 << 64) - 1
ODD, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def mixed(word, seed=1):
    h = (zlib.crc32(word if isinstance(word, bytes) else word.encode()) + seed) * ODD & M
    return (h ^ h >> 29) * MIX & M


def bucket(h, size):
    return (h >> 40) % size


def grams(text, size):
    """Buckets of a text's words, pairs and endings, in whole numbers of Python, and as many times as they occur."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = Counter()
    for w in words:
        out[bucket(mixed(w), size)] += 1
        out[bucket(mixed(w.encode()[-3:], 1 << 33), size)] += 1
    for a, b in zip(words, words[1:]):
        p = (mixed(a) * ODD + mixed(b)) & M
        out[bucket(0 if mixed(a) == mixed(b) else (p ^ p >> 31) * MIX & M, size)] += 1
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_ratio_against_a_plain_count(spark, monkeypatch, broadcast):
    """llr and kept for every document, from Counters over all other documents."""
    if not broadcast:
        monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    size = 97
    rows = [(i, t) for i, t in enumerate(texts())] + [(10, texts()[9]), (None, "river bank and stone " * 9)]
    good = {i for i in range(0, 60, 3)} | {500}
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, good boolean")
    labels = spark.createDataFrame([(i, 1) for i in sorted(good)] * 2 + [(None, 1), (4, 0)], "doc_id long, quality int")
    of = [grams(t, size) for _, t in rows]
    every, trusted = Counter(), Counter()
    for (i, _), g in zip(rows, of):
        every.update(g)
        if i in good:
            trusted.update(g)
    total, liked = sum(every.values()), sum(trusted.values())
    share, want = liked / total, []
    for (i, t), g in zip(rows, of):
        n, own = sum(g.values()), i in good
        x = sum(k * (math.log(trusted[b] - k * own + share) - math.log(every[b] - k + 1)) for b, k in g.items()) / n if n else 0.0
        x -= (math.log(liked - own * n + share * size) - math.log(total - n + size)) if n else 0.0
        c = brute(t)
        want.append((i, t, round(x, 9), not (c[0] < 20 or 100 * c[4] > 30 * c[0]) and x >= -0.35))
    got = [(x.doc_id, x.text, round(x.llr, 9), x.kept) for x in score_quality(df, trusted_ids(labels), buckets=size).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert [x[:2] + x[3:] for x in sorted(got, key=key)] == [x[:2] + x[3:] for x in sorted(want, key=key)]
    assert [x[2] for x in sorted(got, key=key)] == pytest.approx([x[2] for x in sorted(want, key=key)], abs=1e-8)
    assert all(x.good for x in score_quality(df, trusted_ids(labels)).collect())


def test_separates_junk_and_handles_empty_tables(spark):
    r = random.Random(2)
    clean = [" ".join(r.choice(["river", "stone", "of", "the", "and", "walked", "a"]) for _ in range(60)) for _ in range(120)]
    junk = [" ".join(r.choice(["river", "stone", "the"]) + r.choice(["***", "%%%", "$$$"]) for _ in range(60)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 3)] + [(130, 0), (None, 1)], "doc_id long, quality int")
    kept = {x.doc_id for x in score_quality(df, trusted_ids(labels)).where("kept").collect()}
    assert kept == set(range(120))
    assert score_quality(df, trusted_ids(labels.limit(0))).where("kept").count() == 145
    assert score_quality(df.limit(0), trusted_ids(labels)).count() == 0


def test_repeat_words_over_long_texts():
    words = [b"%d" % i for i in range(30_000)]
    assert repeat_words(words, hashes(words)) == 0
    again = words + words[100:110]
    assert repeat_words(again, hashes(again)) == 20


def test_words_of_one_hash_are_two_words(spark):
    """plumless and buckeroo have the same crc32."""
    same = "a b c d e f g"
    text = f"{same} plumless h i j k {same} buckeroo " + " ".join(f"w{i}" for i in range(16))
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo") and len(text.split()) == 36
    df = spark.createDataFrame([(1, text), (2, text.replace("buckeroo", "plumless"))], "doc_id long, text string")
    got = {x.doc_id: x for x in score_quality(df, df.select(F.col("doc_id").alias("doc"))).collect()}
    assert (got[1].n_repeat_words, got[1].base_failed) == (0, False) and got[2].n_repeat_words == 16


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13])
def test_repeat_words_against_counts_of_windows(window):
    r = random.Random(window)
    for _ in range(300):
        words = [r.choice([b"plumless", b"buckeroo", b"x", b"y"]) for _ in range(r.randrange(60))]
        windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        many = Counter(windows)
        assert repeat_words(words, hashes(words), window) == len({i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(window)})
