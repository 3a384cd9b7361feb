import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import spelling
from loomwright.llm.spelling import Words, group_variants, made, neighbours, words_of


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_words(docs, noise=97):
    out = []
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower(t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            out.append(w[: h % len(w)] + w[h % len(w) + 1 :] if noise and h % noise == 0 else w)
    return out


def one_edit(a, b):
    """Whether exactly one edit apart, by comparing beginnings and ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(words, min_chars=5, min_count=3, ratio=2):
    """Each word against each other."""
    n = {w: k for w, k in Counter(words).items() if len(w) >= min_chars and k >= min_count}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("words", [["aabba", "abc", "zzzz", "a", ""], ["ééa", "ba🂡"]])
def test_neighbours_are_all_and_distinct(words):
    letters = np.array(sorted({ord(c) for w in words for c in w} | {ord("q")}), np.uint64)
    got = {w: [] for w in words}
    for kind, word, at, letter, h in neighbours(Words(words), letters, at_once=7):
        for i, a, x, y in zip(word.tolist(), at.tolist(), letter.tolist(), h.tolist()):
            v = made(words[i], kind, a, x)
            assert int(Words([v]).hash[0]) == y
            got[words[i]].append(v)
    for w in words:
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + chr(c) + w[i:] for i in range(len(w) + 1) for c in letters.tolist()} | {w[:i] + chr(c) + w[i + 1 :] for i in range(len(w)) for c in letters.tolist()}
        assert sorted(got[w]) == sorted(want - {w})


@pytest.mark.parametrize("small", [False, True])
def test_against_each_with_each(spark, small, monkeypatch):
    """Also where the filter lets much through and long words are too many to send."""
    if small:
        monkeypatch.setattr(spelling, "MOST_BITS", 1 << 10)
        monkeypatch.setattr(spelling, "LEAST_BITS", 1 << 10)
        monkeypatch.setattr(spelling, "LONG_WORDS", 1)
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(4, 8))) for _ in range(300)] + ["x" * 70 + c for c in "abc"]
    docs = [(i, " ".join(r.choice(words).title() for _ in range(200)) + "\n" + " ".join(words[-3:])) for i in range(20)]
    docs += [(20, None), (21, ""), (None, "abéab abéab ABÉAB x×y÷z " * 5), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, word string")
    assert sorted(x.word for x in words_of(df).collect()) == sorted(brute_words(docs))
    got = found(group_variants(words_of(df)))
    assert got == brute(brute_words(docs)) and any(x[2] != (x[1] or x[0]) for x in got)


def test_chains_ties_and_hubs(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 4, "zzzzy": 4, "zzzzx": 8, "zzzzw": 8, "hubhub": 100} | {"hubhub"[:i] + c + "hubhub"[i + 1 :]: 3 for i in range(6) for c in "klmnop"}
    words = [w for w, k in n.items() for _ in range(k)]
    got = found(group_variants(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")))
    assert got == brute(words)
    of = {x[0]: x for x in got}
    assert of["aaaaa"][1:3] == ("aaaab", "abbbb") and of["zzzzz"][1] == "zzzzw" and of["hubhub"][4] == 36 and of["khbhub" if "khbhub" in of else "hkbhub"][2] == "hubhub"


def test_very_long_words_and_none(spark):
    """A word of 100,000 letters has millions of neighbours; only words of the vocabulary are built."""
    long = "ab" * 50_000
    words = [long] * 6 + [long[:-1]] * 3 + [long + "c"] * 3
    assert [(r.n, r.n_near, r.form_n) for r in group_variants(spark.createDataFrame([(w,) for w in words], "word string")).orderBy("n", "word").collect()] == [(3, 1, 6), (3, 1, 6), (6, 2, None)]
    assert group_variants(spark.createDataFrame([], "word string")).count() == 0
    with pytest.raises(ValueError):
        group_variants(spark.createDataFrame([], "word string"), ratio=1)
