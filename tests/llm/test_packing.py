import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwright.llm.packing import Slots, column_generation, pack_documents, padding, price, sequences, whole_patterns
from loomwright.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_price_against_enumeration():
    r = random.Random(1)
    for _ in range(20):
        y = np.array([r.random() * (i + 1) / 6 for i in range(6)])

        def best(c, k):
            return 0 if k == 0 else max([best(c, k - 1)] + ([y[k - 1] + best(c - k, k)] if c >= k else []))

        value, pattern = price(y, 10)
        assert value == pytest.approx(best(10, 6)) and value == pytest.approx(pattern @ y)
        assert pattern @ np.arange(1, 7) <= 10


def test_column_generation_reaches_the_bound():
    r = np.random.default_rng(2)
    demand = np.zeros(64, np.int64)
    for _ in range(300):  # sequences that are full, so that the bound is their number
        left = 64
        while left:
            c = int(r.integers(1, left + 1))
            demand[c - 1] += 10
            left -= c
    cols, amounts = column_generation(demand, 64)
    assert np.allclose(amounts @ cols, demand)
    assert amounts.sum() == pytest.approx(3000)
    patterns, counts = whole_patterns(demand, 64)
    assert (counts @ patterns == demand).all() and (patterns @ np.arange(1, 65) <= 64).all()
    s = Slots(demand, 64)
    size = np.repeat(np.arange(1, 65), demand)
    rank = np.concatenate([np.arange(d) for d in demand])
    sequence, slot = s.place(size, rank)
    assert np.bincount(sequence, weights=size).max() <= 64 and len(set(zip(sequence, slot))) == len(size)
    assert whole_patterns(np.zeros(8, np.int64), 8)[1].sum() == 0


def test_packing_covers_every_id(spark):
    r = random.Random(3)
    words = ["the", " of", "é", "\n", "x1", " and", "<|endoftext|>"]
    rows = [(i, "".join(r.choice(words) for _ in range(int(r.paretovariate(0.6)) % 9000)), "x") for i in range(400)]
    rows += [(None, "no id", "x"), (500, None, "x"), (501, "", "x"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = pack_documents(df, keep_ids=True)
    got = out.collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(((-1 if d is None else d), [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    by_doc, by_seq = {}, {}
    for x in got:
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(ids) == x.length
        by_doc.setdefault(-1 if x.doc_id is None else x.doc_id, []).append((x.start, ids, x.doc_tokens))
        by_seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))
    copies = by_doc.pop(3)
    assert sorted(p[0] for p in copies) == sorted([p[0] for p in copies][::2] * 2) or len(copies) == 2
    for d, ids in want:
        if d != 3:
            assert sum((p[1] for p in sorted(by_doc[d])), []) == ids and {p[2] for p in by_doc[d]} == {len(ids)}
    p = padding(out).first()
    assert p.tokens == sum(len(i) for _, i in want) and p.padded <= sum(-len(i) % 8 for _, i in want) + 1024
    assert {len(x.ids) for x in sequences(out).collect()} <= {2**k for k in range(11)}
    assert pack_documents(df.limit(0)).count() == 0
