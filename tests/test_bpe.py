import random

import pytest
from tokenizers import Tokenizer

from loomwright.functions.bpe import encode_table, load_merges, vocabulary_path
from loomwright.functions.tokenizer import tidy

PATH = vocabulary_path(None)
ODD = ["", "  ", "it's  THE &amp;amp; end", "á é É", "日本語 text 🂡🂡", "don't 12345 !!??", "a <|startoftext|> b<|endoftext|>", "x" * 3000, "ab" * 20_000, "\x85  wide", "&lt;b&gt;", "ﬁne ½ ²"]


def test_words_against_the_library():
    own, lib, r = load_merges(PATH), Tokenizer.from_file(PATH), random.Random(1)
    for _ in range(3000):
        w = "".join(r.choice("abcdehilnorst") for _ in range(r.randrange(1, 30)))
        assert own.merge(w) == lib.encode(w, add_special_tokens=False).ids, w
    assert own.merge("") == []


@pytest.mark.parametrize("most", [200_000, 20, 0])
def test_table_against_the_library(spark, most):
    """All words sent, the frequent ones sent and the rest joined, and all joined."""
    r, lib = random.Random(2), Tokenizer.from_file(PATH)
    words = ["the", "of", "Being", "unhappily", "it's", "x1y2", "é", "--", "&amp;", "wholly"]
    texts = [*ODD, *[" ".join(r.choice(words) + r.choice(["", "", ",", str(r.randrange(99))]) for _ in range(r.randrange(60))) for _ in range(150)]]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (3, texts[3])], "k int, text string").withColumnRenamed("k", "row").selectExpr("row", "text", "'old' AS ids", "1 AS `a.b`")
    got = encode_table(df, PATH, broadcast_words=most)
    assert got.columns == ["row", "text", "a.b", "ids"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for x in rows:
        assert x.ids == (None if x.text is None else lib.encode(tidy(x.text), add_special_tokens=False).ids), x.text[:80]
    assert encode_table(df.limit(0), PATH).count() == 0


def test_documents_against_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for x in encode_table(docs, PATH, broadcast_words=500).collect():
        assert x.ids == lib.encode(tidy(x.text), add_special_tokens=False).ids


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Rare words are merged where they are: the result is a narrow plan, and few remembered words give the same ids."""
    import loomwright.functions.bpe as bpe

    monkeypatch.setattr(bpe, "KNOWN_WORDS", 2)
    lib = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(50)
    got = encode_table(docs, PATH, broadcast_words=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert all(x.ids == lib.encode(tidy(x.text), add_special_tokens=False).ids for x in got.collect())
