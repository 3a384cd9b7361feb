import random
import re

from tokenizers import Tokenizer, models

from loomwright.llm.token_counts import UnigramTrie, count_tokens, load_pieces
from loomwright.llm.tokens import tokenizer_path


def test_against_all_segmentations():
    r = random.Random(1)
    for _ in range(30):
        pieces = {c: -r.random() - 3 for c in "abc"} | {"".join(r.choice("abcd") for _ in range(r.randrange(2, 5))): -r.random() * 4 for _ in range(12)}
        trie = UnigramTrie(pieces, byte_score=-7.3)

        def best(w):
            if not w:
                return (0.0, 0)
            found = [best(w[k:]) + (pieces[w[:k]], 1) for k in range(1, len(w) + 1) if w[:k] in pieces]
            if w[0] not in pieces:
                n = len(w[0].encode())
                found.append(best(w[1:]) + (-7.3 * n, n))
            return max((a + c, b + d) for a, b, c, d in found)

        words = ["".join(r.choice("abcdé") for _ in range(r.randrange(0, 9))) for _ in range(40)]
        assert trie.counts(words) == {w: best(w)[1] for w in words}


def test_prefixes_are_scored_once():
    trie = UnigramTrie({"a": -1.0, "b": -1.0, "ab": -1.5})
    trie.counts(["abab", "ababa", "ababb", "abab"])
    assert trie.visited == 6
    trie.counts(["abab", "ababab"])  # another batch goes on in the same trie
    assert trie.visited == 7
    small = UnigramTrie({"a": -1.0, "b": -1.0, "ab": -1.5}, nodes=3, depth=4)
    words = ["abab", "ababa", "ba" * 40, "é" + "ab" * 9, "abab"]
    assert small.counts(words) == UnigramTrie({"a": -1.0, "b": -1.0, "ab": -1.5}).counts(words)
    assert len(small.best) <= 3 + 4 + 1


def test_against_an_independent_unigram_model(spark):
    pieces = load_pieces(tokenizer_path("piece_bpe_32k.model"))
    other = Tokenizer(models.Unigram([("<unk>", -100.0), *pieces.items()], 0, False))
    r = random.Random(2)
    vocab = ["the", "theation", "Été", "naïve", "walking,", "x" * 300, "don't", "été.", "2024"]
    texts = [None, "", " \t\n", *("".join(r.choice(vocab) + r.choice([" ", "\n", "\x0b"]) for _ in range(r.randrange(60))) for _ in range(50)), "w" * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, n_tokens string")
    for x in count_tokens(df).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", x.text or "")
        assert x.n_pretokens == len(words)
        if len(x.text or "") < 50_000:
            assert x.n_tokens == sum(len(other.encode("▁" + w).ids) for w in words)
    assert count_tokens(df.limit(0)).count() == 0


def test_long_words_are_not_remembered():
    from loomwright.llm.token_counts import _Counter
    from loomwright.llm.tokens import tokenizer_path

    counter = _Counter(tokenizer_path("piece_bpe_32k.model"), "zipf")
    word = b"ab" * 5_000
    assert counter.of([word, word + b" ab"])[0][1] == counter.of([word])[0][1] and all(len(w) <= 64 for w in counter.cache) and counter.cache
