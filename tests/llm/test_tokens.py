import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwright.llm.tokens import Encoder, tokenizer_path

FILES = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}


def texts():
    r = random.Random(7)
    bits = ["the", " ", "  ", "\n", "\n\n", "\t", " \n ", "É", "é", "́x", "don't", "'s", "42", "日本語", "<|endoftext|>", " ", "　", "\x1c", "\x85", "\x00", "🙂", "İ", "ΑΣ", "-", "--", "of.\nThe", "\r\n", "ﬁ", "a\x0bb", "naïve_x", "Straße", "Ŀ", "ĳ", "x²", "½", "ª", "µ", "×", "l'll", "IT'S", "Æ", "ÿ", "Œ", "I\u0307", "E\u0301", "\u212a", "\u212b", "É.", "É,", "Ab.", "...", ",.", "A.B"]
    return ["", " ", "\n", "x", *("".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(600))]


ADDED = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", "|>", "<|endoftext|><|endoftext|>", "<|start", "of<|endoftext|>the", " <|startoftext|> ", "<|endoftext|>."]


@pytest.mark.parametrize("name", FILES.values())
def test_equal_to_whole_text_encoding(name):
    path = tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    e = Encoder(path)
    assert e.cuts == ("words" if name == "word_bpe_49k.json" else "bytes")
    r = random.Random(8)
    ts = texts() + ADDED + ["".join(r.choice([*ADDED, " ", "The ", "x", "\n", "É"]) for _ in range(r.randrange(1, 9))) for _ in range(300)]
    assert any(i in plain.encode(t, add_special_tokens=False).ids for t in ts for i in (49407, 50256))
    for part in (ts[:100], ts[100:], ts[:50]):
        got = e.encode([t.encode() for t in part])
        for t, g in zip(part, got):
            assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", FILES.values())
def test_added_tokens_as_text(name):
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = True
    e = Encoder(tokenizer_path(name), added_as_text=True)
    for t in [*ADDED, *texts()[:60]]:
        assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_unknown_files_are_encoded_whole(tmp_path):
    """Files that cut or normalise in another way, or whose added tokens match in one: no shortcut is taken."""
    spec = json.load(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8"))
    changed = [{**spec, "normalizer": {"type": "NFC"}}, {**spec, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {**spec, "added_tokens": [{**spec["added_tokens"][0], "normalized": True}]}]
    for i, c in enumerate(changed):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(c), encoding="utf-8")
        e, plain = Encoder(str(path)), Tokenizer.from_file(str(path))
        assert e.cuts == "whole"
        for t in [*ADDED, *texts()[:80]]:
            assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_without_spaces_leave_no_cache(name):
    """20 MB of pieces of 100 kB; what is kept is bounded by bytes, not by their number."""
    own, r = Encoder(tokenizer_path(name)), random.Random(3)
    plain = Tokenizer.from_file(tokenizer_path(name))
    texts = ["".join(r.choices("abcdefghij", k=200)) * 500 for _ in range(200)]
    for i, t in enumerate(texts[:3] if name.startswith("word") else texts):
        got = own.encode([t.encode()])[0]
        if i == 0:
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert sum(len(k) + len(v) for c in (own.cache, own.known) for k, v in c.items()) < 10 << 20
