import itertools
import random
import time
from collections import Counter

import pytest

from loomwright.operators.meteor import align, chunks, meteor, search, stem, tile

# Examples of Porter's paper (fixed values).
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))
    assert [stem(w) for w in ("is", "été", "don't", "Running", "")] == ["is", "été", "don't", "Running", ""]


def fewest(a, b):
    """All ways to pair equal words as often as can be; the fewest chunks."""
    most = sum((Counter(a) & Counter(b)).values())
    best = None
    for places in itertools.product(*[[None, *[j for j, w in enumerate(b) if w == x]] for x in a]):
        used = [j for j in places if j is not None]
        if len(used) == most and len(set(used)) == most:
            n = chunks([(i, j) for i, j in enumerate(places) if j is not None])
            best = n if best is None else min(best, n)
    return most, best


def test_equal_to_trying_everything():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.choice("abc") for _ in range(r.randrange(7))] for _ in range(2))
        got = align(a, b, stems=False)
        assert all(a[i] == b[j] for i, j in got) and len({j for _, j in got}) == len(got)
        assert (len(got), chunks(got)) == fewest(a, b)


def test_scores():
    assert meteor("b c".split(), "b a b c".split()) == pytest.approx(10 * 0.5 / (0.5 + 9) * (1 - 0.5 * 0.5**3))
    assert meteor("the cats sitting".split(), "the cat sits".split()) == pytest.approx(1 - 0.5 / 27) and meteor("the cats".split(), "the cat".split(), stems=False) < 0.6
    assert meteor([], ["a"]) == meteor(["a"], []) == meteor(["a"], ["b"]) == 0.0


def test_tiles_pair_as_many_as_can_be_and_search_never_does_worse():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(40))] for _ in range(2))
        tiled, found = tile(a, b), search(a, b)
        assert len(tiled) == sum((Counter(a) & Counter(b)).values()) == len(set(i for i, _ in tiled)) == len(set(j for _, j in tiled))
        got = align([str(x) for x in a], [str(x) for x in b])
        assert len(got) == len(tiled) and chunks(got) <= chunks(tiled) and (found is None or len(found) == len(tiled))


def test_long_texts_take_time_in_proportion():
    r = random.Random(3)
    took = []
    for n in (20_000, 80_000):
        a = [f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(n)]
        b = a[n // 3 :] + a[: n // 3]
        b[::50] = ["x"] * len(b[::50])
        began = time.time()
        got = align(a, b)
        took.append(time.time() - began)
        assert len(got) == sum((Counter(map(stem, a)) & Counter(map(stem, b))).values()) and chunks(got) < n / 10
    assert took[1] < 12 * took[0] + 1 and took[1] < 20
