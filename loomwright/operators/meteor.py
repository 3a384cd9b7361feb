"""METEOR: words aligned by equal stems, as many as can be, in as few chunks as can be found; Porter's stems."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np

# --- stems, by Porter's published rules (fixed values) -----------------------------------------------------------------

_STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    """(ending, what it becomes), longest endings first."""
    return sorted((tuple(r.partition(":")[::2]) for r in text.split()), key=lambda r: -len(r[0]))


_TABLES = [(_rules(_STEP_2), 0), (_rules(_STEP_3), 0), (_rules(_STEP_4), 1)]


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant: a y behind a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _closed(word: str) -> bool:
    """Whether it ends on consonant, vowel, consonant, the last none of w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a word of a to z; other words, and those of two letters or less, are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: len(word) - len(ending)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (cut := next((e for e in ("ed", "ing") if word.endswith(e)), None)) and "v" in _shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _closed(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table, least in _TABLES:
        for ending, to in table:
            if word.endswith(ending):
                left = word[: len(word) - len(ending)]
                if _measure(left) > least and (ending != "ion" or left[-1:] in ("s", "t")):
                    word = left + to
                break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _closed(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


# --- alignment --------------------------------------------------------------------------------------------------------

#: Places of a word that a run may begin at, states kept at each word, and words up to which states are searched at all.
_STARTS, _BEAM, _SEARCHED = 8, 400, 64


def chunks(pairs: list[tuple[int, int]]) -> int:
    """Runs of pairs that follow each other on both sides."""
    pairs = sorted(pairs)
    return sum(k == 0 or (i - 1, j - 1) != pairs[k - 1] for k, (i, j) in enumerate(pairs))


def _windows(a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
    """For lengths 1, 2, 4 and so on, a number for each window of both sides, equal for equal windows: pairs of those before."""
    at = np.array(a + b, np.int64)
    out, size = [(a, b)], 1
    while 2 * size <= min(len(a), len(b)):
        paired = at[: len(at) - size] * (int(at.max()) + 1) + at[size:]
        at = np.unique(paired, return_inverse=True)[1]
        size *= 2
        own = at.tolist()
        out.append((own[: len(a) - size + 1], own[len(a) : len(a) + len(b) - size + 1]))
    return out


def tile(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal words, as many as can be, by longest common runs first.

    Windows are looked up for lengths that halve down to 1, and each that meets another is made as long as both sides allow;
    of the places in ``b`` where a run could be, the first few free ones are tried. The last round pairs single words, so that no
    pair is left out. Runs found before are as long as a window or longer, so one is free if both its ends are. The work
    grows with the words times their number's digits.
    """
    free_a, free_b, pairs = [True] * len(a), [True] * len(b), []
    windows = _windows(a, b)
    for level in reversed(range(len(windows))):
        size, (of_a, of_b) = 1 << level, windows[level]
        places: dict[int, list[int]] = {}
        for j in range(len(of_b) - 1, -1, -1):
            if free_b[j] and free_b[j + size - 1]:
                places.setdefault(of_b[j], []).append(j)
        i = 0
        while i < len(of_a):
            known = places.get(of_a[i]) if free_a[i] and free_a[i + size - 1] else None
            best, at, again = 0, -1, []
            while known and len(again) < _STARTS:
                j = known.pop()
                if not (free_b[j] and free_b[j + size - 1]):
                    continue  # taken since, and never free again
                again.append(j)
                n = size
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, at = n, j
            if again:
                known.extend(reversed(again))
            for k in range(best):
                free_a[i + k] = free_b[at + k] = False
                pairs.append((i + k, at + k))
            i += max(best, 1)
    return pairs


def search(a: list[int], b: list[int], beam: int = _BEAM) -> list[tuple[int, int]] | None:
    """Pairs as many as can be in the fewest chunks, by states from word to word; None where a state has no way on.

    A state is the place of the last word, the places taken, and how many words of each kind may still be left out; of more
    than ``beam`` those of fewest chunks are kept, so that the result is the best where there are no more.
    """
    at: dict[int, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    count = Counter(a)
    spare = {w: max(0, n - len(at.get(w, ()))) for w, n in count.items()}
    states = {(-2, 0, ()): (0, ())}  # (place of the word before, places taken as bits, words left out): chunks, places
    for w in a:
        nxt: dict[tuple, tuple] = {}
        for (last, taken, out), (n, places) in states.items():
            options = [j for j in at.get(w, ()) if not taken >> j & 1]
            left = dict(out)
            for j in [*options, None]:
                if j is None:
                    if left.get(w, 0) >= spare[w]:
                        continue
                    new = (-2, taken, tuple(sorted({**left, w: left.get(w, 0) + 1}.items())))
                    value = (n, (*places, None))
                else:
                    new, value = (j, taken | 1 << j, out), (n + (j != last + 1), (*places, j))
                if new not in nxt or value[0] < nxt[new][0]:
                    nxt[new] = value
        states = nxt
        if len(states) > beam:
            states = dict(sorted(states.items(), key=lambda s: s[1][0])[:beam])
        if not states:
            return None
    _, places = min(states.values(), key=lambda v: v[0])
    return [(i, j) for i, j in enumerate(places) if j is not None]


def inside(a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
    """The pairs of one run where the shorter side is a run of the longer one: no alignment has more pairs or fewer chunks."""
    if not a or not b:
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    x, y = np.array(short, np.int32).tobytes(), np.array(long, np.int32).tobytes()
    at = y.find(x)
    while at % 4 and at > 0:  # found between two words
        at = y.find(x, at + 1)
    if at < 0:
        return None
    at //= 4
    return [(i, i + at) for i in range(len(a))] if short is a else [(i + at, i) for i in range(len(b))]


def align(candidate: list[str], reference: list[str], stems: bool = True) -> list[tuple[int, int]]:
    """Places of candidate and reference words that are paired: of each stem as many as both have, in few chunks. Captions are
    searched for the fewest; longer texts are tiled by their longest common runs, unless one is a run of the other."""
    number: dict[str, int] = {}
    of = lambda ws: [number.setdefault(stem(w) if stems else w, len(number)) for w in ws]
    a, b = of(candidate), of(reference)
    if (run := inside(a, b)) is not None:
        return run
    tiled = tile(a, b)
    if max(len(a), len(b)) > _SEARCHED or chunks(tiled) <= 1:
        return tiled
    found = search(a, b)
    return found if found is not None and (len(found), -chunks(found)) > (len(tiled), -chunks(tiled)) else tiled


def meteor(candidate: list[str], reference: list[str], stems: bool = True) -> float:
    """The original score with equal stems (synonyms and paraphrases need word lists): 10PR / (R + 9P), less half the cube of
    chunks over matches."""
    pairs = align(candidate, reference, stems)
    if not pairs:
        return 0.0
    p, r = len(pairs) / len(candidate), len(pairs) / len(reference)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks(pairs) / len(pairs)) ** 3)
