"""Token counts under a unigram vocabulary: forward scores along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import pack, prepare, raw, unpack
from loomwright.llm.tokens import tokenizer_path

#: Distinct pre-tokens whose counts one worker remembers; then it starts anew. Longer ones than this are not remembered, so that
#: their number bounds the bytes.
CACHE_WORDS = 400_000
CACHE_WORD_BYTES = 64
#: Nodes that a worker's trie grows to before it starts anew, and characters of a pre-token that it holds.
TRIE_NODES, TRIE_DEPTH = 1_000_000, 64

SPACE_MARK = "▁"


class UnigramTrie:
    """Counts of the pieces on the best path (greatest sum of log-probabilities) through pre-tokens.

    A node of the trie is a prefix of the pre-tokens met so far and holds the forward score of the best path through
    it and that path's number of pieces; at a pre-token's last node that is its terminal count. A prefix is scored
    once, whichever batch it comes in. A character that is no piece is written as its UTF-8 bytes, ``byte_score``
    each. Of equally good paths, the one whose last piece is longest counts, and so on from the end.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None, nodes: int = TRIE_NODES, depth: int = TRIE_DEPTH):
        self.byte_score = min(pieces.values(), default=0.0) - 10 if byte_score is None else byte_score
        self.pieces, self.nodes, self.depth = pieces, nodes, depth
        #: Every ending of a piece, with the score if it is one itself: the search for pieces that end at a place stops
        #: at the first ending that no piece has.
        self.endings: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))} | pieces
        self.visited = 0
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.pieces_to = [0.0], [0]

    def count(self, word: str) -> int:
        """The terminal count of a pre-token; prefixes that the trie lacks are scored and, up to its depth, added."""
        if len(self.best) > self.nodes:
            self._clear()
        child, best, pieces_to = self.child, self.best, self.pieces_to
        node, known = 0, 0
        path_best, path_count = [0.0], [0]
        for c in word:
            nxt = child.get(node << 21 | ord(c))
            if nxt is None:
                break
            node, known = nxt, known + 1
            path_best.append(best[node])
            path_count.append(pieces_to[node])
        pieces, endings, depth = self.pieces, self.endings, self.depth
        for i in range(known, len(word)):
            c = word[i]
            top, n = -math.inf, 0
            if c not in pieces:
                size = len(c.encode("utf-8", "replace"))
                top, n = path_best[i] + size * self.byte_score, path_count[i] + size
            start, got = i, endings.get(c, False)
            while got is not False:
                if got is not None and path_best[start] + got >= top:
                    top, n = path_best[start] + got, path_count[start] + 1
                start -= 1
                if start < 0:
                    break
                got = endings.get(word[start : i + 1], False)
            path_best.append(top)
            path_count.append(n)
            if i < depth:
                child[node << 21 | ord(c)] = node = len(best)
                best.append(top)
                pieces_to.append(n)
        self.visited += len(word) - known
        return path_count[-1]

    def counts(self, words: list[str]) -> dict[str, int]:
        return {w: self.count(w) for w in dict.fromkeys(words)}


def load_pieces(path: str, scores: str = "zipf") -> dict[str, float]:
    """The pieces of a sentencepiece file with log-probabilities.

    ``scores="file"`` takes the file's own, as a unigram model has them. ``scores="zipf"`` is for a merge vocabulary,
    whose scores are only ranks: probabilities 1 / (rank + 1), normalised.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    found = {sp.id_to_piece(i): sp.get_score(i) for i in own}
    if scores == "file":
        return found
    if scores != "zipf":
        raise ValueError(f"scores must be 'zipf' or 'file', not {scores!r}")
    total = sum(1 / (r + 1) for r in range(len(found)))
    ranked = sorted(found, key=lambda p: (-found[p], p))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(ranked)}


class _Counter:
    def __init__(self, path: str, scores: str):
        self.trie, self.cache = UnigramTrie(load_pieces(path, scores)), {}

    def of(self, texts: list[bytes]) -> list[tuple[int, int]]:
        cache, count, out = self.cache, self.trie.count, []
        for t in texts:
            words = t.split()
            got = list(map(cache.get, words))
            if None in got:
                for i, n in enumerate(got):
                    if n is None:
                        w = words[i]
                        n = cache.get(w)
                        if n is None:
                            n = count(SPACE_MARK + w.decode("utf-8", "replace"))
                            if len(w) <= CACHE_WORD_BYTES:
                                cache[w] = n
                        got[i] = n
                if len(cache) > CACHE_WORDS:
                    cache.clear()
            out.append((len(words), sum(got)))
        return out


@lru_cache(2)
def _counter(path: str, scores: str) -> _Counter:
    return _Counter(path, scores)


def count_tokens(docs: DataFrame, model: str | None = None, text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """The input's columns with n_pretokens and n_tokens (long); such names in the input are replaced.

    Pre-tokens are runs of characters outside space and \\t-\\r, each behind the space mark; n_tokens is the sum of
    their pieces on the best unigram path, with the probabilities that ``scores`` names (see load_pieces). Nulls and
    texts without words count 0, a pre-token can be of any length, repeated rows are counted each, an empty table
    gives an empty table.

    Every worker inserts the distinct pre-tokens that it meets in a trie that it keeps from batch to batch, up to a
    bound, and remembers their terminal counts, so neither words nor texts are shuffled and nothing grows with the corpus.
    """
    prepare(docs.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")

    @F.arrow_udf(T.StructType([T.StructField("p", T.LongType()), T.StructField("n", T.LongType())]))
    def count(text: pa.Array) -> pa.Array:
        rows = _counter(path, scores).of(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["p", "n"])

    rows = pack(docs, t=raw(text_col)).withColumn("c", count("t"))
    return unpack(rows, docs, add={"n_pretokens": F.col("c.p"), "n_tokens": F.col("c.n")})
