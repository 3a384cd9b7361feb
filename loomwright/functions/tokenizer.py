"""Token ids from any file of the tokenizers library, over Arrow batches; the vocabulary is loaded once in each worker."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tidy(text: str) -> str:
    """References decoded twice, white space runs as one space, trimmed."""
    return re.sub(r"\s+", " ", html.unescape(html.unescape(text))).strip()


def encode(text: Column, path: str, clean: bool = True) -> Column:
    """array<int> of a text's ids as the file's tokenizer gives them, with no special tokens added around; the text of a
    special token inside it is that token. Null stays null. Pass it to the renderers as ``tokenize``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(col: pa.Array) -> pa.Array:
        texts = [x if x is None else tidy(x) if clean else x for x in col.to_pylist()]
        found = iter(_load(path).encode_batch([t for t in texts if t is not None], add_special_tokens=False))
        return pa.array([None if t is None else next(found).ids for t in texts], pa.list_(pa.int32()))

    return ids(text)
