"""A model in the loop: loaded once for each task, called with Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def encode_batches(df: DataFrame, load: Callable[[], Any], encode: Callable[[Any, pa.RecordBatch], pa.RecordBatch], schema: str, batch_rows: int = 512) -> DataFrame:
    """``encode(load(), batch)`` over batches of at most ``batch_rows`` rows, as rows of ``schema``; an empty partition loads
    nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for at in range(0, b.num_rows, batch_rows):
                model = load() if model is None else model
                yield encode(model, b.slice(at, batch_rows))

    return df.mapInArrow(run, schema)
