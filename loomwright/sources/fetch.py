"""Fetching by URL: a getter that is passed in, tries with growing waits, and a report row for every URL."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers after which another try makes no sense.
FINAL = frozenset({200, 204, 301, 400, 401, 403, 404, 410, 451})
REPORT = "status int, tries int, error string, payload binary"


def http_get(url: str, attempt: int, timeout: float = 20.0) -> tuple[int, bytes]:
    """(status, body) by plain HTTP; answers other than success are statuses, not errors."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read()
    except HTTPError as e:
        return e.code, b""


def fetch(rows: DataFrame, key: str, url: str, get: Callable[[str, int], tuple[int, bytes]] = http_get, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """(key, url, status, tries, error, payload) of each row: ``get(url, attempt)`` is called until its status is final, at
    most ``tries`` times, after waits of ``wait``, 2 * wait, 4 * wait ... seconds. A getter that raises has status null and
    its message as the error. Leave out what is done with relational.unfinished(); write the report by chunks of rows
    (a partitioning) to resume."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for k, u in zip(pdf["k"], pdf["u"]):
                status = error = body = None
                n = 0
                while n < tries and (status is None or status not in FINAL):
                    if n:
                        time.sleep(wait * 2 ** (n - 1))
                    n += 1
                    try:
                        status, body = get(u, n)
                        error = None
                    except Exception as e:  # whatever a getter raises is a row of the report
                        status, error = None, f"{type(e).__name__}: {e}"
                out.append((k, u, status, n, error, body if status == 200 else None))
            made = pd.DataFrame(out, columns=["k", "u", "status", "tries", "error", "payload"])
            yield made.astype({"status": "Int32", "tries": "int32"})

    kind = rows.schema[key].dataType.simpleString()
    done = rows.select(F.col(key).alias("k"), F.col(url).alias("u")).mapInPandas(run, f"k {kind}, u string, {REPORT}")
    return done.withColumnsRenamed({"k": key, "u": url})
