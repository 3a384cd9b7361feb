import hashlib
import random

import pytest

from loomwright.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=2, min_chars=10):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_against_brute_force(spark, min_docs):
    r = random.Random(6)
    pool = ["A shared line of text", " a SHARED line of text\t", "short", "été été ét", "Été été été", "ÉTÉ été ÉTÉ", "\x85 not stripped \x85", "日本語日本語日本語日", "another passage here", "", " ", "x" * 5000]
    rows = [(i, "\n".join(r.choice([*pool, f"own line number {i} {k}"]) for k in range(r.randrange(1, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (5, rows[5][1]), (None, "A shared line of text\nmine"), (-3, "another passage here\r\nA shared line of text")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, k string")
    got = dedup_lines(df, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "k", "n_lines", "n_dropped"]
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got.collect()), key=repr) == brute(rows, min_docs)


def test_empty_table_and_digest(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(df).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
