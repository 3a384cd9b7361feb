import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomwright.llm.pii import BASE, KINDS, find_pii, redact


def luhn(d):
    worth = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
    return sum(worth) % 10 == 0


def iban(m):
    c = m.replace(" ", "")
    return 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


CHECKS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
    "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    "iban": iban,
    "ssn": lambda m: not re.search("^(000|666|9)|-00-|-0000$", m),
    "tel": lambda m: True,
}


def brute(text):
    """Python's expressions as the contract has them, then checks and context in loops."""
    out, text = [], text or ""
    for rank, k in enumerate(KINDS):
        found = list(re.finditer(k.plain, text))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()][-40:]
            behind = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None][:20]
            near = re.sub("[A-Z]", lambda x: x[0].lower(), before + "\n" + behind)
            score = k.score + 0.4 * k.checksum + 0.2 * bool(k.words and re.search(f"(?:^|[^a-z0-9])(?:{k.words})(?:[^a-z0-9]|$)", near))
            if CHECKS[k.name](m[0]) and score >= k.least and not (k.alone and re.search("[A-Za-z0-9]", before[-1:] + behind[:1])):
                out.append((m.start(), rank, m.end(), k.name))
    base = [s for s in out if s[1] < 4]
    return sorted(s for s in out if s[1] < 4 or not any(b[0] <= s[0] and s[2] <= b[2] for b in base))


def spans(df):
    return {r.id: [(s.start, s.rank, s.end, s.kind) for s in r.spans] for r in find_pii(df).collect()}


GOOD = [
    "write to a.b-c%d+e@mail.example.co.uk, or x@y.z!", "a@b.co_x@d.ef a@b a@b.c.d@e.f", "10.0.0.255 1.2.3.256 1.2.3.4.5 001.002.003.004", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 49927398716",
    "call +1 (743) 555-3824 or +49.30.123456-7 +1 2", "iban DE89 3704 0044 0532 0130 00 IBAN GB82WEST12345698765432 DE88 3704 0044 0532 0130 00", "my ssn is 123-45-6789, not 123-45-6789", "SSN 000-12-3456 ssn 123-45-67890",
    "phone: (743) 555-3824 or 743-555-3824", "the number 743-555-3824 of a part", "tel +1 (743) 555-3824", "é 🂡 à@b.c x@y.de 4111111111111111", "", "  ", "@@@@", "1.1.1.1.1.1.1.1", "+1+1 555 555 5555+1 555 555 5555", "\u0001 a@b.cd ￾",
]


def test_cases_against_loops(spark):
    rows = list(enumerate(GOOD)) + [(100, None)]
    got = spans(spark.createDataFrame(rows, "id int, text string"))
    assert got == {i: brute(t) for i, t in rows}
    kinds = lambda i: [s[3] for s in got[i]]
    assert kinds(0) == ["email"] * 2 and kinds(1) == ["email"] * 3 and kinds(5).count("iban") == 2 and kinds(6) == ["ssn"]
    assert kinds(7) == [] and kinds(8) == ["tel"] and kinds(9) == [] and kinds(10) == ["phone"]


def test_random_texts_against_loops(spark):
    r = random.Random(1)
    bits = ["@", ".", "-", " ", "+", "(", ")", "1", "42", "4111111111111111", "a", "b.c", "x@y.zz", "10.0.0.1", "\n", "é", "🂡", "phone", "ssn ", "123-45-6789", "DE89370400440532013000", "_", "%", "555-1234"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(1500)]
    assert spans(spark.createDataFrame(rows, "id int, text string")) == {i: brute(t) for i, t in rows}


def test_many_spans_and_long_runs(spark):
    """Texts without a match and with very many take time in proportion to their length."""
    many = "a@b.cd, " * 40_000
    rows = [(0, many), (1, "x" * 400_000), (2, "1" * 400_000), (3, "a@" + "b" * 400_000), (4, "a@b" + ".c" * 200_000), (5, "+1" + " (" * 200_000), (6, "1." * 200_000), (7, "4 " * 200_000), (8, "AB12 " * 80_000), (9, "555-" * 100_000)]
    began = time.time()
    got = spans(spark.createDataFrame(rows, "id int, text string"))
    assert time.time() - began < 60
    assert got[0] == [(8 * i, 0, 8 * i + 6, "email") for i in range(40_000)]
    assert got[1] == got[2] == got[3] == got[5] == [] and got[4] == [(0, 0, 3 + 400_000, "email")] and len(got[6]) == 50_000


def test_redact_nulls_and_names(spark):
    long = "é🂡" * 3000 + " a@b.cd " + "x" * 9000 + " 10.0.0.1"
    df = spark.createDataFrame([(1, "mail a@b.cd or 4111 1111 1111 1111.", "s"), (2, None, "s"), (3, "clean", "s"), (4, long, "s"), (5, "x" * 8190 + " 10.0.0.1" + "y" * 4096, "s")], "id int, text string, spans string").withColumn("row", F.lit(1)).withColumn("a`b.c", F.lit(2))
    got = {r.id: r for r in redact(df).collect()}
    assert got[1].text == "mail [email] or [card]." and got[2].text is None and got[3].text == "clean" and got[2].spans == []
    assert got[4].text == "é🂡" * 3000 + " [email] " + "x" * 9000 + " [ip]" and got[5].text == "x" * 8190 + " [ip]" + "y" * 4096
    assert set(redact(df).columns) == set(df.columns) and find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [k for k in KINDS if k.name in BASE])
def test_stricter_patterns_match_the_same(spark, kind):
    r = random.Random(kind.name)
    rows = [(i, "".join(r.choice("aZ09@.+-_ ()%1") for _ in range(r.randrange(40)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert df.where(F.regexp_extract_all("t", F.lit(kind.plain), F.lit(0)) != F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = find_pii(spark.createDataFrame([(1, "x")], "id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
