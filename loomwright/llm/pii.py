"""Personal data by Column expressions alone: regular expressions propose spans, checksums confirm them, words nearby adjust the
score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import named, pack, unpack

#: Code points before a proposal, and behind it, in which context words count (up to the next proposal of that kind).
BEFORE, BEHIND = 40, 20
#: What a context word adds to a score.
CONTEXT = 0.2
#: Code points of the pieces that a text is cut into before stretches of it are taken.
_PIECE = 4096

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double,confirmed:boolean>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- validators -------------------------------------------------------------------------------------------------------


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, each second digit doubled, its digits added."""
    at = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.cast("int"))
    worth = F.transform(at, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder by 97 of an account number with its first four characters moved to the end, letters as 10 to 35."""
    turned = F.filter(F.split(F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(turned, F.lit(0), step)


def _ip(v: Column) -> Column:
    return F.forall(F.split(v, "[.]"), lambda p: p.cast("double") <= 255)


def _card(v: Column) -> Column:
    d = digits(v)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def _phone(v: Column) -> Column:
    return F.length(digits(v)).between(10, 15)


def _iban(v: Column) -> Column:
    code = F.replace(v, F.lit(" "), F.lit(""))
    return F.when(F.length(code).between(15, 34), mod97(code) == 1).otherwise(False)


def _ssn(v: Column) -> Column:
    return ~F.rlike(v, F.lit("^(?:000|666|9)|-00-|-0000$"))


def _yes(v: Column) -> Column:
    return F.lit(True)


# --- kinds ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Kind:
    """What proposes spans of a kind (``pattern``; ``hint`` is part of each of its matches and found faster), what confirms
    them, and how they score. ``plain`` is the pattern without the marks that keep the search in proportion to the text."""

    name: str
    plain: str
    pattern: str
    hint: str
    check: Callable[[Column], Column]
    score: float
    checksum: bool = False
    words: str = ""
    least: float = 0.0
    alone: bool = False  # no letter or digit may stand next to it


# A match begins where its first run of characters does, or where the match before it ended (\G). Possessive quantifiers say
# that no shorter run can match instead. Both leave the matches as they are, and a long run is read once.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", _yes, 0.9, words="mail|email|contact|write|correo|courriel"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip, 0.6, words="ip|host|server|address|addr|from"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", _card, 0.5, True, "card|visa|mastercard|credit|debit|amex|tarjeta|karte|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _phone, 0.6, words="tel|telephone|phone|call|mobile|fax|cell|telefon|movil"),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)", "[A-Z][A-Z][0-9][0-9]", _iban, 0.5, True, "iban|account|bank|konto|cuenta|compte", 0.8, True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"-[0-9]{2}-", _ssn, 0.5, words="ssn|social|security|taxpayer", least=0.7, alone=True),
    Kind("tel", r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}", r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{4}", _yes, 0.5, words="tel|telephone|phone|call|mobile|fax|cell|telefon|movil", least=0.7, alone=True),
)
BASE = tuple(k.name for k in KINDS[:4])
#: What a checksum adds to a score.
CHECKSUM = 0.4


def _score(kind: Kind, before: Column, value: Column, behind: Column) -> Column:
    """The score of a proposal, null where it is dropped."""
    score = F.lit(kind.score + CHECKSUM * kind.checksum)
    if kind.words:
        near = F.translate(F.concat(F.right(before, F.lit(BEFORE)), F.lit("\n"), F.left(behind, F.lit(BEHIND))), _UPPER, _LOWER)
        score = score + F.when(F.rlike(near, F.lit(f"(?:^|[^a-z0-9])(?:{kind.words})(?:[^a-z0-9]|$)")), CONTEXT).otherwise(0.0)
    ok = kind.check(value)
    if kind.alone:
        ok = ok & ~F.rlike(F.right(before, F.lit(1)), F.lit("[A-Za-z0-9]")) & ~F.rlike(F.left(behind, F.lit(1)), F.lit("[A-Za-z0-9]"))
    return F.when(ok, F.when(score >= kind.least, F.least(score, F.lit(1.0)))).cast("double")


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an array under an associative ``op``, in as many passes as its size has binary digits. ``values`` is
    a plain column, as lambdas evaluate anything else once for each element."""
    n = F.size(values)
    widths = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(widths, values, lambda acc, w: F.transform(acc, lambda v, i: F.when(i >= w, op(v, F.get(acc, i - w))).otherwise(v)))


def with_spans(rows: DataFrame, text: str, into: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``rows`` with ``into``, all spans of a text column (not null) by start and kind. A span of a kind behind the four base ones
    goes where it lies inside a base span.

    Places are the lengths of what a pattern leaves between its matches, and of those. Each kind is a projection for the
    matches and one for their spans, so that each expression is searched once and one kind's matches are held at a time.
    """
    t, none = F.col(text), F.array().cast(f"array<{SPAN}>")
    for rank, kind in enumerate(kinds):
        cut = F.struct(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(t, kind.pattern, -1).alias("between"))
        rows = rows.withColumn("_cut", F.when(F.rlike(t, F.lit(kind.hint)), cut))
        found, between = F.col("_cut.found"), F.col("_cut.between")
        zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("before"), found.alias("value"), F.slice(between, F.lit(2), F.size(found)).alias("behind"))
        rows = rows.withColumn("_scored", F.when(F.col("_cut").isNotNull(), _scored(zipped, kind))).drop("_cut")
        rows = rows.withColumn("_sizes", F.transform("_scored", lambda x: (x["gap"] + x["size"]).cast("bigint")))
        rows = rows.withColumn("_ends", running(F.col("_sizes"), lambda a, b: a + b)).drop("_sizes")
        placed = F.transform("_scored", _span(rank, kind))
        rows = rows.withColumn(f"_spans{rank}", F.coalesce(F.filter(placed, lambda x: x["score"].isNotNull()), none)).drop("_scored", "_ends")
    rows = rows.withColumn(into, F.array_sort(F.concat(*[f"_spans{i}" for i in range(len(kinds))]))).drop(*[f"_spans{i}" for i in range(len(kinds))])
    more = F.exists(into, lambda x: x["rank"] >= len(BASE))
    rows = rows.withColumn("_base_ends", F.when(more, F.transform(into, lambda x: F.when(x["rank"] < len(BASE), x["end"]).otherwise(F.lit(-1).cast("bigint")))))
    rows = rows.withColumn("_reach", running(F.col("_base_ends"), F.greatest))
    outside = F.filter(into, lambda x, i: (x["rank"] < len(BASE)) | (x["end"] > F.get("_reach", i)))
    return rows.withColumn(into, F.when(F.col("_reach").isNull(), F.col(into)).otherwise(outside)).drop("_base_ends", "_reach")


def _scored(zipped: Column, kind: Kind) -> Column:
    """(gap, size, value, score) of what a kind proposes (before, value, behind)."""
    return F.transform(zipped, lambda p: F.struct(F.length(p["before"]).alias("gap"), F.length(p["value"]).alias("size"), p["value"].alias("value"), _score(kind, p["before"], p["value"], p["behind"]).alias("score")))


def _span(rank: int, kind: Kind) -> Callable[[Column, Column], Column]:
    def span(x: Column, i: Column) -> Column:
        end = F.get("_ends", i)
        return F.struct(end - x["size"], F.lit(rank), end, F.lit(kind.name), x["value"], x["score"], F.lit(kind.checksum)).cast(SPAN)

    return span


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The input's columns with ``spans``, an array of (start, rank, end, kind, value, score, confirmed) by start and kind; a
    column of that name in the input is replaced. Places are code points, the end exclusive.

    Base kinds (email, ip, card, phone) are found wherever their pattern and check say so, leftmost first and without
    overlaps within a kind; a proposal that fails its check is dropped without another try. iban (mod-97), ssn and tel
    come on top, where their score reaches what the kind asks for: ssn and tel need a context word. Kinds may overlap each
    other, but for added spans inside a base one. A null text is empty; repeated rows are searched each; an empty table
    gives an empty table. Everything is a projection: nothing is shuffled, and the work grows with the text.
    """
    rows = pack(docs, t=F.coalesce(named(text_col), F.lit("")))
    return unpack(with_spans(rows, "t", "found", kinds), docs, add={"spans": F.col("found")})


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """find_pii() with each span of ``text_col`` replaced by its kind in brackets; where spans overlap, the first stands for
    both. A null text stays null."""
    text = F.col("t")
    rows = with_spans(pack(docs, t=named(text_col), full=F.coalesce(named(text_col), F.lit(""))), "full", "found", kinds)
    rows = rows.withColumn("ends", F.transform("found", lambda x: x["end"]))
    rows = rows.withColumn("reach", running(F.col("ends"), F.greatest))
    rows = rows.withColumn("apart", F.filter("found", lambda x, i: (i == 0) | (x["start"] >= F.get("reach", i - 1))))
    rows = rows.withColumn("pieces", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("apart", lambda x: x["end"]))
    cut = F.transform(F.arrays_zip(F.slice(ends, 1, F.size("apart")).alias("at"), F.col("apart").alias("x")), lambda p: F.concat(_stretch(F.col("pieces"), p["at"], p["x"]["start"]), F.lit("["), p["x"]["kind"], F.lit("]")))
    tail = _stretch(F.col("pieces"), F.element_at("apart", -1)["end"], F.length(text).cast("bigint"))
    made = F.when(F.size("apart") > 0, F.concat(F.array_join(cut, ""), tail)).otherwise(text)
    return unpack(rows, docs, replace={text_col: made}, add={"spans": F.col("found")})


def _stretch(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text in pieces of equal length: no more than two pieces are cut."""
    i, j = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    of = lambda k, at, n: F.coalesce(F.substring(F.get(pieces, k), at.cast("int"), n.cast("int")), F.lit(""))
    apart = F.concat(of(i, start % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), of(j, F.lit(1), end % _PIECE))
    return F.when(i == j, of(i, start % _PIECE + 1, end - start)).otherwise(apart)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
