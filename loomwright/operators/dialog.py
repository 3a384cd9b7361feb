"""Dialogues as long tables (conversation, turn, role, text): folds to prompts, context windows, response parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import IMAGE_CODES, IMAGE_ID_SHIFT, IMAGE_IDS
from loomwright.functions.vectors import bind


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns array of struct(turn, role, text) in order): one row for each conversation."""
    t = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return df.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(t)).alias("turns"))


def without_system(ts: Column) -> Column:
    return F.filter(ts, lambda t: t["role"] != "system")


def system_text(ts: Column) -> Column:
    """The system turns' texts, one line each, or null."""
    said = F.filter(ts, lambda t: t["role"] == "system")
    return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda t: t["text"]), "\n"))


def fold_single(ts: Column, system: Column | None = None, sep: str = "\n", answerer: str = "ASSISTANT") -> Column:
    """"role: text" lines behind the system text, then the answerer's role."""
    head = F.lit("") if system is None else F.coalesce(F.concat(F.nullif(system, F.lit("")), F.lit(sep)), F.lit(""))
    return F.concat(head, F.array_join(F.transform(ts, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"], F.lit(sep))), ""), F.lit(answerer + ":"))


def fold_instructions(ts: Column, system: Column | None = None, sep: str = "\n") -> Column:
    """Even turns between [INST] and [/INST], odd ones plain, the system text in its own marks."""
    head = F.lit("") if system is None else F.coalesce(F.concat(F.lit("<<SYS>>\n"), F.nullif(system, F.lit("")), F.lit("\n<</SYS>>\n\n")), F.lit(""))
    body = F.transform(ts, lambda t, i: F.when(i % 2 == 0, F.concat(F.lit("[INST] "), t["text"], F.lit(" [/INST]" + sep))).otherwise(F.concat(t["text"], F.lit(sep))))
    return F.concat(head, F.array_join(body, ""))


def with_context(df: DataFrame, most: int | None = None) -> DataFrame:
    """Each turn with all turns before it, or the last ``most`` of them."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    return df.withColumn("context", F.collect_list(F.struct("turn", "role", "text")).over(w))


def last_turn(ts: Column) -> tuple[Column, Column]:
    """(the turns before, the last one)."""
    return F.slice(ts, 1, F.size(ts) - 1), F.element_at(ts, -1)


def speaker_types(ts: Column, caption: Column, answer_ignore: int = -1) -> tuple[Column, Column, Column]:
    """(pieces, types, labels) of a generated dialogue: the caption, then turns of alternating speakers, each ended; only
    the last answer is a label, the rest ``answer_ignore``."""
    pieces = F.concat(F.array(caption), F.transform(ts, lambda t: t["text"]))
    types = F.transform(pieces, lambda p, i: F.when(i == 0, "cap").when(i % 2 == 1, "speaker1").otherwise("speaker2"))
    labels = F.transform(pieces, lambda p, i: F.when(i == F.size(pieces) - 1, p).otherwise(F.lit(str(answer_ignore))))
    return pieces, types, labels


def assemble_request(text: Column, images: Column, force_image: bool = False, flag: str = "<image>") -> Column:
    """The text with the k-th flag replaced by the k-th image's tokens; null unless there is an image for each flag."""
    parts = F.split(text, r"\Q" + flag + r"\E", -1)
    pairs = F.zip_with(parts, images, lambda p, i: F.concat(p, F.coalesce(i, F.lit(""))))
    made = F.concat(F.array_join(pairs, ""), F.lit("<img>" if force_image else ""))
    return F.when(F.size(parts) == F.size(images) + 1, made)


def parse_response(ids: Column, boi: int, eoi: int) -> Column:
    """struct(spans, text_ids, errors): the k-th begin of an image goes with the k-th end. A span is valid if it has 32
    ids that are image codes once shifted; span ids are cut from the text either way."""
    at = lambda x: F.filter(F.transform(ids, lambda v, i: F.when(v == x, i)), lambda i: i.isNotNull())
    # what every id is compared with is worked out once, not once for each id
    return bind(F.struct(at(boi).alias("b"), at(eoi).alias("e")), lambda s: bind(_pairs(s["b"], s["e"]), lambda pairs: _parsed(ids, s["b"], s["e"], pairs)))


def _pairs(b: Column, e: Column) -> Column:
    n = F.least(F.size(b), F.size(e))
    return F.arrays_zip(F.slice(b, 1, n).alias("b"), F.slice(e, 1, n).alias("e"))


def _parsed(ids: Column, b: Column, e: Column, pairs: Column) -> Column:
    inside = lambda p: F.transform(F.slice(ids, p["b"] + 2, F.greatest(p["e"] - p["b"] - 1, F.lit(0))), lambda v: v - IMAGE_ID_SHIFT)

    def judge(p):
        def one(codes):
            error = F.when(F.size(codes) != IMAGE_IDS, F.concat(F.lit("length "), F.size(codes).cast("string"))).when(F.exists(codes, lambda c: (c < 0) | (c >= IMAGE_CODES)), F.lit("code out of range"))
            return F.struct(codes.alias("codes"), error.alias("error"))

        return bind(inside(p), one)

    kept = F.filter(F.transform(ids, lambda v, i: F.when(~F.exists(pairs, lambda p: (i > p["b"]) & (i < p["e"])), v)), lambda v: v.isNotNull())
    uneven = F.when(F.size(b) != F.size(e), F.array(F.concat(F.lit("begins "), F.size(b).cast("string"), F.lit(", ends "), F.size(e).cast("string")))).otherwise(F.array().cast("array<string>"))
    return bind(F.transform(pairs, judge), lambda spans: F.struct(spans.alias("spans"), kept.alias("text_ids"), F.concat(uneven, F.filter(F.transform(spans, lambda s: s["error"]), lambda x: x.isNotNull())).alias("errors")))
