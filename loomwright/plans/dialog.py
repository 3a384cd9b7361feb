"""Queries over conversations: rendering, folds, context windows, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.operators import dialog as D
from loomwright.operators import render as R
from loomwright.operators.assemble import group_adjacent
from loomwright.plans.catalog import query
from loomwright.plans.common import joined_sql, table

LENGTH = 64

#: Conversations with their system turns taken off: c (id), texts (in order), sys (system text or null).
_CONV = """
turned AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role <> 'system') AS texts, list(role ORDER BY turn) FILTER (role <> 'system') AS roles,
                  string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS sys FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(texts, []::VARCHAR[]) AS texts, coalesce(roles, []::VARCHAR[]) AS roles, sys FROM turned)"""


def _conversations(spark, sf):
    t = D.turns(table(spark, sf, "conversations"))
    return t.select("conv_id", D.without_system(F.col("turns")).alias("turns"), D.system_text(F.col("turns")).alias("sys"))


def _contents(spark, sf):
    return _conversations(spark, sf).select("conv_id", F.transform("turns", lambda t: t["text"]).alias("contents"))


_SFT_TEXT = "CASE WHEN i % 2 = 1 THEN (CASE WHEN i = 1 THEN '' ELSE chr(10) END) || 'USER: ' || texts[i] || chr(10) || 'ASSISTANT:' ELSE texts[i] END"
_RENDER = f"""
WITH {_CONV},
s AS (SELECT conv_id, list_transform(range(1, len(texts) + 1), lambda i: {_SFT_TEXT}) AS parts FROM c),
ids AS (SELECT conv_id, array_to_string(parts, '') AS text, list_transform(parts, lambda p: {A.word_ids_sql('p')}) AS ids FROM s),
k AS (SELECT conv_id, text, [1] || flatten(ids) || [2] AS input,
             [-100] || flatten(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i % 2 = 0 THEN ids[i] ELSE list_transform(ids[i], lambda x: -100) END)) || [2] AS lab FROM ids)
"""
_PAD = f"list_transform(range(1, {LENGTH} + 1), lambda i: CASE WHEN i <= len(input) THEN %s[i] ELSE %s END)"


@query(
    "chat_render",
    _RENDER
    + f"SELECT conv_id, md5(text) AS text_md5, {joined_sql(_PAD % ('input', '0'))} AS input_ids, {joined_sql(_PAD % ('lab', '-100'))} AS labels, least(len(input), {LENGTH})::BIGINT AS n_attended, len(input) > {LENGTH} AS truncated FROM k",
)
def chat_render(spark, sf):
    """Fine-tuning dialogues: prompt text, token ids, attention and masked labels of fixed length."""
    rows = _contents(spark, sf)
    out = R.finish(rows, R.conversation(F.col("contents"), sft=True), LENGTH)
    return out.select("conv_id", F.md5("text").alias("text_md5"), A.joined(F.col("input_ids")).alias("input_ids"), A.joined(F.col("labels")).alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_attended"), "truncated")


@query(
    "chat_render_pretrain",
    f"""WITH {_CONV} SELECT conv_id, 'Be brief.' || chr(10) || array_to_string(list_transform(range(1, len(texts) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN (CASE WHEN i = 1 THEN '' ELSE chr(10) END) || 'USER: ' || texts[i] || chr(10) || 'ASSISTANT: ' ELSE texts[i] END), '') AS text FROM c""",
)
def chat_render_pretrain(spark, sf):
    return _contents(spark, sf).select("conv_id", R.text_of(R.conversation(F.col("contents"), system="Be brief.")).alias("text"))


@query(
    "chat_render_single",
    f"""WITH {_CONV} SELECT conv_id, coalesce(nullif(sys, '') || chr(10), '') || array_to_string(list_transform(range(1, len(texts) + 1), lambda i: upper(roles[i]) || ': ' || texts[i] || chr(10)), '') || 'ASSISTANT:' AS prompt FROM c""",
)
def chat_render_single(spark, sf):
    return _conversations(spark, sf).select("conv_id", D.fold_single(F.col("turns"), F.col("sys")).alias("prompt"))


@query(
    "chat_render_llama2",
    f"""WITH {_CONV} SELECT conv_id, coalesce('<<SYS>>' || chr(10) || nullif(sys, '') || chr(10) || '<</SYS>>' || chr(10) || chr(10), '') || array_to_string(list_transform(range(1, len(texts) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN '[INST] ' || texts[i] || ' [/INST]' || chr(10) ELSE texts[i] || chr(10) END), '') AS prompt FROM c""",
)
def chat_render_llama2(spark, sf):
    return _conversations(spark, sf).select("conv_id", D.fold_instructions(F.col("turns"), F.col("sys")).alias("prompt"))


@query("system_prefix", f"WITH {_CONV} SELECT conv_id, sys AS system_text, len(texts)::BIGINT AS n_turns FROM c")
def system_prefix(spark, sf):
    return _conversations(spark, sf).select("conv_id", F.col("sys").alias("system_text"), F.size("turns").cast("long").alias("n_turns"))


def _context_sql(most: int | None) -> str:
    frame = "UNBOUNDED PRECEDING" if most is None else f"{most} PRECEDING"
    return f"""SELECT conv_id, turn, coalesce(md5(array_to_string(list(role || ': ' || text) OVER w, chr(10))), md5('')) AS context_md5, coalesce(len(list(text) OVER w), 0)::BIGINT AS n_context
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {frame} AND 1 PRECEDING)"""


def _context(spark, sf, most):
    said = F.array_join(F.transform("context", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return D.with_context(table(spark, sf, "conversations"), most).select("conv_id", "turn", F.md5(said).alias("context_md5"), F.size("context").cast("long").alias("n_context"))


@query("dialog_context", _context_sql(None))
def dialog_context(spark, sf):
    """Each turn with all before it."""
    return _context(spark, sf, None)


@query("dialog_recent3", _context_sql(3))
def dialog_recent3(spark, sf):
    return _context(spark, sf, 3)


@query("dialog_last_turn", "SELECT conv_id, max(turn)::BIGINT AS last_turn, arg_max(text, turn) AS last_text, count(*) - 1 AS n_before FROM conversations GROUP BY conv_id")
def dialog_last_turn(spark, sf):
    t = D.turns(table(spark, sf, "conversations"))
    before, last = D.last_turn(F.col("turns"))
    return t.select("conv_id", last["turn"].cast("long").alias("last_turn"), last["text"].alias("last_text"), F.size(before).cast("long").alias("n_before"))


_IDS = f"WITH d AS (SELECT conv_id, turn, {A.word_ids_sql('text')} AS ids FROM conversations)"


@query("pad_truncate", f"{_IDS} SELECT conv_id, turn, {joined_sql('list_transform(range(1, 17), lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE 0 END)')} AS ids FROM d")
def pad_truncate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", A.joined(A.pad_truncate(A.word_ids(F.col("text")), 16)).alias("ids"))


@query("attention_mask", f"{_IDS} SELECT conv_id, turn, {joined_sql('list_transform(range(1, 17), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END)')} AS mask FROM d")
def attention_mask(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", A.joined(A.attention(F.size(A.word_ids(F.col("text"))), 16)).alias("mask"))


@query("label_mask", f"{_IDS} SELECT conv_id, turn, {joined_sql('list_transform(range(1, 17), lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE -100 END)')} AS labels FROM d")
def label_mask(spark, sf):
    """Labels are the padded ids with -100 for the pad's id."""
    return table(spark, sf, "conversations").select("conv_id", "turn", A.joined(A.mask_id(A.pad_truncate(A.word_ids(F.col("text")), 16))).alias("labels"))


@query("mask_left", f"{_IDS} SELECT conv_id, turn, {joined_sql('list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= turn + 1 THEN -100 ELSE ids[i] END)')} AS labels FROM d")
def mask_left(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", A.joined(A.mask_prefix(A.word_ids(F.col("text")), F.col("turn") + 1)).alias("labels"))


@query("pad_to_longest", f"{_IDS}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS n FROM d) SELECT conv_id, turn, {joined_sql('list_transform(range(1, n + 1), lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE 0 END)')} AS ids FROM m")
def pad_to_longest(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "conversations").select("conv_id", "turn", A.word_ids(F.col("text")).alias("ids"))
    return d.select("conv_id", "turn", A.joined(A.pad_to_longest(F.col("ids"), F.max(F.size("ids")).over(Window.partitionBy("conv_id")))).alias("ids"))


@query(
    "group_adjacent",
    """WITH n AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS group_no FROM n""",
)
def adjacent(spark, sf):
    return group_adjacent(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "group_no")


@query(
    "dialog_speakers",
    f"""WITH {_CONV} SELECT conv_id, array_to_string(list_transform(range(0, len(texts) + 1), lambda i: CASE WHEN i = 0 THEN 'cap' WHEN i % 2 = 1 THEN 'speaker1' ELSE 'speaker2' END), ' ') AS types,
    array_to_string(list_transform(range(0, len(texts) + 1), lambda i: CASE WHEN i = len(texts) THEN (CASE WHEN i = 0 THEN 'conversation ' || conv_id ELSE texts[i] END) ELSE '-1' END), '|') AS labels FROM c""",
)
def dialog_speakers(spark, sf):
    pieces, types, labels = D.speaker_types(F.col("turns"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    return _conversations(spark, sf).select("conv_id", F.array_join(types, " ").alias("types"), F.array_join(labels, "|").alias("labels"))


@query(
    "qa_split",
    f"""WITH {_CONV},
    m AS (SELECT conv_id, array_to_string(list_transform(list_filter(range(1, len(texts) + 1), lambda i: roles[i] = 'user'), lambda i: 'Question: ' || texts[i]), ' ') AS qs,
                 array_to_string(list_transform(list_filter(range(1, len(texts) + 1), lambda i: roles[i] = 'assistant'), lambda i: 'Answer: ' || texts[i]), ' ') AS ans FROM c),
    p AS (SELECT conv_id, string_split(qs, 'Question: ')[2:] AS q, string_split(ans, 'Answer: ')[2:] AS a FROM m),
    n AS (SELECT *, least(len(q), len(a)) AS n FROM p)
    SELECT conv_id, n::BIGINT AS n_pairs, md5(array_to_string(list_transform(range(1, n + 1), lambda i: trim(q[i], ' ') || '|' || trim(a[i], ' ')), chr(10))) AS pairs_md5 FROM n""",
)
def qa_split(spark, sf):
    """Marked questions and answers, zipped to the shorter side."""
    t = _conversations(spark, sf)
    of = lambda role, mark: F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == role), lambda x: F.concat(F.lit(mark), x["text"])), " ")
    pairs = R.marked_pairs(of("user", R.QUESTION), of("assistant", R.ANSWER))
    return t.select("conv_id", pairs.alias("p")).select("conv_id", F.size("p").cast("long").alias("n_pairs"), F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["q"], F.lit("|"), x["a"])), "\n")).alias("pairs_md5"))


_ITEMS = """WITH i AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS images FROM conversations)"""


def _items(spark, sf):
    """Conversations as interleaved documents: user turns stand for images."""
    t = D.turns(table(spark, sf, "conversations"))
    item = lambda x: F.struct(F.when(x["role"] == "user", F.array(x["turn"].cast("int"))).alias("image_ids"), F.when(x["role"] != "user", x["text"]).alias("text"))
    return t.select("conv_id", F.transform("turns", item).alias("items"))


def _shown(items):
    return F.array_join(F.transform(items, lambda x: F.coalesce(F.concat(F.lit("#"), x["image_ids"][0].cast("string")), F.md5(x["text"]))), " ")


@query(
    "interleave_cap",
    _ITEMS
    + """, s AS (SELECT conv_id, min(CASE WHEN images >= 2 THEN CASE WHEN role = 'user' AND images > 2 THEN k - 1 WHEN role <> 'user' THEN k END END) AS stop FROM i GROUP BY conv_id)
    SELECT i.conv_id, string_agg(CASE WHEN role = 'user' THEN '#' || turn ELSE md5(text) END, ' ' ORDER BY k) AS items FROM i JOIN s USING (conv_id) WHERE stop IS NULL OR k <= stop GROUP BY i.conv_id""",
)
def interleave_cap(spark, sf):
    return _items(spark, sf).select("conv_id", _shown(R.cap_images(F.col("items"), 2)).alias("items"))


#: In a run of images those at its 1st, 3rd, ... place change places with the item behind them.
_SWAPPED = """, r AS (SELECT *, role = 'user' AS image, k - row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY k) AS run FROM i),
o AS (SELECT *, image AND (row_number() OVER (PARTITION BY conv_id, image, run ORDER BY k)) % 2 = 1 AS moves, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
p AS (SELECT *, CASE WHEN moves AND k < n THEN k + 1 WHEN lag(moves) OVER (PARTITION BY conv_id ORDER BY k) THEN k - 1 ELSE k END AS place FROM o)"""


@query("interleave_swap", _ITEMS + _SWAPPED + " SELECT conv_id, string_agg(CASE WHEN image THEN '#' || turn ELSE md5(text) END, ' ' ORDER BY place) AS items FROM p GROUP BY conv_id")
def interleave_swap(spark, sf):
    """Images change places with the items behind them, pair by pair."""
    return _items(spark, sf).select("conv_id", _shown(R.swap_images(F.col("items"))).alias("items"))


@query(
    "leaderboard_export",
    "SELECT conv_id, '{\"' || conv_id || '\":{\"direct_answer\":\"' || arg_max(role, turn) || '\",\"multiple_choice\":\"\"}}' AS line, '{\"questionId\":\"' || conv_id || '\",\"prediction\":\"' || arg_max(role, turn) || '\"}' AS item FROM conversations GROUP BY conv_id",
)
def leaderboard_export(spark, sf):
    from loomwright.sources.sinks import leaderboard_item, leaderboard_line

    last = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("answer"))
    return last.select("conv_id", leaderboard_line(F.col("conv_id"), F.col("answer")).alias("line"), leaderboard_item(F.col("conv_id"), F.col("answer")).alias("item"))
