"""Queries over documents' texts: cleaning, filters, image tokens, single-turn renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions import text as X
from loomwright.functions.rng import pick_sql as draw_sql
from loomwright.functions.rng import u01, u01_sql
from loomwright.operators import render as R
from loomwright.plans.catalog import query
from loomwright.plans.common import image_ids, image_ids_sql, image_tokens_sql, joined_sql, pick_sql, q, table

_IMAGE = image_tokens_sql(image_ids_sql("doc_id"))


@query(
    "caption_clean",
    r"""WITH c AS (SELECT doc_id, trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]', ' ', 'g'), '\s{2,}', ' ', 'g'), chr(10)), ' ') AS t FROM documents)
    SELECT doc_id, array_to_string(string_split(t, ' ')[1:50], ' ') AS caption FROM c""",
)
def caption_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.caption_clean(F.col("text")).alias("caption"))


@query(
    "question_clean",
    r"""WITH c AS (SELECT doc_id, rtrim(regexp_replace(lower(text), '[.!"()*#:;~]', '', 'g'), ' ') AS t FROM documents) SELECT doc_id, array_to_string(string_split(t, ' ')[1:50], ' ') AS question FROM c""",
)
def question_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.question_clean(F.col("text")).alias("question"))


@query("blank_filter", f"SELECT doc_id, trim(text, {q(X.BLANK_CHARS)}) = '' AS blank, list_transform(string_split(text, ' ')[1:3], lambda w: (trim(w, {q(X.BLANK_CHARS)}) = '')::VARCHAR).array_to_string(' ') AS blank_words FROM documents")
def blank_filter(spark, sf):
    """Whether a whole text is blank, and whether its first words are."""
    first = F.transform(F.slice(F.split("text", " ", -1), 1, 3), lambda w: X.is_blank(w).cast("string"))
    return table(spark, sf, "documents").select("doc_id", X.is_blank(F.col("text")).alias("blank"), F.array_join(first, " ").alias("blank_words"))


_FIRST = "array_to_string(string_split(text, ' ')[1:8], ' ')"


def _first(n=8):
    return X.first_words(F.col("text"), n)


def _punct_sql(t: str) -> str:
    out, comma = t, f"regexp_matches({t}, '[0-9],[0-9]')"
    for p in X.PUNCTUATION:
        out = f"replace({out}, {q(p)}, CASE WHEN {comma} OR contains({t}, {q(p + ' ')}) OR contains({t}, {q(' ' + p)}) THEN '' ELSE ' ' END)"
    return rf"regexp_replace(regexp_replace({out}, '\.([^0-9.])', '\1', 'g'), '\.+([^0-9]|$)', '\1', 'g')"


@query("answer_norm_punct", f"WITH f AS (SELECT doc_id, {_FIRST} AS t FROM documents) SELECT doc_id, {_punct_sql('t')} AS answer FROM f")
def answer_norm_punct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_punctuation(_first()).alias("answer"))


_NUMBERS = "CASE w " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.NUMBER_WORDS.items()) + " ELSE w END"
_FORMS = "CASE w " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.CONTRACTIONS.items()) + " ELSE w END"


@query(
    "answer_norm_digits",
    rf"""WITH f AS (SELECT doc_id, list_filter(string_split_regex(lower({_FIRST}), '\s+'), lambda w: w <> '') AS ws FROM documents),
    g AS (SELECT doc_id, list_filter(list_transform(ws, lambda w: {_NUMBERS}), lambda w: w NOT IN ('a', 'an', 'the')) AS ws FROM f)
    SELECT doc_id, array_to_string(list_transform(ws, lambda w: {_FORMS}), ' ') AS answer FROM g""",
)
def answer_norm_digits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_words(_first()).alias("answer"))


@query("ensure_period", "SELECT doc_id, CASE WHEN ends_with(text, '.') THEN md5(text) ELSE md5(text || '.') END AS with_md5, md5(rtrim(text, '.')) AS without_md5 FROM documents")
def ensure_period(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.ensure_period(F.col("text"))).alias("with_md5"), F.md5(X.strip_periods(F.col("text"))).alias("without_md5"))


@query("image_tokens_format", f"SELECT doc_id, {_IMAGE} AS tokens FROM documents")
def image_tokens_format(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.image_tokens(image_ids(F.col("doc_id"))).alias("tokens"))


@query("image_tokens_parse", f"SELECT doc_id, {joined_sql(image_ids_sql('doc_id'))} AS ids, 32::BIGINT AS n FROM documents")
def image_tokens_parse(spark, sf):
    """Tokens parsed back from text give the ids that made them."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(X.image_tokens(image_ids(F.col("doc_id"))), F.col("text")).alias("t"))
    ids = X.parse_image_tokens(F.col("t"))
    return d.select("doc_id", A.joined(ids).alias("ids"), F.size(ids).cast("long").alias("n"))


@query("image_id_parse", "SELECT page_id, split_part(split_part(trim(list_extract(string_split(url, '/'), -1), '.jpg'), '_', -1), '~~~', 1) AS image_id FROM pages")
def image_id_parse(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.base_name_id(F.col("url")).alias("image_id"))


@query(
    "frame_sample",
    "SELECT doc_id, array_to_string(list_transform(range(0, 4), lambda i: floor((floor(i * n_chars / 4.0) + floor((i + 1) * n_chars / 4.0)) / 2)::BIGINT), ' ') AS frames FROM documents",
)
def frame_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.joined(A.frame_indices(F.col("n_chars"), 4)).alias("frames"))


@query("fixed_slices", f"SELECT doc_id, array_to_string(list_transform(range(0, 3), lambda k: md5({joined_sql('list_slice(' + image_ids_sql('doc_id', 100) + ', k * 32 + 1, k * 32 + 32)')})), ' ') AS slices FROM documents")
def fixed_slices(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(F.transform(A.slices(image_ids(F.col("doc_id"), 100)), lambda s: F.md5(A.joined(s))), " ").alias("slices"))


@query("hash_uniform", f"SELECT doc_id, {u01_sql('doc_id', 'direction')} AS u FROM documents")
def hash_uniform(spark, sf):
    return table(spark, sf, "documents").select("doc_id", u01(F.col("doc_id"), "direction").alias("u"))


_U = u01_sql("doc_id", "direction")


@query("caption_pair_direction", f"SELECT doc_id, {_U} < 0.3 AS image_first FROM documents")
def caption_pair_direction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.image_first(F.col("doc_id"), 0.3).alias("image_first"))


_PAIR = f"(CASE WHEN {_U} < 0.5 THEN {_IMAGE} || text ELSE text || {_IMAGE} END)"


@query(
    "caption_pair_render",
    f"""WITH t AS (SELECT doc_id, text AS caption, {_PAIR} AS text FROM documents), i AS (SELECT *, [1] || {A.word_ids_sql('text')} || [2] AS ids FROM t)
    SELECT doc_id, md5(text) AS text_md5, {joined_sql('list_transform(range(1, 49), lambda k: CASE WHEN k <= len(ids) THEN ids[k] ELSE 0 END)')} AS input_ids,
    {joined_sql('list_transform(range(1, 49), lambda k: CASE WHEN k <= len(ids) THEN ids[k] ELSE -100 END)')} AS labels, len(ids) > 48 AS truncated, trim(caption, {q(X.BLANK_CHARS)}) <> '' AS filter_flag FROM i""",
)
def caption_pair_render(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("caption"))
    out = R.caption_pair(d, image_ids(F.col("doc_id")), F.col("caption"), F.col("doc_id"), 48)
    return out.select("doc_id", F.md5("text").alias("text_md5"), A.joined(F.col("input_ids")).alias("input_ids"), A.joined(F.col("labels")).alias("labels"), "truncated", "filter_flag")


@query("edit_pair_render", f"SELECT doc_id, md5({_IMAGE} || replace(text, {q(R.EDIT_PREFIX)}, '') || {image_tokens_sql(image_ids_sql('doc_id + 1'))}) AS text_md5, (35 + len({A.word_ids_sql('text')}))::BIGINT AS masked FROM documents")
def edit_pair_render(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(R.EDIT_PREFIX), F.col("text")).alias("order"))
    out = R.edit_pair(d, image_ids(F.col("doc_id")), image_ids(F.col("doc_id") + 1), F.col("order"), 100_000 // 100)
    n = F.size(A.word_ids(F.replace("order", F.lit(R.EDIT_PREFIX), F.lit(""))))
    return out.select("doc_id", F.md5("text").alias("text_md5"), (F.lit(35) + n).cast("long").alias("masked"))


def _turn(asked: str, answered: str) -> str:
    return f"'USER: ' || {asked} || chr(10) || 'ASSISTANT:' || {answered}"


_EDIT = draw_sql("doc_id", "edit", len(R.EDIT_RESPONSES))


@query("edit_render", f"SELECT doc_id, md5({_turn(_IMAGE + ' || text', pick_sql(R.EDIT_RESPONSES, _EDIT) + ' || ' + image_tokens_sql(image_ids_sql('doc_id + 1')))}) AS text_md5 FROM documents")
def edit_render(spark, sf):
    s = R.edit_turn(image_ids(F.col("doc_id")), image_ids(F.col("doc_id") + 1), F.col("text"), F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


_SLICE = lambda k: image_tokens_sql(f"list_slice({image_ids_sql('doc_id', 160)}, {32 * k + 1}, {32 * k + 32})")


@query(
    "edit_multi_render",
    f"""SELECT doc_id, md5({_turn(_SLICE(0) + ' || lang', pick_sql(R.EDIT_RESPONSES, _EDIT) + ' || ' + _SLICE(1))} || chr(10) || {_turn('source', pick_sql(R.EDIT_RESPONSES, _EDIT) + ' || ' + _SLICE(2))}
    || chr(10) || {_turn('text', pick_sql(R.EDIT_RESPONSES, _EDIT) + ' || ' + _SLICE(3))}) AS text_md5 FROM documents""",
)
def edit_multi_render(spark, sf):
    s = R.edit_turns(image_ids(F.col("doc_id"), 160), [F.col("lang"), F.col("source"), F.col("text")], F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


_LETTERS = "replace(replace(replace(replace({t}, 'image a', 'the first image'), 'image A', 'the first image'), 'image b', 'the second image'), 'image B', 'the second image')"


@query("difference_replace", f"SELECT doc_id, {_LETTERS.format(t='(' + chr(39) + 'image a and image B, image about ' + chr(39) + ' || lang)')} AS question FROM documents")
def difference_replace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.image_pair_words(F.concat(F.lit("image a and image B, image about "), F.col("lang"))).alias("question"))


@query(
    "difference_render",
    f"""SELECT doc_id, md5('USER: ' || CASE WHEN {u01_sql('doc_id', 'template')} < 0.5 THEN {_SLICE(0)} || 'This is the first image.' || {_SLICE(1)} || 'This is the second image. ' || lang
    ELSE 'This is the first image.' || {_SLICE(0)} || 'This is the second image.' || {_SLICE(1)} || lang END || chr(10) || 'ASSISTANT:' || source || '.') AS text_md5 FROM documents""",
)
def difference_render(spark, sf):
    s = R.difference(image_ids(F.col("doc_id"), 160), F.col("lang"), F.col("source"), F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


_STORY = draw_sql("doc_id", "story", len(R.STORY_PROMPTS))
_TOLD = " || ".join(f"chr(10) || lang || '{i}' || {_SLICE(i)}" for i in (1, 2, 3, 4))
_STEPS = " || ".join(f"(chr(10) || {_turn(f'lang || {chr(39)}{i}{chr(39)} || {chr(39)} Please generate an image.{chr(39)}', f'{chr(39)}Here is an image.{chr(39)} || ' + _SLICE(i))})" for i in (2, 3, 4))


@query(
    "story_render",
    f"""SELECT doc_id, md5({_turn(f"lang || '0' || {_SLICE(0)} || {pick_sql(R.STORY_PROMPTS, _STORY)}", pick_sql(R.STORY_RESPONSES, _STORY) + ' || ' + _TOLD)}) AS told_md5,
    md5({_turn(f"lang || '0' || {_SLICE(0)} || lang || '1' || ' Please generate an image.'", "'Here is an image.' || " + _SLICE(1))} || {_STEPS}) AS steps_md5 FROM documents""",
)
def story_render(spark, sf):
    c = F.array(*[F.concat(F.col("lang"), F.lit(str(i))) for i in range(5)])
    ids = image_ids(F.col("doc_id"), 160)
    made = lambda steps: F.md5(R.text_of(R.story(ids, c, F.col("doc_id"), steps)))
    return table(spark, sf, "documents").select("doc_id", made(False).alias("told_md5"), made(True).alias("steps_md5"))


_GEN = draw_sql("doc_id", "generate", len(R.GENERATE_PROMPTS))


@query(
    "qa_or_generate",
    f"""SELECT doc_id, md5(CASE WHEN {_U} < 0.5 THEN {_turn(_IMAGE + ' || lang', "CASE WHEN ends_with(trim(text, ' '), '.') THEN trim(text, ' ') ELSE trim(text, ' ') || '.' END")}
    ELSE {_turn(pick_sql(R.GENERATE_PROMPTS, _GEN) + " || ' ' || rtrim(trim(text, ' '), '.') || CASE WHEN " + _GEN + " >= 14 THEN '?' ELSE '.' END", pick_sql(R.GENERATE_RESPONSES, _GEN) + ' || ' + _IMAGE)} END) AS text_md5 FROM documents""",
)
def qa_or_generate(spark, sf):
    s = R.question_or_generation(image_ids(F.col("doc_id")), F.col("lang"), F.col("text"), F.col("doc_id"), 0.5)
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


@query("video_caption_render", f"SELECT doc_id, md5({' || '.join(_SLICE(k) for k in range(4))} || text) AS text_md5 FROM documents")
def video_caption_render(spark, sf):
    s = R.video_caption(image_ids(F.col("doc_id"), 160), F.col("text"), 4)
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


@query("video_question_render", f"SELECT doc_id, md5({_turn(' || '.join(_SLICE(k) for k in range(5)) + ' || lang', 'source || ' + chr(39) + '.' + chr(39))}) AS text_md5 FROM documents")
def video_question_render(spark, sf):
    s = R.video_question(image_ids(F.col("doc_id"), 160), F.col("lang"), F.concat(F.col("source"), F.lit(R.NOISY_SUFFIX)))
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


@query("instruction_render", f"SELECT doc_id, md5({_turn(_IMAGE + ' || lang', 'text')}) AS text_md5 FROM documents")
def instruction_render(spark, sf):
    """Blank inputs fall back to the instruction."""
    s = R.instruction_pair(F.col("lang"), F.lit("  "), F.col("text"), X.image_tokens(image_ids(F.col("doc_id"))))
    return table(spark, sf, "documents").select("doc_id", F.md5(R.text_of(s)).alias("text_md5"))


@query("chunked_caption", "SELECT doc_id, md5('<image>' || text || '<|endofchunk|></s>') AS text_md5 FROM documents")
def chunked_caption(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(R.chunked_caption(F.col("text"))).alias("text_md5"))


@query("few_shot_caption", f"SELECT doc_id, md5({image_tokens_sql(image_ids_sql('doc_id + 1'))} || lang || {image_tokens_sql(image_ids_sql('doc_id + 2'))} || source || {_IMAGE} || 'A photo of') AS text_md5 FROM documents")
def few_shot_caption(spark, sf):
    item = lambda k, c: F.struct(image_ids(F.col("doc_id") + k).alias("image_ids"), F.col(c).alias("text"))
    out = R.few_shot_caption(image_ids(F.col("doc_id")), F.array(item(1, "lang"), item(2, "source"), item(3, "text")), 2, "A photo of")
    return table(spark, sf, "documents").select("doc_id", F.md5(out).alias("text_md5"))


@query(
    "ra_render",
    f"""WITH r AS (SELECT doc_id, image_first, md5(string_agg(CASE WHEN image_first THEN img || t ELSE t || img END, '' ORDER BY k)) AS text_md5, sum(2) AS n FROM (
      SELECT doc_id, {_U} < 0.5 AS image_first, unnest([lang, a[1].t, a[2].t]) AS t, unnest([{_IMAGE}, a[1].img, a[2].img]) AS img, unnest([1, 2, 3]) AS k FROM (
        SELECT doc_id, lang, list_sort([{{'h': md5(doc_id || ':' || source), 't': source, 'img': {image_tokens_sql(image_ids_sql('doc_id + 1'))}}}, {{'h': md5(doc_id || ':' || 'x'), 't': 'x', 'img': {image_tokens_sql(image_ids_sql('doc_id + 2'))}}}]) AS a FROM documents)) GROUP BY ALL)
    SELECT doc_id, image_first, text_md5, n::BIGINT AS n_segments FROM r""",
)
def ra_render(spark, sf):
    """A target with its retrieved context in the order of a hash."""
    d = table(spark, sf, "documents")
    item = lambda k, c: F.struct(image_ids(F.col("doc_id") + k).alias("image_ids"), c.alias("text"))
    s = R.retrieval_augmented(item(0, F.col("lang")), F.array(item(1, F.col("source")), item(2, F.lit("x"))), F.col("doc_id"), 0.5, most=3)
    return d.select("doc_id", R.image_first(F.col("doc_id"), 0.5).alias("image_first"), F.md5(R.text_of(s)).alias("text_md5"), F.size(s).cast("long").alias("n_segments"))


@query("response_parse", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'length 31' ELSE 'code out of range' END AS errors, {joined_sql(image_ids_sql('doc_id', 5))} AS first_codes, 3::BIGINT AS n_text FROM documents")
def response_parse(spark, sf):
    """Generated ids with one image span: whole, one id short, or with a code out of range."""
    from loomwright.operators.dialog import parse_response

    d = table(spark, sf, "documents")
    codes = F.transform(image_ids(F.col("doc_id")), lambda x: x + X.IMAGE_ID_SHIFT)
    codes = F.when(F.col("doc_id") % 3 == 1, F.slice(codes, 1, 31)).when(F.col("doc_id") % 3 == 2, F.concat(F.slice(codes, 1, 31), F.array(F.lit(40192)))).otherwise(codes)
    r = d.select("doc_id", parse_response(F.concat(F.array(F.lit(7), F.lit(8)), codes, F.array(F.lit(9))), 8, 9).alias("r"))
    return r.select("doc_id", F.array_join("r.errors", ", ").alias("errors"), A.joined(F.slice(F.col("r.spans")[0]["codes"], 1, 5)).alias("first_codes"), F.size("r.text_ids").cast("long").alias("n_text"))


@query("request_assemble", f"SELECT doc_id, md5(lang || {_IMAGE} || source || '<img>') AS text_md5 FROM documents")
def request_assemble(spark, sf):
    from loomwright.operators.dialog import assemble_request

    text = F.concat(F.col("lang"), F.lit("<image>"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.md5(assemble_request(text, F.array(X.image_tokens(image_ids(F.col("doc_id")))), True)).alias("text_md5"))


@query("bpe_ids")
def bpe_ids(spark, sf):
    """The ids of whole texts by merging each distinct word once; tests/test_bpe compares with the library."""
    from loomwright.functions.bpe import encode_table, vocabulary_path

    out = encode_table(table(spark, sf, "documents").select("doc_id", "text"), vocabulary_path(spark))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5"))
