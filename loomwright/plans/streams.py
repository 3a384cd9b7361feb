"""Queries over mixing, batching and indexing of samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions.rng import u01_sql
from loomwright.operators import assemble as S
from loomwright.operators import curate as C
from loomwright.operators import mixing as M
from loomwright.operators import relational as J
from loomwright.plans.catalog import query
from loomwright.plans.common import q, table

WEIGHTS = {"en": 5.0, "fr": 2.0, "de": 1.0, "es": 0.5}
_RATE = "CASE lang " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " END"
_WAIT = f"(-ln({u01_sql('doc_id', 'race')} + 1e-12) / {_RATE})"


def _docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", *cols)


@query("concat", "SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en' UNION ALL SELECT doc_id, 'label' FROM labels")
def concat(spark, sf):
    """The documents of one language, those of all others, and the labels."""
    d = _docs(spark, sf, "lang")
    return M.concat(d.where("lang = 'en'"), d.where(~F.col("lang").eqNullSafe("en")), table(spark, sf, "labels").select("doc_id", F.lit("label").alias("lang")))


@query("concat_common", "SELECT doc_id, n FROM (SELECT doc_id, n_chars AS n FROM documents UNION ALL SELECT doc_id, toxic AS n FROM labels)")
def concat_common(spark, sf):
    """Only the columns that both sides have."""
    return M.concat_common(_docs(spark, sf, F.col("n_chars").alias("n"), "lang"), table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("long").alias("n"), "quality"))


@query("round_robin", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS round FROM documents")
def round_robin(spark, sf):
    d = _docs(spark, sf, "lang")
    out = M.mix({x: d.where(F.col("lang") == x) for x in WEIGHTS}, "mux_longest", order="doc_id")
    return out.select("doc_id", "lang", "round")


@query("weighted_mix", f"SELECT doc_id, lang, row_number() OVER (ORDER BY a, lang, doc_id) AS place FROM (SELECT doc_id, lang, sum({_WAIT}) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS a FROM documents)")
def weighted_mix(spark, sf):
    """The race of streams and the order it gives."""
    out = M.race(_docs(spark, sf, "lang"), "lang", "doc_id", WEIGHTS)
    return out.select("doc_id", "lang", F.row_number().over(Window.orderBy("arrival", "lang", "doc_id")).cast("long").alias("place"))


@query("cycle", "SELECT doc_id, epoch::INTEGER AS epoch FROM documents, range(0, 3) t(epoch)")
def cycle(spark, sf):
    return M.cycle(_docs(spark, sf), 3)


@query("shuffle", "SELECT doc_id, md5(doc_id::VARCHAR || ':49') AS shuffle_key FROM documents")
def shuffle(spark, sf):
    """The key of seed 42 in epoch 7."""
    return _docs(spark, sf).withColumn("shuffle_key", M.shuffle_key(F.col("doc_id"), 42, 7))


@query("shard", "SELECT doc_id FROM documents WHERE doc_id % 8 = 3")
def shard(spark, sf):
    return M.shard(_docs(spark, sf), "doc_id", 8, 3)


@query("split_workers", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND (doc_id // 4) % 3 = 2")
def split_workers(spark, sf):
    return M.split_by_node_and_worker(_docs(spark, sf), "doc_id", 4, 1, 3, 2, shards=20)


@query("rank_slice", "SELECT doc_id, (doc_id // ((SELECT count(*) FROM documents) // 8 + 1))::BIGINT AS rank FROM documents")
def rank_slice(spark, sf):
    d = _docs(spark, sf)
    return d.withColumn("rank", M.rank_slice(F.col("doc_id"), d.count(), 8).cast("long"))


@query("batch", "SELECT (doc_id // 64)::BIGINT AS batch, count(*) AS n FROM documents GROUP BY 1")
def batch(spark, sf):
    return M.batch(_docs(spark, sf), F.col("doc_id"), 64).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("batch_drop_last", "SELECT (doc_id // 64)::BIGINT AS batch, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) = 64")
def batch_drop_last(spark, sf):
    return M.batch(_docs(spark, sf), F.col("doc_id"), 64, True).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("collate", "SELECT (doc_id // 64)::BIGINT AS batch, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS ids, string_agg(lang, ' ' ORDER BY doc_id) AS langs FROM documents GROUP BY 1")
def collate(spark, sf):
    out = M.collate(M.batch(_docs(spark, sf, "lang"), F.col("doc_id"), 64), "batch", "doc_id", "doc_id", "lang")
    return out.select(F.col("batch").cast("long").alias("batch"), F.array_join(F.col("doc_id").cast("array<string>"), " ").alias("ids"), F.array_join("lang", " ").alias("langs"))


@query(
    "epoch_plan",
    """WITH w AS (SELECT round_even(count(*) / 128.0, 0) AS w FROM documents), e AS (SELECT round_even(w / 4.0, 0)::BIGINT AS e FROM w)
    SELECT e * 4 AS num_batches, e AS worker_batches, e * 4 * 128 AS num_samples FROM e""",
)
def epoch_plan(spark, sf):
    """Batches of 32 over 4 ranks with 4 workers each."""
    n = _docs(spark, sf).count()
    p = M.epoch_plan(n, 32, 4, 4)
    return spark.createDataFrame([(p["num_batches"], p["worker_batches"], p["num_samples"])], "num_batches long, worker_batches long, num_samples long")


_DRAW = u01_sql("'7/' || id", "draw")


@query("resample_shards", f"SELECT id AS draw, floor({_DRAW} * (SELECT count(*) FROM documents))::BIGINT AS doc_id, d.lang FROM range(0, 500) t(id) JOIN documents d ON d.doc_id = floor({_DRAW} * (SELECT count(*) FROM documents))::BIGINT")
def resample_shards(spark, sf):
    return M.resample(_docs(spark, sf, "lang"), "doc_id", 500, 7).select("draw", "doc_id", "lang")


@query(
    "weighted_pick",
    f"""SELECT source, arg_min(doc_id, {{'w': -ln({u01_sql("source || '/' || doc_id", "pick")} + 1e-12) / n_chars, 'd': doc_id}}) AS doc_id FROM documents WHERE n_chars > 0 GROUP BY source""",
)
def weighted_pick(spark, sf):
    return M.weighted_pick(_docs(spark, sf, "source", "n_chars"), "source", "doc_id", "n_chars")


@query("sample_rows", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':sample'), doc_id LIMIT 100")
def sample_rows(spark, sf):
    return M.sample_rows(_docs(spark, sf), "doc_id", 100)


@query("sample_rows_short", f"WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region) SELECT r.r_regionkey AS regionkey FROM range(0, 20) t(id) JOIN r ON r.k = floor({u01_sql("'0/' || id", 'draw')} * (SELECT count(*) FROM region))::BIGINT")
def sample_rows_short(spark, sf):
    """Twenty of a table that has fewer: drawn with replacement."""
    return M.sample_rows(table(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey")), "regionkey", 20)


@query("sampler", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':3'), doc_id) - 1 AS draw FROM documents")
def sampler(spark, sf):
    """Without replacement: every row once, in the order of a hash."""
    return M.sampler(_docs(spark, sf), "doc_id", False, seed=3).select("doc_id", "draw")


_REDRAW = u01_sql("'3/' || id", "draw")


@query("sampler_replacement", f"WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) SELECT id AS draw, n.doc_id FROM range(0, (SELECT count(*) FROM documents)) t(id) JOIN n ON n.k = floor({_REDRAW} * (SELECT count(*) FROM documents))::BIGINT")
def sampler_replacement(spark, sf):
    return M.sampler(_docs(spark, sf), "doc_id", True, seed=3).select("draw", "doc_id")


@query("instance_id", "SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1)::VARCHAR AS instance_id FROM documents")
def instance_id(spark, sf):
    return S.instance_ids(_docs(spark, sf, "source"), "source", "doc_id").select("doc_id", "instance_id")


@query("dense_id_first_seen", "WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS img_id FROM documents GROUP BY source) SELECT doc_id, img_id::INTEGER AS img_id FROM documents JOIN f USING (source)")
def dense_id_first_seen(spark, sf):
    return S.dense_ids(_docs(spark, sf, "source"), "source", "doc_id").select("doc_id", "img_id")


@query("class_index_unknown", "SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS label FROM documents")
def class_index_unknown(spark, sf):
    return _docs(spark, sf, S.class_index(F.col("lang"), {"en": 0, "fr": 1, "de": 2}).alias("label"))


@query(
    "flip_pair",
    f"SELECT doc_id, CASE WHEN {u01_sql('doc_id', 'flip')} < 0.5 THEN source ELSE lang END AS image0, CASE WHEN {u01_sql('doc_id', 'flip')} < 0.5 THEN lang ELSE source END AS image1, CASE WHEN {u01_sql('doc_id', 'flip')} < 0.5 THEN 'right of left ' || lang ELSE 'left of right ' || lang END AS sentence FROM documents",
)
def flip_pair(spark, sf):
    from loomwright.functions.rng import u01

    a, b, t = S.flip_pair(F.col("lang"), F.col("source"), F.concat(F.lit("left of right "), F.col("lang")), u01(F.col("doc_id"), "flip") < 0.5)
    return table(spark, sf, "documents").select("doc_id", a.alias("image0"), b.alias("image1"), t.alias("sentence"))


@query("presence_filter", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND coalesce(l.toxic = 0, true)")
def presence_filter(spark, sf):
    """Rendered rows that no flag takes out."""
    d = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return d.where(C.has_tokens(F.col("quality"), F.col("toxic") == 0)).select("doc_id")


@query("alias_first", "SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.lang) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def alias_first(spark, sf):
    d = _docs(spark, sf, "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    data = F.map_concat(F.create_map(F.lit("png"), F.col("lang")), F.when(F.col("quality").isNotNull(), F.create_map(F.lit("jpg"), F.col("quality").cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    return d.select("doc_id", S.first_present(data, "jpg", "png").alias("value"))


_PROP = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"


@query("meta_threshold", f"SELECT event_id FROM events WHERE coalesce({_PROP} >= 50 , false)")
def meta_threshold(spark, sf):
    return table(spark, sf, "events").where(C.metadata_filter(F.col("props"), {"k": ">= 50"})).select("event_id")


@query("meta_coalesce", f"SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.width') AS DOUBLE), {_PROP}) AS width FROM events")
def meta_coalesce(spark, sf):
    return table(spark, sf, "events").select("event_id", C.metadata_number(F.col("props"), "$.width", "$.k").alias("width"))


@query(
    "qwen_filter",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 100 + event_id % 300 END AS w, CASE WHEN event_id % 11 <> 0 THEN 120 + event_id % 170 END AS h, CASE WHEN event_id % 5 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS s FROM events)
    SELECT event_id FROM e WHERE coalesce(h >= 180 AND w >= 180 AND h / w::DOUBLE >= 0.666::DOUBLE AND h / w::DOUBLE <= 1 / 0.666::DOUBLE, true) AND coalesce(s >= 0.2::DOUBLE, true)""",
)
def qwen_filter(spark, sf):
    """Sizes and similarities out of metadata that may lack them."""
    i = F.col("event_id")
    entry = lambda name, c, ok: F.when(ok, F.concat(F.lit(f'"{name}":'), c.cast("string")))
    parts = F.concat_ws(",", entry("width", 100 + i % 300, i % 7 != 0), entry("HEIGHT", 120 + i % 170, i % 11 != 0), entry("score", (i % 100) / 100, i % 5 != 0))
    meta = F.concat(F.lit("{"), parts, F.lit("}"))
    return table(spark, sf, "events").where(C.image_quality_from_metadata(meta, min_similarity=0.2, min_side=180, min_aspect=0.666)).select("event_id")


@query("split_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2')")
def split_filter(spark, sf):
    return C.by_ids(_docs(spark, sf, "lang", "source"), lang=["en", "fr"], source=["src1", "src2"], doc_id=[]).select("doc_id")


@query(
    "refill_batch",
    """WITH b AS (SELECT doc_id, doc_id // 16 AS batch, lang <> 'fr' AS ok FROM documents), g AS (SELECT *, sum((NOT ok)::INTEGER) OVER (PARTITION BY batch) AS lost FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS k FROM g WHERE ok) SELECT doc_id, batch::BIGINT AS batch, false AS refilled FROM k UNION ALL SELECT doc_id, batch::BIGINT, true FROM k WHERE k <= lost""",
)
def refill_batch(spark, sf):
    d = M.batch(_docs(spark, sf, (F.col("lang") != "fr").alias("ok")), F.col("doc_id"), 16)
    return C.refill_batches(d, "batch", "doc_id", "ok").select("doc_id", F.col("batch").cast("long").alias("batch"), "refilled")


@query("lookup_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_left(spark, sf):
    return J.lookup(_docs(spark, sf), table(spark, sf, "labels"), "doc_id").select("doc_id", "quality")


@query("lookup_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def lookup_semi(spark, sf):
    return J.members(_docs(spark, sf), table(spark, sf, "labels"), "doc_id")


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return J.unfinished(_docs(spark, sf), table(spark, sf, "labels"), "doc_id")


@query("same_ids_join", "SELECT a.doc_id, b.n_chars FROM documents a JOIN documents b USING (doc_id)")
def same_ids_join(spark, sf):
    """A join that refuses sides with different ids."""
    return J.same_ids(_docs(spark, sf), _docs(spark, sf, "n_chars"), "doc_id")


@query("dedup_first", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def dedup_first(spark, sf):
    d = _docs(spark, sf, "lang", "source").withColumn("k", F.concat("lang", F.lit("/"), "source"))
    return J.first_wins(d, "k", "doc_id").select("lang", "source", "doc_id")


@query("dedup_content", "SELECT md5(text) AS content_md5, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_content(spark, sf):
    return J.by_content(_docs(spark, sf, "text"), F.col("text"), "doc_id").select("content_md5", "doc_id")


@query("distinct_ordered", "WITH f AS (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT source, string_agg(lang, ' ' ORDER BY f) AS langs FROM f GROUP BY source")
def distinct_ordered(spark, sf):
    g = J.grouped(_docs(spark, sf, "source", "lang"), "source", "doc_id", "lang")
    return g.select("source", F.array_join(F.array_distinct(F.transform("items", lambda x: x["lang"])), " ").alias("langs"))


#: Items of five groups, and behind them the same again without a word at each end, which the whole ones contain.
_CONTAINED = """t AS (SELECT item_id % 5 AS g, item_id AS k, text FROM benchmark UNION ALL SELECT item_id % 5, 1000000000 + item_id, array_to_string(string_split(text, ' ')[2:-2], ' ') FROM benchmark),
l AS (SELECT g, list([text] ORDER BY k) AS l FROM t GROUP BY g)"""


@query("substring_dedup", f"WITH {_CONTAINED} SELECT g, md5(array_to_string(list_reduce(l, lambda kept, t: CASE WHEN len(list_filter(kept, lambda k: contains(k, t[1]))) > 0 THEN kept ELSE list_concat(kept, t) END), '|')) AS kept_md5 FROM l")
def substring_dedup(spark, sf):
    """Whole texts without those contained in one kept before, in order."""
    b = table(spark, sf, "benchmark")
    w = F.split("text", " ", -1)
    inner = b.select((F.col("item_id") + 1_000_000_000).alias("k"), F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), " ").alias("text"), (F.col("item_id") % 5).alias("g"))
    t = b.select(F.col("item_id").alias("k"), "text", (F.col("item_id") % 5).alias("g")).unionByName(inner)
    g = J.grouped(t, "g", "k", "text")
    return g.select("g", F.md5(F.array_join(J.without_contained(F.transform("items", lambda x: x["text"])), "|")).alias("kept_md5"))


_INSIDE = """t AS (SELECT source AS g, doc_id AS k, text FROM documents UNION ALL SELECT source, 1000000000 + doc_id, array_to_string(string_split(text, ' ')[2:-2], ' ') FROM documents
UNION ALL SELECT source, 2000000000 + doc_id, left(text, 12) FROM documents UNION ALL SELECT source, 3000000000 + doc_id, left(text, 40) || doc_id FROM documents)"""


@query("contained_texts", f"WITH {_INSIDE} SELECT g, k, md5(text) AS text_md5 FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.g IS NOT DISTINCT FROM t.g AND u.k < t.k AND contains(u.text, t.text)) OR text IS NULL")
def contained_texts(spark, sf):
    """Documents, their insides, short beginnings, and beginnings that go on differently, by source: what is inside a text
    before it goes."""
    from loomwright.operators.containment import drop_contained

    d = table(spark, sf, "documents").select(F.col("source").alias("g"), F.col("doc_id").alias("k"), "text")
    w = F.split("text", " ", -1)
    more = lambda plus, t: d.select("g", (F.col("k") + plus).alias("k"), t.alias("text"))
    inner = more(1_000_000_000, F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), " "))
    every = d.union(inner).union(more(2_000_000_000, F.left("text", F.lit(12)))).union(more(3_000_000_000, F.concat(F.left("text", F.lit(40)), F.col("k").cast("string"))))
    return drop_contained(every, "g", "k", "text").select("g", "k", F.md5("text").alias("text_md5"))


@query("qa_last_wins", "SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def qa_last_wins(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))
    return J.last_wins(o, "custkey", "orderkey")


@query("img_index", "SELECT l_orderkey AS orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
def img_index(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey")
    g = J.grouped(rows, "orderkey", "l_linenumber", "l_partkey")
    return g.select("orderkey", F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), " ").alias("parts"), F.size("items").cast("long").alias("n"))


@query("txt2img", "SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::VARCHAR AS txt_id, l_orderkey AS orderkey FROM lineitem")
def txt2img(spark, sf):
    return S.instance_ids(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").select(F.col("instance_id").alias("txt_id"), F.col("l_orderkey").alias("orderkey"))


@query("ragged_collate", "WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1) SELECT (l_orderkey // 64)::BIGINT AS batch, md5(array_to_string(flatten(list(a ORDER BY l_orderkey)), ' ')) AS answers_md5, array_to_string(list(len(a) ORDER BY l_orderkey), ' ') AS n_answers FROM a GROUP BY 1")
def ragged_collate(spark, sf):
    g = J.grouped(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    g = g.select(F.floor(F.col("l_orderkey") / 64).alias("batch"), "l_orderkey", F.transform("items", lambda x: x["l_partkey"]).alias("a"))
    r = J.ragged(g, "batch", "l_orderkey", "a")
    return r.select(F.col("batch").cast("long").alias("batch"), F.md5(F.array_join(F.col("answers").cast("array<string>"), " ")).alias("answers_md5"), F.array_join(F.col("n_answers").cast("array<string>"), " ").alias("n_answers"))


@query("split_catalog", "SELECT lang AS split, string_agg(DISTINCT source, ' ' ORDER BY source) AS datasets FROM documents GROUP BY lang")
def split_catalog(spark, sf):
    """{dataset: {split}} turned into {split: [datasets]}."""
    d = _docs(spark, sf, "lang", "source")
    return d.groupBy(F.col("lang").alias("split")).agg(F.array_join(F.array_sort(F.collect_set("source")), " ").alias("datasets"))


#: crc32 by its table of 256 steps, over the bytes of a text.
_CRC = """s AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
b AS (SELECT page_id, list_transform(range(1, octet_length(encode(url)) + 1), lambda i: ('0x' || substr(hex(encode(url)), 2 * i - 1, 2))::BIGINT) AS b FROM pages)"""


@query("crc_name", f"WITH {_CRC} SELECT page_id, lpad(xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[((xor(c, x)) & 255) + 1])), 4294967295)::VARCHAR, 10, '0') AS name FROM b, s")
def crc_name(spark, sf):
    from loomwright.sources.sinks import url_file_name

    return table(spark, sf, "pages").select("page_id", url_file_name(F.col("url")).alias("name"))


@query("log_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def log_day(spark, sf):
    from loomwright.sources.sinks import log_day as day

    return table(spark, sf, "events").select("event_id", day(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")).alias("day"))
