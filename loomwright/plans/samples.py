"""Queries over files written for the purpose, annotation datasets and declared pipelines: each writes or builds its input
from the tables, runs the operator, and has SQL over the tables."""

from __future__ import annotations

import gzip
import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions import rng
from loomwright.functions import text as X
from loomwright.operators import assemble as S
from loomwright.operators import curate as C
from loomwright.operators import relational as J
from loomwright.operators import render as R
from loomwright.plans import datasets as D
from loomwright.plans import pipelines as P
from loomwright.plans.catalog import query
from loomwright.plans.common import image_ids, image_ids_sql, image_tokens_sql, joined_sql, pick_sql, q, table
from loomwright.session import durable, scratch_path
from loomwright.sources import paths, readers, shards, sinks, tars


def _docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", *cols)


# --- files ------------------------------------------------------------------------------------------------------------


@query("brace_paths", "SELECT source, source || printf('/part-%05d/', i) || x || '.tar' AS path FROM (SELECT source, count(*) // 20 AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), range(0, n + 1) t(i), (VALUES ('a'), ('b')) v(x)")
def brace_paths(spark, sf):
    """The shards of each source, from a range as long as the source and two names."""
    n = table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").count()
    last = F.lpad(F.floor(F.col("count") / 20).cast("string"), 5, "0")
    pattern = F.concat("source", F.lit("/part-{00000.."), last, F.lit("}/{a,b}.tar"))
    return n.select("source", F.explode(paths.expanded(pattern)).alias("path"))


@query("list_files", "SELECT DISTINCT 'lang=' || lang AS folder FROM documents WHERE lang IS NOT NULL")
def list_files(spark, sf):
    """Files of one mask in folders below two brace-expanded roots."""
    path = scratch_path(spark, "files")
    d = _docs(spark, sf, "lang").where("lang IS NOT NULL")
    for part in (0, 1):
        d.where(F.col("doc_id") % 2 == part).select(F.col("doc_id").cast("string"), "lang").write.partitionBy("lang").text(f"{path}/r{part}")
    files = readers.list_files(spark, path + "/r{0..1}", "part-*.txt")
    return files.where("length > 0").select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


def _json_lines(spark, sf):
    """Every fifth line is blank, every seventh broken."""
    path, d = scratch_path(spark, "lines"), _docs(spark, sf, "lang", "text")
    line = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct("doc_id", "lang", "text")))
    d.select(line.alias("value")).write.text(path)
    return path


@query("json_lines", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def json_lines(spark, sf):
    return readers.read_json_lines(spark, _json_lines(spark, sf), "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("json_line_rejects", "SELECT '{\"doc_id\": ' || doc_id AS line FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0")
def json_line_rejects(spark, sf):
    return readers.read_json_lines(spark, _json_lines(spark, sf), "doc_id long", rejects=True).select("line")


@query("line_keys", "SELECT doc_id, 'f' || doc_id % 3 || '_line' || doc_id // 3 AS key FROM documents")
def line_keys(spark, sf):
    d = _docs(spark, sf, F.concat(F.lit("dir/f"), (F.col("doc_id") % 3).cast("string"), F.lit(".jsonl")).alias("path"), F.floor(F.col("doc_id") / 3).alias("place"))
    return readers.number_lines(d).select("doc_id", "key")


@query(
    "json_list",
    """WITH i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS caption, CASE WHEN doc_id % 3 = 1 THEN lang END AS question, CASE WHEN doc_id % 4 = 0 THEN source END AS video FROM documents)
    SELECT doc_id, caption, question, video FROM i WHERE caption IS NOT NULL OR question IS NOT NULL UNION ALL SELECT doc_id, caption, question, video FROM i WHERE video IS NOT NULL""",
)
def json_list(spark, sf):
    """A list in each file; items with one of the sets of fields, and again those with a video."""
    path, n = scratch_path(spark, "lists"), F.col("doc_id")
    of = lambda name, value, ok: F.when(ok, value).alias(name)
    item = F.struct("doc_id", of("caption", F.col("lang"), n % 3 == 0), of("question", F.col("lang"), n % 3 == 1), of("answer", F.col("source"), n % 3 == 1), F.lit("im").alias("image"), of("video", F.col("source"), n % 4 == 0))
    lists = _docs(spark, sf, "lang", "source").groupBy((n % 8).alias("file")).agg(F.to_json(F.collect_list(item)).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = readers.read_json_list(spark, path, "doc_id long, caption string, question string, answer string, image string, video string")
    return readers.select_items(found).select("doc_id", "caption", "question", "video")


@query("annotations", "SELECT lang AS caption, source AS image, doc_id AS image_id FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND source IS NOT NULL")
def annotations(spark, sf):
    """Files of {"annotations": [...]} and of bare lists; every fifth item lacks its image."""
    path, n = scratch_path(spark, "annotations"), F.col("doc_id")
    item = F.struct(F.col("lang").alias("caption"), F.when(n % 5 != 0, F.col("source")).alias("image"), n.alias("image_id"))
    lists = _docs(spark, sf, "lang", "source").groupBy((n % 6).alias("file")).agg(F.to_json(F.collect_list(item)).alias("l"))
    lists.select(F.when(F.col("file") % 2 == 0, F.concat(F.lit('{"annotations": '), F.col("l"), F.lit("}"))).otherwise(F.col("l")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_annotations(spark, path)


@query("text_images", "SELECT md5(text) AS image_md5, lang AS text FROM documents WHERE lang = 'en'")
def text_images(spark, sf):
    path = scratch_path(spark, "images")
    _docs(spark, sf, F.struct(F.col("text").cast("binary").alias("bytes")).alias("image"), F.col("lang").alias("text")).drop("doc_id").write.parquet(path)
    return readers.read_text_images(spark, path, F.col("text") == "en").select(F.md5("image.bytes").alias("image_md5"), "text")


def _tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    meta = F.to_json(F.struct((F.col("doc_id") % 10 / 10).alias("score")))
    _docs(spark, sf, F.concat_ws("\t", "lang", F.col("doc_id").cast("string"), meta).alias("value")).select("value").write.text(path)
    return readers.read_tsv(spark, path, "caption string, image_name string, meta string")


@query("tsv_metadata", "SELECT lang AS caption, doc_id::VARCHAR AS image_name FROM documents WHERE doc_id % 10 / 10.0::DOUBLE >= 0.3")
def tsv_metadata(spark, sf):
    return _tsv(spark, sf).where(C.metadata_filter(F.col("meta"), {"score": ">= 0.3"})).select("caption", "image_name")


@query("captions_store", f"SELECT doc_id::VARCHAR AS image_name, CASE WHEN doc_id % 3 <> 0 THEN lang END AS caption, CASE WHEN doc_id % 3 <> 0 THEN {joined_sql(image_ids_sql('doc_id', 4))} END AS ids FROM documents")
def captions_store(spark, sf):
    """Captions of a TSV looked up in a table of image ids; a miss leaves the row empty."""
    store = _docs(spark, sf).where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("image_name"), image_ids(F.col("doc_id"), 4).alias("image_ids"))
    return readers.captions_with_ids(_tsv(spark, sf), store).select("image_name", "caption", A.joined(F.col("image_ids")).alias("ids"))


@query("read_splits", "SELECT doc_id, lang FROM documents")
def read_splits(spark, sf):
    path, d = scratch_path(spark, "splits"), _docs(spark, sf, "lang")
    d.where("doc_id % 4 <> 0").write.parquet(f"{path}/train")
    d.where("doc_id % 4 = 0").select("lang", "doc_id").write.parquet(f"{path}/validation")
    return readers.read_splits(spark, [f"{path}/train", f"{path}/validation"])


@query("image_folder", "WITH f AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) SELECT 'lang=' || lang AS class, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS label FROM f")
def image_folder(spark, sf):
    """Classes by folder, numbered by name."""
    path = scratch_path(spark, "folders")
    _docs(spark, sf, "lang").where("lang IS NOT NULL").select(F.col("doc_id").cast("string"), "lang").write.partitionBy("lang").text(path)
    return readers.read_image_folder(spark, path, "part-*.txt", labelled=True).select("class", "label").distinct()


@query("load_by_extension", " UNION ALL ".join(f"SELECT '{e}' AS ext, doc_id, lang FROM documents" for e in ("jsonl", "csv", "tsv", "parquet", "orc")))
def load_by_extension(spark, sf):
    path, d = scratch_path(spark, "formats"), _docs(spark, sf, "lang")
    d.write.json(f"{path}/x.jsonl")
    d.write.csv(f"{path}/x.csv", header=True)
    d.write.csv(f"{path}/x.tsv", header=True, sep="\t")
    d.write.parquet(f"{path}/x.parquet")
    d.write.orc(f"{path}/x.orc")
    every = [readers.load(spark, f"{path}/x.{e}").select(F.lit(e).alias("ext"), F.col("doc_id").cast("long").alias("doc_id"), "lang") for e in ("jsonl", "csv", "tsv", "parquet", "orc")]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out


@query("archives", "SELECT doc_id::VARCHAR || '.txt' AS member, CASE WHEN doc_id % 5 <> 4 THEN md5(text) END AS text_md5, doc_id % 5 = 4 AS rejected FROM documents")
def archives(spark, sf):
    """Texts in gz and zip files, each fifth file of neither kind."""

    def pack(pdfs):
        for pdf in pdfs:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                data = (t or "").encode()
                if i % 5 == 4:
                    rows.append((f"x/{i}.txt", b"plain " + data))
                elif i % 2:
                    rows.append((f"x/{i}.txt.gz", gzip.compress(data, mtime=0)))
                else:
                    buf = io.BytesIO()
                    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(f"{i}.txt", data)
                    rows.append((f"x/{i}.zip", buf.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = _docs(spark, sf, "text").mapInPandas(pack, "path string, content binary")
    m = shards.expand_archive(files)
    name = F.coalesce("member", F.element_at(F.split("shard", "/"), -1))
    return m.select(name.alias("member"), F.md5("payload").alias("text_md5"), F.col("error").isNotNull().alias("rejected"))


@query("base64_members", "SELECT doc_id, md5(base64(encode(text))) AS coded_md5, md5(text) AS text_md5, true AS bad_is_null FROM documents")
def base64_members(spark, sf):
    coded = S.encode_base64(F.col("text").cast("binary"))
    return _docs(spark, sf, F.md5(coded).alias("coded_md5"), F.md5(S.decode_base64(coded)).alias("text_md5"), S.decode_base64(F.lit("*")).isNull().alias("bad_is_null"))


@query("qa_samples", "SELECT doc_id AS image_ids, lang AS question, source AS answer FROM documents")
def qa_samples(spark, sf):
    """Samples written in files of at most 64, without their metadata, and read back."""
    path = scratch_path(spark, "samples")
    sinks.write_samples(sinks.question_answer(_docs(spark, sf, F.col("doc_id").alias("image_ids"), F.col("lang").alias("question"), F.col("source").alias("answer"), F.lit("{}").alias("metadata"))), path, 64)
    return spark.read.parquet(path)


@query("metrics_log", "SELECT lang AS split, count(*)::BIGINT AS n, 2::BIGINT AS times FROM documents GROUP BY 1")
def metrics_log(spark, sf):
    """Metrics appended twice."""
    path = scratch_path(spark, "metrics")
    for _ in range(2):
        sinks.append_metrics(_docs(spark, sf, "lang").groupBy(F.col("lang").alias("split")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("split string, n long").json(path).groupBy("split", "n").agg(F.count("*").alias("times"))


@query("status_report", "SELECT page_id::VARCHAR AS page_id, CASE WHEN length(coalesce(html, '')) = 0 THEN '204' WHEN contains(url, 'spam') THEN '404' ELSE '200' END AS status FROM pages")
def status_report(spark, sf):
    path = scratch_path(spark, "report")
    status = F.when(F.coalesce(F.length("html"), F.lit(0)) == 0, 204).when(F.contains("url", F.lit("spam")), 404).otherwise(200)
    sinks.write_report(table(spark, sf, "pages").select("page_id", status.alias("status")), path)
    return spark.read.csv(path, sep="\t", header=True)


@query("result_files", "SELECT doc_id, lang FROM documents UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%d') FROM events")
def result_files(spark, sf):
    """Results as JSON, and a chat log by day, read back."""
    path = scratch_path(spark, "results")
    sinks.save_json(_docs(spark, sf, "lang"), f"{path}/r")
    e = table(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("tstamp"))
    sinks.append_chat_log(e, f"{path}/log")
    log = spark.read.schema("event_id long, tstamp double, day string").json(f"{path}/log").select(F.col("event_id").alias("doc_id"), F.col("day").alias("lang"))
    return spark.read.schema("doc_id long, lang string").json(f"{path}/r").unionByName(log)


# --- samples ----------------------------------------------------------------------------------------------------------


@query("flatten_plain", "SELECT doc_id, lang, source FROM documents")
def flatten_plain(spark, sf):
    """One level of structs, without a default and with the key as it is."""
    d = _docs(spark, sf, F.struct("lang", F.lit("x").alias("source")).alias("a"), F.struct("source").alias("b"))
    return S.flatten_sample(d, ["a", "b"], default_metadata=False)


@query("filter_keys", "SELECT doc_id, lang, list_transform(range(0, 3), lambda i: ((doc_id * 31 + i * 7) % 8192)::VARCHAR).array_to_string(' ') AS first_ids FROM documents")
def filter_keys(spark, sf):
    """Some keys of a sample, and the first of its ids."""
    d = _docs(spark, sf, "lang", "source", image_ids(F.col("doc_id")).alias("ids"))
    return d.select("doc_id", "lang", A.joined(F.slice("ids", 1, 3)).alias("first_ids"))


@query("decode_members", "SELECT doc_id || '.' || ext AS member, CASE WHEN ext <> 'bin' THEN md5(text) END AS text_md5 FROM documents, (VALUES ('txt'), ('json'), ('bin')) v(ext)")
def decode_members(spark, sf):
    tars = shards.pack_tar(_docs(spark, sf, "text"), "doc_id", {"txt": "text", "json": "text", "bin": "text"}, per_shard=50)
    m = shards.samples(shards.expand_tar(tars.select(F.concat_ws("-", "part", "shard").alias("path"), "content")))
    return m.select("member", F.md5(S.decode_member(F.col("ext"), F.col("payload"))).alias("text_md5"))


@query("caption_source", "SELECT doc_id, lang AS from_text, source AS from_metadata FROM documents")
def caption_source(spark, sf):
    d = _docs(spark, sf, "lang", F.to_json(F.struct(F.col("source").alias("top_caption"))).alias("metadata"))
    return d.select("doc_id", S.caption_source(F.col("lang"), F.col("metadata"), False).alias("from_text"), S.caption_source(F.col("lang"), F.col("metadata"), True).alias("from_metadata"))


@query("image_name", "SELECT doc_id, doc_id::VARCHAR || md5(text) AS image_name FROM documents")
def image_name(spark, sf):
    return _docs(spark, sf, F.concat(F.col("doc_id").cast("string"), F.md5("text")).alias("image_name"))


@query("prune_context", "SELECT doc_id, '[{\"text\":\"' || lang || '\",\"image_name\":\"' || source || '\",\"similarity\":0.5}]' AS context FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def prune_context(spark, sf):
    c = F.array(F.struct(F.col("source").alias("image_name"), F.lit(0.5).alias("similarity"), F.lit("gone").alias("url"), F.col("lang").alias("text")))
    return _docs(spark, sf, "lang", "source").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", S.prune_context(c).alias("context"))


@query("display_item", "SELECT doc_id, source AS file, lang || '; ' || source AS answers, [lang, source][doc_id % 2 + 1] AS choice FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def display_item(spark, sf):
    both = F.array("lang", "source")
    d = _docs(spark, sf, "lang", "source").where("lang IS NOT NULL AND source IS NOT NULL")
    return S.display(d, doc_id=F.col("doc_id"), file=F.col("source"), answers=F.array_join(both, "; "), choice=both[(F.col("doc_id") % 2).cast("int")])


_SIZES = "s AS (SELECT doc_id, 100 + doc_id % 300 AS w, 50 + doc_id % 170 AS h, CASE WHEN doc_id % 3 > 0 THEN text END AS t, CASE WHEN doc_id % 4 > 0 THEN lang END AS l FROM documents)"


def _sized(spark, sf):
    n = F.col("doc_id")
    return _docs(spark, sf, (100 + n % 300).alias("w"), (50 + n % 170).alias("h"), F.when(n % 3 > 0, F.col("text")).alias("t"), F.when(n % 4 > 0, F.col("lang")).alias("l"))


@query("presence_sft", f"WITH {_SIZES} SELECT doc_id FROM s WHERE t IS NOT NULL")
def presence_sft(spark, sf):
    """Rendered, whatever the flag."""
    return _sized(spark, sf).where(C.has_tokens(F.col("t"))).select("doc_id")


@query("presence_sets", f"WITH {_SIZES} SELECT doc_id FROM s WHERE (t IS NOT NULL AND l IS NOT NULL) OR (l IS NOT NULL AND w > 300) OR (t IS NOT NULL AND h > 200)")
def presence_sets(spark, sf):
    t, l, w, h = F.col("t"), F.col("l"), F.when(F.col("w") > 300, 1), F.when(F.col("h") > 200, 1)  # noqa: E741
    return _sized(spark, sf).where(C.any_set_present([t, l], [l, w], [t, h])).select("doc_id")


@query("aspect_flag", f"WITH {_SIZES} SELECT doc_id, w / h::DOUBLE BETWEEN 1 / 3.0::DOUBLE AND 3 AS flag FROM s")
def aspect_flag(spark, sf):
    return _sized(spark, sf).select("doc_id", C.aspect_flag(F.col("w"), F.col("h")).alias("flag"))


@query("large_and_matched", "SELECT doc_id, ((octet_length(encode(text)) // 1000 > 10)::INTEGER * (doc_id % 10 >= 3)::INTEGER + (octet_length(encode(text || text)) // 1000 > 10)::INTEGER)::BIGINT AS kept FROM documents")
def large_and_matched(spark, sf):
    image = lambda data, sim: F.struct(data.cast("binary").alias("data"), sim.alias("matched_sim"))
    images = F.array(image(F.col("text"), F.col("doc_id") % 10 / 10), image(F.concat("text", "text"), F.lit(0.9).cast("double")))
    return _docs(spark, sf, "text").select("doc_id", F.size(C.large_and_matched(images, 0.3)).cast("long").alias("kept"))


@query("interleaved_check", "SELECT doc_id, doc_id % 3 <> 0 AS ok FROM documents")
def interleaved_check(spark, sf):
    """Slots with exactly one of image and text; every third document has one with both or none."""
    n, none = F.col("doc_id"), F.lit(None)
    slot = lambda i, t: F.struct(i.cast("array<int>").alias("image_ids"), t.cast("string").alias("text"))
    bad = F.when(n % 2 == 0, slot(F.array(F.lit(1)), F.col("lang"))).otherwise(slot(none, none))
    items = F.array(slot(F.array(F.lit(1)), none), F.when(n % 3 == 0, bad).otherwise(slot(none, F.lit("t"))))
    return _docs(spark, sf, "lang").select("doc_id", R.interleaved_ok(items).alias("ok"))


@query("image_count", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN {rng.u01_sql('doc_id', 'single')} >= 0.5 ELSE true END AS keep FROM documents")
def image_count(spark, sf):
    return _docs(spark, sf, C.keep_by_image_count(F.col("doc_id") % 3, F.col("doc_id")).alias("keep"))


@query("id_filters", "SELECT doc_id FROM documents WHERE doc_id IN (1, 3, 5, 100) AND lang IN ('en', 'de', 'fr', 'es')")
def id_filters(spark, sf):
    """Lists of values; an empty one is no condition."""
    return C.by_ids(_docs(spark, sf, "lang", "source"), doc_id=[1, 3, 5, 100], lang=["en", "de", "fr", "es"], source=[]).select("doc_id")


@query("existing_paths", "WITH f AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source) SELECT doc_id, source FROM f WHERE source IN (SELECT source FROM documents WHERE lang = 'de')")
def existing_paths(spark, sf):
    d = _docs(spark, sf, "lang", "source")
    return J.existing(d, d.where("lang = 'de'"), "source", "doc_id").select("doc_id", "source")


_CAPTIONS = "[('c' || doc_id % 3), ('c' || doc_id % 5), ('c' || doc_id % 7)]"


@query(
    "unused_captions",
    f"""WITH a AS (SELECT doc_id // 10 AS question, list({_CAPTIONS} ORDER BY doc_id) AS c, list(doc_id ORDER BY doc_id) AS d FROM documents GROUP BY 1),
    t AS (SELECT question, d, list_reduce(list_concat([['']], c), lambda acc, x: list_append(acc, coalesce(list_filter(x, lambda y: NOT list_contains(acc, y))[1], '')))[2:] AS t FROM a)
    SELECT question::VARCHAR AS question, unnest(d)::VARCHAR AS answer, nullif(unnest(t), '') AS caption FROM t""",
)
def unused_captions(spark, sf):
    """Each answer's first caption that no earlier answer of its question took."""
    n = F.col("doc_id")
    c = F.array(*[F.concat(F.lit("c"), (n % k).cast("string")) for k in (3, 5, 7)])
    return J.unused_captions(_docs(spark, sf).select(F.floor(n / 10).cast("string").alias("question"), n.alias("place"), n.cast("string").alias("answer"), c.alias("captions")))


@query("with_epoch", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id LIMIT 100")
def with_epoch(spark, sf):
    """A shuffled stream that ends after a number of samples."""
    from loomwright.operators.mixing import shuffle_key

    return _docs(spark, sf).orderBy(shuffle_key(F.col("doc_id"), 0), "doc_id").limit(100)


@query("sorted_splits", "SELECT string_agg(DISTINCT lang, ' ' ORDER BY lang) AS splits FROM documents")
def sorted_splits(spark, sf):
    return _docs(spark, sf, "lang").agg(F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("splits"))


@query("random_caption", f"SELECT doc_id, {pick_sql(['a', 'b', 'c', 'd', 'e'], rng.pick_sql('doc_id', 'caption', 5))} AS caption FROM documents")
def random_caption(spark, sf):
    return _docs(spark, sf, F.element_at(F.array(*[F.lit(x) for x in "abcde"]), rng.pick(F.col("doc_id"), "caption", 5) + 1).alias("caption"))


_LEN = "(10 + doc_id % 50)"
_SOME = "list_sort(list_transform(list_sort(list_transform({at}, lambda i: {{'h': md5(doc_id || ':' || i), 'i': i}}))[1:4], lambda x: x.i))"


@query(
    "video_frames",
    f"SELECT doc_id, {joined_sql(f'list_transform(range(0, 8), lambda i: floor(i * {_LEN} / 8.0)::INTEGER)')} AS uniform, {joined_sql('list_concat(' + _SOME.format(at=f'range(0, {_LEN} // 2)') + ', ' + _SOME.format(at=f'range({_LEN} // 2, {_LEN})') + ')')} AS headtail FROM documents",
)
def video_frames(spark, sf):
    n = 10 + F.col("doc_id") % 50
    return _docs(spark, sf, A.joined(A.uniform_frames(n, 8)).alias("uniform"), A.joined(A.headtail_frames(n, 8, F.col("doc_id"))).alias("headtail"))


@query("json_fields", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS made FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("made"))


@query("vq_unmap", "SELECT doc_id AS id, (doc_id % 40)::INTEGER AS place, CASE WHEN doc_id % 40 < 32 THEN (doc_id % 40 * 3)::INTEGER END AS code FROM documents")
def vq_unmap(spark, sf):
    from loomwright.operators.vq import unmap

    used = spark.range(32).select((F.col("id") * 3).cast("int").alias("code"), F.col("id").cast("int").alias("place"))
    return unmap(_docs(spark, sf).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).cast("int").alias("place")), used)


@query("drop_undecodable", "SELECT doc_id, array_to_string(list_transform(list_filter(range(0, 6), lambda i: i % 2 = 1 OR (doc_id + i) % 3 <> 0), lambda i: CASE WHEN i % 2 = 0 THEN 'im' || i ELSE '-' END || '/t' || i), ' ') AS slots FROM documents")
def drop_undecodable(spark, sf):
    """Six slots, three with images, of which one can't be decoded: it goes with its text."""
    at = F.array(*[F.lit(i) for i in range(6)])
    images = F.transform(at, lambda i: F.when(i % 2 == 0, F.concat(F.lit("im"), i.cast("string"))))
    texts, ok = F.transform(at, lambda i: F.concat(F.lit("t"), i.cast("string"))), F.transform(at, lambda i: (F.col("doc_id") + i) % 3 != 0)
    shown = F.transform(S.drop_undecodable(images, texts, ok), lambda s: F.concat(F.coalesce(s["image"], F.lit("-")), F.lit("/"), s["text"]))
    return _docs(spark, sf).select("doc_id", F.array_join(shown, " ").alias("slots"))


_PLACES = "[[doc_id % 4, 1], NULL, [doc_id % 3, doc_id % 4, 3]]"


@query(
    "reason_prompt",
    f"""WITH d AS (SELECT *, ['A ' || lang || '.', 'B.', 'C.', 'D.'] AS c, {_PLACES} AS p FROM documents),
    t AS (SELECT *, list_reduce(list_concat([[-1]], list_transform(range(0, 30), lambda k: coalesce(p[((2 - k) % 3 + 3) % 3 + 1], [0]))), lambda acc, x: CASE WHEN len(list_filter(x, lambda y: NOT list_contains(acc, y))) > 0 THEN list_append(acc, list_filter(x, lambda y: NOT list_contains(acc, y))[1]) ELSE acc END)[2:] AS taken FROM d)
    SELECT doc_id, md5({q(R.REASON_HEAD)} || 'Contexts:' || array_to_string(list_transform(taken, lambda x: c[x + 1]), '') || chr(10) || 'Question:' || source || {q(R.REASON_EXAMPLES)} || 'Question:' || lang || chr(10) || 'Answer:') AS prompt_md5 FROM t""",
)
def reason_prompt(spark, sf):
    n = F.col("doc_id")
    captions = F.array(F.concat(F.lit("A "), F.col("lang"), F.lit(".")), *[F.lit(x) for x in ("B.", "C.", "D.")])
    i = lambda *xs: F.array(*[x.cast("int") for x in xs])
    places = F.array(i(n % 4, F.lit(1)), F.lit(None).cast("array<int>"), i(n % 3, n % 4, F.lit(3)))
    made = R.reason_prompt(F.col("lang"), F.array(F.lit("x."), F.lit("y."), F.lit("z.")), F.array("lang", "source"), captions, places)
    return _docs(spark, sf, "lang", "source").select("doc_id", F.md5(made).alias("prompt_md5"))


@query(
    "fetch_report",
    """SELECT page_id, CASE page_id % 10 WHEN 0 THEN 404 WHEN 2 THEN NULL WHEN 3 THEN 503 ELSE 200 END::INTEGER AS status, CASE page_id % 10 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END::INTEGER AS tries,
    CASE WHEN page_id % 10 = 2 THEN 'TimeoutError: no answer' END AS error, CASE WHEN page_id % 10 NOT IN (0, 2, 3) THEN md5('http://x/' || page_id) END AS payload_md5 FROM pages WHERE page_id % 4 <> 0""",
)
def fetch_report(spark, sf):
    """What is not done yet is fetched: some URLs are gone, some answer the second time, some never, some are overloaded."""
    from loomwright.sources.fetch import fetch

    def get(url, attempt):
        k = int(url.rsplit("/", 1)[-1]) % 10
        if k == 2 or k == 1 and attempt == 1:
            raise TimeoutError("no answer")
        return {0: 404, 3: 503}.get(k, 200), url.encode()

    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("http://x/"), F.col("page_id").cast("string")).alias("url"))
    report = fetch(J.unfinished(p, p.where("page_id % 4 = 0").select("page_id"), "page_id"), "page_id", "url", get, wait=0.0)
    return report.select("page_id", "status", "tries", "error", F.md5("payload").alias("payload_md5"))


@query("image_sizes", "SELECT doc_id, (100 + doc_id % 300)::INTEGER AS width, (120 + doc_id % 170)::INTEGER AS height FROM documents")
def image_sizes(spark, sf):
    """Width and height from the headers of image members."""
    n, number = F.col("doc_id"), lambda c: F.lpad(F.hex(c), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(100 + n % 300), number(120 + n % 170), F.lit("0802000000")))
    return shards.with_image_size(_docs(spark, sf, png.alias("payload"))).select("doc_id", "width", "height")


@query("encode_images", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT v.vec_id AS id, c.vec_id AS code, list_reduce(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])), lambda x, y: x + y) AS d FROM v, (SELECT * FROM v WHERE vec_id < 32) c) SELECT id, arg_min(code, {'d': d, 'c': code})::INTEGER AS code FROM d GROUP BY id")
def encode_images(spark, sf):
    """A model in the loop: loaded once for each task, it turns batches of vectors into codes."""
    import numpy as np
    import pyarrow as pa

    from loomwright.operators.batch import encode_batches

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    words = [list(r.v) for r in v.where("id < 32").orderBy("id").collect()]

    def encode(w, b):
        x, d = np.array(b.column(1).to_pylist()), 0.0
        for k in range(w.shape[1]):
            d = d + (x[:, [k]] - w[None, :, k]) ** 2
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(axis=1), pa.int32())], ["id", "code"])

    return encode_batches(v, lambda: np.array(words), encode, "id long, code int", 64)


_RGB = "list_transform(range(0, 8 * 6 * 3), lambda i: (doc_id * 31 + i * 7) % 256)"


@query(
    "pixel_values",
    f"""WITH d AS (SELECT doc_id, {_RGB} AS p FROM documents),
    c AS (SELECT doc_id, list_transform(range(0, 48), lambda i: p[(((1 + i // 12) * 8 + 2 + (i % 12) // 3) * 3 + i % 3) + 1]) AS c, list_transform(range(0, 36), lambda i: p[((floor((i // 12 + 0.5) * 2)::INTEGER * 8 + floor(((i % 12) // 3 + 0.5) * 2)::INTEGER) * 3 + i % 3) + 1]) AS r,
      list_transform(range(0, 144), lambda i: p[(((i // 24) * 8 + 7 - (i % 24) // 3) * 3 + i % 3) + 1]) AS f FROM d)
    SELECT doc_id, {joined_sql('c')} AS cropped, {joined_sql('r')} AS resized, {joined_sql('f')} AS flipped,
      round(list_reduce(list_transform(range(0, 48), lambda i: (c[i + 1] / 255.0::DOUBLE - [0.5, 0.4, 0.3][i % 3 + 1]) / [0.2, 0.3, 0.4][i % 3 + 1] * (i + 1)), lambda a, b: a + b), 6) AS weighed FROM c""",
)
def pixel_values(spark, sf):
    """Crop, resize, flip and normalise raw images of 8 x 6 pixels."""
    from loomwright.functions import pixels as px

    p = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: ((F.col("doc_id") * 31 + i * 7) % 256).cast("int"))
    d = _docs(spark, sf, p.alias("p"))
    d = d.select("doc_id", px.crop(F.col("p"), 8, 2, 1, 4, 4).alias("c"), px.resize_nearest(F.col("p"), 8, 6, 4, 3).alias("r"), px.flip(F.col("p"), 8, 6).alias("f"))
    n = px.normalise(F.col("c"), (0.5, 0.4, 0.3), (0.2, 0.3, 0.4))
    weighed = F.aggregate(F.transform(n, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("doc_id", A.joined(F.col("c")).alias("cropped"), A.joined(F.col("r")).alias("resized"), A.joined(F.col("f")).alias("flipped"), F.round(weighed, 6).alias("weighed"))


_PNG_BYTES = "text || repeat(' ', ((48 - octet_length(encode(text)) % 48) % 48)::INTEGER)"


@query("png_decode", f"SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 16 END AS width, CASE WHEN doc_id % 10 <> 0 THEN (octet_length(encode({_PNG_BYTES})) // 48)::INTEGER END AS height, CASE WHEN doc_id % 10 <> 0 THEN md5({_PNG_BYTES}) END AS pixels_md5, doc_id % 10 = 0 AS broken FROM documents WHERE text <> ''")
def png_decode(spark, sf):
    """The bytes of each text as an image 16 pixels wide under all five row filters, in tar shards, each tenth file cut off:
    pixels of the members that can be decoded, and rejects."""
    from loomwright.functions import png

    n = F.octet_length("text")
    d = _docs(spark, sf, "text").where("text <> ''").withColumn("bytes", F.concat("text", F.repeat(F.lit(" "), F.pmod(48 - n % 48, F.lit(48)))).cast("binary"))
    made = png.encoded(F.col("bytes"), F.lit(16), F.col("doc_id") % 5)
    half = lambda c: F.substring(c, F.lit(1), (F.octet_length(c) / 2).cast("int"))
    images = d.select("doc_id", made.alias("png")).select("doc_id", F.when(F.col("doc_id") % 10 == 0, half(F.col("png"))).otherwise(F.col("png")).alias("png"))
    path = scratch_path(spark, "images")
    tars.write_shards(images, path, "doc_id", {"png": "png"}, per_shard=200)
    got = tars.read_shards(spark, path, exts=("png",)).select(F.regexp_replace("member", r"\..*", "").cast("long").alias("doc_id"), png.decoded(F.col("payload")).alias("p"))
    return got.select("doc_id", "p.width", "p.height", F.md5("p.pixels").alias("pixels_md5"), F.col("p.error").isNotNull().alias("broken"))


#: The bytes of each text as rows of 16 pixels: (doc_id, h, y, x, c, v).
_PIXELS = f"""b AS (SELECT doc_id, hex(encode({_PNG_BYTES})) AS hx, octet_length(encode({_PNG_BYTES})) // 48 AS h FROM documents WHERE text <> ''),
p AS MATERIALIZED (SELECT doc_id, h, k // 48 AS y, k % 48 // 3 AS x, k % 3 AS c, ('0x' || b)::INTEGER AS v FROM (SELECT doc_id, h, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, h, regexp_extract_all(hx, '..') AS l FROM b)))"""


def _shown_sql(rows: str) -> str:
    """md5 of the hexadecimal digits of (doc_id, y, x, c, v)."""
    return f"SELECT doc_id, md5(string_agg(printf('%02x', v::INTEGER), '' ORDER BY y, x, c)) AS pixels_md5 FROM {rows} GROUP BY doc_id"


def _pixels(spark, sf):
    n = F.octet_length("text")
    return _docs(spark, sf, "text").where("text <> ''").select("doc_id", F.concat("text", F.repeat(F.lit(" "), F.pmod(48 - n % 48, F.lit(48)))).cast("binary").alias("pixels"))


def _changed(spark, sf, work):
    from loomwright.functions import images

    made = images.transformed(F.col("pixels"), F.lit(16), work, F.col("doc_id"))
    return _pixels(spark, sf).select("doc_id", F.md5(F.lower(F.hex(made))).alias("pixels_md5"))


def _taps_sql(name: str, n: str, size: int) -> str:
    """(n, i, k, w): whole weights of the samples k of n that make the new sample i of ``size``."""
    return f"""{name}0 AS (SELECT n, i, n::DOUBLE / {size} AS scale, greatest(n::DOUBLE / {size}, 1.0) AS wide, (i + 0.5) * (n::DOUBLE / {size}) AS centre FROM ({n}), range(0, {size}) t(i)),
{name}1 AS (SELECT n, i, k, abs((k - centre + 0.5) / wide) AS d FROM {name}0, range(0, n) t(k) WHERE k >= greatest(trunc(centre - 2 * wide + 0.5), 0) AND k < least(trunc(centre + 2 * wide + 0.5), n)),
{name}2 AS (SELECT *, CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1 WHEN d < 2 THEN ((-0.5 * d + 2.5) * d - 4) * d + 2 ELSE 0 END AS w0 FROM {name}1),
{name} AS (SELECT n, i, k, floor(w0 / sum(w0) OVER (PARTITION BY n, i) * 4194304 + 0.5)::BIGINT AS w FROM {name}2)"""


_BYTE = "greatest(0, least(255, (2097152 + sum(w * v)) // 4194304))"


@query(
    "image_resize",
    f"""WITH {_PIXELS}, {_taps_sql('tx', 'SELECT 16 AS n', 8)}, {_taps_sql('ty', 'SELECT DISTINCT h AS n FROM b', 6)},
    q AS (SELECT doc_id, h, y, i AS x, c, {_BYTE} AS v FROM p JOIN tx ON tx.k = p.x GROUP BY ALL), r AS (SELECT doc_id, i AS y, x, c, {_BYTE} AS v FROM q JOIN ty ON ty.n = q.h AND ty.k = q.y GROUP BY doc_id, i, x, c)
    {_shown_sql('r')}""",
)
def image_resize(spark, sf):
    """Images of 16 pixels' width and any height as 8 by 6, by the cubic kernel."""
    from loomwright.functions import images

    return _changed(spark, sf, lambda p, key: images.resize(p, 8, 6))


@query(
    "image_tones",
    f"""WITH {_PIXELS}, e AS (SELECT doc_id, c, v, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT doc_id, c, v, coalesce(sum(n) OVER (PARTITION BY doc_id, c ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, (sum(n) OVER (PARTITION BY doc_id, c) - last(n) OVER (PARTITION BY doc_id, c ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) // 255 AS step FROM e),
    t AS (SELECT doc_id, c, v, CASE WHEN step = 0 THEN v ELSE least((step // 2 + below) // step, 255) END AS u FROM s), eq AS (SELECT p.doc_id, h, y, x, c, t.u AS v FROM p JOIN t USING (doc_id, c, v)),
    m AS (SELECT doc_id, c, min(v) AS lo, max(v) AS hi FROM eq GROUP BY ALL), ac AS (SELECT doc_id, y, x, c, CASE WHEN hi <= lo THEN v ELSE (v - lo) * 255 // (hi - lo) END AS v FROM eq JOIN m USING (doc_id, c)),
    so AS (SELECT doc_id, y, x, c, (CASE WHEN v < 128 THEN v ELSE 255 - v END)::INTEGER & 240 AS v FROM ac) {_shown_sql('so')}""",
)
def image_tones(spark, sf):
    """Images equalized, stretched, solarized and posterized, one after the other."""
    from loomwright.functions import images

    return _changed(spark, sf, lambda p, key: images.posterize(images.solarize(images.autocontrast(images.equalize(p)), 128), 4))


@query(
    "image_affine",
    f"""WITH {_PIXELS}, g AS (SELECT doc_id, h, y, x, c, floor(x + 0.25 * y - 3) AS sx, floor(-0.5 * x + y + 2) AS sy FROM p)
    {_shown_sql("(SELECT g.doc_id, g.y, g.x, g.c, coalesce(p.v, 128) AS v FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.x = g.sx AND p.y = g.sy AND p.c = g.c)")}""",
)
def image_affine(spark, sf):
    """Images sheared both ways and moved."""
    from loomwright.functions import images

    return _changed(spark, sf, lambda p, key: images.affine(p, (1, 0.25, -3, -0.5, 1, 2)))


_DRAWN = ", ".join(f"'{n}'" for n in ("identity", "autocontrast", "equalize", "rotate", "solarize", "color", "contrast", "brightness", "sharpness", "shear_x", "translate_x", "translate_y", "posterize", "shear_y"))


@query("augment_policy", " UNION ALL ".join(f"SELECT doc_id, {i} AS draw, [{_DRAWN}][{rng.pick_sql('doc_id', f'op{i}', 14)} + 1] AS operation, CASE WHEN {rng.u01_sql('doc_id', f'sign{i}')} > 0.5 THEN -1 ELSE 1 END AS sign FROM documents WHERE text <> '' AND {rng.u01_sql('doc_id', f'apply{i}')} <= 0.5" for i in (0, 1)))
def augment_policy(spark, sf):
    """The operations that the policy draws for each image, which is augmented by them beside."""
    from loomwright.functions import images

    made = images.transformed(F.col("pixels"), F.lit(16), images.augment, F.col("doc_id"))
    d = _pixels(spark, sf).select("doc_id", F.octet_length(made).alias("size")).where("size > 0")
    rows = None
    for i in (0, 1):
        name = F.element_at(F.array(*map(F.lit, images.OPERATIONS)), rng.pick(F.col("doc_id"), f"op{i}", len(images.OPERATIONS)) + 1)
        sign = F.when(rng.u01(F.col("doc_id"), f"sign{i}") > 0.5, -1).otherwise(1)
        part = d.where(rng.u01(F.col("doc_id"), f"apply{i}") <= 0.5).select("doc_id", F.lit(i).alias("draw"), name.alias("operation"), sign.alias("sign"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --- streams ----------------------------------------------------------------------------------------------------------


#: Letters of JSON in a file of a stream, about.
STREAM_BYTES = 64 << 20


def _stream_of(spark, df, parts: int):
    """Rows written as files of about STREAM_BYTES at most, and read again in ``parts`` micro-batches."""
    path = scratch_path(spark, "stream")
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0
    each = -(-size // (STREAM_BYTES * parts)) or 1
    df.repartition(parts * each).write.json(f"{path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return path, spark.readStream.schema(schema).option("maxFilesPerTrigger", each).json(f"{path}/in")


_RING = "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    "meter_stream",
    f"""SELECT event_id, event_type AS meter, count(value) OVER g AS n, round(avg(value) OVER w, 6) AS window_avg, list_sort(list(value) OVER w)[((len(list(value) OVER w) - 1) // 2)::INTEGER + 1] AS window_median,
    max(value) OVER w AS window_max, value AS last_value, round(sum(value) OVER g, 2) AS global_sum {_RING}""",
)
def meter_stream(spark, sf):
    """Running meters over three parts of a stream, each a run that goes on from the checkpoint of the one before: every
    column of the ring, for every event."""
    from loomwright.streaming.meters import meter_stream as meters
    from loomwright.streaming.meters import rocksdb_state

    path, events = scratch_path(spark, "meters"), table(spark, sf, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    part = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    for i in range(3):
        events.where(part == i).write.mode("append").parquet(f"{path}/in")
        out = meters(spark.readStream.schema(events.schema).parquet(f"{path}/in"), "event_type", "event_id", "value", "ts")
        with rocksdb_state(spark):
            q = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").format("parquet").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(f"{path}/out").where("NOT idle")
    return rows.select(F.col("o").cast("long").alias("event_id"), "meter", "n", F.round("window_avg", 6).alias("window_avg"), "window_median", "window_max", "last_value", F.round(F.col("global_avg") * F.col("n"), 2).alias("global_sum"))


@query("windowed_totals", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_totals(spark, sf):
    """Daily totals of a stream in three runs: what each batch changed, the last of it for each window."""
    from loomwright.streaming.meters import windowed_totals as totals

    path, events = scratch_path(spark, "windows"), table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    part = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    for i in range(3):
        events.where(part == i).write.mode("append").parquet(f"{path}/in")
        w = totals(spark.readStream.schema(events.schema).parquet(f"{path}/in"), "ts", "event_type", "value", "1 day")
        write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        w.writeStream.outputMode("update").option("checkpointLocation", f"{path}/c").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("s"))
    return last.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "s.n", F.round("s.total", 4).alias("total"))


@query("shard_stream", f"SELECT doc_id, {joined_sql(f'list_slice([1] || {A.word_ids_sql(chr(116))} || [2] || list_transform(range(0, 16), lambda i: 0), 1, 16)')} AS input_ids FROM (SELECT doc_id, text AS t FROM documents) WHERE trim(t, {q(X.BLANK_CHARS)}) <> ''")
def shard_stream(spark, sf):
    """New files rendered and filtered as they come."""
    from loomwright.streaming import ingest

    path, rows = _stream_of(spark, _docs(spark, sf, "text"), 3)
    ingest.append(ingest.render_stream(rows, "pretrain_text", "doc_id", max_length=16), f"{path}/out", f"{path}/c").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", A.joined(F.col("input_ids")).alias("input_ids"))


_CODES, _DECAY, _DEAD = 32, 0.9, 0.95
_NORM = "list_transform({0}, lambda u: u / sqrt(list_inner_product({0}, {0})))"


def _book_sql(batches: int = 3) -> str:
    """The codebook folded over batches: nearest words, counts and means, moving averages, and words for dead codes."""
    parts = [f"z AS MATERIALIZED (SELECT vec_id, {_NORM.format('e')} AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))", f"b0 AS MATERIALIZED (SELECT vec_id::INTEGER AS code, e AS w, 1.0::DOUBLE AS size FROM z WHERE vec_id < {_CODES})"]
    for i in range(batches):
        new = _NORM.format("x")
        parts.append(f"a{i} AS MATERIALIZED (SELECT z.vec_id, arg_min(b.code, list_sum(list_transform(list_zip(z.e, b.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS code FROM z, b{i} b WHERE z.vec_id % {batches} = {i} GROUP BY z.vec_id)")
        parts.append(f"m{i} AS MATERIALIZED (SELECT code, max(n) AS n, list(m ORDER BY k) AS m FROM (SELECT code, k, avg(z.e[k]) AS m, count(*) AS n FROM a{i} a JOIN z USING (vec_id), range(1, 65) t(k) GROUP BY ALL) GROUP BY code)")
        step = f"list_transform(list_zip(b.w, {_NORM.format('m.m')}), lambda p: {_DECAY}::DOUBLE * p[1] + (1 - {_DECAY}::DOUBLE) * p[2])"
        parts.append(f"v{i} AS MATERIALIZED (SELECT code, CASE WHEN x IS NULL THEN w ELSE {new} END AS w, size FROM (SELECT b.code, b.w, CASE WHEN m.m IS NOT NULL THEN {step} END AS x, {_DECAY}::DOUBLE * b.size + (1 - {_DECAY}::DOUBLE) * coalesce(m.n, 0) AS size FROM b{i} b LEFT JOIN m{i} m USING (code)))")
        parts.append(f"s{i} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(vec_id || ':{i}'), vec_id) AS place, e FROM z WHERE vec_id % {batches} = {i})")
        parts.append(f"d{i} AS MATERIALIZED (SELECT code, row_number() OVER (ORDER BY code) AS place FROM v{i} WHERE size < {_DEAD})")
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT v.code, coalesce(s.e, v.w) AS w, CASE WHEN s.e IS NOT NULL THEN {_DEAD}::DOUBLE ELSE v.size END AS size FROM v{i} v LEFT JOIN d{i} d USING (code) LEFT JOIN s{i} s USING (place))")
    return f"WITH {', '.join(parts)} SELECT code, array_to_string(list_transform(w, lambda x: printf('%.4f', round(x, 4) + 0.0)), ' ') AS vec, round(size, 6) AS size FROM b{batches}"


@query("codebook_stream", _book_sql())
def codebook_stream(spark, sf):
    """A codebook of 32 words that follows three micro-batches, each a run that goes on from the last one's checkpoint."""
    from loomwright.streaming.meters import follow_codebook

    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    first = v.where(F.col("vec_id") < _CODES).select(F.col("vec_id").cast("int").alias("code"), "vec")
    path = scratch_path(spark, "codebook")
    for i in range(3):
        v.where(F.col("vec_id") % 3 == i).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(v.schema).parquet(f"{path}/in")
        follow_codebook(stream, first, f"{path}/book", f"{path}/c", _DECAY, _DEAD).awaitTermination()
    shown = F.array_join(F.transform("vec", lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), " ")
    return spark.read.parquet(f"{path}/book/epoch=2").select("code", shown.alias("vec"), F.round("size", 6).alias("size"))


# --- datasets and pipelines -------------------------------------------------------------------------------------------

_ANNOTATION = """a AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS instance_id, 'im/x_' || source || '.jpg' AS image, 'v/' || source AS video, text AS caption, text AS question, text AS sentence, lang AS label, doc_id * 2 AS img_id, doc_id + 7 AS question_id,
  ['im0', 'im1'] AS images, [lang, source, lang] AS answers, source AS answer1, lang AS choices, 1 AS correct_choice_idx, text AS dialog FROM documents),
first_image AS (SELECT image, row_number() OVER (ORDER BY min(doc_id), image) - 1 AS id FROM a GROUP BY image), first_video AS (SELECT video, row_number() OVER (ORDER BY min(doc_id), video) - 1 AS id FROM a GROUP BY video)"""
_CLEAN = r"array_to_string(string_split(trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!\"()*#:;~]', ' ', 'g'), '\s{2,}', ' ', 'g'), chr(10)), ' '), ' ')[1:50], ' ')"
_ASKED = r"array_to_string(string_split(rtrim(regexp_replace(lower(text), '[.!\"()*#:;~]', '', 'g'), ' '), ' ')[1:50], ' ')"
_DISTINCT = "(CASE WHEN answers[1] = answers[2] THEN [answers[1]] ELSE answers[1:2] END)"
_WEIGHTS = "(CASE WHEN answers[1] = answers[2] THEN ['1.0000'] ELSE ['0.6667', '0.3333'] END)"
_CAPTION, _QUESTION = _CLEAN.replace("text", "caption"), _ASKED.replace("text", "question")
_ALL_ANSWERS = {"answers": f"array_to_string({_DISTINCT}, '|')", "weights": f"array_to_string({_WEIGHTS}, '|')"}

@query("web_dataset", f"SELECT 'image_text' AS type, md5(text) AS image_md5, {_CLEAN.replace('text', 'lang')} AS caption FROM documents WHERE lang IS NOT NULL AND doc_id % 6 <> 5")
def web_dataset(spark, sf):
    """A web dataset from tar shards of image and JSON members; samples whose JSON is broken or missing are left out."""
    d = _docs(spark, sf, "text", "lang").where("lang IS NOT NULL")
    meta = F.when(F.col("doc_id") % 6 != 5, F.to_json(F.struct(F.col("lang").alias("caption")))).otherwise(F.when(F.col("doc_id") % 12 == 5, F.lit("{broken")))
    tars = shards.pack_tar(d.select("doc_id", "text", meta.alias("meta")), "doc_id", {"jpg": "text", "json": "meta"}, per_shard=64)
    members = shards.samples(shards.expand_tar(tars.select(F.concat_ws("-", "part", "shard").alias("path"), "content"), exts=("jpg", "json")))
    samples = S.group_members(members, {"jpg", "json"}).select(F.col("key").cast("long").alias("n"), F.col("data")["jpg"].alias("image"), F.get_json_object(F.decode(F.col("data")["json"], "UTF-8"), "$.caption").alias("caption"))
    return D.load("laion400M_multi", samples.where("caption IS NOT NULL"), "n").select("type", F.md5("image").alias("image_md5"), "caption")


#: What a sample has, by kind, in SQL over the annotations.
_KIND_SQL: dict[str, dict[str, str]] = {
    "caption": {"image": "image", "image_id": "(SELECT id FROM first_image f WHERE f.image = a.image)", "text_input": _CAPTION},
    "caption_eval": {"image": "image", "image_id": "img_id", "instance_id": "instance_id"},
    "coco_caption_eval": {"image": "image", "instance_id": "instance_id", "image_id": "split_part(trim(string_split(image, '/')[-1], '.jpg'), '_', -1)"},
    "nocaps_eval": {"image": "image", "instance_id": "instance_id", "image_id": "img_id"},
    "web_pair": {"image": "image", "caption": _CAPTION, "type": "'image_text'"},
    "web_plain": {"image": "image", "text_input": "caption"},
    "pair": {"image": "image", "caption": _CAPTION},
    "pair_text": {"image": "image", "text_input": _CAPTION, "text_output": "caption"},
    "video_caption": {"video": "video", "image_id": "(SELECT id FROM first_video f WHERE f.video = a.video)", "text_input": _CAPTION},
    "video_caption_eval": {"video": "video", "image_id": "img_id", "instance_id": "instance_id"},
    "vqa": {"image": "image", "text_input": _QUESTION, **_ALL_ANSWERS},
    "vqa_eval": {"image": "image", "question_id": "question_id", "instance_id": "instance_id", "text_input": _QUESTION},
    "direct_vqa": {"image": "image", "text_input": _QUESTION, **_ALL_ANSWERS},
    "direct_vqa_eval": {"image": "image", "question_id": "question_id", "instance_id": "instance_id", "choices": "choices", "correct_choice_idx": "correct_choice_idx", "direct_answers": "array_to_string(answers, '|')", "text_input": _QUESTION},
    "one_answer": {"image": "image", "text_input": _QUESTION, "answers": "answer1", "weights": "'1.0000'"},
    "one_answer_low": {"image": "image", "text_input": _QUESTION, "answers": "answer1", "weights": "'0.2000'"},
    "one_answer_eval": {"image": "image", "answer": "answer1", "question_id": "question_id", "instance_id": "instance_id", "text_input": _QUESTION},
    "pair_class": {"instance_id": "instance_id", "image0": "'im0'", "image1": "'im1'", "text_input": _CLEAN.replace("text", "sentence"), "label": "2"},
    "entailment": {"image": "image", "instance_id": "instance_id", "image_id": "image", "text_input": _CLEAN.replace("text", "sentence"), "label": "3"},
    "retrieval": {"image": "image", "image_id": "(SELECT id FROM first_image f WHERE f.image = a.image)", "instance_id": "instance_id", "text_input": _CAPTION},
    "retrieval_eval": {"image": "image", "caption": "caption", "index": "instance_id", "path": "image"},
    "video_retrieval": {"video": "video", "image_id": "(SELECT id FROM first_video f WHERE f.video = a.video)", "text_input": _CAPTION},
    "video_retrieval_eval": {"video": "video", "index": "instance_id"},
    "video_qa": {"video": "video", "question_id": "question_id", "instance_id": "instance_id", "text_input": _QUESTION, "answers": "answer1"},
    "dialogue": {"image_id": "img_id", "instance_id": "instance_id", "dialog": "dialog"},
    "image_folder": {"image": "image", "label": "label", "image_id": "img_id", "instance_id": "instance_id", "file": "image"},
}
_NUMBERED = {"caption", "retrieval", "video_caption", "video_retrieval"}
_LISTS = {"vqa": "answer", "direct_vqa": "direct_answers", "direct_vqa_eval": "direct_answers"}


def _digest_sql(cols: dict[str, str]) -> str:
    return "md5(" + " || ';' || ".join(f"'{c}=' || ({e})::VARCHAR" for c, e in sorted(cols.items())) + ")"


def _parts():
    return [(n, split, kind) for n, kinds in D.DATASETS.items() for split, kind in zip(("train", "val"), kinds) if kind is not None]


@query("dataset_samples", f"WITH {_ANNOTATION}, " + ", ".join(f"k_{k} AS (SELECT {_digest_sql(c)} AS sample FROM a)" for k, c in _KIND_SQL.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS dataset, '{s}' AS split, sample, count(*) AS n FROM k_{k} GROUP BY sample" for n, s, k in _parts()))
def dataset_samples(spark, sf):
    """All named datasets, training and evaluation, over one table of annotations: each sample by the md5 of its fields."""
    d, n = S.instance_ids(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id"), F.col("doc_id")
    d = durable(d, "annotations")
    every = d.select(
        "doc_id", "instance_id", F.concat(F.lit("im/x_"), "source", F.lit(".jpg")).alias("image"), F.concat(F.lit("v/"), "source").alias("video"), *[F.col("text").alias(c) for c in ("caption", "question", "sentence", "dialog")], F.col("lang").alias("label"), (n * 2).alias("img_id"), (n + 7).alias("question_id"),
        F.array(F.lit("im0"), F.lit("im1")).alias("images"), F.array("lang", "source", "lang").alias("direct_answers"), F.col("source").alias("answer"), F.col("lang").alias("choices"), F.lit(1).alias("correct_choice_idx"),
    )

    def text(field):
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "array":
            number = field.dataType.elementType.typeName() == "double"
            return F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)) if number else c, "|")
        return c.cast("string")

    made = {}
    for name, split, kind in _parts():
        if kind not in made:
            a = every if kind in _NUMBERED else every.withColumn("image_id", F.col("img_id"))
            a = a.withColumn("answer", F.col("direct_answers")) if kind == "vqa" else a
            s = D.load(name, a, "doc_id", split)
            fields = sorted(s.schema.fields, key=lambda f: f.name)
            made[kind] = s.select(F.lit(kind).alias("kind"), F.md5(F.concat_ws(";", *[F.concat(F.lit(f.name + "="), text(f)) for f in fields])).alias("sample"))
    counted = reduce(DataFrame.union, made.values()).groupBy("kind", "sample").agg(F.count("*").alias("n"))
    parts = spark.createDataFrame(_parts(), "dataset string, split string, kind string")
    return counted.join(F.broadcast(parts), "kind").select("dataset", "split", "sample", "n")


_IMG = image_tokens_sql(image_ids_sql("doc_id"))
_STATES = [image_tokens_sql(f"list_slice({image_ids_sql('doc_id', 160)}, {32 * k + 1}, {32 * k + 32})") for k in range(5)]
_FRAMES = " || ".join(_STATES)
_PERIOD = "CASE WHEN ends_with({t}, '.') THEN {t} ELSE {t} || '.' END"
_ANSWER = _PERIOD.format(t="trim(text, ' ')")


def _said(asked: str, answered: str) -> str:
    return f"'USER: ' || {asked} || chr(10) || 'ASSISTANT:' || {answered}"


_EDITED = pick_sql(R.EDIT_RESPONSES, rng.pick_sql("doc_id", "edit", len(R.EDIT_RESPONSES)))
_STORY = rng.pick_sql("doc_id", "story", len(R.STORY_PROMPTS))
_GENERATE = rng.pick_sql("doc_id", "generate", len(R.GENERATE_PROMPTS))
_LEFT = f"{rng.u01_sql('doc_id', 'direction')} < 0.5"
_TALK = f"CASE WHEN doc_id % 2 = 0 THEN text ELSE {_ANSWER} END"

#: The text that each pipeline renders, over the documents: lang asks, text answers, the key's ids are the image.
_RENDERED: dict[str, str] = {
    "pretrain_caption": f"CASE WHEN {_LEFT} THEN {_IMG} || text ELSE text || {_IMG} END",
    "pretrain_edit": f"{_STATES[0]} || lang || {_STATES[1]}",
    "pretrain_interleaved": f"CASE WHEN {_LEFT} THEN text || {_IMG} ELSE {_IMG} || text END",
    "pretrain_interleaved_pages": f"CASE WHEN {_LEFT} THEN text || {_IMG} ELSE {_IMG} || text END",
    "pretrain_retrieval": f"CASE WHEN {_LEFT} THEN {_IMG} || text || {_STATES[1]} || lang ELSE text || {_IMG} || lang || {_STATES[1]} END",
    "pretrain_conversation": "'USER: ' || lang || chr(10) || 'ASSISTANT: ' || text",
    "pretrain_visual": f"'USER: ' || CASE WHEN {rng.u01_sql('doc_id', 'image_side')} < 0.5 THEN {_IMG} || lang ELSE lang || {_IMG} END || chr(10) || 'ASSISTANT: ' || text",
    "pretrain_video_caption": f"{' || '.join(_STATES[:4])} || text",
    "pretrain_text": "text",
    "sft_edit": _said(f"{_STATES[0]} || lang", f"{_EDITED} || {_STATES[1]}"),
    "sft_edit_multi": f"{_said(_STATES[0] + ' || lang', _EDITED + ' || ' + _STATES[1])} || chr(10) || {_said('source', _EDITED + ' || ' + _STATES[2])} || chr(10) || {_said('text', _EDITED + ' || ' + _STATES[3])}",
    "sft_marked": _said(f"{_IMG} || lang", _ANSWER),
    "sft_marked_video": _said(f"{_FRAMES} || lang", "trim(text, ' ')"),
    "sft_qa": _said(f"{_IMG} || lang", _ANSWER),
    "sft_instruction": _said("lang", "text"),
    "sft_video_qa": _said(f"{_FRAMES} || lang", _ANSWER),
    "sft_video_generation": f"{' || '.join(_STATES[:4])} || text",
    "sft_difference": f"'USER: ' || CASE WHEN {rng.u01_sql('doc_id', 'template')} < 0.5 THEN {_STATES[0]} || 'This is the first image.' || {_STATES[1]} || 'This is the second image. ' || lang ELSE 'This is the first image.' || {_STATES[0]} || 'This is the second image.' || {_STATES[1]} || lang END || chr(10) || 'ASSISTANT:' || {_PERIOD.format(t='source')}",
    "sft_story": _said(f"lang || '0' || {_STATES[0]} || {pick_sql(R.STORY_PROMPTS, _STORY)}", pick_sql(R.STORY_RESPONSES, _STORY) + "".join(f" || chr(10) || lang || '{i}' || {_STATES[i]}" for i in (1, 2, 3, 4))),
    "sft_conversation": _said("lang", "text"),
    "sft_visual": _said(f"{_IMG} || lang", _ANSWER),
}
_IDS_128 = f"list_slice({A.word_ids_sql('text')} || list_transform(range(0, 128), lambda z: 0), 1, 128)"
_TOKENS = f"{joined_sql(_IDS_128)} || ':' || least(128, len({A.word_ids_sql('text')}))"
#: What the others make: tokens and their number, prompts with answers, a context as JSON; the rest hands pixels on.
_RENDERED |= {n: _TOKENS for n in ("preprocess_caption", "preprocess_coco", "eval_caption", "eval_coco")}
_RENDERED |= {"eval_question": f"{q(R.DESCRIBE.format('image'))} || '|' || text", "eval_video": f"{q(R.DESCRIBE.format('video'))} || '|' || text", "eval_edit": "lang || '|img'"}
_RENDERED |= {"preprocess_retrieval": f"'[{{\"image_ids\":[' || array_to_string(list_slice({image_ids_sql('doc_id', 160)}, 33, 64), ',') || '],\"text\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END || '}}]'"}
_PASSED = ("pretrain_pixels", "preprocess_interleaved", "preprocess_instructions", "preprocess_visual")

_IMAGES = "list_filter(list_transform(range(0, len(s)), lambda i: {i: i, big: i % 3 = 0, sim: ((doc_id * 7 + i * 13) % 100) / 100.0}) || list_transform(range(0, len(s)), lambda i: {i: i, big: i % 5 = 0, sim: ((doc_id + i * 29) % 100) / 100.0}), lambda x: x.big AND x.sim >= 0.24)[1:5]"
_CHUNKED_SQL = f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, s, {_IMAGES} AS m FROM s),
b AS (SELECT doc_id, array_to_string(list_transform(s, lambda t, i: repeat('<|endofchunk|><image>', len(list_filter(m, lambda x: x.i = i - 1))) || t), ' ') AS b FROM m),
t AS (SELECT doc_id, replace(replace(replace(CASE WHEN contains(b, '<|endofchunk|>') THEN left(b, strpos(b, '<|endofchunk|>') - 1) || substr(b, strpos(b, '<|endofchunk|>') + 14) ELSE b END, ' <|endofchunk|>', '<|endofchunk|>'), '<image> ', '<image>'), ' <image>', '<image>') || '<|endofchunk|></s>' AS text FROM b),
n AS (SELECT *, len(list_filter(regexp_extract_all(text, '<image>|<\\|endofchunk\\|>|[^\\s<]+|<')[1:256], lambda x: x = '<image>'))::INTEGER AS num_images FROM t)
SELECT doc_id, md5(text) AS text_md5, num_images FROM n WHERE num_images > 1 OR num_images = 1 AND {rng.u01_sql('doc_id', 'single')} >= 0.5"""


@query("chunked_document", _CHUNKED_SQL)
def chunked_document(spark, sf):
    """The interleaved documents of the pipeline preprocess_chunked: lines as sentences, some of them with one image or two, of
    which too small and badly matched ones don't count, and at most five."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("text_list"))
    big, small = F.lit(b"x" * 11_000), F.lit(b"x" * 10_999)  # constants, so that no row makes its own
    image = lambda i, every, sim: F.struct(F.when(i % every == 0, big).otherwise(small).alias("data"), (F.pmod(sim, F.lit(100)) / 100.0).alias("matched_sim"), i.alias("matched_text_index"))
    at = F.sequence(F.lit(0), F.size("text_list") - 1)
    images = F.concat(F.transform(at, lambda i: image(i, 3, F.col("doc_id") * 7 + i * 13)), F.transform(at, lambda i: image(i, 5, F.col("doc_id") + i * 29)))
    return P.build("preprocess_chunked", d.withColumn("images", images), "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "num_images")


_STYLES = {"describe_image": q(R.DESCRIBE.format("image")), "describe_video": q(R.DESCRIBE.format("video")), "caption": q(R.BRIEF_CAPTION), "plain": "lang", "word": f"lang || {q(R.ONE_WORD)}", "word_video": f"lang || '?' || {q(R.ONE_WORD)}", "dialog": f"{q(R.DIALOG_SYSTEM)} || lang"}


@query(
    "evaluation_prompts",
    " UNION ALL ".join(f"SELECT doc_id, '{k}' AS style, {e} AS question, md5(text) AS answer_md5 FROM documents" for k, e in _STYLES.items())
    + " UNION ALL SELECT doc_id, 'turns', 'Question: ' || lang || ' Question: ' || source, md5(trim('Answer: ' || text || ' Answer: ' || lang, ' ')) FROM documents",
)
def evaluation_prompts(spark, sf):
    """What evaluation asks about each document in every style, and a whole dialogue as one question."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    rows = None
    for style in _STYLES:
        part = d.select("doc_id", F.lit(style).alias("style"), R.asked(style, F.col("lang")).alias("question"), F.md5("text").alias("answer_md5"))
        rows = part if rows is None else rows.unionByName(part)
    question, answer = R.asked_turns(F.array(F.struct(F.col("lang").alias("q"), F.col("text").alias("a")), F.struct(F.col("source").alias("q"), F.col("lang").alias("a"))))
    return rows.unionByName(d.select("doc_id", F.lit("turns").alias("style"), question.alias("question"), F.md5(answer).alias("answer_md5")))


_NO_MARKS = "text NOT LIKE '%Image Descriptions%' AND text NOT LIKE '%Question: %' AND text NOT LIKE '%Answer: %' AND text NOT LIKE '%image a%' AND text NOT LIKE '%image b%'"


@query(
    "pipeline_samples",
    f"WITH d AS (SELECT * FROM documents WHERE trim(text, {q(X.BLANK_CHARS)}) <> '' AND {_NO_MARKS}) "
    + " UNION ALL ".join(f"SELECT '{n}' AS pipeline, doc_id, md5({e}) AS text_md5 FROM d" for n, e in _RENDERED.items())
    + f" UNION ALL SELECT 'eval_few_shot_caption', doc_id, md5({_STATES[1]} || lang || {_IMG}) FROM d"
    + "".join(f" UNION ALL SELECT '{n}', doc_id, md5(text) FROM d" for n in _PASSED),
)
def pipeline_samples(spark, sf):
    """All declared pipelines over one table of samples: the text that each renders for each key."""
    d = table(spark, sf, "documents").where(~X.is_blank(F.col("text"))).where("text NOT LIKE '%Image Descriptions%' AND text NOT LIKE '%Question: %' AND text NOT LIKE '%Answer: %' AND text NOT LIKE '%image a%' AND text NOT LIKE '%image b%'")
    n, ids = F.col("doc_id"), image_ids(F.col("doc_id"))
    long, states = image_ids(n, 160), A.slices(image_ids(n, 160))
    base = d.select(
        "doc_id", "text", F.lit("{}").alias("metadata"), ids.alias("image_ids"), F.col("lang").alias("question"), F.col("text").alias("answer"), F.col("lang").alias("instruction"), F.col("text").alias("response"), states[0].alias("source_image_ids"), states[1].alias("target_image_ids"),
        F.array(F.struct(states[1].alias("image_ids"), F.col("lang").alias("text"))).alias("context"), F.array("lang", "text").alias("data"), F.col("text").cast("binary").alias("pixel_values"), F.lit(300).alias("width"), F.lit(300).alias("height"), F.lit("img").alias("source_image"),
        F.col("lang").alias("instruction0"), F.col("source").alias("instruction1"), F.col("text").alias("instruction2"), *[F.concat("lang", F.lit(str(i))).alias(f"caption{i}") for i in range(5)], long.alias("long"), "source",
    )
    marked = {"question": F.concat(F.lit(R.QUESTION), F.col("question")), "answer": F.concat(F.lit(R.ANSWER), F.col("answer"))}
    states_as_ids = {"image_ids": F.col("long")}
    change = {
        "interleaved": {"image_ids": F.array(F.col("image_ids"), F.lit(None).cast("array<int>")), "texts": F.array(F.lit(None).cast("string"), F.col("text"))},
        "visual": {"image_ids": F.array("image_ids")}, "visual_sft": {"image_ids": F.array("image_ids")},
        "video_caption": states_as_ids, "edit_multi": states_as_ids, "video_qa": states_as_ids, "story": states_as_ids, "marked": marked, "marked_video": {**marked, **states_as_ids}, "difference": {**states_as_ids, "answer": F.col("source")},
    }
    out = None
    for name, spec in P.PIPELINES.items():
        if spec.render == "chunked":
            continue  # its documents are those of the query chunked_document
        src = base.withColumns(change.get(spec.render, {}))
        made = P.build(name, src, "doc_id", **({"reverse_ratio": 0.5} if name == "sft_story" else {}))
        shown = {
            "few_shot": F.col("prompt"), "pixels_tokens": F.concat(A.joined(F.col("input_ids")), F.lit(":"), F.size(F.filter("attention_mask", lambda x: x == 1)).cast("string")) if "attention_mask" in made.columns else None,
            "ask": F.concat_ws("|", "question", "answer"), "context_json": F.col("context"),
        }.get(spec.render, F.concat_ws("|", "instruction", "source_image") if name == "eval_edit" else F.col("text" if "text" in made.columns else "raw"))
        part = made.select(F.lit(name).alias("pipeline"), "doc_id", F.md5(shown).alias("text_md5"))
        out = part if out is None else out.unionByName(part)
    return out
