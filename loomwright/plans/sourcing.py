"""Queries over sources, shards, registries and pipelines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions.rng import u01_sql
from loomwright.operators import assemble as S
from loomwright.plans import datasets as D
from loomwright.plans import pipelines as P
from loomwright.plans.catalog import query
from loomwright.plans.common import image_ids, image_ids_sql, image_tokens_sql, joined_sql, q, table
from loomwright.session import scratch_path
from loomwright.sources import shards, tars
from loomwright.sources.sinks import merge_results, sample_key
from loomwright.streaming import ingest


@query("tar_roundtrip", "SELECT doc_id::VARCHAR AS key, md5(text) AS text_md5, lang FROM documents")
def tar_roundtrip(spark, sf):
    """Documents written as tar shards of 100 samples, read back, and their members grouped to samples."""
    path = scratch_path(spark, "shards")
    tars.write_shards(table(spark, sf, "documents"), path, "doc_id", {"txt": "text", "lang": "lang"}, per_shard=100)
    samples = S.group_members(shards.samples(tars.read_shards(spark, path)))
    text = lambda name: F.decode(F.col("data")[name], "UTF-8")
    return samples.select("key", F.md5(text("txt")).alias("text_md5"), text("lang").alias("lang"))


@query("tar_ranges", "SELECT coalesce(source, 'none') AS shard, doc_id::VARCHAR AS key, md5(text) AS text_md5, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS ord FROM documents WHERE text IS NOT NULL")
def tar_ranges(spark, sf):
    """A shard for each source, read in ranges of about 16 kB: most shards are cut, and some documents are larger than a range."""
    path, d = scratch_path(spark, "ranges"), table(spark, sf, "documents")
    tars.write_shards(d, path, "doc_id", {"txt": "text"}, shard=F.coalesce("source", F.lit("none")))
    m = tars.read_shards(spark, path, split_bytes=16 << 10)
    return m.select(F.regexp_extract("shard", r"([^/]*)\.tar$", 1).alias("shard"), F.regexp_replace("member", r"\..*", "").alias("key"), F.md5("payload").alias("text_md5"), "ord")


#: A member is a header of 512 bytes and its bytes up to a multiple of 512; behind all of them, a file is zeros up to a multiple of 10,240 bytes.
_TAR_LAYOUT = """m AS (SELECT doc_id, doc_id // 20 AS s, text, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, sum(512 + (n + 511) // 512 * 512) OVER (PARTITION BY s ORDER BY doc_id) AS nxt, sum(512 + (n + 511) // 512 * 512) OVER (PARTITION BY s) AS total FROM m),
cut AS (SELECT *, CASE WHEN s % 3 = 0 THEN ((total + 1024 + 10239) // 10240 * 10240) * 3 // 5 ELSE 1e18::BIGINT END AS cut, nxt - (n + 511) // 512 * 512 + n AS stop FROM placed),
kept AS (SELECT * FROM cut WHERE stop <= cut)"""


@query(
    "tar_rejects",
    f"""WITH {_TAR_LAYOUT} SELECT s::VARCHAR AS shard, doc_id::VARCHAR AS key, md5(text) AS text_md5, false AS rejected FROM kept
    UNION ALL SELECT s::VARCHAR, NULL, NULL, true FROM (SELECT s, any_value(cut) AS cut, count(*) AS n FROM cut GROUP BY s) c LEFT JOIN (SELECT s, max(nxt) AS nxt, count(*) AS k FROM kept GROUP BY s) k USING (s) WHERE cut > coalesce(nxt, 0) AND coalesce(k, 0) < n""",
)
def tar_rejects(spark, sf):
    """Shards of twenty documents, each third of them broken off after three fifths of its bytes: their whole members come
    through in ranges, and the damage of each is one row."""
    path = scratch_path(spark, "broken")
    tars.write_shards(table(spark, sf, "documents"), f"{path}/whole", "doc_id", {"txt": "text"}, shard=F.floor(F.col("doc_id") / 20))
    cut_shards(spark, f"{path}/whole", f"{path}/cut")
    m = tars.read_shards(spark, f"{path}/cut", split_bytes=32 << 10)
    shard = F.regexp_extract("shard", r"([^/]*)\.tar$", 1).alias("shard")
    return m.select(shard, F.regexp_replace("member", r"\..*", "").alias("key"), F.md5("payload").alias("text_md5"), F.col("error").isNotNull().alias("rejected"))


def cut_shards(spark, source: str, target: str) -> None:
    """Copies of shards by tasks; those whose number is divisible by three get three fifths of their bytes."""

    def copy(batches):
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                left = size * 3 // 5 if int(name.split(".")[0]) % 3 == 0 else size
                (src, at), (dst, to) = tars.file_system(path), tars.file_system(f"{target}/{name}")
                dst.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with src.open_input_file(at) as f, dst.open_output_stream(to) as out:
                    while left and (part := f.read(min(left, 1 << 20))):
                        out.write(part)
                        left -= len(part)
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    files = spark.createDataFrame(tars.list_shards(source), "path string, size long")
    files.repartition(max(8, min(1000, files.count() // 100))).mapInArrow(copy, "name string").write.format("noop").mode("overwrite").save()


@query(
    "shard_ingest",
    f"""WITH {_TAR_LAYOUT} SELECT s::VARCHAR AS shard, doc_id::VARCHAR AS key, md5(text) AS text_md5, false AS rejected FROM kept
    UNION ALL SELECT s::VARCHAR, NULL, NULL, true FROM (SELECT s, any_value(cut) AS cut, count(*) AS n FROM cut GROUP BY s) c LEFT JOIN (SELECT s, max(nxt) AS nxt, count(*) AS k FROM kept GROUP BY s) k USING (s) WHERE cut > coalesce(nxt, 0) AND coalesce(k, 0) < n""",
)
def shard_ingest(spark, sf):
    """A stream of shards, some broken off, that fails in its second batch after its samples are written, and is started again:
    each sample and each reject once."""
    path = scratch_path(spark, "ingest")
    d = table(spark, sf, "documents")
    tars.write_shards(d, f"{path}/whole", "doc_id", {"txt": "text"}, shard=F.floor(F.col("doc_id") / 20))
    cut_shards(spark, f"{path}/whole", f"{path}/in")
    per_batch = -(-len(tars.list_shards(f"{path}/in")) // 4)

    def fail(epoch: int) -> None:
        if epoch == 1:
            raise RuntimeError("stopped in the second batch")

    run = lambda hook: ingest.ingest_shards(spark, f"{path}/in", f"{path}/out", f"{path}/c", per_batch=per_batch, split_bytes=32 << 10, after_write=hook)
    try:
        run(fail).awaitTermination()
    except StreamingQueryException:
        pass
    run(None).awaitTermination()
    shard = F.regexp_extract("shard", r"([^/]*)\.tar$", 1).alias("shard")
    good = ingest.ingested(spark, f"{path}/out").select(shard, "key", F.md5(F.col("data")["txt"]).alias("text_md5"), F.lit(False).alias("rejected"))
    return good.unionByName(ingest.ingested(spark, f"{path}/out", "rejects").select(shard, F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text_md5"), F.lit(True).alias("rejected")))


@query("sample_keys", "SELECT doc_id, md5(doc_id::VARCHAR) AS key FROM documents")
def sample_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sample_key(F.col("doc_id")).alias("key"))


@query("merge_results", "SELECT source AS id, arg_min(lang, doc_id) AS answer FROM documents GROUP BY 1")
def merged(spark, sf):
    """Ranks' results, the first for each id in rank order."""
    r = table(spark, sf, "documents").select(F.col("source").alias("id"), F.col("lang").alias("answer"), F.floor(F.col("doc_id") / 300).alias("rank"), F.col("doc_id").alias("place"))
    return merge_results(r, "id", "rank", "place").select("id", "answer")


@query("flatten_sample", "SELECT doc_id::VARCHAR AS key, lang, source, '{}' AS metadata FROM documents")
def flatten_sample(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("shard/00/"), F.col("doc_id").cast("string")).alias("key"), F.struct("lang", F.lit("x").alias("source")).alias("a"), F.struct("source").alias("b"))
    return S.flatten_sample(d, ["a", "b"], key="key").select("key", "lang", "source", "metadata")


_BLANK = "trim(text, ' ;,[]{}''\".?:') <> ''"
_U = u01_sql("doc_id", "direction")
_IMG = image_tokens_sql(image_ids_sql("doc_id"))


@query(
    "pipeline_caption",
    f"""WITH t AS (SELECT doc_id, [1] || {A.word_ids_sql(f"(CASE WHEN {_U} < 0.5 THEN {_IMG} || text ELSE text || {_IMG} END)")} || [2] AS ids FROM documents WHERE {_BLANK})
    SELECT doc_id, e::INTEGER AS epoch, md5(doc_id::VARCHAR || ':' || (5 + e)) AS shuffle_key, {joined_sql('list_transform(range(1, 33), lambda k: CASE WHEN k <= len(ids) THEN ids[k] ELSE 0 END)')} AS input_ids FROM t, range(0, 2) x(e)""",
)
def pipeline_caption(spark, sf):
    """A declared pipeline from source to shuffled, repeated samples."""
    src = table(spark, sf, "documents").select("doc_id", "text", image_ids(F.col("doc_id")).alias("image_ids"))
    out = P.build("pretrain_caption", src, "doc_id", cycle_count=2, seed=5, max_length=32)
    return out.select("doc_id", "epoch", "shuffle_key", A.joined(F.col("input_ids")).alias("input_ids"))


@query("pipeline_batches", "SELECT ((row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':5'), doc_id) - 1) // 32)::BIGINT AS batch, doc_id FROM documents")
def pipeline_batches(spark, sf):
    src = table(spark, sf, "documents").select("doc_id", image_ids(F.col("doc_id")).alias("image_ids"), F.col("lang").alias("question"), F.col("source").alias("answer"))
    out = P.build("sft_qa", src, "doc_id", batch_size=32, seed=5, max_length=32)
    return out.select(F.col("batch").cast("long").alias("batch"), "doc_id")


@query("dataset_vqa", "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS instance_id, source AS image, lang AS text_input, doc_id AS question_id FROM documents")
def dataset_vqa(spark, sf):
    """A named dataset's evaluation samples from annotations."""
    a = table(spark, sf, "documents").select("doc_id", F.col("source").alias("image"), F.col("lang").alias("question"), F.col("doc_id").alias("question_id"))
    return D.load("coco_vqa", a, "doc_id", "val").select("instance_id", "image", "text_input", "question_id")


#: What is built for the documents of each language.
_BUILT = {"en": ("pipeline", "pretrain_text"), "fr": ("pipeline", "sft_qa"), "de": ("dataset", "coco_vqa"), "es": ("dataset", "coco_caption")}


@query("catalog_names", f"SELECT doc_id, CASE lang {' '.join(f'WHEN {q(k)} THEN {q(v[0])}' for k, v in _BUILT.items())} END AS kind, CASE lang {' '.join(f'WHEN {q(k)} THEN {q(v[1])}' for k, v in _BUILT.items())} END AS name, CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'qa' END AS render FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def catalog_names(spark, sf):
    """What the registry holds under the names that documents ask for by their language, and how pipelines among them render."""
    from loomwright.plans.registry import REGISTRY

    asked = [(lang, kind, name, getattr(REGISTRY.get(kind, name), "render", None)) for lang, (kind, name) in _BUILT.items() if name in REGISTRY.names(kind)]
    held = spark.createDataFrame(asked, "lang string, kind string, name string, render string")
    return table(spark, sf, "documents").join(F.broadcast(held), "lang").select("doc_id", "kind", "name", "render")


@query("download_report", "SELECT page_id, CASE WHEN contains(url, 'spam') THEN 404 ELSE 200 END AS status, octet_length(encode(html)) AS size FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id < 50)")
def download_report(spark, sf):
    """Fetches that are not done yet, with their status; the network is a column here."""
    from loomwright.operators.relational import unfinished

    p = table(spark, sf, "pages")
    left = unfinished(p, p.where("page_id < 50").select("page_id"), "page_id")
    return left.select("page_id", F.when(F.contains("url", F.lit("spam")), 404).otherwise(200).alias("status"), F.octet_length("html").cast("long").alias("size"))
