"""The training-data queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped, and the sha256 of what stays. A null text is one empty line; rows that repeat an id
    are one document and keep what the smallest id keeps; a row without an id keeps all."""
    from loomwright.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
found AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(f.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN found f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: fingerprint and smallest linked id. Null texts have no words and the fingerprint zero, which links; a row
    without an id has a fingerprint and no component; equal fingerprints are one node."""
    from loomwright.llm.simhash import hex_fingerprint, simhash_groups

    out = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, bits=64, distance=3)
    return out.select(F.col("doc").alias("doc_id"), hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


@_query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: words, its source's words and target, and the words taken. A null text has none; null sources are one source,
    last; rows that repeat an id get the same coin."""
    from loomwright.llm.mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (2 * source_size)::DOUBLE AS cap FROM per),
r AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS rate
      FROM w WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN cap / w >= rate THEN rate END) OVER (), 'infinity'::DOUBLE)) AS target FROM r),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: the base counts and both verdicts. Null texts have no words and fail; repeated rows count each; a null id is
    never trusted. ``llr`` is 0 where there are no words or nothing is trusted."""
    from loomwright.llm.quality import score_quality, trusted_ids

    out = score_quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: where its ids lie. A null text is its end id alone; repeated rows and null ids are documents of their own;
    pieces of equal length and hash are ranked by id, start and checksum."""
    from loomwright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@_query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: its five best. Vectors that are null or hold a null or non-finite component take no part, nor do null ids;
    rows that repeat an id are vectors of their own; ties go to the smaller id."""
    from loomwright.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op7_exact_topk"] = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(NOT isfinite(x::DOUBLE), true)), true)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: score and verdict from the text alone. Null and empty texts get the score of the bias; repeated rows get equal
    scores; a null id is not held out."""
    from loomwright.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: pre-tokens and tokens, both 0 for a null text; repeated rows are counted each."""
    from loomwright.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_pretokens", "n_tokens")


@_query
def op2_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the store's files: start, ids and checksum. A null text is its end id alone; repeated rows are
    documents of their own, next to each other; null ids come last."""
    from loomwright.llm.chunk_store import read_store, write_store
    from loomwright.llm.common import scratch_path

    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-store")
    write_store(docs, path)
    return read_store(spark, path)


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text, "" for null or empty html. A null url has no neighbour; repeated rows are copies of each other."""
    from loomwright.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


#: For pages whose article stands in one article element of h1 and p blocks, as all of the driver's do.
ORACLES["op8_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(regexp_replace(a, '<br>', ' ', 'g'), '</?(?:h1|p)>'),
        lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


@_query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector of 64 finite components: its cluster, distance and sums. Other vectors take no part; rows that repeat an id are
    vectors of their own; a row without an id is clustered, but begins no centroid before those with one."""
    from loomwright.llm.clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64)


def _clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds unrolled: distances of all to all centroids, the nearest, and exact floors of the means."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE len(embedding) = {dims} AND NOT list_contains(list_transform(embedding, lambda x: coalesce(NOT isfinite(x::DOUBLE), true)), true))""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1)::INTEGER AS k, e FROM v QUALIFY k < {k})",
    ]
    nearest = "SELECT v.r, arg_min({{k: c.k, d: list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))}}, (list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * 1000 + c.k)) AS m FROM v CROSS JOIN {c} c GROUP BY v.r"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})")
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (
                SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p)::BIGINT[] AS e FROM (
                  SELECT a.m.k AS k, p, sum(v.e[p])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN v USING (r), range(1, {dims + 1}) t(p) GROUP BY ALL) GROUP BY k) n USING (k))"""
            )
    return (
        f"WITH {', '.join(parts)} SELECT v.vec_id, a.m.k::INTEGER AS cluster, a.m.d::BIGINT AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.k))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.k = a.m.k"
    )


ORACLES["op13_centroid_clustering"] = _clustering_sql()


@_query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: base counts, base spans hashed, all spans listed. Null texts have none; repeated rows are searched each; spans
    that begin together are listed by kind."""
    from loomwright.llm.pii import BASE, find_pii, listed

    out = find_pii(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in BASE]
    base = listed(F.filter("spans", lambda s: s["rank"] < len(BASE)))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _pii_sql() -> str:
    from loomwright.llm.pii import BASE, BEFORE, BEHIND, CHECKSUM, CONTEXT, KINDS

    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    worth = "CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END"
    checks = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: p::DOUBLE)) <= 255",
        "card": f"CASE WHEN length({number}) BETWEEN 14 AND 19 THEN list_sum(list_transform(string_split(reverse({number}), ''), lambda c, i: {worth})) % 10 = 0 ELSE false END",
        "phone": f"length({number}) BETWEEN 10 AND 15",
        "iban": "CASE WHEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 THEN list_reduce([0] || list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1 ELSE false END",
        "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
        "tel": "true",
    }
    parts = []
    for rank, k in enumerate(KINDS):
        near = low.format(f"right(before, {BEFORE}) || chr(10) || left(behind, {BEHIND})")
        score = f"{k.score + CHECKSUM * k.checksum} + CASE WHEN regexp_matches({near}, '(?:^|[^a-z0-9])(?:{k.words})(?:[^a-z0-9]|$)') THEN {CONTEXT} ELSE 0 END"
        apart = "AND NOT regexp_matches(right(before, 1) || '|' || left(behind, 1), '[A-Za-z0-9]')" if k.alone else ""
        parts.append(
            f"""SELECT r, {rank} AS rank, '{k.name}' AS kind, stop - length(m) AS start, stop FROM (
            SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
              SELECT r, unnest(m) AS m, unnest(g[1:len(m)]) AS before, unnest(g[2:]) AS behind, generate_subscripts(m, 1) AS i
              FROM (SELECT r, regexp_extract_all(t, '{k.plain}') AS m, string_split_regex(t, '{k.plain}') AS g FROM d)))
            WHERE {checks[k.name]} {apart} AND {score} >= {k.least}"""
        )
    n = len(BASE)
    counts = ", ".join(f"count(s.r) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    text = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s0 AS ({' UNION ALL '.join(parts)}),
s1 AS (SELECT *, max(CASE WHEN rank < {n} THEN stop END) OVER (PARTITION BY r ORDER BY start, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s0),
s AS (SELECT * FROM s1 WHERE rank < {n} OR reach IS NULL OR stop > reach)
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({text.format(f' FILTER (rank < {n})')}) AS base_sha256, {text.format('')} AS spans FROM d LEFT JOIN s USING (r) GROUP BY d.r
"""


ORACLES["op12_pii"] = _pii_sql()


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word: its form and root. Null and empty texts have no words; a null id is the empty text in the hash; repeated rows
    count each; of near words as frequent as each other the smallest is the form."""
    from loomwright.llm.spelling import group_variants, words_of

    return group_variants(words_of(table(spark, sf_dir, "documents")))
