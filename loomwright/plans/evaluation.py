"""Queries over codebooks, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import schedules as L
from loomwright.functions import vectors as V
from loomwright.operators import metrics as E
from loomwright.operators import retrieval as R
from loomwright.operators import vq as Q
from loomwright.plans.catalog import query
from loomwright.plans.common import table

CODES = 32


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("vec"))


def _codebook(spark, sf):
    return _vectors(spark, sf).where(F.col("vec_id") < CODES).select(F.col("vec_id").cast("int").alias("code"), "vec")


#: v (vectors as doubles), near (id, code, dist) with ties to the lower code.
_SUM = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {e}), lambda x, y: x + y)"
_D2 = _SUM.format(a="v.e", e="(v.e[i] - c.e[i]) * (v.e[i] - c.e[i])")
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_U = "u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_reduce(list_transform(e, lambda z: z * z), lambda p, r: p + r))) AS e FROM v)"
_NEAR = f"""{_V}, pairs AS (SELECT v.vec_id, c.vec_id AS code, {_D2} AS dist FROM v, (SELECT * FROM v WHERE vec_id < {CODES}) c),
near AS (SELECT vec_id, code, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) AS k FROM pairs) WHERE k = 1)"""


@query("vq_assign", f"WITH {_NEAR} SELECT vec_id AS id, code::INTEGER AS code, round(dist, 6) AS dist FROM near")
def vq_assign(spark, sf):
    return Q.assign(_vectors(spark, sf), _codebook(spark, sf)).select("id", "code", F.round("dist", 6).alias("dist"))


@query("vq_assign_large", f"WITH {_NEAR} SELECT vec_id AS id, code::INTEGER AS code, round(dist, 6) AS dist FROM near")
def vq_assign_large(spark, sf):
    out = Q.assign_large(_vectors(spark, sf), _codebook(spark, sf))
    return out.select("id", "code", (F.round("dist", 6) + 0.0).alias("dist"))


@query("vq_usage", f"WITH {_NEAR} SELECT c::INTEGER AS code, count(near.code) AS n FROM range(0, {CODES}) t(c) LEFT JOIN near ON near.code = c GROUP BY c")
def vq_usage(spark, sf):
    return Q.usage(Q.assign(_vectors(spark, sf), _codebook(spark, sf)), CODES)


@query("vq_perplexity", f"WITH {_NEAR}, n AS (SELECT count(*)::DOUBLE AS n FROM near GROUP BY code), p AS (SELECT n / sum(n) OVER () AS p FROM n) SELECT round(exp(-sum(p * ln(p + 1e-10))), 6) AS perplexity FROM p")
def vq_perplexity(spark, sf):
    n = Q.usage(Q.assign(_vectors(spark, sf), _codebook(spark, sf)), CODES)
    return Q.perplexity(n).select(F.round("perplexity", 6).alias("perplexity"))


_MEANS = f"""{_NEAR}, flat AS (SELECT near.code, i, avg(v.e[i]) AS m FROM near JOIN v USING (vec_id), range(1, 65) t(i) GROUP BY near.code, i), means AS (SELECT code, list(m ORDER BY i) AS m FROM flat GROUP BY code)"""
_SHOW = "array_to_string(list_transform({v}, lambda x: printf('%.4f', round(x, 4) + 0.0)), ' ')"


def _show(v):
    return F.array_join(F.transform(v, lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), " ")


@query("kmeans_step", f"WITH {_MEANS} SELECT code::INTEGER AS code, {_SHOW.format(v='m')} AS vec FROM means")
def kmeans_step(spark, sf):
    """Every code keeps at least its own vector here, so no old word stays."""
    return Q.kmeans_step(_vectors(spark, sf), _codebook(spark, sf)).select("code", _show(F.col("vec")).alias("vec"))


@query("ema_step", f"WITH {_MEANS} SELECT means.code::INTEGER AS code, {_SHOW.format(v='list_transform(range(1, 65), lambda i: 0.99::DOUBLE * v.e[i] + (1 - 0.99::DOUBLE) * m[i])')} AS vec FROM means JOIN v ON v.vec_id = means.code")
def ema_step(spark, sf):
    return Q.ema_step(_vectors(spark, sf), _codebook(spark, sf)).select("code", _show(F.col("vec")).alias("vec"))


@query("vq_smoothed_counts", f"WITH {_NEAR}, n AS (SELECT c, count(near.code)::DOUBLE AS n FROM range(0, {CODES}) t(c) LEFT JOIN near ON near.code = c GROUP BY c) SELECT c::INTEGER AS code, round((n + 1e-5) / (sum(n) OVER () + {CODES} * 1e-5) * sum(n) OVER (), 6) AS n FROM n")
def vq_smoothed_counts(spark, sf):
    n = Q.usage(Q.assign(_vectors(spark, sf), _codebook(spark, sf)), CODES)
    return Q.smoothed_counts(n, CODES).select("code", F.round("n", 6).alias("n"))


@query("vq_remap", f"WITH {_NEAR} SELECT vec_id AS id, code::INTEGER AS code, CASE WHEN code % 2 = 0 THEN (code // 2)::INTEGER ELSE -1 END AS place FROM near")
def vq_remap(spark, sf):
    used = spark.range(CODES // 2).select((F.col("id") * 2).cast("int").alias("code"), F.col("id").cast("int").alias("place"))
    return Q.remap(Q.assign(_vectors(spark, sf), _codebook(spark, sf)), used)


@query("vq_loss", f"WITH {_NEAR} SELECT round(1.25 * avg(dist), 6) AS loss FROM near")
def vq_loss(spark, sf):
    return Q.commitment(Q.assign(_vectors(spark, sf), _codebook(spark, sf))).select(F.round("loss", 6).alias("loss"))


_DOT = _SUM.format(a="q.e", e="q.e[i] * t.e[i]")
_SCORES = f"{_V}, {_U}, s AS (SELECT q.vec_id AS i, t.vec_id AS j, {_DOT} AS score, q.label = t.label AS hit FROM u q, u t WHERE q.vec_id % 20 = 0 AND t.vec_id <> q.vec_id)"


def _sides(spark, sf):
    """Each vector whose id is divisible by 20 as a query, against all vectors but itself."""
    v = _vectors(spark, sf)
    return v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "i"), v.withColumnRenamed("vec_id", "j")


@query("topk_scores", f"WITH {_SCORES} SELECT i, j, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM s) WHERE k <= 8")
def topk_scores(spark, sf):
    return R.top_k(*_sides(spark, sf), 8, same=True).select("i", "j", "rank")


@query("topk_filled", f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM s) SELECT i, count(*) FILTER (k <= 8) AS kept, count(*) FILTER (k > 8) AS filled, -100.0::DOUBLE AS fill, round(sum(score) FILTER (k <= 8), 6) AS kept_sum FROM r GROUP BY i")
def topk_filled(spark, sf):
    kept, filled = R.filled_top_k(*_sides(spark, sf), 8, same=True)
    return kept.groupBy("i").agg(F.count("*").alias("kept"), F.round(F.sum("score"), 6).alias("kept_sum")).join(filled, "i").select("i", "kept", "filled", "fill", "kept_sum")


_RECALL = ", ".join(f"round(100 * avg((rank <= {k})::INTEGER), 6) AS {{p}}{k}" for k in (1, 5, 10))


@query(
    "recall_at_k",
    f"""WITH {_SCORES}, a AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY score DESC, i) AS rj FROM s),
    t AS (SELECT i, min(ri) AS rank FROM a WHERE hit GROUP BY i), m AS (SELECT j, min(rj) AS rank FROM a WHERE hit GROUP BY j),
    x AS (SELECT {_RECALL.format(p='txt_r')} FROM t), y AS (SELECT {_RECALL.format(p='img_r')} FROM m)
    SELECT *, round((txt_r1 + txt_r5 + txt_r10) / 3, 4) AS agg_metrics FROM x, y""",
)
def recall_at_k(spark, sf):
    """Vectors of one label are true partners."""
    r = R.recall_report(*_sides(spark, sf), "label", same=True)
    return r.select(*[F.round(f"{p}{k}", 6).alias(f"{p}{k}") for p in ("txt_r", "img_r") for k in (1, 5, 10)], F.round("agg_metrics", 4).alias("agg_metrics"))


@query(
    "best_ranks",
    f"""WITH {_SCORES}, a AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY score DESC, i) AS rj FROM s)
    SELECT 'i' AS side, i AS id, min(ri) AS rank FROM a WHERE hit GROUP BY i UNION ALL SELECT 'j', j, min(rj) FROM a WHERE hit GROUP BY j""",
)
def best_ranks(spark, sf):
    """The rank of each side's best true partner."""
    return R.best_ranks(*_sides(spark, sf), "label", same=True)


@query(
    "two_stage_rank",
    """WITH c AS (SELECT l_orderkey AS question, l_linenumber AS answer, max(l_extendedprice) AS score, min(l_quantity) AS loss FROM lineitem GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, answer) AS k FROM c)
    SELECT question, arg_min(answer, {'l': loss, 'a': answer}) AS answer FROM f WHERE k <= 3 GROUP BY question""",
)
def two_stage_rank(spark, sf):
    """Three candidates by a first score, the one of least loss among them."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("answer")).agg(F.max("l_extendedprice").alias("score"), F.min("l_quantity").alias("loss"))
    return R.two_stage(li.select("question", "answer", "score"), li.select("question", "answer", "loss"), 3)


_ZERO = f"""{_V}, {_U}, f AS (SELECT label, i, avg(e[i]) AS m FROM u, range(1, 65) t(i) WHERE vec_id % 2 = 0 GROUP BY label, i), g AS (SELECT label, list(m ORDER BY i) AS e FROM f GROUP BY label),
w AS (SELECT label, list_transform(e, lambda x: x / sqrt(list_reduce(list_transform(e, lambda z: z * z), lambda p, r: p + r))) AS e FROM g),
z AS (SELECT q.vec_id, q.label, t.label AS c, {_DOT} AS s FROM u q, w t), b AS (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS k FROM z)"""


def _zero(spark, sf):
    v = _vectors(spark, sf)
    return R.zero_shot(v, R.class_vectors(v.where("vec_id % 2 = 0")))


@query("zero_shot", f"WITH {_ZERO} SELECT vec_id AS id, c AS predicted FROM b WHERE k = 1")
def zero_shot(spark, sf):
    return _zero(spark, sf).select("id", "predicted")


@query("zero_shot_acc", f"WITH {_ZERO} SELECT round(100 * avg((c = label)::INTEGER), 6) AS accuracy FROM b WHERE k = 1")
def zero_shot_acc(spark, sf):
    z = _zero(spark, sf).join(_vectors(spark, sf).select(F.col("vec_id").alias("id"), "label"), "id")
    return z.agg(F.round(100 * F.avg((F.col("predicted") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("classification_acc", "SELECT round(100 * avg((list_position(embedding, list_max(embedding)) - 1 = label)::INTEGER), 6) AS accuracy FROM embeddings")
def classification_acc(spark, sf):
    """Whole vectors stand for logits."""
    e = table(spark, sf, "embeddings").select(F.col("embedding").alias("logits"), "label")
    return E.classification_accuracy(e, "logits", "label").select(F.round("accuracy", 6).alias("accuracy"))


_SQUARE = f"{_V}, {_U}, s AS (SELECT q.vec_id // 64 AS batch, q.vec_id AS i, t.vec_id AS j, {_DOT} AS score, {_DOT} / 0.07::DOUBLE AS z FROM u q JOIN u t ON q.vec_id // 64 = t.vec_id // 64)"
_SIDE = "(SELECT batch, avg(lse - 0.9 * own - 0.1 * m) AS l FROM (SELECT batch, max(z) + ln(sum(exp(z - t))) AS lse, sum(CASE WHEN i = j THEN z END) AS own, avg(z) AS m FROM (SELECT *, max(z) OVER (PARTITION BY {k}) AS t FROM s) GROUP BY batch, {k}) GROUP BY batch)"


def _square(spark, sf):
    """All vectors in batches of 64 by id."""
    v = _vectors(spark, sf).select(F.floor(F.col("vec_id") / 64).cast("long").alias("batch"), "vec_id", F.col("vec").alias("a"), F.col("vec").alias("b"))
    return R.in_batch_scores(v, "batch", "vec_id")


@query("contrastive_loss", f"WITH {_SQUARE} SELECT batch::BIGINT AS batch, round((a.l + b.l) / 2, 6) AS loss FROM {_SIDE.format(k='i')} a JOIN {_SIDE.format(k='j')} b USING (batch)")
def contrastive_loss(spark, sf):
    return R.contrastive_loss(_square(spark, sf)).select("batch", F.round("loss", 6).alias("loss"))


@query("hard_negatives", f"WITH {_SQUARE}, p AS (SELECT i, j, exp(score) / sum(exp(score)) OVER (PARTITION BY i) + 1e-4 AS w FROM s) SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE w END, 9) AS weight FROM p")
def hard_negatives(spark, sf):
    return R.in_batch_negatives(_square(spark, sf)).select("i", "j", F.round("weight", 9).alias("weight"))


_ANSWERS = "a AS (SELECT l_orderkey AS k, list({'answer_id': l_linenumber, 'answer': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS a FROM lineitem GROUP BY 1)"
_SOFT = "list_avg(list_transform(a, lambda g: least(1.0::DOUBLE, len(list_filter(a, lambda o: (o.answer_id <> g.answer_id OR o.answer <> g.answer) AND o.answer = {p})) / 3.0::DOUBLE)))"


def _answers(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("answer_id"), F.col("l_returnflag").alias("answer")))).alias("a"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("pred"), "o_orderpriority", "o_orderstatus")
    return li.join(o, "k")


_JOINED = f"{_ANSWERS}, j AS (SELECT a.k, a.a, CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END AS pred, o_orderpriority, o_orderstatus FROM a JOIN orders ON o_orderkey = a.k)"


@query("soft_accuracy", f"WITH {_JOINED} SELECT k, round({_SOFT.format(p='pred')}, 9) AS accuracy FROM j")
def soft_accuracy(spark, sf):
    return _answers(spark, sf).select("k", F.round(E.soft_accuracy(F.col("pred"), F.col("a")), 9).alias("accuracy"))


@query("direct_accuracy", f"WITH {_JOINED} SELECT k, least(1.0::DOUBLE, len(list_filter(a, lambda o: o.answer = pred)) / 3.0::DOUBLE) AS accuracy FROM j")
def direct_accuracy(spark, sf):
    return _answers(spark, sf).select("k", E.direct_accuracy(F.col("pred"), F.transform("a", lambda x: x["answer"])).alias("accuracy"))


@query(
    "accuracy_by_type",
    f"""WITH {_JOINED}, s AS (SELECT o_orderpriority AS q, o_orderstatus AS t, {_SOFT.format(p='pred')} AS x FROM j)
    SELECT 'overall' AS kind, '' AS value, round(100 * avg(x), 2) AS accuracy FROM s UNION ALL SELECT 'o_orderpriority', q, round(100 * avg(x), 2) FROM s GROUP BY q UNION ALL SELECT 'o_orderstatus', t, round(100 * avg(x), 2) FROM s GROUP BY t""",
)
def accuracy_by_type(spark, sf):
    """Overall, by question type and by answer type in one pass."""
    d = _answers(spark, sf).withColumn("acc", E.soft_accuracy(F.col("pred"), F.col("a")))
    return E.accuracy_report(d, "acc", "o_orderpriority", "o_orderstatus")


@query("exact_match", "SELECT round(100 * avg((o_orderstatus = CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END)::INTEGER), 6) AS accuracy FROM orders")
def exact_match(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 100000, "F").otherwise("O").alias("gt"))
    return E.exact_match(o, "o_orderstatus", "gt").select(F.round("accuracy", 6).alias("accuracy"))


@query("answer_weights", f"WITH {_ANSWERS}, x AS (SELECT k, unnest(a).answer AS ans, unnest(range(1, len(a) + 1)) AS p, len(a) AS n FROM a), g AS (SELECT k, ans, min(p) AS f, count(*) / max(n)::DOUBLE AS w FROM x GROUP BY k, ans) SELECT k, string_agg(ans || ':' || printf('%.4f', w), ' ' ORDER BY f) AS weights FROM g GROUP BY k")
def answer_weights(spark, sf):
    w = E.answer_weights(F.transform("a", lambda x: x["answer"]))
    return _answers(spark, sf).select("k", F.array_join(F.transform(w, lambda x: F.concat(x["answer"], F.lit(":"), F.format_string("%.4f", x["weight"]))), " ").alias("weights"))


@query("candidate_answers", "WITH g AS (SELECT o_orderpriority AS a, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1 ORDER BY n DESC, f LIMIT 30) SELECT string_agg(a || '.', '|' ORDER BY n DESC, f) || '|yes.' AS candidates FROM g")
def candidate_answers(spark, sf):
    out = E.candidate_answers(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("answer"), "o_orderkey"), "answer", "o_orderkey")
    return out.select(F.array_join("candidates", "|").alias("candidates"))


_PROBS = f"{_V}, p AS (SELECT vec_id, vec_id % 4 AS s, list_transform(e, lambda x: exp(x - list_max(e))) AS x FROM v), n AS (SELECT vec_id, s, list_transform(x, lambda y: y / list_sum(x)) AS p FROM p)"


@query(
    "inception_score",
    f"""WITH {_PROBS}, f AS (SELECT vec_id, s, i, p[i] AS p FROM n, range(1, 65) t(i)), g AS (SELECT *, avg(p) OVER (PARTITION BY s, i) AS q FROM f),
    e AS (SELECT s, exp(sum(p * (ln(p) - ln(q))) / count(DISTINCT vec_id)) AS e FROM g GROUP BY s) SELECT round(avg(e), 9) AS is_mean, round(stddev_pop(e), 9) AS is_std FROM e""",
)
def inception_score(spark, sf):
    d = _vectors(spark, sf).select("vec_id", V.softmax(F.col("vec")).alias("p"))
    return E.inception_score(d, "p", F.col("vec_id") % 4).select(F.round("is_mean", 9).alias("is_mean"), F.round("is_std", 9).alias("is_std"))


_COVAR = "SELECT i, j, covar_samp(e[i], e[j]) AS c FROM (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 2 = {}), range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j"


@query(
    "fid_moments",
    f"""WITH a AS ({_COVAR.format(0)}), b AS ({_COVAR.format(1)}), m AS (SELECT vec_id % 2 AS p, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
    SELECT (SELECT round(sum((x.m - y.m) ** 2), 6) FROM m x JOIN m y USING (i) WHERE x.p = 0 AND y.p = 1) AS mean_gap, (SELECT round(sum(c), 6) FROM a WHERE i = j) AS trace_a, (SELECT round(sum(c), 6) FROM b WHERE i = j) AS trace_b, (SELECT round(sum(a.c * b.c), 6) FROM a JOIN b ON a.i = b.j AND a.j = b.i) AS trace_ab""",
)
def fid_moments(spark, sf):
    """What the distance of distributions is made of, from tables of tiles: means, covariances and their product."""
    v = _vectors(spark, sf)
    (_, m1, c1), (_, m2, c2) = (E.gram(v.where(f"vec_id % 2 = {i}").select("vec"), "vec", tile=24) for i in (0, 1))
    traces = [E.tile_trace(c, 24) for c in (c1, c2, E.tile_product(c1, c2, len(m1), 24))]
    return spark.createDataFrame([(round(float(((m1 - m2) ** 2).sum()), 6), *[round(t, 6) for t in traces])], "mean_gap double, trace_a double, trace_b double, trace_ab double")


@query("entropy", f"WITH {_PROBS} SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) AS entropy FROM n")
def entropy(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(V.entropy(V.softmax(F.col("vec"))), 9).alias("entropy"))


@query("fid")
def fid(spark, sf):
    """Even against odd vectors; the eigenvalues have no SQL, so the tests compare with numpy."""
    v = _vectors(spark, sf)
    return spark.createDataFrame([(round(E.fid(v.where("vec_id % 2 = 0").select("vec"), v.where("vec_id % 2 = 1").select("vec")), 6),)], "fid double")


def _captions(spark, sf):
    """Each document as a caption, and as its references the text without its first two words, and without its first and last."""
    w = F.filter(F.split("text", " "), lambda x: x != "")
    n = F.size("w")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("c"), w.alias("w"))
    cut = lambda at, less: F.array_join(F.slice("w", at, F.greatest(n - less, F.lit(0))), " ")
    return d.select("doc_id", "c", F.array(cut(3, 2), cut(2, 2)).alias("r"))


#: w (doc_id, p: 0 the caption, 1 and 2 its references, ws: words) and g (doc_id, p, n, g, f: counts of n-grams).
_GRAMS = """d AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, 0 AS p, ws FROM d UNION ALL SELECT doc_id, 1, coalesce(ws[3:], []) FROM d UNION ALL SELECT doc_id, 2, coalesce(ws[2:greatest(len(ws) - 1, 1)], []) FROM d),
o AS (SELECT doc_id, p, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT doc_id, p, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS g, count(*) AS f FROM o, range(1, 5) t(n) WHERE pos + n - 1 <= len(ws) GROUP BY ALL)"""


@query(
    "bleu",
    f"""WITH {_GRAMS}, m AS (SELECT c.n, sum(least(c.f, r.f)) AS m FROM g c JOIN (SELECT doc_id, n, g, max(f) AS f FROM g WHERE p > 0 GROUP BY ALL) r ON c.doc_id = r.doc_id AND c.n = r.n AND c.g = r.g WHERE c.p = 0 GROUP BY c.n),
    t AS (SELECT n, sum(f) AS t FROM g WHERE p = 0 GROUP BY n),
    l AS (SELECT sum(len(c.ws)) AS cl, sum(list_min([{{'d': abs(len(a.ws) - len(c.ws)), 'n': len(a.ws)}}, {{'d': abs(len(b.ws) - len(c.ws)), 'n': len(b.ws)}}]).n) AS rl FROM w c JOIN w a ON a.doc_id = c.doc_id AND a.p = 1 JOIN w b ON b.doc_id = c.doc_id AND b.p = 2 WHERE c.p = 0),
    x AS (SELECT t.n, ln((coalesce(m.m, 0) + 1e-15::DOUBLE) / (t.t + 1e-9::DOUBLE)) AS x FROM t LEFT JOIN m ON m.n = t.n), b AS (SELECT CASE WHEN cl < rl THEN exp(1 - rl / cl::DOUBLE) ELSE 1.0::DOUBLE END AS b FROM l)
    SELECT {', '.join(f"round((SELECT b FROM b) * exp(sum(x) FILTER (n <= {k}) / {k}), 6) AS bleu{k}" for k in (1, 2, 3, 4))} FROM x""",
)
def bleu(spark, sf):
    return E.bleu(_captions(spark, sf), "doc_id", "c", "r").select(*[F.round(f"bleu{n}", 6).alias(f"bleu{n}") for n in range(1, 5)])


@query("rouge_l")
def rouge_l(spark, sf):
    """Longest common subsequences of whole texts have no SQL; the tests compare with a table of lengths."""
    return E.rouge_l_mean(_captions(spark, sf), "c", "r").select(F.round("rouge_l", 6).alias("rouge_l"))


@query(
    "meteor",
    """WITH n AS (SELECT len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS n FROM documents)
    SELECT round(avg(CASE WHEN n > 2 THEN 10 * ((n - 2) / n) / (1 + 9 * (n - 2) / n) * (1 - 0.5 * (1 / (n - 2)) ** 3) ELSE 0 END), 6) AS meteor FROM n""",
)
def meteor(spark, sf):
    """Sequential matching; the tests compare with worked examples."""
    return E.meteor_mean(_captions(spark, sf), "c", "r").select(F.round("meteor", 6).alias("meteor"))


@query(
    "cider",
    f"""WITH {_GRAMS}, f AS (SELECT n, g, count(DISTINCT doc_id) AS d FROM g WHERE p > 0 GROUP BY ALL), i AS (SELECT ln((SELECT count(*) FROM documents)::DOUBLE) AS n),
    x AS (SELECT g.doc_id, g.p, g.n, g.g, g.f * ((SELECT n FROM i) - ln(coalesce(f.d, 1)::DOUBLE)) AS w FROM g LEFT JOIN f ON f.n = g.n AND f.g = g.g),
    z AS (SELECT doc_id, p, n, sqrt(sum(w * w)) AS o FROM x GROUP BY ALL),
    s AS (SELECT r.doc_id, r.p, r.n, sum(least(c.w, r.w) * r.w) AS s FROM x c JOIN x r ON r.doc_id = c.doc_id AND r.n = c.n AND r.g = c.g WHERE c.p = 0 AND r.p > 0 GROUP BY ALL),
    k AS (SELECT s.doc_id, s.p, sum(CASE WHEN a.o > 0 AND b.o > 0 THEN s.s / a.o / b.o ELSE 0 END) AS k FROM s JOIN z a ON a.doc_id = s.doc_id AND a.n = s.n AND a.p = 0 JOIN z b ON b.doc_id = s.doc_id AND b.n = s.n AND b.p = s.p GROUP BY ALL)
    SELECT c.doc_id, round(avg(10 * coalesce(k.k, 0) / 4 * exp(-pow(len(c.ws) - len(r.ws), 2) / 72.0::DOUBLE)), 6) AS cider FROM w c JOIN w r ON r.doc_id = c.doc_id AND r.p > 0 LEFT JOIN k ON k.doc_id = r.doc_id AND k.p = r.p WHERE c.p = 0 GROUP BY c.doc_id""",
)
def cider(spark, sf):
    return E.cider(_captions(spark, sf), "doc_id", "c", "r").select("doc_id", F.round("cider", 6).alias("cider"))


_METER = "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query("meter_window", f"SELECT event_id, round(avg(value) OVER w, 6) AS window_avg, list_sort(list(value) OVER w)[((len(list(value) OVER w) - 1) // 2)::INTEGER + 1] AS window_median, max(value) OVER w AS window_max, round(sum(value) OVER g, 2) AS global_sum {_METER}")
def meter_window(spark, sf):
    """Means, lower medians and maxima over the last twenty values of each meter."""
    m = E.meter_window(table(spark, sf, "events"), "event_type", ["ts", "event_id"], "value")
    return m.select("event_id", F.round("window_avg", 6).alias("window_avg"), "window_median", "window_max", F.round(F.col("global_avg") * F.col("global_n"), 2).alias("global_sum"))


@query("meter_global", "SELECT event_type, round(sum(value) / count(*), 6) AS global_avg FROM events GROUP BY 1")
def meter_global(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("value"), 6).alias("global_avg"))


@query("lower_median", "SELECT event_type, list_sort(list(value))[((count(*) - 1) // 2)::INTEGER + 1] AS median FROM events GROUP BY 1")
def lower_median(spark, sf):
    return E.lower_median(table(spark, sf, "events"), "event_type", "value")


@query("dataset_sizes", "SELECT sum(n)::BIGINT AS total, round(avg(n), 6) AS mean_size FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def dataset_sizes(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").count()
    return n.agg(F.sum("count").alias("total"), F.round(F.avg("count"), 6).alias("mean_size"))


@query("best_checkpoint", "SELECT o_orderkey AS epoch, o_totalprice AS agg_metrics FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_checkpoint(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("epoch"), F.when(F.col("o_orderstatus") == "F", "val").otherwise("test").alias("split"), F.col("o_totalprice").alias("agg_metrics"))
    return E.best_checkpoint(o).select("epoch", "agg_metrics")


_STEPS = "(SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS s FROM events)"


def _steps(spark, sf):
    """The events of each type as the logged steps of a run."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", (F.row_number().over(w) - 1).alias("s"))


@query("lr_cosine", f"SELECT event_id, round(CASE WHEN s < 100 THEN s / 100.0::DOUBLE ELSE greatest(0.0, 0.5 * (1.1 + 0.9 * cos(pi() * 0.5 * 2 * (s - 100) / 900.0::DOUBLE))) END, 9) AS rate FROM {_STEPS}")
def lr_cosine(spark, sf):
    return _steps(spark, sf).select("event_id", F.round(L.cosine_with_warmup(F.col("s"), 100, 1000, floor=0.1), 9).alias("rate"))


@query("lr_warmup", f"SELECT event_id, round(least(1e-3, 1e-5 + (1e-3 - 1e-5) * s / 500), 12) AS warmup, round((1e-3 - 1e-5) * 0.5 * (1 + cos(pi() * s / 1000)) + 1e-5, 12) AS cosine, round(greatest(1e-5, 1e-3 * pow(0.99, s)), 12) AS step_decay FROM {_STEPS}")
def lr_warmup(spark, sf):
    s = F.col("s")
    return _steps(spark, sf).select("event_id", F.round(L.linear_warmup(s, 500, 1e-5, 1e-3), 12).alias("warmup"), F.round(L.cosine_epochs(s, 1000, 1e-3, 1e-5), 12).alias("cosine"), F.round(L.step_decay(s, 1e-3, 1e-5, 0.99), 12).alias("step_decay"))


@query("image_geometry", "SELECT doc_id, (w - least(w, h)) // 2 AS crop_left, (h - least(w, h)) // 2 AS crop_top, least(w, h) AS side, CASE WHEN w <= h THEN 224 ELSE 224 * w // h END AS new_w, CASE WHEN w <= h THEN 224 * h // w ELSE 224 END AS new_h FROM (SELECT doc_id, 100 + doc_id % 300 AS w, 120 + doc_id % 170 AS h FROM documents)")
def image_geometry(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (100 + F.col("doc_id") % 300).alias("w"), (120 + F.col("doc_id") % 170).alias("h"))
    left, top, side = L.centre_crop(F.col("w"), F.col("h"))
    nw, nh = L.resize_short_side(F.col("w"), F.col("h"), 224)
    return d.select("doc_id", left.cast("long").alias("crop_left"), top.cast("long").alias("crop_top"), side.alias("side"), nw.cast("long").alias("new_w"), nh.cast("long").alias("new_h"))
