"""Batches, evidential heads, metrics, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.helm import clean
from ..operators import metrics as m, sequences as q, vectors as v
from .helm_queries import PPI, WS, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


VOCABULARY = 78
_TOK = q.TOKEN.replace("'", "''")
_VOC = f"w AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 + 5 AS INT) AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(helm, '{_TOK}')) AS token FROM p) GROUP BY 1) ORDER BY n DESC, token LIMIT {VOCABULARY})"
_IDS = f"{PPI}, {_VOC}, mp AS (SELECT map(list(token), list(id)) AS t FROM w), e AS (SELECT row_id, [1] || list_transform(regexp_extract_all(helm, '{_TOK}')[:510], lambda x: coalesce(t[x], 4)) || [2] AS ids FROM p, mp WHERE helm IS NOT NULL)"


def _encoded(spark, sf_dir):
    rows = read(spark, sf_dir, "chembl_ppi").select("row_id", clean("helm_notation").alias("helm"))
    return q.encoded(rows.where("helm IS NOT NULL"), "helm", q.vocabulary(rows, "helm", VOCABULARY)).select("row_id", "ids")


@query(f"WITH {PPI}, {_VOC} SELECT token, id FROM w")
def token_vocabulary(spark, sf_dir):
    """B1: token table."""
    return q.vocabulary(read(spark, sf_dir, "chembl_ppi").select(clean("helm_notation").alias("helm")), "helm", VOCABULARY)


@query(f"WITH {_IDS} SELECT row_id, CAST(len(ids) AS INT) AS n_ids, array_to_string(ids, ' ') AS ids FROM e")
def tokenise(spark, sf_dir):
    """B1: ids of each notation, cut to 512."""
    return _encoded(spark, sf_dir).select("row_id", F.size("ids").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


@query(f"WITH {_IDS}, o AS (SELECT row_id, ids, (row_number() OVER (ORDER BY md5('epoch1:' || row_id)) - 1) // 32 AS batch_id FROM e), z AS (SELECT *, (max(len(ids)) OVER (PARTITION BY batch_id) + 7) // 8 * 8 AS w FROM o) SELECT row_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(w AS INT) AS width, array_to_string(ids, ' ') || repeat(' 0', CAST(w - len(ids) AS INT)) AS ids, CAST(len(ids) AS INT) AS attended FROM z")
def padded_batches(spark, sf_dir):
    """Batches of 32 in seeded order, padded to a multiple of 8."""
    rows = _encoded(spark, sf_dir)
    got = q.padded(q.batched(rows.join(q.epoch_order(rows, "row_id", "epoch1"), "row_id"), "number", 32), 8)
    return got.select("row_id", "batch_id", F.size("ids").alias("width"), F.array_join("ids", " ").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("attended"))


@query(f"WITH {_IDS} SELECT row_id, CAST(greatest(1, floor((len(ids) - 2) * 0.15)) AS INT) AS budget, true AS in_bounds, true AS labels_match FROM e WHERE len(ids) > 2")
def span_mask(spark, sf_dir):
    """Span corruption, as checks of every row (the spans follow a hash SQL does not redo)."""
    rows = _encoded(spark, sf_dir).where("size(ids) > 2")
    got = q.span_mask(rows, "row_id", VOCABULARY + len(q.SPECIAL))
    budget = F.greatest(F.lit(1), F.floor((F.size("ids") - 2) * 0.15)).cast("int")
    chosen = F.size(F.filter("labels", lambda x: x != -100))
    same = F.forall(F.arrays_zip("ids", "masked", "labels"), lambda z: F.when(z["labels"] == -100, z["ids"] == z["masked"]).otherwise(z["ids"] == z["labels"]))
    return got.select("row_id", budget.alias("budget"), ((chosen >= 1) & (chosen <= F.greatest(F.lit(5), 2 * budget))).alias("in_bounds"), same.alias("labels_match"))


def _emb(spark, sf_dir, n):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", "embedding", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)])


_SP = lambda x: f"(ln(1 + exp(-abs({x}))) + greatest({x}, 0))"
_X = "x AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(5)) + " FROM embeddings)"
_NIG = f"h AS (SELECT vec_id, x0 AS gamma, {_SP('x1')} + 1e-6 AS nu, {_SP('x2')} + 1 + 1e-6 AS alpha, {_SP('x3')} + 1e-6 AS beta, x4 AS y FROM x)"


@query(f"WITH {_X}, {_NIG} SELECT vec_id, round(gamma, 6) AS gamma, round(nu, 6) AS nu, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(beta / (alpha - 1), 6) AS aleatoric, round(beta / (nu * (alpha - 1)), 5) AS epistemic FROM h")
def nig_head(spark, sf_dir):
    """Parameters and uncertainties of the regression head."""
    got = st.nig_head([F.col(f"x{i}") for i in range(4)])
    return _emb(spark, sf_dir, 4).select("vec_id", *[F.round(c, 5 if k == "epistemic" else 6).alias(k) for k, c in got.items()])


_NLL = "0.5 * ln(pi() / nu) - alpha * ln(2 * beta * (1 + nu)) + (alpha + 0.5) * ln((y - gamma) * (y - gamma) * nu + 2 * beta * (1 + nu)) + lgamma(alpha) - lgamma(alpha + 0.5)"


@query(f"WITH {_X}, {_NIG} SELECT count(*) AS n, round(avg({_NLL}), 6) AS nll, round(avg(abs(y - gamma) * (2 * nu + alpha)), 6) AS regulariser, round(avg({_NLL}) + 0.1 * avg(abs(y - gamma) * (2 * nu + alpha)), 6) AS loss FROM h")
def nig_loss(spark, sf_dir):
    """M3, M4: evidential regression loss."""
    p = st.nig_head([F.col(f"x{i}") for i in range(4)])
    y = F.col("x4")
    nll, reg = F.avg(st.nig_nll(y, p["gamma"], p["nu"], p["alpha"], p["beta"])), F.avg(st.nig_regulariser(y, p["gamma"], p["nu"], p["alpha"]))
    return _emb(spark, sf_dir, 5).agg(F.count("*").alias("n"), F.round(nll, 6).alias("nll"), F.round(reg, 6).alias("regulariser"), F.round(nll + 0.1 * reg, 6).alias("loss"))


_DIR = f"h AS (SELECT vec_id, label % 2 AS t, {_SP('x0')} + 1 AS a, {_SP('x1')} + 1 AS b FROM x)"


@query(f"WITH {_X}, {_DIR} SELECT vec_id, round(a / (a + b), 6) AS p0, round(b / (a + b), 6) AS p1, round(2 / (a + b), 6) AS uncertainty, CAST(b / (a + b) > 0.5 AS INT) AS at_half, CAST(b > a AS INT) AS by_argmax FROM h")
def dirichlet_head(spark, sf_dir):
    """Class probabilities, uncertainty and both ways to decide."""
    _, p, u = st.dirichlet_head([F.col("x0"), F.col("x1")])
    argmax = (F.array_position(F.array(*p), F.array_max(F.array(*p))) - 1).cast("int")
    return _emb(spark, sf_dir, 2).select("vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"), F.round(u, 6).alias("uncertainty"), (p[1] > 0.5).cast("int").alias("at_half"), argmax.alias("by_argmax"))


def _dg(x):
    y = f"({x} + 8)"
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - (" + " + ".join(f"1 / ({x} + {k})" for k in range(8)) + "))"


_KL = f"lgamma(c + d) - lgamma(c) - lgamma(d) - lgamma(2) + (c - 1) * ({_dg('c')} - {_dg('(c + d)')}) + (d - 1) * ({_dg('d')} - {_dg('(c + d)')})"


@query(f"WITH {_X}, {_DIR}, k AS (SELECT *, (1 - t) + t * a AS c, t + (1 - t) * b AS d FROM h) SELECT count(*) AS n, round(avg({_dg('(a + b)')} - CASE WHEN t = 1 THEN {_dg('b')} ELSE {_dg('a')} END), 6) AS digamma_loss, round(avg({_KL}), 6) AS kl FROM k")
def dirichlet_loss(spark, sf_dir):
    """Evidential classification loss."""
    alpha, _, _ = st.dirichlet_head([F.col("x0"), F.col("x1")])
    t = (F.col("label") % 2).cast("double")
    truth = [1 - t, t]
    return _emb(spark, sf_dir, 2).agg(F.count("*").alias("n"), F.round(F.avg(st.dirichlet_digamma_loss(alpha, truth)), 6).alias("digamma_loss"), F.round(F.avg(st.dirichlet_kl(alpha, truth)), 6).alias("kl"))


_PR = "r AS (SELECT permeability AS y, pampa AS p FROM permeability_peptides WHERE permeability > -10 AND pampa > -10)"


@query(f"WITH {_PR} SELECT count(*) AS n, round(avg((y - p) ** 2), 6) AS mse, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS pearson FROM r")
def regression_metrics(spark, sf_dir):
    """M7: one assay as the prediction of the other."""
    rows = read(spark, sf_dir, "permeability_peptides").where("permeability > -10 AND pampa > -10").select("permeability", "pampa")
    got = m.regression(rows, "permeability", "pampa")
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "r2", "pearson")])


_CL = "s AS (SELECT label AS y, (row_id * 37 % 11) / 11.0 + label * 0.1 AS score FROM ppi_split WHERE label IS NOT NULL)"


def _scores(spark, sf_dir):
    return read(spark, sf_dir, "ppi_split").where("label IS NOT NULL").select("label", ((F.col("row_id") * 37 % 11) / F.lit(11.0) + F.col("label") * F.lit(0.1)).alias("score"))


@query(f"""WITH {_CL}, g AS (SELECT round(score, 9) AS score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM s GROUP BY 1), t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT round(sum(neg * (tp - pos + tp) / 2.0) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * (CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END + tp / (tp + fp)) / 2.0) / sum(pos), 6) AS pr_auc FROM t""")
def curve_areas(spark, sf_dir):
    """M8, M9: areas under both curves, with many ties."""
    rows = _scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return m.curve_areas(rows, "label", "score").select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH {_CL}, c AS (SELECT CAST(count_if(y = 1 AND score > 0.5) AS DOUBLE) AS tp, CAST(count_if(y <> 1 AND score > 0.5) AS DOUBLE) AS fp, CAST(count_if(y = 1 AND score <= 0.5) AS DOUBLE) AS fn, CAST(count_if(y <> 1 AND score <= 0.5) AS DOUBLE) AS tn FROM s) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")
def confusion_metrics(spark, sf_dir):
    """Binary metrics at 0.5."""
    got = m.confusion(_scores(spark, sf_dir), "label", F.col("score") > 0.5)
    return got.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in got.columns[4:]])


@query("WITH a AS (SELECT label AS y, vec_id * 7 % 10 AS p FROM embeddings), k AS (SELECT y AS k, count(*) AS support, count_if(y = p) AS tp FROM a GROUP BY 1), c AS (SELECT p AS k, count(*) AS called FROM a GROUP BY 1), z AS (SELECT support, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS pr, tp / support AS re FROM k LEFT JOIN c USING (k)) SELECT round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall, round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 6) AS f1 FROM z")
def weighted_class_metrics(spark, sf_dir):
    """M10 for several classes."""
    rows = read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") * 7 % 10).alias("p"))
    got = m.weighted_scores(rows, "label", "p")
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("SELECT CAST(step AS BIGINT) AS step, round(CASE WHEN step < 100 THEN step / 100 WHEN step < 800 THEN 1.0 WHEN step >= 1000 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * (step - 800) / 200)) END, 6) AS factor FROM range(1001) r(step)")
def learning_rate_schedule(spark, sf_dir):
    """Warm-up, level, decay."""
    return spark.range(1001).select(F.col("id").alias("step"), F.round(st.wsd_factor(F.col("id"), 1000, 100, 200), 6).alias("factor"))


@query("SELECT split, count(*) AS n, CAST(ceil(count(*) / 32.0) * 50 AS BIGINT) AS total_steps FROM ppi_split GROUP BY split")
def total_steps(spark, sf_dir):
    """Optimiser steps of 50 epochs."""
    return read(spark, sf_dir, "ppi_split").groupBy("split").agg(F.count("*").alias("n"), (F.ceil(F.count("*") / 32.0) * 50).cast("long").alias("total_steps"))


@query("SELECT md5(target_sequence) AS key, count(*) AS n_rows FROM ppi_split WHERE target_sequence IS NOT NULL AND target_sequence NOT IN (SELECT target_sequence FROM chembl_ppi WHERE target_sequence IS NOT NULL AND md5(target_sequence) < '8') GROUP BY 1")
def embedding_misses(spark, sf_dir):
    """Sequences without a stored embedding (half of those of chembl_ppi count as stored)."""
    stored = read(spark, sf_dir, "chembl_ppi").where("target_sequence IS NOT NULL").select(F.md5("target_sequence").alias("key")).where("key < '8'").distinct()
    rows = read(spark, sf_dir, "ppi_split").where("target_sequence IS NOT NULL").select("target_sequence")
    missing = v.missing_keys(rows, "target_sequence", stored).select("key")
    return rows.select(F.md5("target_sequence").alias("key")).join(missing, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_rows"))


@query()
def embedding_fill(spark, sf_dir):
    """A batch function fills what is missing (here: composition as the vector)."""
    rows = read(spark, sf_dir, "ppi_split").select("target_sequence")
    none = spark.createDataFrame([], "key string, vector array<float>")

    def embed(texts):
        return [[t.count(a) / max(1, len(t)) for a in "ACDEFGHIKLMNPQRSTVWY"] for t in texts]

    return v.fill(v.missing_keys(rows, "target_sequence", none), "target_sequence", embed)


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round({_DOT('q.embedding', 'e.embedding')} / sqrt({_DOT('q.embedding', 'q.embedding')} * {_DOT('e.embedding', 'e.embedding')}), 6) AS similarity FROM q JOIN e ON q.vec_id <> e.vec_id) SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5")
def nearest_vectors(spark, sf_dir):
    """The five nearest by cosine of each 50th vector, against all."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


_ROWS = "t AS (SELECT label, vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, embedding[2] AS score FROM embeddings)"


@query(f"WITH {_ROWS} SELECT label, dim, round(coalesce(sum(CASE WHEN vec_id % 3 <> 0 THEN CAST(x AS DOUBLE) END), 0) / greatest(count_if(vec_id % 3 <> 0), 1e-9), 6) AS mean FROM t GROUP BY 1, 2")
def masked_mean_pool(spark, sf_dir):
    """Mean over the vectors that are not masked, in every dimension."""
    got = v.mean_pooled_rows(read(spark, sf_dir, "embeddings"), "label", "embedding", (F.col("vec_id") % 3 != 0).cast("int"))
    return got.select("label", "dim", F.round("pooled", 6).alias("mean"))


@query(f"WITH {_ROWS} SELECT label, dim, round(sum(CAST(x AS DOUBLE) * exp(CAST(score AS DOUBLE))) / sum(exp(CAST(score AS DOUBLE))), 6) AS pooled FROM t WHERE vec_id % 3 <> 0 GROUP BY 1, 2")
def attention_pool(spark, sf_dir):
    """Softmax-weighted mean over the vectors that are not masked, in every dimension; the second one is the score."""
    got = v.attention_pooled_rows(read(spark, sf_dir, "embeddings"), "label", "embedding", F.col("embedding")[1], (F.col("vec_id") % 3 != 0).cast("int"))
    return got.select("label", "dim", F.round("pooled", 6).alias("pooled"))


for _whole, _same in (("mean_pool_whole", masked_mean_pool), ("attention_pool_whole", attention_pool)):  # their names so far
    QUERIES[_whole], SQL[_whole] = _same, SQL[_same.__name__]


@query()
def pca_points(spark, sf_dir):
    """Two components to plot (t-SNE has no counterpart here)."""
    got, _ = v.principal(read(spark, sf_dir, "embeddings"), "embedding", 2)
    return got.select("vec_id", "label", F.round(F.col("pca")[0], 6).alias("x"), F.round(F.col("pca")[1], 6).alias("y"))


@query("SELECT vec_id, round(concat_vec[1], 6) AS first, CAST(len(concat_vec) AS INT) AS size FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || [CAST(label AS DOUBLE)] AS concat_vec FROM embeddings)")
def fused_vectors(spark, sf_dir):
    """Features put together."""
    c = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("label").cast("double")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(c[0], 6).alias("first"), F.size(c).alias("size"))


@query(f"WITH {_IDS}, t AS (SELECT row_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM e), m AS (SELECT id, CASE WHEN md5(row_id || ':' || i) < '2' THEN id ELSE -100 END AS label, CASE WHEN md5(row_id || '/' || i) < 'c' THEN id ELSE 4 END AS pred FROM t) SELECT CAST(count_if(label <> -100) AS BIGINT) AS n, round(avg(CASE WHEN label <> -100 THEN CAST(pred = label AS INT) END), 6) AS accuracy FROM m")
def masked_accuracy(spark, sf_dir):
    """Accuracy over the tokens that carry a label (labels and predictions drawn by hash)."""
    t = _encoded(spark, sf_dir).select("row_id", F.posexplode("ids").alias("i", "id")).withColumn("i", F.col("i") + 1)
    draw = lambda sep: F.md5(F.concat_ws(sep, F.col("row_id").cast("string"), F.col("i").cast("string")))
    label, pred = F.when(draw(":") < "2", F.col("id")).otherwise(-100), F.when(draw("/") < "c", F.col("id")).otherwise(4)
    return t.select(label.alias("label"), pred.alias("pred")).agg(F.count_if(F.col("label") != -100).alias("n"), F.round(F.avg(F.when(F.col("label") != -100, (F.col("pred") == F.col("label")).cast("int"))), 6).alias("accuracy"))


@query("WITH a AS (SELECT split, label AS y, (row_id * 37 % 11) / 11.0 + label * 0.1 AS p, (row_id % 7) / 7.0 AS u FROM ppi_split WHERE label IS NOT NULL) SELECT split, count(*) AS n, round(avg(u), 6) AS uncertainty, round(avg(CAST((p > 0.5) = (y = 1) AS INT)), 6) AS accuracy, CASE WHEN count(DISTINCT y) > 1 THEN round(sqrt(avg((y - p) ** 2)), 6) END AS rmse FROM a GROUP BY split")
def epoch_metrics(spark, sf_dir):
    """The predictions of an epoch per split, in one aggregation."""
    p, u, y = (F.col("row_id") * 37 % 11) / F.lit(11.0) + F.col("label") * F.lit(0.1), (F.col("row_id") % 7) / F.lit(7.0), F.col("label")
    rows = read(spark, sf_dir, "ppi_split").where("label IS NOT NULL").select("split", y.alias("y"), p.alias("p"), u.alias("u"))
    err = F.col("y") - F.col("p")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("u"), 6).alias("uncertainty"), F.round(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("int")), 6).alias("accuracy"), F.when(F.min("y") != F.max("y"), F.round(F.sqrt(F.avg(err * err)), 6)).alias("rmse"))


@query("SELECT label, CAST(floor(vec_id / 1000) AS BIGINT) AS page, count(*) AS n, array_to_string(list_sort(list(vec_id)), ' ') AS members FROM embeddings GROUP BY 1, 2")
def group_members(spark, sf_dir):
    """Members of each group in order, in pages of a thousand ids, so that no row grows with the group."""
    return read(spark, sf_dir, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 1000).alias("page")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("vec_id")), " ").alias("members"))


@query("WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id, min(sqrt((q.x - e.x) ** 2 + (q.y - e.y) ** 2)) AS d FROM q JOIN e ON q.vec_id <> e.vec_id GROUP BY 1) SELECT count(*) AS n, round(quantile_cont(d, 0.25), 6) AS spacing, round(least(greatest(quantile_cont(d, 0.25) * 40, 2), 40), 6) AS point_size FROM d")
def point_spacing(spark, sf_dir):
    """How far the next point is, as a quantile over every 50th point, and a size to draw with."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("xy"))
    d = v.nearest_distance(e.where("vec_id % 50 = 0"), e, "vec_id", "xy")
    q = F.percentile("distance", F.lit(0.25))
    return d.agg(F.count("*").alias("n"), F.round(q, 6).alias("spacing"), F.round(F.least(F.greatest(q * 40, F.lit(2.0)), F.lit(40.0)), 6).alias("point_size"))


#: The error function by its series; vectors here are small enough for 80 terms.
_ERF = lambda x: f"CASE WHEN abs({x}) > 5 THEN sign({x}) ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * ({x}) ** (2 * k + 1) / (exp(lgamma(k + 1)) * (2 * k + 1)))) END"
_GELU = lambda x: f"0.5 * {x} * (1 + {_ERF(f'{x} / sqrt(2.0)')})"


@query(f"""WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
h AS (SELECT vec_id, a + b - 0.5 * c + 0.1 + a AS u, a - b + 0.25 * c + b AS w, 0.5 * a + 0.5 * b + c - 0.2 + c AS z FROM x), g AS (SELECT vec_id, {_GELU('u')} AS u, {_GELU('w')} AS w, {_GELU('z')} AS z FROM h),
m AS (SELECT vec_id, u - (u + w + z) / 3 AS u, w - (u + w + z) / 3 AS w, z - (u + w + z) / 3 AS z FROM g), n AS (SELECT vec_id, sqrt((u * u + w * w + z * z) / 3 + 1e-5) AS s, u, w, z FROM m)
SELECT vec_id, round(0.5 * (u / s * 1.5 + 0.1) - 0.25 * (w / s) + z / s * 0.5 + 0.3, 5) AS output FROM n""")
def mlp_head(spark, sf_dir):
    """A layer with identity skip, exact GELU and layer normalisation, then the output layer, as Arrow batches."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.col("embedding")[i].cast("double") for i in range(3)]).alias("x"))
    layer = ([[1.0, 1.0, 0.5], [1.0, -1.0, 0.5], [-0.5, 0.25, 1.0]], [0.1, 0.0, -0.2], [1.5, 1.0, 0.5], [0.1, 0.0, 0.0])
    return v.mlp(rows, "vec_id", "x", [layer], ([0.5, -0.25, 1.0], 0.3)).select("vec_id", F.round("output", 5).alias("output"))


@query("WITH o AS (SELECT vec_id, embedding, (row_number() OVER (ORDER BY md5('stack:' || vec_id)) - 1) // 32 AS batch_id FROM embeddings) SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS INT) AS n, CAST(max(len(embedding)) AS INT) AS width, round(sum(CAST(embedding[1] AS DOUBLE)), 5) AS first FROM o GROUP BY 1")
def stacked_vectors(spark, sf_dir):
    """The vectors of each batch of 32, in seeded order, stacked."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got = v.stacked(q.batched(e.join(q.epoch_order(e, "vec_id", "stack"), "vec_id"), "number", 32), "batch_id", "number", "embedding")
    return got.select("batch_id", F.size("vectors").alias("n"), F.array_max(F.transform("vectors", F.size)).alias("width"), F.round(F.aggregate("vectors", F.lit(0.0), lambda s, x: s + x[0].cast("double")), 5).alias("first"))


_PRO = "[1] || list_transform(regexp_extract_all(target_sequence, '[A-Z]')[:1022], lambda x: ord(x) - 60) || [2]"


@query(f"WITH p AS (SELECT row_id, regexp_replace(helm_notation, '{WS}', '', 'g') AS helm, upper(regexp_replace(target_sequence, '{WS}', '', 'g')) AS target_sequence FROM ppi_split), {_VOC}, mp AS (SELECT map(list(token), list(id)) AS t FROM w) SELECT row_id, array_to_string([1] || list_transform(regexp_extract_all(helm, '{_TOK}')[:510], lambda x: coalesce(t[x], 4)) || [2], ' ') AS helm_ids, array_to_string({_PRO}, ' ') AS protein_ids FROM p, mp WHERE helm IS NOT NULL AND target_sequence <> ''")
def pair_tokens(spark, sf_dir):
    """B2: both sides of each pair: the notation's tokens to 512, the protein's residues (A is 5, Z is 30) to 1,024."""
    rows = read(spark, sf_dir, "ppi_split").select("row_id", clean("helm_notation").alias("helm"), F.upper(clean("target_sequence")).alias("protein"))
    both = q.encoded(rows.where("helm IS NOT NULL AND protein <> ''"), "helm", q.vocabulary(rows, "helm", VOCABULARY))
    both = q.residues_encoded(both, "protein", 1024)
    return both.select("row_id", F.array_join("ids", " ").alias("helm_ids"), F.array_join("protein_ids", " ").alias("protein_ids"))


@query("WITH r AS (SELECT compound_chembl_id, target_chembl_id, min(row_id) % 2000 AS rep_id FROM ppi_split WHERE compound_chembl_id IS NOT NULL AND target_chembl_id IS NOT NULL GROUP BY 1, 2) SELECT row_id, rep_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM ppi_split JOIN r USING (compound_chembl_id, target_chembl_id) JOIN embeddings ON vec_id = rep_id")
def pair_vectors(spark, sf_dir):
    """Each row's vector by way of its pair's representative (the pair's first row; row numbers stand for vector ids)."""
    keys = ["compound_chembl_id", "target_chembl_id"]
    rows = read(spark, sf_dir, "ppi_split").select("row_id", *keys)
    reps = rows.na.drop(subset=keys).groupBy(*keys).agg((F.min("row_id") % 2000).alias("rep_id"))
    stored = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rep_id"), F.col("embedding").alias("vector"))
    return v.by_representative(rows, keys, reps, stored).select("row_id", "rep_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("WITH s AS (SELECT row_id, label, split, min(row_id) OVER (PARTITION BY compound_chembl_id, target_chembl_id) % 2000 AS rep_id, compound_chembl_id, target_chembl_id FROM ppi_split WHERE compound_chembl_id IS NOT NULL AND target_chembl_id IS NOT NULL), p AS (SELECT row_id, rep_id, split = 'test' AS is_test FROM s WHERE label = 1), c AS (SELECT row_id, rep_id, CASE WHEN is_test THEN 'test' WHEN row_number() OVER (PARTITION BY is_test ORDER BY md5('plot:' || row_id)) <= ceil(0.1 * count(*) OVER (PARTITION BY is_test)) THEN 'valid' ELSE 'train' END AS panel FROM p) SELECT c.row_id, panel, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM c JOIN embeddings ON vec_id = rep_id")
def plot_table(spark, sf_dir):
    """Positives only, a tenth of train carved out as valid, the pair's vector (two coordinates) and its panel."""
    from ..operators.splits import random_split

    keys = ["compound_chembl_id", "target_chembl_id"]
    rows = read(spark, sf_dir, "ppi_split").select("row_id", "label", "split", *keys).na.drop(subset=keys)
    reps = rows.groupBy(*keys).agg((F.min("row_id") % 2000).alias("rep_id"))
    positive = rows.where("label = 1").select("row_id", *keys, (F.col("split") == "test").alias("is_test"))
    carved = random_split(positive.where("NOT is_test").select("row_id"), "row_id", 0.1, "plot").select("row_id", F.when(F.col("split") == "test", "valid").otherwise("train").alias("panel"))
    named = positive.join(carved, "row_id", "left").withColumn("panel", F.coalesce("panel", F.lit("test")))
    stored = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rep_id"), F.col("embedding").alias("vector"))
    xy = [F.round(F.col("vector")[i].cast("double"), 6).alias(c) for i, c in enumerate("xy")]
    return v.by_representative(named, keys, reps, stored).select("row_id", "panel", *xy)
