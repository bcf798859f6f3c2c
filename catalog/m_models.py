"""Models, and the nested and cross-cohort evaluations built on them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalog.e_folds import draw, fold_sql
from catalog.f_selection import FITS4, L1, PCA2, QUICK, index_of, model_rows, split_rows
from catalog.fits_sql import ALL_GENES, LOSS, TWO_GENES, WHOLE, auc_of, binned_cells, boosted_trees, descent, grown_tree, log_loss_of, newton
from catalog.g_search import SPEC
from catalog.registry import query, rounded
from catalog.tables import GENES
from riskloom.functions.vectors import with_vector
from riskloom.operators import kernel_fit as KF
from riskloom.operators import metrics as H
from riskloom.operators import models as M
from riskloom.operators import trees as T
from riskloom.operators.folds import repeated_stratified_k_fold, stratified_k_fold
from riskloom.operators.metrics import roc_auc
from riskloom.operators.runs import compare_models
from riskloom.operators.selection import repeated_fits, slice_genes, weight_table
from riskloom.plans.cross_cohort import score_second, train_on_first_test_on_second
from riskloom.plans.nested import all_genes, l1_selector, nested_evaluation


def _weights(t, fitted):
    one = t.spark.createDataFrame([(fitted.weights.tolist(), float(fitted.intercept))], "w array<double>, intercept double")
    weights = one.select(F.posexplode("w").alias("gene_ix", "weight"), rounded("intercept", 4).alias("intercept"))
    return weights.withColumn("weight", rounded("weight", 4))


WEIGHTS = f"""SELECT CAST(i AS INTEGER) AS gene_ix, round(w[i + 1], 4) + 0 AS weight, round(w[{GENES + 1}], 4) + 0 AS intercept
FROM (SELECT w, unnest(range({GENES})) AS i FROM cd_fit)"""


# -- logistic ---------------------------------------------------------------------------


@query("m01_logistic_l2", f"""
WITH {WHOLE}, {descent('cd', 'whole', GENES + 1, l2=2.0, free=1, sweeps=40)}
{WEIGHTS}""")
def m01(t):
    """Strength 0.5, free intercept, all genes: equal to coordinate descent."""
    return _weights(t, SPEC.with_params(C=0.5).fit(model_rows(t)))


@query("m01_logistic_l2_two_genes", f"""
WITH {TWO_GENES}, {newton('nw', 'two_genes', 'CAST(1 AS DOUBLE)', 'CAST(1 AS DOUBLE)')}
SELECT CAST(0 AS INTEGER) AS gene_ix, round(u, 4) + 0 AS weight, CAST(0 AS DOUBLE) AS intercept FROM nw_fit
UNION ALL SELECT CAST(1 AS INTEGER), round(v, 4) + 0, CAST(0 AS DOUBLE) FROM nw_fit""")
def m01b(t):
    """Two genes without intercept."""
    return _weights(t, SPEC.with_params(fit_intercept=False).fit(slice_genes(model_rows(t), [0, 1])))


@query("m01_logistic_l2_all_genes", f"""WITH {ALL_GENES},
longer AS (SELECT y, list_append(x, CAST(1 AS DOUBLE)) AS x FROM scaled), {descent('cd', 'longer', GENES + 1, l2=10.0, free=1)}
SELECT CAST(i AS INTEGER) AS gene_id, round(w[i + 1], 3) + 0 AS value FROM (SELECT w, unnest(range({GENES})) AS i FROM cd_fit)""")
def m01c(t):
    """All genes with a free intercept: equal to coordinate descent."""
    weights = weight_table(SPEC.with_params(C=0.1).fit(model_rows(t)), index_of(t))
    return weights.select("gene_id", rounded("value", 3).alias("value"))


@query("m02_logistic_l1", f"""
WITH scaled AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, list_transform(embedding[1:12], lambda e: 10 * CAST(e AS DOUBLE)) AS x FROM embeddings),
{descent('cd', 'scaled', 12, l1=4.0, sweeps=40)}
SELECT CAST(i AS INTEGER) AS gene_ix, round(w[i + 1], 4) + 0 AS weight, CAST(0 AS DOUBLE) AS intercept FROM (SELECT w, unnest(range(12)) AS i FROM cd_fit)""")
def m02(t):
    """Twelve genes, strength 0.25: equal to coordinate descent to four digits; f01 and m11 fit all genes."""
    return _weights(t, L1.with_params(C=0.25, tol=1e-12).fit(slice_genes(model_rows(t), list(range(12)))))


def _gene_values(t, fitted):
    return weight_table(fitted, index_of(t)).select("gene_id", rounded("value", 3).alias("value"))


GENE_VALUES = f"SELECT CAST(i AS INTEGER) AS gene_id, round(w[i + 1], 3) + 0 AS value FROM (SELECT w, unnest(range({GENES})) AS i FROM cd_fit)"


@query("m01_logistic_l2_no_intercept", f"""WITH {ALL_GENES}, {descent('cd', 'scaled', GENES, l2=1.0, sweeps=40)}
{GENE_VALUES}""")
def m01d(t):
    """All genes without intercept: equal to coordinate descent."""
    return _gene_values(t, SPEC.with_params(fit_intercept=False).fit(model_rows(t)))


@query("m02_logistic_l1_all_genes", f"""WITH {ALL_GENES}, {descent('cd', 'scaled', GENES, l1=4.0, sweeps=40)}
{GENE_VALUES}""")
def m02b(t):
    """All genes, strength 0.25: equal to coordinate descent to three digits."""
    return _gene_values(t, L1.with_params(C=0.25, tol=1e-12).fit(model_rows(t)))


@query("m03_penalised_intercept", f"""
WITH {WHOLE}, {descent('cd', 'whole', GENES + 1, l2=50.0)}
{WEIGHTS}""")
def m03(t):
    """The intercept as the weight of a constant feature."""
    return _weights(t, SPEC.with_params(C=0.02, penalise_intercept=True).fit(model_rows(t)))


# -- kernels ----------------------------------------------------------------------------

CENTRES = """smp AS (SELECT vec_id AS sample_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
cells AS (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM (SELECT label, embedding, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2),
centres AS (SELECT label AS landmark_ix, list(v ORDER BY i) AS c FROM cells GROUP BY label)"""


def centres(t):
    """One landmark per class code: the mean of its samples."""
    cells = t.expr.join(t.classes.select("sample_id", "code"), "sample_id").groupBy("code", "gene_id").agg(F.avg("value").alias("v"))
    rows = cells.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("gene_id", "v"))).alias("c"))  # one cell per gene
    return rows.select(F.col("code").cast("long").alias("landmark_ix"), F.transform("c", lambda x: x["v"]).alias("features"))


def _kernel_query(name: str, kernel: M.Kernel, sql: str):
    dot, far = "list_dot_product(x, c)", "(list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c))"
    value = sql.format(xy=dot, d2=far)

    @query(name, f"""WITH {CENTRES}
SELECT sample_id, CAST(landmark_ix AS INTEGER) AS landmark_ix, round({value}, 6) + 0 AS value FROM smp CROSS JOIN centres""")
    def run(t):
        mapped = kernel.features(t.vectors.select("sample_id", "features"), centres(t))
        return mapped.select("sample_id", F.posexplode("features").alias("landmark_ix", "value")).withColumn("value", rounded("value"))

    run.__doc__ = "Kernel of every sample with the class means."


_kernel_query("m04_kernel_linear", M.Kernel("linear"), "{xy}")
_kernel_query("m04_kernel_poly", M.Kernel("poly", gamma=0.5, degree=2, coef0=1.0), "pow(0.5 * {xy} + 1, 2)")
_kernel_query("m04_kernel_rbf", M.Kernel("rbf"), "exp(-{d2} / 64)")
_kernel_query("m04_kernel_sigmoid", M.Kernel("sigmoid", gamma=0.3, coef0=0.1), "tanh(0.3 * {xy} + 0.1)")


def _inverse_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([1.0 / (1.0 + np.abs(x - mark).sum(axis=1)) for mark in y], axis=1)


_kernel_query(
    "m04_kernel_of_the_caller", M.Kernel(_inverse_distance),
    "1 / (1 + list_sum(list_transform(range(64), lambda k: abs(x[k + 1] - c[k + 1]))))",
)

RBF = {"C": 0.1, "kind": "rbf", "gamma": 2.0, "max_iter": 300, "tol": 1e-15}


def kernel_fit_sql(value: str, l2: float) -> str:
    """CTE ``kp(sample_id, y, d)``: decision values of a logistic fit on the kernel with the class means."""
    return f"""{CENTRES}, lab AS (SELECT vec_id AS sample_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings),
kv AS (SELECT s.sample_id, y, list_append(list({value} ORDER BY landmark_ix), CAST(1 AS DOUBLE)) AS x
  FROM smp s JOIN lab ON lab.sample_id = s.sample_id CROSS JOIN centres GROUP BY s.sample_id, y),
{descent('kd', 'kv', 11, l2=l2, free=1, sweeps=400)},
kp AS (SELECT sample_id, y, list_dot_product(w, x) AS d FROM kv CROSS JOIN kd_fit)"""


SQUARED = "(list_dot_product(s.x, s.x) + list_dot_product(c, c) - 2 * list_dot_product(s.x, c))"


@query("m05_kernel_logistic", f"""WITH {kernel_fit_sql(f'exp(-2 * {SQUARED})', 10.0)}
SELECT sample_id, CAST(y AS DOUBLE) AS label, round(1 / (1 + exp(-d)), 3) + 0 AS p1 FROM kp""")
def m05(t):
    """Fit on the kernel with the class means; probabilities of all samples."""
    rows = with_vector(t.vectors.drop("code"))
    spec = M.KernelLogisticSpec(centres(t), **RBF)
    return spec.fit(rows).transform(rows).select("sample_id", "label", rounded("p1", 3).alias("p1"))


@query("m06_kernel_probability", f"""WITH {CENTRES},
s AS (SELECT sample_id, sum((landmark_ix - 4) * exp(-2 * (list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c)))) + CAST(0.25 AS DOUBLE) AS d
  FROM smp CROSS JOIN centres GROUP BY sample_id)
SELECT sample_id, round(d, 6) + 0 AS decision, round(1 / (1 + exp(-d)), 6) + 0 AS p1, CAST(CASE WHEN d > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM s""")
def m06(t):
    """Probability from given kernel weights."""
    mapped = M.Kernel("rbf", gamma=2.0).features(t.vectors.select("sample_id", "features"), centres(t))
    out = M.kernel_probability(mapped, [float(k - 4) for k in range(10)], 0.25)
    return out.select("sample_id", rounded("decision").alias("decision"), rounded("p1").alias("p1"), "prediction")


@query("m07_kernel_class", f"""WITH {kernel_fit_sql('pow(list_dot_product(s.x, c) + 1, 2)', 20.0)}
SELECT sample_id, CAST(y AS DOUBLE) AS label, CAST(CASE WHEN d > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM kp""")
def m07(t):
    """Class by the sign of the decision value, polynomial kernel."""
    rows = with_vector(t.vectors.drop("code"))
    spec = M.KernelLogisticSpec(centres(t), **{**RBF, "C": 0.05, "kind": "poly", "gamma": 1.0, "degree": 2})
    return spec.fit(rows).transform(rows).select("sample_id", "label", "prediction")


THREE_SWEEPS = 400
SOFTMAX = "exp(list_dot_product(w[{c}], x)) / (exp(list_dot_product(w[1], x)) + exp(list_dot_product(w[2], x)) + exp(list_dot_product(w[3], x)))"
AT = "(it // 11 % 3)"  # the class whose weight a step moves; the place of that weight is it % 11


@query("m07_kernel_three_classes", f"""WITH {CENTRES}, lab AS (SELECT vec_id AS sample_id, label % 3 AS y FROM embeddings),
kv AS (SELECT s.sample_id, y, list_append(list(exp(-2 * {SQUARED}) ORDER BY landmark_ix), CAST(1 AS DOUBLE)) AS x
  FROM smp s JOIN lab ON lab.sample_id = s.sample_id CROSS JOIN centres GROUP BY s.sample_id, y),
st AS (SELECT 0 AS it, list_transform(range(3), lambda c: list_transform(range(11), lambda k: CAST(0 AS DOUBLE))) AS w
UNION ALL
SELECT it + 1, list_transform(range(3), lambda c: list_transform(range(11), lambda k:
    CASE WHEN c = {AT} AND k = it % 11 THEN w[c + 1][k + 1] - (g + pen * w[c + 1][k + 1]) / (h + pen) ELSE w[c + 1][k + 1] END))
FROM (SELECT it, w, CASE WHEN it % 11 < 10 THEN CAST(0.2 AS DOUBLE) ELSE 0 END AS pen,
    sum((p - CASE WHEN y = {AT} THEN 1 ELSE 0 END) * x[it % 11 + 1]) AS g, sum(p * (1 - p) * x[it % 11 + 1] * x[it % 11 + 1]) AS h
  FROM (SELECT it, w, y, x, {SOFTMAX.format(c=f'{AT} + 1')} AS p FROM st CROSS JOIN kv WHERE it < {33 * THREE_SWEEPS}) GROUP BY it, w)),
pr AS (SELECT sample_id, y, list_transform(range(3), lambda c: {SOFTMAX.format(c='c + 1')}) AS p FROM kv CROSS JOIN (SELECT w FROM st WHERE it = {33 * THREE_SWEEPS}))
SELECT sample_id, CAST(y AS DOUBLE) AS label, round(p[1], 3) + 0 AS p_0, round(p[2], 3) + 0 AS p_1, round(p[3], 3) + 0 AS p_2,
  CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS prediction FROM pr""")
def m07b(t):
    """Three classes by arg-max of a softmax fit on the kernel with the class means."""
    mapped = M.Kernel("rbf", gamma=2.0).features(t.vectors.select("sample_id", "features"), centres(t)).withColumn("features", array_to_vector("features"))
    rows = mapped.join(t.classes.select("sample_id", (F.col("code") % 3).cast("double").alias("label")), "sample_id")
    out = KF.SoftmaxSpec(C=5.0, max_iter=300, tol=1e-11).fit(rows).transform(rows)
    return out.select("sample_id", "label", *[rounded(F.col("probabilities")[c], 3).alias(f"p_{c}") for c in range(3)], "prediction")


@query("m05_kernel_of_all_samples")
def m05b(t):
    """Fit against all samples, ten classes, linear kernel of all genes; its samples are chosen by the fit."""
    rows = with_vector(t.vectors.drop("code", "label").join(t.classes.select("sample_id", F.col("code").cast("double").alias("label")), "sample_id"))
    out = KF.KernelOfAllSpec(C=0.05, kind="linear").fit(rows).transform(rows)
    return out.select("sample_id", "label", rounded(F.array_max("probabilities"), 3).alias("p"), "prediction")


# -- trees ------------------------------------------------------------------------------


@query("m08_random_forest")
def m08(t):
    rows = model_rows(t)
    return T.ForestSpec(5, n_trees=10, max_features="sqrt").fit(rows).transform(rows).select("sample_id", "label", "p1", "prediction")


@query("m08_one_tree", f"""WITH {ALL_GENES}, {binned_cells(64)}, stats AS (SELECT sample_id, CAST(-y AS DOUBLE) AS g, CAST(1 AS DOUBLE) AS h FROM scaled),
{grown_tree('t', 'stats', 6)}
SELECT s.sample_id, CAST(y AS DOUBLE) AS label, round(weight, 6) + 0 AS p1, CAST(CASE WHEN weight > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM scaled s JOIN t_leaf l ON s.sample_id = l.sample_id""")
def m08b(t):
    """One tree of six levels on all samples and genes: equal to the tree grown in SQL."""
    rows = model_rows(t)
    out = T.ForestSpec(6, n_trees=1, max_features="all", bootstrap=False).fit(rows).transform(rows)
    return out.select("sample_id", "label", rounded("p1").alias("p1"), "prediction")


@query("m09_boosted_trees", f"""WITH {ALL_GENES}, {binned_cells(64)}, {boosted_trees(8, 2, 0.3, 0.1, 2.0, 1.0)}
SELECT sample_id, CAST(y AS DOUBLE) AS label, round(1 / (1 + exp(-margin)), 6) + 0 AS p1, CAST(CASE WHEN margin > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM margins""")
def m09(t):
    """Eight rounds with penalties on the leaves: equal to the same rounds in SQL."""
    rows = model_rows(t)
    out = T.BoostedSpec(max_depth=2, n_rounds=8, learning_rate=0.3, alpha=0.1, reg_lambda=2.0).fit(rows).transform(rows)
    return out.select("sample_id", "label", rounded("p1").alias("p1"), "prediction")


# -- regression on months ---------------------------------------------------------------

MONTHS = "md AS (SELECT CAST(center AS DOUBLE) AS x, CAST(months AS DOUBLE) AS y FROM patients)"


def _months(t):
    return t.patients.select(
        "sample_id", array_to_vector(F.array(F.col("center").cast("double"))).alias("features"),
        F.col("months").cast("double").alias("label"),
    )


MOMENTS = f"{MONTHS}, mo AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM md)"


@query("m10_plain_regression", f"""WITH {MOMENTS}
SELECT CAST(0 AS INTEGER) AS gene_ix, round(sxy / sxx, 4) + 0 AS weight, round(my - sxy / sxx * mx, 4) + 0 AS intercept FROM mo""", "patients")
def m10(t):
    """Months on the center number, closed form."""
    return _weights(t, M.RegressionSpec("plain").fit(_months(t)))


@query("m10_ridge", f"""WITH {MOMENTS}
SELECT CAST(0 AS INTEGER) AS gene_ix, round(sxy / (sxx + 1000), 4) + 0 AS weight, round(my - sxy / (sxx + 1000) * mx, 4) + 0 AS intercept FROM mo""", "patients")
def m10r(t):
    return _weights(t, M.RegressionSpec("ridge", alpha=1000.0).fit(_months(t)))


@query("m10_lasso", f"""WITH {MOMENTS},
s AS (SELECT *, sign(sxy) * greatest(abs(sxy) / n - CAST(0.05 AS DOUBLE), 0) / (sxx / n) AS w FROM mo)
SELECT CAST(0 AS INTEGER) AS gene_ix, round(w, 4) + 0 AS weight, round(my - w * mx, 4) + 0 AS intercept FROM s""", "patients")
def m10l(t):
    """One variable: the soft threshold of the covariance."""
    return _weights(t, M.RegressionSpec("lasso", alpha=0.05).fit(_months(t)))


@query("m11_repeated_fits", f"""WITH {FITS4},
tested AS (SELECT a.split_id, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p1 FROM all_splits a JOIN cd_fit c ON a.split_id = c.split_id WHERE NOT is_train)
SELECT CAST(split_id AS INTEGER) AS fit_id, 'weight' AS kind, CAST(gene_id AS VARCHAR) AS name, round(value, 3) + 0 AS value FROM fits
UNION ALL SELECT CAST(split_id AS INTEGER), 'metrics', 'loss', round({LOSS}, 3) + 0 FROM tested GROUP BY split_id
UNION ALL SELECT CAST(split_id AS INTEGER), 'metrics', 'accuracy', round(avg(CASE WHEN (p1 > 0.5) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 3) + 0 FROM tested GROUP BY split_id""")
def m11(t):
    """Weights and metrics of one fit per fold."""
    stats = repeated_fits(L1, split_rows(t, 4), range(4), index_of(t), {"loss": H.log_loss, "accuracy": H.accuracy})
    return stats.withColumn("value", rounded("value", 3))


@query("m12_component_mesh", f"""
WITH {PCA2}, {TWO_GENES}, {newton('nw', 'two_genes', 'CAST(1 AS DOUBLE)', 'CAST(1 AS DOUBLE)')},
-- loadings with the largest entry of each component positive
l AS (SELECT ma, mb, CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS s1,
  CASE WHEN abs(sin(th)) > abs(cos(th)) THEN sign(-sin(th)) ELSE sign(cos(th)) END AS s2, th FROM m),
ld AS (SELECT ma, mb, s1 * cos(th) AS l11, s1 * sin(th) AS l12, s2 * -sin(th) AS l21, s2 * cos(th) AS l22 FROM l),
sc AS (SELECT (a - ma) * l11 + (b - mb) * l12 AS p, (a - ma) * l21 + (b - mb) * l22 AS q FROM g CROSS JOIN ld),
e AS (SELECT min(p) - 0.5 AS p0, max(p) + 0.5 AS p1, min(q) - 0.5 AS q0, max(q) + 0.5 AS q1 FROM sc),
n AS (SELECT *, CAST(ceil((p1 - p0) / 0.25) AS BIGINT) AS np, CAST(ceil((q1 - q0) / 0.25) AS BIGINT) AS nq FROM e),
pt AS (SELECT point, p0 + (point // nq) * CAST(0.25 AS DOUBLE) AS p, q0 + (point % nq) * CAST(0.25 AS DOUBLE) AS q FROM (SELECT *, unnest(range(np * nq)) AS point FROM n))
SELECT point, round(p, 4) + 0 AS at_1, round(q, 4) + 0 AS at_2,
  round(1 / (1 + exp(-(u * (ma + p * l11 + q * l21) + v * (mb + p * l12 + q * l22)))), 3) + 0 AS p1 FROM pt CROSS JOIN ld CROSS JOIN nw_fit""")
def m12(t):
    """Probability over a mesh of two components, taken back to the genes."""
    return _mesh(slice_genes(model_rows(t), [0, 1]))


@query("m12_component_mesh_all_genes")
def m12b(t):
    """The same for two components of all genes."""
    return _mesh(model_rows(t))


def _mesh(rows):
    parts = M.fit_components(rows.where("sample_id % 4 <> 0"), 2)
    signs = np.sign(parts.loadings[np.abs(parts.loadings).argmax(axis=0), [0, 1]])
    scores = vector_to_array("features")
    turned = parts.transform(rows).withColumn(
        "features", array_to_vector(F.array(scores[0] * float(signs[0]), scores[1] * float(signs[1])))
    )
    mesh = M.component_mesh(turned, 0, 1, 2, 0.25)
    points = M.back_to_genes(mesh, parts.loadings * signs, parts.mean)
    fitted = SPEC.with_params(fit_intercept=False).fit(rows)
    out = fitted.transform(points)
    at = F.col("scores")
    return out.select("point", rounded(at[0], 4).alias("at_1"), rounded(at[1], 4).alias("at_2"), rounded("p1", 3).alias("p1"))


# -- evaluations ------------------------------------------------------------------------


def _nested(t, split_ids):
    labels = t.classes.select("sample_id", "y")
    outer = repeated_stratified_k_fold(labels, "y", 2, 1, 7)
    expr = t.expr.withColumn("value", F.col("value") * 10)
    return nested_evaluation(
        expr, labels, outer, split_ids, "logistic", M.LogisticSpec(), {"C": [0.01, 0.1]},
        "l1", l1_selector(QUICK), {"log_loss": H.negative_log_loss, "accuracy": H.accuracy}, 2, "log_loss",
    )


@query("r01_nested_evaluation_l1")
def r01(t):
    """Select, search and score inside each outer split: mean and variance of the results."""
    results, _ = _nested(t, range(2))
    return compare_models(results)


@query("r02_out_of_fold_predictions_l1")
def r02(t):
    """Outer-fold probabilities of every sample."""
    _, predictions = _nested(t, range(2))
    return predictions


# All genes, two outer and two inner folds, two strengths: all steps by coordinate descent.
NESTED = f"""{WHOLE},
oix AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM whole),
outer_f AS (SELECT sample_id, y, x, {fold_sql('i', 'n', 2)} AS fold FROM oix),
otr AS (SELECT o, sample_id, y, x FROM outer_f CROSS JOIN (SELECT unnest(range(2)) AS o) t WHERE fold <> o),
iix AS (SELECT *, row_number() OVER (PARTITION BY o, y ORDER BY {draw('0', seed=0)}) - 1 AS i, count(*) OVER (PARTITION BY o, y) AS n FROM otr),
inner_f AS (SELECT o, y, x, s, {fold_sql('i', 'n', 2)} <> s AS is_train FROM iix CROSS JOIN (SELECT unnest(range(2)) AS s) t),
cand AS (SELECT * FROM (VALUES (0, '0.01', CAST(0.01 AS DOUBLE)), (1, '0.1', CAST(0.1 AS DOUBLE))) v(k, shown, c)),
itr AS (SELECT o, s, k, c, y, x FROM inner_f CROSS JOIN cand WHERE is_train),
{descent('inw', 'itr', GENES + 1, l2='1 / d.c', free=1, keys='o, s, k')},
isc AS (SELECT i.o, i.s, f.k, count(*) AS n, -{log_loss_of('list_dot_product(w, x)')} AS score
  FROM inner_f i JOIN inw_fit f ON f.o = i.o AND f.s = i.s WHERE NOT is_train GROUP BY 1, 2, 3),
means AS (SELECT o, k, sum(n * score) / sum(n) AS m FROM isc GROUP BY 1, 2),
best AS (SELECT o, k, m FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY m DESC, k) AS r FROM means) WHERE r = 1),
rtr AS (SELECT t.o, y, x, c FROM otr t JOIN best ON best.o = t.o JOIN cand ON cand.k = best.k),
{descent('rnw', 'rtr', GENES + 1, l2='1 / d.c', free=1, keys='o')},
tested AS (SELECT fold AS o, sample_id, y, list_dot_product(w, x) AS d FROM outer_f JOIN rnw_fit ON rnw_fit.o = fold)"""


def _nested_all_genes(t):
    labels = t.classes.select("sample_id", "y")
    expr = t.expr.withColumn("value", F.col("value") * 10)
    metrics = {"log_loss": H.negative_log_loss, "accuracy": H.accuracy, "roc_auc": H.auc}
    return nested_evaluation(
        expr, labels, stratified_k_fold(labels, "y", 2), range(2), "logistic", SPEC, {"C": [0.01, 0.1]},
        "all", all_genes, metrics, 2, "log_loss",
    )


@query("r01_nested_evaluation", f"""WITH {NESTED},
lines AS (SELECT o, -avg(ln(1 + exp(CASE WHEN y = 1 THEN -d ELSE d END))) AS loss,
  avg(CASE WHEN (d > 0) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS acc FROM tested GROUP BY o)
SELECT CAST(o AS INTEGER) AS split_id, 'general' AS section, 'fs_size' AS name, CAST({GENES} AS DOUBLE) AS value FROM lines
UNION ALL SELECT CAST(o AS INTEGER), 'Test', 'score', round(loss, 4) + 0 FROM lines
UNION ALL SELECT CAST(o AS INTEGER), 'Test', 'log_loss', round(loss, 4) + 0 FROM lines
UNION ALL SELECT CAST(o AS INTEGER), 'Test', 'accuracy', round(acc, 4) + 0 FROM lines
UNION ALL SELECT CAST(o AS INTEGER), 'Test', 'roc_auc', round(auc, 4) + 0 FROM ({auc_of('(SELECT o, y, d AS decision FROM tested)', 'o')})
UNION ALL SELECT CAST(o AS INTEGER), 'Validation', 'score', round(m, 4) + 0 FROM best
UNION ALL SELECT CAST(o AS INTEGER), 'Validation', 'C', c FROM best JOIN cand ON cand.k = best.k""")
def r01n(t):
    """One result row per outer split and field: size, test scores, validation score, best parameter."""
    results, _ = _nested_all_genes(t)
    numbers = results.where("name <> 'Class'")
    return numbers.select("split_id", "section", "name", rounded(F.col("value").cast("double"), 4).alias("value"))


@query("r02_out_of_fold_predictions", f"""WITH {NESTED}
SELECT CAST(o AS INTEGER) AS split_id, sample_id, CAST(y AS DOUBLE) AS label, round(1 / (1 + exp(-d)), 3) + 0 AS p1 FROM tested""")
def r02n(t):
    """Probability of every sample from the outer split that tests it."""
    _, predictions = _nested_all_genes(t)
    return predictions.select("split_id", "sample_id", "label", rounded("p1", 3).alias("p1"))


SECOND = f"""{ALL_GENES}, both_c AS (SELECT sample_id, y, list_append(x[17:48], CAST(1 AS DOUBLE)) AS x FROM scaled),
first_c AS (SELECT * FROM both_c WHERE sample_id % 2 = 0), {descent('cd', 'first_c', 33, l2=1.0, free=1, sweeps=60)},
pred AS (SELECT sample_id, y, list_dot_product(w, x) AS d FROM both_c CROSS JOIN cd_fit WHERE sample_id % 2 = 1)"""


def _cross_cohort(t):
    """Cohorts by odd and even ids; the first lacks the last 16 genes, the second the first 16."""
    expr = t.expr.withColumn("value", F.col("value") * 10)
    labels = t.classes.select("sample_id", "y")
    first = expr.where("sample_id % 2 = 0 AND gene_id <= 47"), labels.where("sample_id % 2 = 0")
    second = expr.where("sample_id % 2 = 1 AND gene_id >= 16"), labels.where("sample_id % 2 = 1")
    return train_on_first_test_on_second(first, second, all_genes, SPEC)


@query("c11_train_one_test_other", f"""WITH {SECOND}
SELECT sample_id, CAST(y AS DOUBLE) AS label, round(1 / (1 + exp(-d)), 3) + 0 AS p1, CAST(CASE WHEN d > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM pred""")
def c11(t):
    return _cross_cohort(t).select("sample_id", "label", rounded("p1", 3).alias("p1"), "prediction")


@query("c11_scores_on_other", f"""WITH {SECOND}
SELECT round(-avg(CASE WHEN y = 1 THEN ln(1 / (1 + exp(-d))) ELSE ln(1 - 1 / (1 + exp(-d))) END), 4) + 0 AS log_loss,
  round(avg(CASE WHEN (d > 0) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) + 0 AS accuracy FROM pred""")
def c11s(t):
    out = score_second(_cross_cohort(t), {"log_loss": H.log_loss, "accuracy": H.accuracy})
    return out.select(rounded("log_loss", 4).alias("log_loss"), rounded("accuracy", 4).alias("accuracy"))


@query("c11_auc_on_other", f"""WITH {SECOND}
SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * sum(1 - y)), 8) + 0 AS auc
FROM (SELECT y, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / CAST(2 AS DOUBLE) AS r FROM pred)""")
def c11a(t):
    return roc_auc(_cross_cohort(t), "label", "p1").select(rounded("auc", 8).alias("auc"))
