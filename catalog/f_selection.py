"""Gene selection: on given weight tables, and with fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fits_sql import ALL_GENES, LOSS, descent, split_genes
from catalog.registry import query, rounded
from catalog.tables import GENES
from riskloom.functions.vectors import gene_index, with_vector
from riskloom.operators import metrics as H
from riskloom.operators import selection as S
from riskloom.operators.folds import attach_splits, stratified_k_fold
from riskloom.operators.components import fit_gene_components
from riskloom.operators.models import LogisticSpec, fit_components
from riskloom.runtime import cut, scratch_path

L1 = LogisticSpec(C=0.5, penalty="l1", fit_intercept=False, max_iter=300, tol=1e-10)
QUICK = L1.with_params(tol=1e-6)
L2 = LogisticSpec(C=1.0)
# L1 weights of every train side, and how often each gene has one
FITS4 = f"""{split_genes(4)}, {descent('cd', 'train_splits', GENES, l1=2.0, keys='split_id')},
fits AS (SELECT split_id, CAST(i AS INTEGER) AS gene_id, w[i + 1] AS value FROM (SELECT split_id, w, unnest(range({GENES})) AS i FROM cd_fit)),
freq AS (SELECT gene_id, avg(CASE WHEN abs(value) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS frequency FROM fits GROUP BY gene_id)"""


def curve_sql(grid: list[float]) -> str:
    """CTE ``curve(place, threshold, loss, accuracy, split_id)`` of an L2 model on the genes above each threshold."""
    listed = ", ".join(f"({k}, CAST({g!r} AS DOUBLE))" for k, g in enumerate(grid))
    return f"""marks(place, threshold) AS (VALUES {listed}),
masks AS (SELECT place, threshold, list(CASE WHEN frequency > threshold THEN CAST(1 AS DOUBLE) ELSE 0 END ORDER BY gene_id) AS keep,
  max(frequency) > threshold AS passed FROM freq CROSS JOIN marks GROUP BY place, threshold),
masked AS (SELECT place, threshold, split_id, is_train, y,
  list_append(list_transform(range({GENES}), lambda k: x[k + 1] * keep[k + 1]), CAST(1 AS DOUBLE)) AS x FROM all_splits CROSS JOIN masks WHERE passed),
masked_train AS (SELECT * FROM masked WHERE is_train),
{descent('ls', 'masked_train', GENES + 1, l2=1.0, free=1, keys='place, split_id', sweeps=14)},
scored_test AS (SELECT m.place, threshold, m.split_id, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p1
  FROM masked m JOIN ls_fit l ON m.place = l.place AND m.split_id = l.split_id WHERE NOT is_train),
curve AS (SELECT place, threshold, split_id, {LOSS} AS loss,
  avg(CASE WHEN (p1 > 0.5) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy FROM scored_test GROUP BY 1, 2, 3)"""


def peeled_sql(limit: int, rounds: int = 5) -> str:
    """CTE ``st5(kept, active)``: repeated L1 fits on the genes not yet kept."""
    parts = [ALL_GENES, f"st0 AS (SELECT list_transform(range({GENES}), lambda k: 0) AS kept, TRUE AS active)"]
    for r in range(1, rounds + 1):
        parts.append(
            f"left{r} AS (SELECT y, list_transform(range({GENES}), lambda k: CASE WHEN kept[k + 1] > 0 THEN 0 ELSE x[k + 1] END) AS x "
            f"FROM scaled CROSS JOIN st{r - 1} WHERE active)"
        )
        parts.append(descent(f"cd{r}", f"left{r}", GENES, l1=2.0))
        parts.append(
            f"b{r} AS (SELECT kept, list_transform(range({GENES}), lambda k: CASE WHEN w[k + 1] > 0 THEN 1 ELSE 0 END) AS batch FROM cd{r}_fit CROSS JOIN st{r - 1} WHERE active)"
        )
        parts.append(
            f"st{r} AS (SELECT CASE WHEN ok THEN list_transform(range({GENES}), lambda k: kept[k + 1] + batch[k + 1]) ELSE kept END AS kept, ok AS active "
            f"FROM (SELECT *, list_sum(batch) > 0 AND list_sum(batch) + list_sum(kept) <= {limit} AS ok FROM b{r}) "
            f"UNION ALL SELECT kept, active FROM st{r - 1} WHERE NOT active)"
        )
    return ", ".join(parts)


def model_rows(t):
    """``(sample_id, features VECTOR, label)`` of all genes, scaled by 10."""
    arrays = t.vectors.withColumn("features", F.transform("features", lambda v: v * 10.0)).drop("code")
    return with_vector(arrays)


def split_rows(t, k: int):
    """The same with plain stratified folds; written once, since several fits read it."""
    rows = model_rows(t)
    sides = stratified_k_fold(rows.select("sample_id", "label"), "label", k)
    return cut(attach_splits(rows, sides), "design")


def index_of(t):
    return cut(gene_index(t.expr), "genes")


@query("f01_l1_positive_genes", f"""
WITH {ALL_GENES}, {descent('cd', 'scaled', GENES, l1=2.0)}
SELECT CAST(i AS INTEGER) AS gene_id FROM (SELECT w, unnest(range({GENES})) AS i FROM cd_fit) WHERE w[i + 1] > 0""")
def f01(t):
    """Genes with a positive weight in an L1 model."""
    return S.select_by_model(L1, model_rows(t), index_of(t)).select("gene_id")


@query("f02_peeled_genes", f"WITH {peeled_sql(40)} SELECT CAST(i AS INTEGER) AS gene_id FROM (SELECT kept, unnest(range({GENES})) AS i FROM st5) WHERE kept[i + 1] > 0")
def f02(t):
    """Repeated L1 fits on the genes not yet kept, up to 40 genes."""
    return S.select_by_peeling(L1, cut(model_rows(t), "design"), index_of(t), 40).select("gene_id")


@query("f03_participation", "SELECT gene_id, round(frequency, 8) + 0 AS frequency FROM frequency", "frequency")
def f03(t):
    """Share of fits with a weight other than 0."""
    stats = t.weights.selectExpr("fit_id", "'weight' AS kind", "gene_id AS name", "value")
    return S.frequency_of(stats).withColumn("frequency", rounded("frequency", 8))


@query("f03_participation_of_fits", f"WITH {FITS4} SELECT CAST(gene_id AS VARCHAR) AS gene_id, frequency FROM freq")
def f03f(t):
    """The same from L1 fits on four folds."""
    stats = S.repeated_fits(QUICK, split_rows(t, 4), range(4), index_of(t))
    return S.frequency_of(stats)


@query("f04_participation_threshold", """
SELECT threshold FROM (SELECT split_id, avg(test_score) AS loss, split_id / CAST(7 AS DOUBLE) AS threshold FROM score_log GROUP BY split_id)
ORDER BY loss, split_id LIMIT 1""", "score_log")
def f04(t):
    """The threshold of the lowest mean loss, first on ties."""
    curve = t.score_log.groupBy("split_id").agg(F.avg("test_score").alias("loss"))
    return S.chosen_threshold(curve.selectExpr("split_id AS place", "split_id / 7D AS threshold", "loss"))


@query("f04_participative_selection", f"""WITH {FITS4}, {curve_sql([0.1, 0.5, 0.9])},
best AS (SELECT threshold FROM curve GROUP BY place, threshold ORDER BY avg(loss), place LIMIT 1)
SELECT CAST(gene_id AS VARCHAR) AS gene_id FROM freq WHERE frequency > (SELECT threshold FROM best)""")
def f04f(t):
    """Frequencies from L1 fits, threshold by the loss of an L2 model."""
    return S.select_by_participation(QUICK, L2, split_rows(t, 4), range(4), range(4), index_of(t), [0.1, 0.5, 0.9])


@query("f05_top_by_participation", """
SELECT gene_id, frequency FROM frequency ORDER BY frequency DESC, gene_id LIMIT 50""", "frequency")
def f05(t):
    return S.top_by_participation(t.frequency, 50)


CURVE = "curve AS (SELECT user_id / CAST(1000 AS DOUBLE) AS threshold, avg(value) AS loss FROM events GROUP BY user_id)"


def _smoothed_choice() -> str:
    from riskloom.operators.describe import window_weights

    listed = ", ".join(f"({d - 2}, CAST({w!r} AS DOUBLE))" for d, w in enumerate(window_weights(5, "hanning")))
    return f"""
WITH {CURVE}, s AS (SELECT row_number() OVER (ORDER BY threshold) - 1 AS i, count(*) OVER () AS n, threshold, loss FROM curve),
k(d, w) AS (VALUES {listed}),
r AS (SELECT i, w, CASE WHEN i + d < 0 THEN -(i + d) WHEN i + d > n - 1 THEN 2 * (n - 1) - (i + d) ELSE i + d END AS j FROM s CROSS JOIN k),
m AS (SELECT r.i, sum(w * s.loss) AS v FROM r JOIN s ON s.i = r.j GROUP BY r.i),
best AS (SELECT threshold FROM m JOIN s ON s.i = m.i ORDER BY v, m.i LIMIT 1)
SELECT gene_id, frequency FROM frequency WHERE frequency > (SELECT threshold FROM best) - CAST(0.05 AS DOUBLE)"""


@query("f06_smoothed_threshold", _smoothed_choice(), "frequency")
def f06(t):
    """Genes above the lowest point of a smoothed loss curve less the malus."""
    curve = t.raw("events").groupBy((F.col("user_id") / 1000.0).alias("threshold")).agg(F.avg("value").alias("loss"))
    return S.select_by_smoothed_curve(t.frequency, curve)


@query("f07_above_kth", """
WITH share AS (SELECT l_partkey AS gene_id, avg(CASE WHEN l_quantity > 20 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS frequency FROM lineitem GROUP BY 1)
SELECT gene_id, frequency FROM share WHERE frequency > (SELECT frequency FROM share ORDER BY frequency DESC LIMIT 1 OFFSET 100)""")
def f07(t):
    """Parts by their share of large orders: those strictly above the 100th largest share, counted from 0."""
    large = F.avg((F.col("l_quantity") > 20).cast("double")).alias("frequency")
    return S.above_kth(t.raw("lineitem").groupBy(F.col("l_partkey").alias("gene_id")).agg(large), 100)


@query("f08_all_genes", "SELECT DISTINCT gene_id FROM weights", "weights")
def f08(t):
    return S.chosen_by_sign(t.weights.select("gene_id", "value"), passthrough=True).distinct()


@query("f09_stored_selection", "SELECT CAST(fit_id AS INTEGER) AS split_id, gene_id FROM weights WHERE value > 0", "weights")
def f09(t):
    """Selections of every split stored under their key and read back."""
    path = scratch_path(t.spark, "selected")
    chosen = t.weights.where("value > 0").selectExpr("fit_id AS split_id", "gene_id")
    S.store_selection(chosen, path, "positive")
    S.store_selection(chosen.where("split_id < 3"), path, "other")
    return S.read_selection(t.spark, path, "positive").selectExpr("split_id", "gene_id")


@query("f09_selection_per_split", f"""WITH {split_genes(3)}, {descent('cd', 'train_splits', GENES, l1=2.0, keys='split_id')}
SELECT CAST(split_id AS INTEGER) AS split_id, CAST(i AS INTEGER) AS gene_id
FROM (SELECT split_id, w, unnest(range({GENES})) AS i FROM cd_fit) WHERE w[i + 1] > 0""")
def f09f(t):
    """An L1 selection on the train side of each split."""
    index = index_of(t)
    return S.select_per_split(lambda train: S.select_by_model(QUICK, train, index), split_rows(t, 3), range(3))


PCA2 = """g AS (SELECT vec_id AS sample_id, 10 * CAST(embedding[1] AS DOUBLE) AS a, 10 * CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
tr AS (SELECT * FROM g WHERE sample_id % 4 <> 0),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) / 2 AS th FROM tr)"""


@query("f10_principal_components", f"""
WITH {PCA2}
SELECT sample_id, round(abs((a - ma) * cos(th) + (b - mb) * sin(th)), 6) + 0 AS pc1,
  round(abs((b - mb) * cos(th) - (a - ma) * sin(th)), 6) + 0 AS pc2 FROM g CROSS JOIN m""")
def f10(t):
    """Components of two genes fitted on the train part, applied to every sample.

    The sign of a component is free, so sizes are compared.
    """
    from riskloom.operators.selection import slice_genes

    rows = slice_genes(model_rows(t), [0, 1])
    parts = fit_components(rows.where("sample_id % 4 <> 0"), 2).transform(rows)
    from pyspark.ml.functions import vector_to_array

    scores = vector_to_array("features")
    return parts.select("sample_id", rounded(F.abs(scores[0])).alias("pc1"), rounded(F.abs(scores[1])).alias("pc2"))


@query("f10_components_of_all_genes")
def f10a(t):
    """Five components of all genes."""
    from pyspark.ml.functions import vector_to_array

    rows = model_rows(t)
    parts = fit_components(rows.where("sample_id % 4 <> 0"), 5).transform(rows)
    return parts.select("sample_id", vector_to_array("features").alias("scores"))


def _power(name: str, matrix: str, steps: int) -> str:
    """CTE ``name_vec(v, l)``: first eigenvector and value of a matrix given as rows ``(i, c)``."""
    return f"""{name} AS (SELECT 0 AS it, list_transform(range({GENES}), lambda k: 1 + CAST(k % 7 AS DOUBLE)) AS v, CAST(0 AS DOUBLE) AS l
UNION ALL SELECT it + 1, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w))), sqrt(list_dot_product(w, w))
  FROM (SELECT it, list(list_dot_product(c, v) ORDER BY i) AS w FROM {name} CROSS JOIN {matrix} WHERE it < {steps} GROUP BY it)),
{name}_vec AS (SELECT v, l FROM {name} WHERE it = {steps})"""


@query("f10_components_by_samples", f"""
WITH RECURSIVE {ALL_GENES}, cells AS (SELECT sample_id, x, unnest(range({GENES})) AS i FROM scaled),
m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x[i + 1]) AS a FROM cells GROUP BY i)),
centred AS (SELECT list_transform(range({GENES}), lambda k: x[k + 1] - m[k + 1]) AS x FROM scaled CROSS JOIN m),
pairs AS (SELECT i, j, sum(x[i + 1] * x[j + 1]) AS s FROM centred CROSS JOIN (SELECT unnest(range({GENES})) AS i) a CROSS JOIN (SELECT unnest(range({GENES})) AS j) b GROUP BY i, j),
c1 AS (SELECT i, list(s ORDER BY j) AS c FROM pairs GROUP BY i),
{_power('p1', 'c1', 1500)},
c2 AS (SELECT i, list_transform(range({GENES}), lambda k: c[k + 1] - l * v[i + 1] * v[k + 1]) AS c FROM c1 CROSS JOIN p1_vec),
{_power('p2', 'c2', 1500)}
SELECT CAST(0 AS INTEGER) AS component, CAST(i AS INTEGER) AS gene_id, round(abs(v[i + 1]), 3) + 0 AS loading FROM (SELECT v, unnest(range({GENES})) AS i FROM p1_vec)
UNION ALL SELECT CAST(1 AS INTEGER), CAST(i AS INTEGER), round(abs(v[i + 1]), 3) + 0 FROM (SELECT v, unnest(range({GENES})) AS i FROM p2_vec)""")
def f10s(t):
    """Loadings of all genes on two components, from tiles of genes and samples; the sign is free."""
    found = fit_gene_components(t.expr.withColumn("value", F.col("value") * 10), 2)
    return found.loadings.withColumn("loading", rounded(F.abs("loading"), 3))


@query("f11_threshold_curve", f"""WITH {FITS4}, {curve_sql([0.1, 0.4, 0.7])}
SELECT CAST(place AS INTEGER) AS place, threshold, 'loss' AS metric, round(avg(loss), 3) + 0 AS mean, round(var_pop(loss), 4) + 0 AS variance FROM curve GROUP BY place, threshold
UNION ALL SELECT CAST(place AS INTEGER), threshold, 'accuracy', round(avg(accuracy), 3) + 0, round(var_pop(accuracy), 4) + 0 FROM curve GROUP BY place, threshold""")
def f11(t):
    """Mean and variance of two metrics per frequency threshold."""
    rows, index = split_rows(t, 4), index_of(t)
    frequency = cut(S.frequency_of(S.repeated_fits(QUICK, rows, range(4), index)), "frequency")
    metrics = {"loss": H.log_loss, "accuracy": H.accuracy}
    out = S.threshold_curve(L2.with_params(tol=1e-9), rows, range(4), frequency, index, [0.1, 0.4, 0.7], metrics)
    return out.select("place", "threshold", "metric", rounded("mean", 3).alias("mean"), rounded("variance", 4).alias("variance"))
