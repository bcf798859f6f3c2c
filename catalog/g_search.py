"""Search and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.e_folds import SEED, draw, fold_sql
from catalog.fits_sql import LOSS, SPLITS4, WHOLE, auc_of, descent, log_loss_of
from catalog.f_selection import model_rows, split_rows
from catalog.registry import query, rounded
from catalog.tables import GENES
from riskloom.operators import folds as E
from riskloom.operators import metrics as H
from riskloom.operators import search as G
from riskloom.operators.models import LogisticSpec

SPEC = LogisticSpec(C=1.0, max_iter=300, tol=1e-15)
STRENGTHS = [0.001, 0.01, 0.1]


def _grid(t, column: str, table: str):
    return t.raw(table).select(column).distinct()


@query("g01_candidates", """
WITH a AS (SELECT DISTINCT p_brand AS brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS i FROM part),
b AS (SELECT DISTINCT p_size AS size, dense_rank() OVER (ORDER BY p_size) - 1 AS j FROM part),
c AS (SELECT DISTINCT o_orderpriority AS priority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS k FROM orders),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc)
SELECT (i * nc + k) * nb + j AS candidate_id, brand, priority, CAST(size AS VARCHAR) AS size FROM a CROSS JOIN b CROSS JOIN c CROSS JOIN n
UNION ALL SELECT na * nb * nc + k, NULL, priority, NULL FROM c CROSS JOIN n""")
def g01(t):
    """Two grids one after the other; names in order, the last name fastest."""
    priorities = _grid(t, "o_orderpriority", "orders")
    first = {"size": _grid(t, "p_size", "part"), "brand": _grid(t, "p_brand", "part"), "priority": priorities}
    table = G.candidate_table(t.spark, [first, {"priority": priorities}])
    return table.select("candidate_id", *[F.col("params")[k].alias(k) for k in ("brand", "priority", "size")])


def four_splits(t):
    return split_rows(t, 4)


CANDIDATES = f"""cand AS (SELECT * FROM (VALUES (0, CAST(0.001 AS DOUBLE)), (1, CAST(0.01 AS DOUBLE)), (2, CAST(0.1 AS DOUBLE))) v(candidate_id, c)),
train4 AS (SELECT candidate_id, c, split_id, y, x FROM splits4 CROSS JOIN cand WHERE is_train),
{descent('cd', 'train4', GENES + 1, l2='1 / d.c', free=1, keys='candidate_id, split_id')},
scores AS (SELECT s.split_id, is_train, f.candidate_id, s.sample_id, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p1, list_dot_product(w, x) AS decision
  FROM splits4 s JOIN cd_fit f ON f.split_id = s.split_id)"""
SEARCHED = f"{SPLITS4}, {CANDIDATES}"
LOG = f"""slog AS (SELECT candidate_id, CAST(split_id AS INTEGER) AS split_id, count(*) AS n_test, -({LOSS}) AS neg_log_loss,
  avg(CASE WHEN (p1 > 0.5) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy
  FROM scores WHERE NOT is_train GROUP BY 1, 2)"""
METRICS = {"neg_log_loss": H.negative_log_loss, "accuracy": H.accuracy, "roc_auc": H.auc}


@query("g02_fit_and_score", f"""WITH {SEARCHED}, {LOG}
SELECT CAST(candidate_id AS INTEGER) AS candidate_id, split_id, n_test, round(neg_log_loss, 4) + 0 AS test_score FROM slog""")
def g02(t):
    """Three strengths on four splits."""
    log = G.fit_and_score(SPEC, [{"C": c} for c in STRENGTHS], four_splits(t), range(4))
    return log.select("candidate_id", "split_id", "n_test", rounded("test_score", 4).alias("test_score"))


@query("g03_search_summary", """
WITH m AS (SELECT candidate_id, metric, sum(n_test * test_score) / sum(n_test) AS mean, count(*) AS n_splits FROM score_log GROUP BY 1, 2),
s AS (SELECT l.candidate_id, l.metric, any_value(mean) AS mean, any_value(n_splits) AS n_splits,
  sqrt(sum(n_test * (test_score - mean) * (test_score - mean)) / sum(n_test)) AS std
  FROM score_log l JOIN m ON l.candidate_id = m.candidate_id AND l.metric = m.metric GROUP BY 1, 2)
SELECT metric, candidate_id, round(mean, 9) + 0 AS mean_score, round(std, 7) + 0 AS std_score, n_splits,
  CAST(rank() OVER (PARTITION BY metric ORDER BY mean DESC) AS INTEGER) AS rank FROM s""", "score_log")
def g03(t):
    """Means weighted by test size, deviation with the same weights, minimum rank."""
    s = G.search_summary(t.score_log)
    return s.select(
        "metric", "candidate_id", rounded("mean_score", 9).alias("mean_score"), rounded("std_score", 7).alias("std_score"), "n_splits", "rank"
    )


@query("g03_split_columns", "SELECT metric, candidate_id, " + ", ".join(
    f"max(test_score) FILTER (split_id = {i}) AS split{i}_test_score" for i in range(7)
) + " FROM score_log GROUP BY 1, 2", "score_log")
def g03s(t):
    return G.split_columns(t.score_log, range(7))


@query("g03_train_score_summary", """
WITH m AS (SELECT candidate_id, metric, avg(train_score) AS mean, stddev_pop(train_score) AS std, count(*) AS n_splits FROM score_log GROUP BY 1, 2)
SELECT metric, candidate_id, round(mean, 9) + 0 AS mean_score, round(std, 7) + 0 AS std_score, n_splits,
  CAST(rank() OVER (PARTITION BY metric ORDER BY mean DESC) AS INTEGER) AS rank FROM m""", "score_log")
def g03t(t):
    """Train scores, splits weighted alike."""
    s = G.search_summary(t.score_log, iid=False, score="train_score")
    return s.select(
        "metric", "candidate_id", rounded("mean_score", 9).alias("mean_score"), rounded("std_score", 7).alias("std_score"), "n_splits", "rank"
    )


@query("g04_best_candidate", """
WITH m AS (SELECT candidate_id, metric, sum(n_test * test_score) / sum(n_test) AS mean FROM score_log GROUP BY 1, 2)
SELECT metric, candidate_id, round(mean, 9) + 0 AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, candidate_id) AS k FROM m) WHERE k = 1""", "score_log")
def g04(t):
    best = G.best_candidate(G.search_summary(t.score_log))
    return best.withColumn("best_score", rounded("best_score", 9))


@query("g04_best_refit", f"""
WITH {SEARCHED}, {LOG},
best AS (SELECT candidate_id FROM slog GROUP BY 1 ORDER BY sum(n_test * neg_log_loss) / sum(n_test) DESC, candidate_id LIMIT 1),
chosen AS (SELECT y, x, c FROM whole CROSS JOIN cand WHERE candidate_id = (SELECT candidate_id FROM best)),
{descent('final', 'chosen', GENES + 1, l2='1 / d.c', free=1)}
SELECT (SELECT c FROM cand JOIN best USING (candidate_id)) AS C, CAST(i AS INTEGER) AS gene_ix, round(w[i + 1], 3) + 0 AS weight, round(w[{GENES + 1}], 3) + 0 AS intercept
FROM (SELECT w, unnest(range({GENES})) AS i FROM final_fit)""")
def g04r(t):
    """Search, then fit the best strength on all rows."""
    rows = four_splits(t)
    found = G.GridSearch(SPEC, {"C": STRENGTHS}).fit(rows, range(4), model_rows(t))
    best = (float(found.best_params["C"]), found.best_model.weights.tolist(), float(found.best_model.intercept))
    one = t.spark.createDataFrame([best], "C double, w array<double>, intercept double")
    weights = one.select("C", F.posexplode("w").alias("gene_ix", "weight"), rounded("intercept", 3).alias("intercept"))
    return weights.withColumn("weight", rounded("weight", 3))


@query("g05_several_metrics", f"""WITH {SEARCHED}, {LOG}
SELECT CAST(candidate_id AS INTEGER) AS candidate_id, split_id, 'neg_log_loss' AS metric, round(neg_log_loss, 4) + 0 AS test_score FROM slog
UNION ALL SELECT CAST(candidate_id AS INTEGER), split_id, 'accuracy', round(accuracy, 4) + 0 FROM slog
UNION ALL SELECT CAST(candidate_id AS INTEGER), CAST(split_id AS INTEGER), 'roc_auc', round(auc, 4) + 0
  FROM ({auc_of('(SELECT * FROM scores WHERE NOT is_train)', 'candidate_id, split_id')})""")
def g05(t):
    log = G.fit_and_score(SPEC, [{"C": c} for c in STRENGTHS], four_splits(t), range(4), METRICS)
    return log.select("candidate_id", "split_id", "metric", rounded("test_score", 4).alias("test_score"))


@query("g06_failed_fit_recorded", f"""WITH {SEARCHED}, {LOG}
SELECT CAST(0 AS INTEGER) AS candidate_id, split_id, CAST(-99 AS DOUBLE) AS test_score FROM slog WHERE candidate_id = 0
UNION ALL SELECT CAST(1 AS INTEGER), split_id, round(neg_log_loss, 4) + 0 FROM slog WHERE candidate_id = 1""")
def g06(t):
    """A strength below 0 cannot be fitted; its score is recorded as -99."""
    log = G.fit_and_score(SPEC, [{"C": -1.0}, {"C": 0.01}], four_splits(t), range(4), error_score=-99.0)
    return log.select("candidate_id", "split_id", rounded("test_score", 4).alias("test_score"))


@query("g07_merged_parameters", """
SELECT candidate_id AS name, arg_max(test_score, split_id) AS value FROM score_log GROUP BY candidate_id""", "score_log")
def g07(t):
    """Best values of grids run one after the other; the later grid wins."""
    return G.merge_best(t.score_log.selectExpr("split_id AS step", "candidate_id AS name", "test_score AS value"))


SEQUENCE = f"""{SPLITS4},
cand AS (SELECT * FROM (VALUES (1, 0, '0.001', CAST(0.001 AS DOUBLE), FALSE), (1, 1, '0.01', CAST(0.01 AS DOUBLE), FALSE),
  (1, 2, '0.1', CAST(0.1 AS DOUBLE), FALSE), (2, 0, 'False', CAST(1 AS DOUBLE), FALSE), (2, 1, 'True', CAST(1 AS DOUBLE), TRUE)) v(grid, candidate_id, shown, c, pen)),
tr AS (SELECT grid, candidate_id, c, pen, split_id, y, x FROM splits4 CROSS JOIN cand WHERE is_train),
{descent('cd', 'tr', GENES + 1, l2='1 / d.c', free=1, keys='grid, candidate_id, split_id', last='CASE WHEN d.pen THEN 1 / d.c ELSE 0 END')},
sc AS (SELECT f.grid, f.candidate_id, s.split_id, count(*) AS n, -{log_loss_of('list_dot_product(w, x)')} AS s
  FROM splits4 s JOIN cd_fit f ON f.split_id = s.split_id WHERE NOT is_train GROUP BY 1, 2, 3),
mn AS (SELECT grid, candidate_id, sum(n * s) / sum(n) AS m FROM sc GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY m DESC, candidate_id) AS k FROM mn) WHERE k = 1)"""


@query("g07_sequential_search", f"""WITH {SEQUENCE}
SELECT CASE WHEN b.grid = 1 THEN 'C' ELSE 'penalise_intercept' END AS name, shown AS value,
  (SELECT round(m, 4) + 0 FROM best WHERE grid = 2) AS best_score FROM best b JOIN cand c ON c.grid = b.grid AND c.candidate_id = b.candidate_id""")
def g07f(t):
    """Strength first, then whether the intercept is penalised."""
    rows = four_splits(t)
    merged, score, _ = G.sequential_search(
        SPEC, [{"C": STRENGTHS}, {"penalise_intercept": [False, True]}], rows, range(4), model_rows(t)
    )
    shown = [(k, str(v), round(float(score), 4)) for k, v in merged.items()]
    return t.spark.createDataFrame(shown, "name string, value string, best_score double")


INTERVALS = [
    # name, lo, hi, lo_limit, hi_limit, grid_lo, grid_hi, scale
    ("click", -2.0, 2.0, -4.0, 4.0, 0.01, 100.0, "log"),
    ("view", 0.0, 3.0, -1.0, 6.0, 1.0, 3.0, "linear"),
    ("error", 1.0, 2.0, 0.0, 9.0, 1.0, 5.0, "linear"),
    ("signup", 0.0, 1.0, -3.0, 2.0, 1.0, 10.0, "log"),
    ("purchase", 2.0, 4.0, 1.0, 8.0, 2.0, 3.0, "linear"),
]


@query("g08_interval_step", """
WITH chosen AS (SELECT event_type AS name, CAST(1 + event_id % 4 + floor(value / 100) AS DOUBLE) AS value FROM events),
iv AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{n}', " + ", ".join(f"CAST({v} AS DOUBLE)" for v in vs) + f", '{s}')" for n, *vs, s in INTERVALS
) + """) v(name, lo, hi, lo_limit, hi_limit, grid_lo, grid_hi, scale)),
e AS (SELECT name, min(value) AS mn, max(value) AS mx FROM chosen GROUP BY name),
s AS (SELECT c.name, any_value(mn) AS mn, any_value(mx) AS mx, avg(CASE WHEN value = mn THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS pn,
  avg(CASE WHEN value = mx THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS px FROM chosen c JOIN e ON c.name = e.name GROUP BY c.name),
n AS (SELECT iv.name,
  CASE WHEN mn > grid_lo THEN CASE WHEN scale = 'log' THEN log10(mn) ELSE mn END WHEN pn > 0.2 THEN lo - abs(pn * (lo - lo_limit)) ELSE lo END AS a,
  CASE WHEN mx < grid_hi THEN CASE WHEN scale = 'log' THEN log10(mx) ELSE mx END WHEN px > 0.2 THEN hi + abs(px * (hi_limit - hi)) ELSE hi END AS b,
  mn <= grid_lo AND pn <= 0.2 AND mx >= grid_hi AND px <= 0.2 AS settled FROM iv JOIN s ON s.name = iv.name)
SELECT name, round(least(a, b), 6) + 0 AS lo, round(greatest(a, b), 6) + 0 AS hi, settled FROM n""")
def g08(t):
    """One update of five intervals from the values picked in the events."""
    chosen = t.raw("events").selectExpr(
        "event_type AS name", "user_id AS split_id", "CAST(1 + event_id % 4 + floor(value / 100) AS DOUBLE) AS value"
    )
    intervals = t.spark.createDataFrame(
        INTERVALS,
        "name string, lo double, hi double, lo_limit double, hi_limit double, grid_lo double, grid_hi double, scale string",
    )
    out = G.interval_step(chosen, intervals, p_aug=0.2)
    return out.select("name", rounded("lo").alias("lo"), rounded("hi").alias("hi"), "settled")


@query("g08_adaptive_search")
def g08f(t):
    """Three rounds over the strength: each split picks its best value, the range follows."""
    rows = four_splits(t)

    def pick(grid):
        log = G.fit_and_score(SPEC, [{"C": c} for c in grid["C"]], rows, range(4))
        best = log.groupBy("split_id").agg(F.max_by(F.col("params")["C"], "test_score").alias("c"))
        return best.select(F.lit("C").alias("name"), "split_id", F.col("c").cast("double").alias("value"))

    start = {"C": {"lo": -3.0, "hi": -1.0, "lo_limit": -4.0, "hi_limit": 1.0, "n": 3, "scale": "log"}}
    state = G.adaptive_search(SPEC, start, pick, n_rounds=3)
    return t.spark.createDataFrame([(k, v["lo"], v["hi"]) for k, v in state.items()], "name string, lo double, hi double")


@query("g09_random_candidates", f"""
WITH a AS (SELECT DISTINCT p_brand AS brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS i FROM part),
b AS (SELECT DISTINCT p_size AS size, dense_rank() OVER (ORDER BY p_size) - 1 AS j FROM part),
c AS (SELECT i * (SELECT count(*) FROM b) + j AS candidate_id, brand, CAST(size AS VARCHAR) AS size FROM a CROSS JOIN b)
SELECT * FROM c ORDER BY {draw('0', 'candidate_id')} LIMIT 40""")
def g09(t):
    """Forty candidates of a grid in hash order."""
    table = G.candidate_table(t.spark, {"brand": _grid(t, "p_brand", "part"), "size": _grid(t, "p_size", "part")})
    return G.random_candidates(table, 40, SEED).select(
        "candidate_id", F.col("params")["brand"].alias("brand"), F.col("params")["size"].alias("size")
    )


@query("g10_cross_validate", f"""WITH {SEARCHED},
x AS (SELECT split_id, is_train, {LOSS} AS loss FROM scores WHERE candidate_id = 1 GROUP BY 1, 2)
SELECT CAST(split_id AS INTEGER) AS split_id, round(-max(loss) FILTER (NOT is_train), 4) + 0 AS test_score,
  round(-max(loss) FILTER (is_train), 4) + 0 AS train_score FROM x GROUP BY 1""")
def g10(t):
    spec = SPEC.with_params(C=0.01)
    log = G.cross_validate(spec, four_splits(t), range(4), train_scores=True)
    return log.select("split_id", rounded("test_score", 4).alias("test_score"), rounded("train_score", 4).alias("train_score"))


@query("g11_cross_val_score", f"""WITH {SEARCHED}, {LOG}
SELECT split_id, round(accuracy, 4) + 0 AS test_score FROM slog WHERE candidate_id = 2""")
def g11(t):
    spec = SPEC.with_params(C=0.1)
    scores = G.cross_val_score(spec, four_splits(t), range(4), H.accuracy)
    return scores.select("split_id", rounded("test_score", 4).alias("test_score"))


@query("g12_out_of_fold_predictions", f"""WITH {SEARCHED}
SELECT sample_id, CAST(split_id AS INTEGER) AS split_id, CAST(CASE WHEN decision > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
  round(p1, 3) + 0 AS p1, round(decision, 3) + 0 AS decision, round(ln(p1), 3) + 0 AS log_p1 FROM scores WHERE NOT is_train AND candidate_id = 2""")
def g12(t):
    """Class, probability, log probability and decision value, each sample once."""
    out = G.cross_val_predict(SPEC.with_params(C=0.1), four_splits(t), range(4))
    return out.select(
        "sample_id", F.col("split_id").cast("int").alias("split_id"), "prediction",
        *[rounded(c, 3).alias(c) for c in ("p1", "decision", "log_p1")],
    )


@query("g12_partition_check", """
SELECT count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tests, count(*) FILTER (n > 0) AS n_tested, sum(n) = count(*) AND count(*) FILTER (n > 0) = count(*) AS exact
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def g12c(t):
    """Customers as samples, orders as tests: not a partition."""
    tests = t.raw("orders").selectExpr("o_custkey AS sample_id")
    return G.check_partition(tests, t.raw("customer").selectExpr("c_custkey AS sample_id"))


@query("g13_permuted_labels", f"""
WITH ix AS (SELECT r, grp, y, row_number() OVER (PARTITION BY r, grp ORDER BY {draw('r')}) - 1 AS i FROM orders_y CROSS JOIN (SELECT unnest(range(2)) AS r) x),
slot AS (SELECT sample_id, grp, row_number() OVER (PARTITION BY grp ORDER BY sample_id) - 1 AS i FROM orders_y)
SELECT CAST(r AS INTEGER) AS permutation, sample_id, slot.grp, y FROM slot JOIN ix ON slot.grp = ix.grp AND slot.i = ix.i""", "orders_y")
def g13(t):
    """Order states dealt out anew within each customer, twice."""
    return G.permuted_labels(t.orders_y.select("sample_id", "grp", "y"), 2, SEED, "grp")


@query("g13_p_values", """
SELECT grp, round((sum(CASE WHEN p1 >= 0.2 THEN 1 ELSE 0 END) + 1) / CAST(count(*) + 1 AS DOUBLE), 8) + 0 AS p_value FROM scored GROUP BY grp""", "scored")
def g13p(t):
    scores = t.scored.withColumnRenamed("p1", "score")
    return G.permutation_p_value(scores, 0.2, ["grp"]).withColumn("p_value", rounded("p_value", 8))


@query("g13_permutation_test", f"""WITH {SPLITS4},
dealt AS (SELECT r, y, row_number() OVER (PARTITION BY r ORDER BY {draw('r')}) - 1 AS i FROM scaled CROSS JOIN (SELECT unnest(range(3)) AS r) x),
slot AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM scaled),
labels AS (SELECT r, sample_id, y FROM slot JOIN dealt ON slot.i = dealt.i UNION ALL SELECT -1, sample_id, y FROM scaled),
rows_ AS (SELECT r, split_id, is_train, l.y, x FROM splits4 s JOIN labels l ON l.sample_id = s.sample_id),
tr AS (SELECT * FROM rows_ WHERE is_train), {descent('cd', 'tr', GENES + 1, l2=10.0, free=1, keys='r, split_id', sweeps=12)},
sc AS (SELECT o.r, o.split_id, -{log_loss_of('list_dot_product(w, x)')} AS s
  FROM rows_ o JOIN cd_fit f ON f.r = o.r AND f.split_id = o.split_id WHERE NOT is_train GROUP BY 1, 2),
m AS (SELECT r, avg(s) AS score FROM sc GROUP BY r)
SELECT CAST(r AS INTEGER) AS permutation, round(score, 4) + 0 AS score,
  (SELECT (count(*) FILTER (r >= 0 AND score >= (SELECT score FROM m WHERE r = -1)) + 1) / CAST(4 AS DOUBLE) FROM m) AS p_value FROM m""")
def g13t(t):
    """A model's score against three deals of permuted labels."""
    rows = four_splits(t)
    labels = t.classes.select("sample_id", "y")
    score, permuted, p = G.permutation_test(SPEC.with_params(C=0.1), rows, range(4), labels, H.negative_log_loss, 3, SEED)
    listed = [(k - 1, round(s, 4) + 0.0, p) for k, s in enumerate([score, *permuted])]  # -1: the true labels
    return t.spark.createDataFrame(listed, "permutation int, score double, p_value double")


@query("g14_learning_curve_subsets", f"""
WITH ix AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT c_custkey AS sample_id FROM customer)),
f AS (SELECT sample_id, s AS split_id, {fold_sql('i', 'n', 3)} <> s AS is_train FROM ix CROSS JOIN (SELECT unnest(range(3)) AS s) x),
nmax AS (SELECT min(c) AS m FROM (SELECT split_id, count(*) AS c FROM f WHERE is_train GROUP BY 1)),
sizes AS (SELECT DISTINCT CAST(greatest(1, least(m, floor(q * m))) AS BIGINT) AS train_size FROM nmax CROSS JOIN (SELECT unnest([CAST(0.1 AS DOUBLE), 0.325, 0.55, 1]) AS q) y),
r AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY sample_id) - 1 AS k FROM f WHERE is_train)
SELECT split_id, train_size, sample_id, is_train FROM r CROSS JOIN sizes WHERE k < train_size
UNION ALL SELECT split_id, train_size, sample_id, is_train FROM f CROSS JOIN sizes WHERE NOT is_train""")
def g14(t):
    """Train subsets of four sizes in every split."""
    samples = t.raw("customer").selectExpr("c_custkey AS sample_id")
    folds = E.with_train_side(E.k_fold(samples, 3), range(3))
    smallest = folds.where("is_train").groupBy("split_id").count().agg(F.min("count")).first()[0]
    return G.train_subsets(folds, G.train_size_list([0.1, 0.325, 0.55, 1.0], smallest))


@query("g14_learning_curve", f"""WITH {SPLITS4},
nmax AS (SELECT min(c) AS m FROM (SELECT split_id, count(*) AS c FROM splits4 WHERE is_train GROUP BY 1)),
sizes AS (SELECT DISTINCT CAST(floor(q * m) AS INTEGER) AS train_size FROM nmax CROSS JOIN (SELECT unnest([CAST(0.2 AS DOUBLE), 1]) AS q) z),
k AS (SELECT *, row_number() OVER (PARTITION BY split_id, is_train ORDER BY sample_id) - 1 AS k FROM splits4),
part AS (SELECT train_size, split_id, is_train, y, x FROM k CROSS JOIN sizes WHERE NOT is_train OR k < train_size),
tr AS (SELECT * FROM part WHERE is_train), {descent('cd', 'tr', GENES + 1, l2=10.0, free=1, keys='train_size, split_id', sweeps=40)},
sc AS (SELECT o.train_size, o.split_id, is_train, {log_loss_of('list_dot_product(w, x)')} AS loss
  FROM part o JOIN cd_fit f ON f.train_size = o.train_size AND f.split_id = o.split_id GROUP BY 1, 2, 3)
SELECT train_size, CAST(split_id AS INTEGER) AS split_id, round(max(loss) FILTER (is_train), 4) + 0 AS train_score, round(max(loss) FILTER (NOT is_train), 4) + 0 AS test_score
FROM sc GROUP BY 1, 2""")
def g14f(t):
    rows = four_splits(t)
    out = G.learning_curve(SPEC.with_params(C=0.1), rows, range(4), [0.2, 1.0], H.log_loss)
    return out.select("train_size", "split_id", rounded("train_score", 4).alias("train_score"), rounded("test_score", 4).alias("test_score"))


@query("g15_validation_curve", f"""WITH {SEARCHED},
x AS (SELECT candidate_id, split_id, is_train, {LOSS} AS loss FROM scores GROUP BY 1, 2, 3)
SELECT CAST(c AS VARCHAR) AS value, CAST(split_id AS INTEGER) AS split_id, round(max(loss) FILTER (is_train), 4) + 0 AS train_score,
  round(max(loss) FILTER (NOT is_train), 4) + 0 AS test_score FROM x JOIN cand ON cand.candidate_id = x.candidate_id GROUP BY 1, 2""")
def g15(t):
    """Train and test loss per strength."""
    out = G.validation_curve(SPEC, "C", STRENGTHS, four_splits(t), range(4), H.log_loss)
    return out.select("value", "split_id", rounded("train_score", 4).alias("train_score"), rounded("test_score", 4).alias("test_score"))


@query("g16_scores_to_columns", """
SELECT event_id AS place, max(value) FILTER (m = 'a') AS a, max(value) FILTER (m = 'b') AS b
FROM (SELECT event_id, value, 'a' AS m FROM events UNION ALL SELECT event_id, 2 * value, 'b' FROM events) GROUP BY 1""")
def g16(t):
    """Score rows of two metrics as two columns, one row per fit."""
    events = t.raw("events").selectExpr("event_id AS place", "value AS score")
    rows = events.withColumn("metric", F.lit("a")).unionByName(
        events.selectExpr("place", "2 * score AS score").withColumn("metric", F.lit("b"))
    )
    return G.aggregate_scores(rows, ["a", "b"])


@query("g17_use_of_best_model", f"""WITH {WHOLE}, {descent('cd', 'whole', GENES + 1, l2=10.0, free=1)}, sc AS (SELECT sample_id, list_dot_product(w, x) AS d FROM whole CROSS JOIN cd_fit)
SELECT sample_id, CAST(CASE WHEN d > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction, round(1 / (1 + exp(-d)), 3) + 0 AS p1,
  round(d, 3) + 0 AS decision, round(ln(1 - 1 / (1 + exp(-d))), 3) + 0 AS log_p0 FROM sc""")
def g17(t):
    """Class, probability, log probability and decision value of a fitted model."""
    rows = model_rows(t)
    out = G.predictions_of(SPEC.with_params(C=0.1).fit(rows), rows)
    return out.select("sample_id", "prediction", *[rounded(c, 3).alias(c) for c in ("p1", "decision", "log_p0")])
