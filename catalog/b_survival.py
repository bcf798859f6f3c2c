"""Survival labels, filters and outcome curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from riskloom.operators import survival as S
from riskloom.plans.prepare import class_balance, task_labels
from riskloom.plans.risk import risk_rows

HORIZONS = [24, 48, 60, 72]
LISTED = "(SELECT unnest([24, 48, 60, 72]) AS h) x"


@query("q01_class_balance_per_fold", f"""
WITH lab AS (SELECT CAST(h AS INTEGER) AS horizon, sample_id,
    CASE WHEN NOT event THEN 1 WHEN months > h THEN 1 ELSE 0 END AS y
  FROM survival CROSS JOIN {LISTED} WHERE event OR months > h),
ix AS (SELECT *, row_number() OVER (PARTITION BY horizon, y ORDER BY sample_id) - 1 AS i,
    count(*) OVER (PARTITION BY horizon, y) AS n FROM lab),
f AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
    ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS split_id FROM ix)
SELECT horizon, CAST(split_id AS INTEGER) AS split_id, count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_positive
FROM f GROUP BY ALL""", "survival")
def q01(t):
    """From censored text to class balance: parse, filter, label, fold, count."""
    return class_balance(task_labels(t.patients, "all", HORIZONS), 5)


@query("b01_parse_months", "SELECT sample_id, months, event FROM survival", "survival")
def b01(t):
    return t.survival.select("sample_id", "months", "event")


@query("b02_censor_filter", "SELECT sample_id, months, event FROM survival WHERE NOT (NOT event AND months <= 60)", "survival")
def b02(t):
    return S.censor(t.survival, 60).select("sample_id", "months", "event")


@query("b03_censor_filter_strict", "SELECT sample_id, months, event FROM survival WHERE NOT (NOT event AND months < 60)", "survival")
def b03(t):
    return S.censor(t.survival, 60, boundary="lt").select("sample_id", "months", "event")


@query("b04_label_at_horizon", """
SELECT sample_id, CAST(CASE WHEN NOT event THEN 1 WHEN months > 60 THEN 1 ELSE 0 END AS INTEGER) AS y_text,
  CAST(months > 60 AS INTEGER) AS y_number FROM survival""", "survival")
def b04(t):
    m, e = F.col("months"), F.col("event")
    return t.survival.select(
        "sample_id", S.label_at(m, e, 60, True).alias("y_text"), S.label_at(m, e, 60, False).alias("y_number")
    )


@query("b05_disease_free_label", """
SELECT sample_id, dfs AS target, CAST(dfs > 48 AS INTEGER) AS y FROM patients WHERE dfs IS NOT NULL""", "patients")
def b05(t):
    """The label follows disease-free survival."""
    rows = S.endpoint(t.patients, "DFS").where("target IS NOT NULL")
    return rows.select("sample_id", "target", S.label_at(F.col("target"), F.col("dead"), 48, False).alias("y"))


@query("b06_regression_target", "SELECT sample_id, CAST(NULL AS INTEGER) AS horizon, CAST(months AS DOUBLE) AS y FROM survival", "survival")
def b06(t):
    return S.label_horizons(t.survival, [None], True).select("sample_id", "horizon", "y")


@query("b07_target_by_horizon", """
SELECT sample_id, CAST(h AS INTEGER) AS horizon, CASE WHEN h IS NULL THEN CAST(months AS DOUBLE)
  WHEN NOT event OR months > h THEN 1 ELSE 0 END AS y
FROM survival CROSS JOIN (SELECT unnest([NULL, 60]) AS h) x WHERE h IS NULL OR event OR months > h""", "survival")
def b07(t):
    """No horizon gives months, a horizon gives classes, in one output."""
    return S.label_horizons(t.survival, [None, 60], True).select("sample_id", "horizon", "y")


@query("b08_many_horizons", f"""
SELECT sample_id, CAST(h AS INTEGER) AS horizon, CAST(CASE WHEN months > h THEN 1 ELSE 0 END AS DOUBLE) AS y
FROM patients CROSS JOIN {LISTED} WHERE dead OR months > h""", "patients")
def b08(t):
    """Numeric cohort, four horizons in one pass."""
    rows = S.label_horizons(t.patients, HORIZONS, text_form=False, event="dead")
    return rows.select("sample_id", "horizon", "y")


@query("b09_short_follow_up", "SELECT sample_id, months FROM survival WHERE NOT event AND months > 48 AND months <= 100", "survival")
def b09(t):
    return S.short_follow_up(t.survival, 48).select("sample_id", "months")


@query("b10_survival_times", "SELECT sample_id, CAST(months AS BIGINT) AS os, CAST(ceil(dfs) AS BIGINT) AS dfs FROM patients", "patients")
def b10(t):
    return S.survival_times(t.patients, "os", "dfs")


@query("b11_labelled_expression", """
SELECT e.sample_id, gene_id, value, y FROM expr e JOIN classes c ON e.sample_id = c.sample_id WHERE code <> 9""", "expr classes")
def b11(t):
    """Measurements of the labelled samples; class 9 plays the unlabelled."""
    return S.labelled_expression(t.expr, t.classes.where("code <> 9"))


@query("b12_two_class_recode", """
SELECT sample_id, code, CAST(CASE WHEN code = 2 THEN 0 ELSE 1 END AS INTEGER) AS y,
  CAST(CASE WHEN code > 3 THEN 1 ELSE 0 END AS INTEGER) AS y_cut FROM classes WHERE code IN (2, 7)""", "classes")
def b12(t):
    listed = S.two_classes(t.classes.drop("y"), "code", [2, 7])
    return listed.withColumn("y_cut", (F.col("code") > 3).cast("int"))


# -- outcome ----------------------------------------------------------------------------

STACKED = """stacked AS (SELECT sample_id, CAST(split_id // 5 AS BIGINT) AS repeat, p1 FROM predictions WHERE p1 IS NOT NULL),
undead AS (SELECT sample_id FROM survival WHERE NOT event AND months > 24 AND months <= 60),
mean_p AS (SELECT sample_id, avg(p1) AS p1 FROM stacked GROUP BY sample_id)"""
GROUPED = f"""{STACKED},
g AS (SELECT m.sample_id, p1, CAST(ceil(months) AS BIGINT) AS time,
  CASE WHEN p1 < 0.25 THEN 1 WHEN p1 < 0.5 THEN 2 WHEN p1 < 0.75 THEN 3 END AS risk_group
  FROM mean_p m JOIN survival s ON m.sample_id = s.sample_id
  WHERE m.sample_id NOT IN (SELECT sample_id FROM undead))"""
CUTS = [0.5, 0.25, 0.75]


def _undead(t):
    return S.short_follow_up(t.survival, 24, limit=60)


def _risk(t):
    return risk_rows(t.predictions, S.survival_times(t.patients, "os"), _undead(t), CUTS, 15, 3)


@query("v01_predictions_by_repeat", f"WITH {STACKED} SELECT * FROM stacked", "predictions survival")
def v01(t):
    return S.by_repeat(t.predictions, 15, 3)


@query("v02_single_prediction_set", """
SELECT sample_id, CAST(0 AS BIGINT) AS repeat, p1 FROM predictions WHERE split_id BETWEEN 5 AND 9 AND p1 IS NOT NULL""", "predictions")
def v02(t):
    """One prediction per sample, as when a whole cohort is predicted at once."""
    return S.single_set(t.predictions.where("split_id BETWEEN 5 AND 9"))


@query("v03_aligned_survival", f"""WITH {STACKED}
SELECT s.sample_id, repeat, p1, CAST(ceil(dfs) AS BIGINT) AS time FROM stacked s JOIN patients p ON s.sample_id = p.sample_id
WHERE dfs IS NOT NULL AND s.sample_id NOT IN (SELECT sample_id FROM undead)""", "predictions survival")
def v03(t):
    times = S.survival_times(t.patients, "os", "dfs")
    return S.align_survival(S.by_repeat(t.predictions, 15, 3), times, _undead(t), "dfs")


@query("v04_mean_prediction", f"WITH {STACKED} SELECT sample_id, round(p1, 9) + 0 AS p1 FROM mean_p", "predictions survival")
def v04(t):
    return S.mean_prediction(S.by_repeat(t.predictions, 15, 3)).withColumn("p1", rounded("p1", 9))


@query("v05_risk_groups", f"""WITH {GROUPED}
SELECT sample_id, round(p1, 9) + 0 AS p1, time, CAST(risk_group AS INTEGER) AS risk_group FROM g""", "predictions survival")
def v05(t):
    return _risk(t).withColumn("p1", rounded("p1", 9))


@query("v06_survival_curves", f"""WITH {GROUPED},
n AS (SELECT risk_group, count(*) AS n FROM g WHERE risk_group IS NOT NULL GROUP BY 1),
months AS (SELECT unnest(range(0, 101)) AS month)
SELECT CAST(n.risk_group AS INTEGER) AS risk_group, CAST(month AS INTEGER) AS month, n.n,
  round((n.n - (SELECT count(*) FROM g WHERE g.risk_group = n.risk_group AND month > 0 AND time < month)) / n.n, 8) + 0 AS share
FROM n CROSS JOIN months""", "predictions survival")
def v06(t):
    """Share of each risk group still under way, month by month."""
    return S.survival_curves(_risk(t)).withColumn("share", rounded("share", 8))


@query("v07_group_sizes", f"""WITH {GROUPED}
SELECT CAST(risk_group AS INTEGER) AS risk_group, count(*) AS n FROM g WHERE risk_group IS NOT NULL GROUP BY 1""", "predictions survival")
def v07(t):
    return S.group_sizes(_risk(t))


@query("v08_prediction_distribution", f"""WITH {STACKED}
SELECT sample_id, p1, row_number() OVER (ORDER BY p1, sample_id) - 1 AS place FROM stacked WHERE repeat = 0""", "predictions survival")
def v08(t):
    return S.prediction_distribution(S.by_repeat(t.predictions, 15, 3).where("repeat = 0"))
