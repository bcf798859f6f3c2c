"""Result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from riskloom.operators import runs as R


@query("r03_pending_splits", """
WITH done AS (SELECT model, selector, split_id FROM results WHERE value IS NOT NULL
  GROUP BY 1, 2, 3 HAVING count(DISTINCT section || '/' || name) >= 3)
SELECT DISTINCT model, selector, split_id FROM results r
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.model = r.model AND d.selector = r.selector AND d.split_id = r.split_id)""", "results")
def r03(t):
    """Planned splits whose stored result is absent or incomplete."""
    planned = t.results.select("model", "selector", "split_id").distinct()
    return R.pending_splits(planned, t.results, 3)


@query("r04_model_comparison", """
SELECT selector, model, section, name, round(avg(TRY_CAST(value AS DOUBLE)), 6) + 0 AS mean,
  round(var_samp(TRY_CAST(value AS DOUBLE)), 6) + 0 AS variance
FROM results WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY 1, 2, 3, 4""", "results")
def r04(t):
    s = R.compare_models(t.results)
    return s.select("selector", "model", "section", "name", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@query("r04_rerun_replaced", """
SELECT model, selector, split_id, section, name, value FROM results WHERE model <> 'Brand#3'
UNION ALL SELECT model, selector, split_id, section, name, 'again' FROM results WHERE model = 'Brand#3' AND split_id <= 3
UNION ALL SELECT model, selector, split_id, section, name, value FROM results r WHERE model = 'Brand#3'
  AND NOT EXISTS (SELECT 1 FROM results q WHERE q.model = r.model AND q.selector = r.selector AND q.split_id <= 3)""", "results")
def r04r(t):
    """Rows of a model that ran again replace its stored rows."""
    fresh = t.results.where("model = 'Brand#3' AND split_id <= 3").withColumn("value", F.lit("again"))
    return R.replace_rerun(t.results, fresh)


@query("r05_metric_by_model", """
SELECT selector, model, round(avg(TRY_CAST(value AS DOUBLE)), 6) + 0 AS mean, round(var_samp(TRY_CAST(value AS DOUBLE)), 6) + 0 AS variance
FROM results WHERE section = 'Test' AND name = 'accuracy' AND TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY 1, 2""", "results")
def r05(t):
    s = R.metric_table(R.compare_models(t.results), "accuracy")
    return s.select("selector", "model", rounded("mean").alias("mean"), rounded("variance").alias("variance"))


@query("r05_metric_by_model_and_selector", """
SELECT model, round(avg(TRY_CAST(value AS DOUBLE)) FILTER (selector = 'PROMO'), 6) + 0 AS PROMO,
  round(avg(TRY_CAST(value AS DOUBLE)) FILTER (selector = 'SMALL'), 6) + 0 AS SMALL
FROM results WHERE section = 'Test' AND name = 'log_loss' AND TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY model""", "results")
def r05g(t):
    """Models as rows, two selectors as columns."""
    s = R.metric_table(R.compare_models(t.results), "log_loss", ["PROMO", "SMALL"])
    return s.select("model", rounded("PROMO").alias("PROMO"), rounded("SMALL").alias("SMALL"))


@query("r06_flattened_grid", """
SELECT DISTINCT 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part
UNION ALL SELECT DISTINCT 'brand', p_brand FROM part WHERE p_partkey % 2 = 0""")
def r06(t):
    """Names and values that occur in any candidate; some lack a parameter."""
    candidates = t.raw("part").select(
        F.when(
            F.col("p_partkey") % 2 == 0,
            F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")),
        )
        .otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string")))
        .alias("params")
    )
    return R.flatten_grid(candidates)


@query("r07_combined_repeats", """
WITH u AS (SELECT CAST(split_id AS VARCHAR) AS "row", candidate_id AS name, loss AS value FROM score_log)
SELECT "row", name, round(value, 9) + 0 AS value FROM u
UNION ALL SELECT 'average', name, round(avg(value), 9) + 0 FROM u GROUP BY name""", "score_log")
def r07(t):
    """Two result files stacked, with an average row per result."""
    rows = t.score_log.selectExpr("split_id AS row", "candidate_id AS name", "loss AS value")
    out = R.combine_repeats([rows.where("row < 4"), rows.where("row >= 4")])
    return out.select("row", "name", rounded("value", 9).alias("value"))


@query("r08_run_keys", """
WITH s AS (SELECT p_partkey AS run, 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part)
SELECT run, sha256(string_agg(name || '=' || value, ';' ORDER BY name)) AS run_key FROM s GROUP BY run""")
def r08(t):
    """A key per run from its settings, whatever their order."""
    part = t.raw("part")
    settings = part.selectExpr("p_partkey AS run", "'size' AS name", "CAST(p_size AS STRING) AS value")
    for name in ("brand", "type"):
        settings = settings.unionByName(part.selectExpr("p_partkey AS run", f"'{name}' AS name", f"p_{name} AS value"))
    return R.run_key(settings)
