"""Sources, cleaning and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from riskloom.operators.describe import mean_and_population_variance
from riskloom.runtime import scratch_path
from riskloom.sources import cohort_files as files

CLINICAL_SQL = """
SELECT CAST(sample_id AS VARCHAR) AS sample_id, histology, months AS overall_survival, dead FROM patients
WHERE histology IS NOT NULL"""


def _clinical_csv(t):
    """The patients as a raw CSV with other column names, and the people nobody measured."""
    path = scratch_path(t.spark, "clinical.csv")
    people = t.raw("customer").select(F.col("c_custkey").alias("sample_id"))
    raw = people.join(t.patients, "sample_id", "left").selectExpr(
        "sample_id AS id_sample", "histology AS histology_type", "months AS os_months", "dead", "center AS id_topology"
    )
    files.export_csv(raw, path)
    schema = "id_sample STRING, histology_type STRING, os_months INT, dead BOOLEAN, id_topology INT"
    return files.read_csv(t.spark, path, schema)


@query("a01_clinical_table", CLINICAL_SQL, "patients")
def a01(t):
    """Clinical CSV kept, renamed, restricted to measured samples, without missing histology."""
    measured = t.raw("orders").select(F.col("o_custkey").cast("string").alias("sample_id"))
    return files.clean_clinical(
        _clinical_csv(t),
        ["id_sample", "histology_type", "os_months", "dead"],
        {"id_sample": "sample_id", "histology_type": "histology", "os_months": "overall_survival"},
        measured,
        ["histology"],
    )


def _expression_csv(t):
    """Genes x samples: one row per part, one column per line number; gaps are empty cells."""
    path = scratch_path(t.spark, "data.csv")
    lines = t.raw("lineitem").groupBy(F.col("l_partkey").alias("probe")).pivot("l_linenumber", list(range(1, 8)))
    files.export_csv(lines.agg(F.sum("l_quantity")), path)
    columns = ", ".join(f"`{i}` DOUBLE" for i in range(1, 8))
    return files.read_csv(t.spark, path, f"probe STRING, {columns}")


LONG_SQL = """
SELECT CAST(s AS VARCHAR) AS sample_id, CAST(p.l_partkey AS VARCHAR) AS gene_id, v.value
FROM (SELECT DISTINCT l_partkey FROM lineitem) p CROSS JOIN (SELECT unnest(range(1, 8)) AS s) x
LEFT JOIN (SELECT l_partkey, l_linenumber, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) v
ON v.l_partkey = p.l_partkey AND v.l_linenumber = s"""


@query("a02_expression_long", LONG_SQL)
def a02(t):
    """Expression CSV (genes x samples) read and turned into the long form."""
    return files.long_expression(_expression_csv(t), "probe")


@query("a03_complete_samples", f"""
WITH long AS ({LONG_SQL})
SELECT * FROM long WHERE gene_id NOT IN (SELECT gene_id FROM long WHERE value IS NULL)""")
def a03(t):
    """Here the parts play the samples: those without any gap are kept."""
    long = files.long_expression(_expression_csv(t), "probe", samples_are="rows")
    kept = files.complete_samples(long)
    return kept.select(F.col("gene_id").alias("sample_id"), F.col("sample_id").alias("gene_id"), "value")


def _platform(t):
    return t.raw("part").selectExpr(
        "CAST(p_partkey AS STRING) AS ID",
        "p_name AS `Gene Symbol`",
        "CASE p_type WHEN 'ECONOMY' THEN '--Control' WHEN 'PROMO' THEN NULL ELSE p_type END AS SPOT_ID",
        "p_size AS size",
    )


PLATFORM_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS gene_id, p_name AS gene_symbol FROM part WHERE p_type <> 'ECONOMY'"""


@query("a04_platform", PLATFORM_SQL)
def a04(t):
    """Annotation without control spots; unmarked spots stay."""
    path = scratch_path(t.spark, "platform.csv")
    files.export_csv(_platform(t), path)
    raw = files.read_csv(t.spark, path, "ID STRING, `Gene Symbol` STRING, SPOT_ID STRING, size INT")
    return files.clean_platform(raw, ["ID", "Gene Symbol"], {"ID": "gene_id", "Gene Symbol": "gene_symbol"}, True)


@query("a05_cohort_in_one_call", """
WITH complete AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 7)
SELECT 'clinical' AS part, (SELECT count(*) FROM complete) AS n, CAST(0 AS DOUBLE) AS total
UNION ALL SELECT 'expression', count(*), coalesce(sum(value), 0)
  FROM (SELECT l_partkey, l_linenumber, sum(l_quantity) AS value FROM lineitem
        WHERE l_partkey IN (SELECT l_partkey FROM complete) GROUP BY 1, 2)
UNION ALL SELECT 'platform', count(*), CAST(0 AS DOUBLE) FROM part WHERE p_type <> 'ECONOMY'""")
def a05(t):
    """All three tables cleaned together, parts as samples; the answer sums them up."""
    clinical = t.raw("lineitem").selectExpr("CAST(l_partkey AS STRING) AS id", "'x' AS histology").distinct()
    cohort = files.load_cohort(
        _expression_csv(t), clinical, _platform(t),
        gene_column="probe", samples_are="rows", keep_clinical=["id", "histology"], rename_clinical={"id": "sample_id"},
        not_null=["histology"], keep_platform=["ID"], rename_platform={"ID": "gene_id"}, remove_control=True,
    )
    zero = F.lit(0.0).alias("total")
    return (
        cohort.clinical.agg(F.lit("clinical").alias("part"), F.count("*").alias("n"), zero)
        .unionByName(
            cohort.expr.agg(
                F.lit("expression").alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")
            )
        )
        .unionByName(cohort.platform.agg(F.lit("platform").alias("part"), F.count("*").alias("n"), zero))
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("a06_one_hot", "SELECT sample_id, months, " + ", ".join(
    f"CAST(CASE WHEN histology = '{s}' THEN 1 ELSE 0 END AS INTEGER) AS histology_{s}" for s in SEGMENTS
) + " FROM patients", "patients")
def a06(t):
    """Histology as 0/1 columns; a missing one is 0 everywhere."""
    return files.one_hot(t.patients.select("sample_id", "months", "histology"), {"histology": SEGMENTS})


@query("a07_standardised", """
SELECT sample_id, gene_id, round(CASE WHEN s > 0 THEN (value - m) / s ELSE value - m END, 6) + 0 AS value
FROM expr JOIN (SELECT gene_id, avg(value) AS m, stddev_pop(value) AS s FROM expr GROUP BY gene_id) USING (gene_id)""", "expr")
def a07(t):
    return files.standardise(t.expr).withColumn("value", rounded("value"))


def _stored_task(t):
    from riskloom.plans.prepare import task_labels

    path = scratch_path(t.spark, "task")
    for cohort, rows in (("even", t.patients.where("center % 2 = 0")), ("odd", t.patients.where("center % 2 = 1"))):
        files.write_task(task_labels(rows, cohort, [None, 24, 48, 72]), path)
    return path


TASK_SQL = """
SELECT CASE WHEN center % 2 = 0 THEN 'even' ELSE 'odd' END AS cohort, CAST(h AS INTEGER) AS horizon, sample_id,
  CASE WHEN h IS NULL THEN CAST(months AS DOUBLE) WHEN NOT event THEN 1 WHEN months > h THEN 1 ELSE 0 END AS y
FROM survival CROSS JOIN (SELECT unnest([NULL, 24, 48, 72]) AS h) x
WHERE h IS NULL OR event OR months > h"""


@query("a08_task_data_written", TASK_SQL, "survival")
def a08(t):
    """Labels of two cohorts at all horizons, written by cohort and horizon and read whole."""
    rows = t.spark.read.parquet(_stored_task(t))
    return rows.select("cohort", F.col("horizon").cast("int").alias("horizon"), "sample_id", "y")


@query("a09_task_data_read", f"SELECT * FROM ({TASK_SQL}) WHERE cohort = 'odd' AND horizon = 48", "survival")
def a09(t):
    """One cohort and horizon of the stored tasks; the other folders are pruned."""
    rows = files.read_task(t.spark, _stored_task(t), "odd", 48)
    return rows.select("cohort", F.col("horizon").cast("int").alias("horizon"), "sample_id", "y")


@query("a10_toy_subset", """
SELECT sample_id, gene_id, value FROM (
  SELECT *, dense_rank() OVER (ORDER BY sample_id) - 1 AS si, dense_rank() OVER (ORDER BY gene_id) - 1 AS gi FROM expr)
WHERE si >= 1 AND si < 150 AND gi >= 1 AND gi < 30""", "expr")
def a10(t):
    """Positions 1..149 of the samples and 1..29 of the genes."""
    return files.toy_subset(t.expr, 150, 30)


@query("a11_csv_export", "SELECT gene_id, round(avg(value), 8) + 0 AS mean, round(var_pop(value), 8) + 0 AS variance FROM expr GROUP BY gene_id", "expr")
def a11(t):
    """Gene statistics written as CSV and read again."""
    path = scratch_path(t.spark, "statistics.csv")
    files.export_csv(mean_and_population_variance(t.expr, ["gene_id"]), path)
    back = files.read_csv(t.spark, path, "gene_id INT, mean DOUBLE, variance DOUBLE")
    return back.select("gene_id", rounded("mean", 8).alias("mean"), rounded("variance", 8).alias("variance"))


@query("a12_stored_statistics", "SELECT fit_id, 'weight' AS kind, CAST(gene_id AS VARCHAR) AS name, value FROM weights", "weights")
def a12(t):
    """Fit statistics stored by kind, one kind read back."""
    path = scratch_path(t.spark, "fit_stats")
    weights = t.weights.selectExpr("fit_id", "'weight' AS kind", "CAST(gene_id AS STRING) AS name", "value")
    counts = t.weights.groupBy("fit_id").agg(F.count("*").cast("double").alias("value"))
    files.save_statistics(weights.unionByName(counts.selectExpr("fit_id", "'metrics' AS kind", "'n' AS name", "value")), path)
    return files.load_statistics(t.spark, path, "weight").select("fit_id", "kind", "name", "value")
