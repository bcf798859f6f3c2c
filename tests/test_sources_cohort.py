import math
import statistics

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalar import inverse_normal, normal_probe
from riskloom.operators import cohort as C
from riskloom.plans.prepare import load_task, prepare_task
from riskloom.runtime import scratch_path, shared_folder
from riskloom.sources import cohort_files as files


def test_cohort_to_task_data(spark):
    wide = spark.createDataFrame([("g1", 1.0, 2.0, None), ("g2", 3.0, 4.0, 5.0)], "probe string, a double, b double, c double")
    clinical = spark.createDataFrame(
        [("a", "x", "40"), ("b", "x", "20+"), ("c", "x", "9"), ("d", "x", "9"), ("a2", None, "9")], "id string, h string, t string"
    )
    cohort = files.load_cohort(
        wide, clinical, gene_column="probe", keep_clinical=["id", "h", "t"],
        rename_clinical={"id": "sample_id", "h": "histology", "t": "os"}, not_null=["histology"],
    )
    assert cohort.platform is None
    assert sorted(r["sample_id"] for r in cohort.clinical.collect()) == ["a", "b"]
    path = scratch_path(spark, "task")
    prepare_task(cohort, "one", [None, 30], path)
    assert sorted(map(tuple, load_task(spark, path, "one", 30).collect())) == [("a", "g1", 1.0, 1.0), ("a", "g2", 3.0, 1.0)]
    assert load_task(spark, path, "one", None).count() == 4
    assert sorted(files.wide_expression(cohort.expr, ["g1", "g2"]).collect()) == [("a", 1.0, 3.0), ("b", 2.0, 4.0)]


def test_nan_counts_as_missing(spark):
    wide = spark.createDataFrame([("s", 1.0, float("nan"))], "id string, g1 double, g2 double")
    assert files.complete_samples(files.long_expression(wide, "id", "rows")).count() == 0


def test_constant_gene_becomes_zero(spark):
    expr = spark.createDataFrame([(i, "g", 5.0) for i in range(3)], "sample_id int, gene_id string, value double")
    assert {r["value"] for r in files.standardise(expr).collect()} == {0.0}


def test_one_hot_of_named_values(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,)], "kind string")
    rows = files.one_hot(df, {"kind": ["a", "b", "c"]}).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 0, 0), (0, 0, 1), (1, 0, 0)]


def test_one_hot_has_no_limit_of_values(spark):
    assert len(files.one_hot(spark.range(3), {"id": range(1200)}).columns) == 1200


def test_scratch_is_in_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark))


def test_probe_names(spark):
    df = spark.createDataFrame([("HS.9123",), ("AB.1",), ("A.B.2",), ("TP53",)], "p string")
    assert [r[0] for r in df.select(normal_probe(F.col("p"))).collect()] == ["Hs.9123", "AB", "A.B", "TP53"]


def test_duplicates_and_copies(spark):
    expr = spark.createDataFrame(
        [(i, "p1", float(i)) for i in range(5)] + [(i, "p2", 3.0 * i) for i in range(5)] + [(i, "p3", -1.0) for i in range(5)],
        "sample_id int, gene_id string, value double",
    )
    gene_map = spark.createDataFrame(
        [("p1", "S1"), ("p2", "S1"), ("p3", "S1"), ("p3", "S2"), ("p9", None)], "old_symbol string, gene_symbol string"
    )
    got = {(r["gene_id"], r["value"]) for r in C.update_genes(expr, gene_map).where("sample_id = 1").collect()}
    assert got == {("S1", 3.0), ("S2", -1.0)}


def test_inverse_normal(spark):
    ps = [1e-7, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(inverse_normal(F.col("p"))).collect()]
    assert all(math.isclose(a, statistics.NormalDist().inv_cdf(p), rel_tol=1e-6, abs_tol=1e-6) for a, p in zip(got, ps))


def test_normalised_ties_share_a_value(spark):
    rows = [("c", i, "g", v) for i, v in enumerate([1.0, 2.0, 2.0, 9.0])]
    df = spark.createDataFrame(rows, "cohort string, sample_id int, gene_id string, value double")
    got = {r["sample_id"]: r["value"] for r in C.quantile_normalise(df).collect()}
    assert got[1] == got[2] == pytest.approx(0.0, abs=1e-9) and got[0] == pytest.approx(-got[3])
