from pyspark.sql import functions as F

from riskloom.operators import survival as S
from riskloom.plans.risk import curves_by_risk


def labels(spark, texts, horizon, boundary="le"):
    df = S.parse_survival(spark.createDataFrame([(t,) for t in texts], "os string"), "os")
    return {r["os"]: int(r["y"]) for r in S.label_horizons(df, [horizon], True, boundary).collect()}


def test_censored_text(spark):
    texts = ["10+", "30+", "31+", "10", "30", "31"]
    assert labels(spark, texts, 30) == {"31+": 1, "10": 0, "30": 0, "31": 1}
    assert labels(spark, texts, 30, "lt") == {"30+": 1, "31+": 1, "10": 0, "30": 0, "31": 1}


def test_numeric(spark):
    rows = [(10, False), (30, False), (31, False), (30, True), (31, True)]
    df = spark.createDataFrame(rows, "months int, event boolean")
    got = S.label_horizons(df, [30], text_form=False).select("months", "event", "y").collect()
    assert sorted(map(tuple, got)) == [(30, True, 0.0), (31, False, 1.0), (31, True, 1.0)]


def test_short_follow_up(spark):
    df = spark.createDataFrame([(m, False) for m in (20, 50, 100, 101)], "months int, event boolean")
    assert sorted(r["months"] for r in S.short_follow_up(df, 30).collect()) == [50, 100]


def test_times_from_text_and_numbers(spark):
    df = spark.createDataFrame([("a", "37+", 3.2), ("b", "12", None)], "sample_id string, os string, dfs double")
    assert [tuple(r) for r in S.survival_times(df, "os", "dfs").orderBy("sample_id").collect()] == [("a", 37, 4), ("b", 12, None)]


def test_two_classes_by_threshold(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "code int")
    assert sorted(map(tuple, S.two_classes(df, "code", [2, 5], cut_above=3).collect())) == [(2, 0), (5, 1)]


def test_risk_groups(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.9,)], "p double")
    assert [r[0] for r in df.orderBy("p").select(S.risk_group(F.col("p"), [0.6, 0.2])).collect()] == [1, 2, 2, None]


def test_survival_curve(spark):
    df = spark.createDataFrame([(1, t) for t in (1, 2, 2, 50)], "risk_group int, time int")
    for grid in (range(1, 101), [1, 2, 3, 50, 51]):
        got = {r["month"]: r["share"] for r in S.survival_curves(df, grid).collect()}
        assert [got[m] for m in (0, 1, 2, 3, 50, 51)] == [1, 1, 0.75, 0.25, 0.25, 0]


def test_risk_pipeline(spark):
    pred = spark.createDataFrame([(i, s, 0.1 * i) for i in range(1, 5) for s in (i % 2, 2 + i % 2)], "sample_id int, split_id int, p1 double")
    times = spark.createDataFrame([(i, 10 * i) for i in range(1, 5)], "sample_id int, os int")
    undead = spark.createDataFrame([(4,), (99,)], "sample_id int")
    out = curves_by_risk(pred, times, undead, [0.25, 1.0], 4, 2).where("month = 21").collect()
    assert {r["risk_group"]: (r["n"], r["share"]) for r in out} == {1: (2, 0.0), 2: (1, 1.0)}
