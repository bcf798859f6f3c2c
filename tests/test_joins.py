from pyspark.sql import functions as F

from riskloom.functions import joins as J


def test_hot_keys_are_split_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_COPY", 50)
    rows = spark.range(1000).selectExpr("id AS sample_id", "CASE WHEN id < 400 THEN 'a' WHEN id < 700 THEN 'b' WHEN id < 900 THEN 'c' ELSE concat('k', id) END AS g")
    side = rows.groupBy("g").agg(F.count("*").alias("size"), F.min("sample_id").alias("low"))
    got = J.join_by_key(rows, side, ["g"], "size").toPandas()
    assert sorted(got.sample_id) == list(range(1000))
    assert (got.low == got.groupby("g").sample_id.transform("min")).all()
    assert sorted(got.columns) == ["g", "low", "sample_id"]


def test_several_side_rows_per_key(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_COPY", 10)
    rows = spark.range(60).selectExpr("id AS sample_id", "id % 2 AS g")
    side = spark.createDataFrame([(0, 30, "x"), (0, 30, "y"), (1, 30, "z")], "g long, size long, v string")
    assert J.join_by_key(rows, side, ["g"], "size").count() == 90


def test_many_hot_keys_of_one_size_and_null(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_COPY", 3)
    rows = spark.range(3000).selectExpr("id AS sample_id", "nullif(id % 300, 7) AS g")
    side = rows.groupBy("g").agg(F.count("*").alias("size"), F.min("sample_id").alias("low"))
    got = J.join_by_key(rows, side, ["g"], "size").toPandas()
    assert sorted(got.sample_id) == list(range(3000))
    assert (got.low == got.sample_id % 300).all()
