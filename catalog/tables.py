"""Clinical, measurement and result tables derived from the given ones, in Spark and in SQL.

Both forms use the same arithmetic, so a query can be compared value by value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

GENES = 64  # length of an embedding

PROBE = (
    "CASE WHEN {k} % 7 = 0 THEN 'HS.' || CAST({k} AS VARCHAR) "
    "WHEN {k} % 3 = 0 THEN 'AB' || CAST({k} AS VARCHAR) || '.' || CAST({k} % 4 AS VARCHAR) "
    "ELSE 'P' || CAST({k} AS VARCHAR) END"
)
PLAIN = (  # the same names after normalisation
    "CASE WHEN {k} % 7 = 0 THEN 'Hs.' || CAST({k} AS VARCHAR) "
    "WHEN {k} % 3 = 0 THEN 'AB' || CAST({k} AS VARCHAR) "
    "ELSE 'P' || CAST({k} AS VARCHAR) END"
)

# name: (tables it needs, SELECT)
SQL_TABLES: dict[str, tuple[list[str], str]] = {
    "expr": (
        [],
        "SELECT vec_id AS sample_id, CAST(i AS INTEGER) AS gene_id, CAST(embedding[i + 1] AS DOUBLE) AS value "
        f"FROM (SELECT vec_id, embedding, unnest(range({GENES})) AS i FROM embeddings)",
    ),
    "classes": (
        [],
        "SELECT vec_id AS sample_id, CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS INTEGER) AS y, "
        "label AS code FROM embeddings",
    ),
    "history": (
        [],
        "SELECT o_custkey AS sample_id, "
        "CAST(1 + date_diff('day', min(o_orderdate), max(o_orderdate)) // 30 AS INTEGER) AS months, "
        "sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS dead "
        "FROM orders GROUP BY o_custkey",
    ),
    "patients": (
        ["history"],
        "SELECT c_custkey AS sample_id, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS histology, "
        "CAST(c_nationkey AS INTEGER) AS center, months, dead, "
        "CAST(months AS VARCHAR) || CASE WHEN dead THEN '' ELSE '+' END AS os, "
        "CASE WHEN c_nationkey = 24 THEN NULL ELSE greatest(0.5, months - (c_nationkey % 7) * CAST(1.25 AS DOUBLE)) END AS dfs "
        "FROM customer JOIN history ON c_custkey = history.sample_id",
    ),
    "survival": (
        ["patients"],
        "SELECT sample_id, histology, center, CAST(regexp_extract(os, '^(\\d+)', 1) AS INTEGER) AS months, "
        "NOT ends_with(os, '+') AS event, dfs, os FROM patients",
    ),
    "orders_y": (
        [],
        "SELECT o_orderkey AS sample_id, o_orderstatus AS y, o_custkey AS grp, o_orderdate AS at FROM orders",
    ),
    "probes": (
        [],
        f"SELECT l_suppkey AS sample_id, {PROBE.format(k='l_partkey')} AS gene_id, sum(l_quantity) AS value "
        "FROM lineitem GROUP BY l_suppkey, l_partkey",
    ),
    "gene_map": (
        [],
        f"SELECT {PLAIN.format(k='p_partkey')} AS old_symbol, "
        "CASE WHEN p_size = 50 THEN NULL ELSE 'G' || CAST(p_partkey // 3 AS VARCHAR) END AS gene_symbol FROM part "
        f"UNION ALL SELECT {PLAIN.format(k='p_partkey')}, 'S' || CAST(p_partkey // 20 AS VARCHAR) FROM part WHERE p_partkey % 10 = 0",
    ),
    "cohort_expr": (
        [],
        "SELECT l_returnflag AS cohort, l_suppkey AS sample_id, l_partkey AS gene_id, sum(l_quantity) AS value "
        "FROM lineitem GROUP BY l_returnflag, l_suppkey, l_partkey",
    ),
    "weights": (
        [],
        "SELECT l_partkey AS gene_id, l_linenumber AS fit_id, "
        "CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) - 5 * count(*) AS DOUBLE) AS value "
        "FROM lineitem GROUP BY l_partkey, l_linenumber",
    ),
    "frequency": (
        ["weights"],
        "SELECT gene_id, avg(CASE WHEN value <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS frequency FROM weights GROUP BY gene_id",
    ),
    "score_log": (
        [],
        "SELECT l_partkey AS candidate_id, l_linenumber - 1 AS split_id, count(*) AS n_test, 'score' AS metric, "
        "(CAST(sum(l_quantity) AS BIGINT) % 64) / CAST(64 AS DOUBLE) AS test_score, "
        "(CAST(sum(l_quantity) AS BIGINT) % 32) / CAST(32 AS DOUBLE) AS train_score, ln(1 + sum(l_quantity)) AS loss "
        "FROM lineitem GROUP BY l_partkey, l_linenumber",
    ),
    "scored": (
        [],
        "SELECT event_id AS sample_id, user_id AS grp, CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS INTEGER) AS y, "
        "value / CAST(500 AS DOUBLE) AS p1, CAST(CASE WHEN value > 75 THEN 1 ELSE 0 END AS INTEGER) AS predicted, value FROM events",
    ),
    "predictions": (
        [],
        "SELECT c_custkey AS sample_id, CAST(r * 5 + (c_custkey * 7 + r) % 5 AS INTEGER) AS split_id, "
        "CASE WHEN c_custkey % 11 = 0 AND r = 1 THEN NULL ELSE (c_acctbal + 1000 + 100 * r) / CAST(12000 AS DOUBLE) END AS p1 "
        "FROM (SELECT *, unnest(range(3)) AS r FROM customer)",
    ),
    "results": (
        [],
        "SELECT p_brand AS model, p_type AS selector, CAST(l_linenumber AS INTEGER) AS split_id, "
        "CASE WHEN l_returnflag = 'R' THEN 'Validation' ELSE 'Test' END AS section, "
        "CASE l_returnflag WHEN 'A' THEN 'log_loss' WHEN 'N' THEN 'accuracy' ELSE 'C' END AS name, "
        "CASE WHEN sum(l_quantity) % 97 = 0 THEN NULL ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) END AS value "
        "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type, l_linenumber, l_returnflag",
    ),
}


class Tables:
    """The derived tables of one scale folder; every one is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def expr(self) -> DataFrame:
        cells = self.raw("embeddings").select("vec_id", F.posexplode("embedding").alias("gene_id", "value"))
        return cells.select(F.col("vec_id").alias("sample_id"), "gene_id", F.col("value").cast("double").alias("value"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.raw("embeddings").selectExpr(
            "vec_id AS sample_id", "CAST(label >= 5 AS INT) AS y", "label AS code"
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Samples with their measurements as an array and the class as label."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("sample_id"),
            F.col("embedding").cast("array<double>").alias("features"),
            (F.col("label") >= 5).cast("double").alias("label"),
            F.col("label").alias("code"),
        )

    @cached_property
    def history(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.raw("orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(
            (1 + F.floor(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / 30)).cast("int").alias("months"),
            (F.sum((status == "F").cast("int")) > F.sum((status == "O").cast("int"))).alias("dead"),
        )

    @cached_property
    def patients(self) -> DataFrame:
        people = self.raw("customer").withColumnRenamed("c_custkey", "sample_id")
        return people.join(self.history, "sample_id").selectExpr(
            "sample_id",
            "CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS histology",
            "c_nationkey AS center",
            "months",
            "dead",
            "concat(CAST(months AS STRING), CASE WHEN dead THEN '' ELSE '+' END) AS os",
            "CASE WHEN c_nationkey = 24 THEN NULL ELSE greatest(0.5D, months - (c_nationkey % 7) * 1.25D) END AS dfs",
        )

    @cached_property
    def survival(self) -> DataFrame:
        from riskloom.operators.survival import parse_survival

        return parse_survival(self.patients.drop("months"), "os")

    @cached_property
    def orders_y(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS sample_id", "o_orderstatus AS y", "o_custkey AS grp", "o_orderdate AS at"
        )

    @cached_property
    def probes(self) -> DataFrame:
        sums = self.raw("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
        name = PROBE.format(k="l_partkey").replace("VARCHAR", "STRING")
        return sums.selectExpr("l_suppkey AS sample_id", f"{name} AS gene_id", "value")

    @cached_property
    def gene_map(self) -> DataFrame:
        plain = PLAIN.format(k="p_partkey").replace("VARCHAR", "STRING")
        part = self.raw("part")
        first = part.selectExpr(
            f"{plain} AS old_symbol",
            "CASE WHEN p_size = 50 THEN NULL ELSE concat('G', CAST(p_partkey div 3 AS STRING)) END AS gene_symbol",
        )
        second = part.where("p_partkey % 10 = 0").selectExpr(
            f"{plain} AS old_symbol", "concat('S', CAST(p_partkey div 20 AS STRING)) AS gene_symbol"
        )
        return first.unionAll(second)

    @cached_property
    def cohort_expr(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_returnflag").alias("cohort"),
                F.col("l_suppkey").alias("sample_id"),
                F.col("l_partkey").alias("gene_id"),
            )
            .agg(F.sum("l_quantity").alias("value"))
        )

    @cached_property
    def weights(self) -> DataFrame:
        cents = F.round(F.col("l_discount") * 100).cast("long")
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("gene_id"), F.col("l_linenumber").alias("fit_id"))
            .agg((F.sum(cents) - 5 * F.count("*")).cast("double").alias("value"))
        )

    @cached_property
    def frequency(self) -> DataFrame:
        from riskloom.operators.describe import participation

        return participation(self.weights)

    @cached_property
    def score_log(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("candidate_id"), (F.col("l_linenumber") - 1).alias("split_id"))
            .agg(
                F.count("*").alias("n_test"),
                ((F.sum("l_quantity").cast("long") % 64) / 64.0).alias("test_score"),
                ((F.sum("l_quantity").cast("long") % 32) / 32.0).alias("train_score"),
                F.log(1 + F.sum("l_quantity")).alias("loss"),
            )
            .withColumn("metric", F.lit("score"))
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS sample_id",
            "user_id AS grp",
            "CAST(event_type IN ('purchase', 'signup') AS INT) AS y",
            "value / 500D AS p1",
            "CAST(value > 75 AS INT) AS predicted",
            "value",
        )

    @cached_property
    def predictions(self) -> DataFrame:
        rows = self.raw("customer").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        return rows.selectExpr(
            "c_custkey AS sample_id",
            "CAST(r * 5 + (c_custkey * 7 + r) % 5 AS INT) AS split_id",
            "CASE WHEN c_custkey % 11 = 0 AND r = 1 THEN NULL ELSE (c_acctbal + 1000 + 100 * r) / 12000D END AS p1",
        )

    @cached_property
    def results(self) -> DataFrame:
        lines = self.raw("lineitem").withColumnRenamed("l_partkey", "p_partkey").join(self.raw("part"), "p_partkey")
        sums = lines.groupBy("p_brand", "p_type", "l_linenumber", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
        return sums.selectExpr(
            "p_brand AS model",
            "p_type AS selector",
            "CAST(l_linenumber AS INT) AS split_id",
            "CASE WHEN l_returnflag = 'R' THEN 'Validation' ELSE 'Test' END AS section",
            "CASE l_returnflag WHEN 'A' THEN 'log_loss' WHEN 'N' THEN 'accuracy' ELSE 'C' END AS name",
            "CASE WHEN q % 97 = 0 THEN NULL ELSE CAST(CAST(q AS BIGINT) AS STRING) END AS value",
        )
