"""Raw cohort tables to labelled task data at several horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.rowindex import with_row_index
from riskloom.operators.folds import fold_of
from riskloom.operators.survival import label_horizons, labelled_expression, parse_survival
from riskloom.runtime import cut
from riskloom.sources.cohort_files import Cohort, read_task, write_task


def task_labels(clinical: DataFrame, cohort: str, horizons: Sequence[int | None], text: str = "os") -> DataFrame:
    """``(cohort, horizon, sample_id, y)`` from censored text, all horizons in one pass."""
    parsed = parse_survival(clinical, text)
    labels = label_horizons(parsed, horizons, text_form=True)
    return labels.select(F.lit(cohort).alias("cohort"), "horizon", "sample_id", "y")


def class_balance(labels: DataFrame, n_splits: int) -> DataFrame:
    """Stratified folds at every horizon and the class counts of their test sides."""
    rows = with_row_index(labels, ["sample_id"], groups=["horizon", "y"], name="_ix", count="_n")
    rows = rows.withColumn("split_id", fold_of(F.col("_ix"), F.col("_n"), n_splits))
    return rows.groupBy("horizon", "split_id").agg(
        F.count("*").alias("n_test"), F.sum(F.col("y").cast("long")).alias("n_positive")
    )


def prepare_task(cohort: Cohort, name: str, horizons: Sequence[int | None], path: str, text: str = "os") -> None:
    """Label the cohort and store its X (long) and Y by cohort and horizon."""
    labels = cut(task_labels(cohort.clinical, name, horizons, text), "labels")
    write_task(labels, f"{path}/Y")
    # the measurements are stored once; a horizon's rows follow from its labels
    labelled = labels.select("sample_id").distinct()
    rows = cohort.expr.join(labelled, "sample_id", "left_semi").withColumn("cohort", F.lit(name))
    rows.write.mode("append").partitionBy("cohort").parquet(f"{path}/X")


def load_task(spark: SparkSession, path: str, cohort: str, horizon: int | None) -> DataFrame:
    """Measurement rows with the label of one cohort and horizon."""
    expr = spark.read.parquet(f"{path}/X").where(F.col("cohort") == cohort).drop("cohort")
    return labelled_expression(expr, read_task(spark, f"{path}/Y", cohort, horizon))
