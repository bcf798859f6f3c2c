"""Result tables of nested evaluations: keys, resume, comparison, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.runtime import path_exists

RESULT_KEY = ["model", "selector"]


def run_key(settings: DataFrame, run: str = "run") -> DataFrame:
    """One key per run from its settings ``(run, name, value)``: equal settings, equal key."""
    cells = settings.groupBy(run).agg(F.array_sort(F.collect_set(F.struct("name", "value"))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda c: F.concat_ws("=", c["name"], c["value"])), ";")
    return cells.select(run, F.sha2(text, 256).alias("run_key"))


class RunStore:
    """Results and predictions of nested evaluations below one path, a folder per run key, model, selector and split.

    A split is committed by its results, written after its predictions and over whatever an earlier try left.
    So a run that was stopped goes on with the splits that have no whole result.
    """

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def commit(self, model: str, selector: str, split: int, lines: DataFrame, predictions: DataFrame) -> None:
        """``lines(section, name, value)`` and ``predictions(sample_id, label, p1)`` of one split."""
        key = {"run_key": self.run, "model": model, "selector": selector, "split_id": int(split)}
        self._write(predictions, "predictions", key)
        self._write(lines.withColumn("n_fields", F.lit(lines.count())).coalesce(1), "results", key)  # a handful of rows

    def _write(self, rows: DataFrame, kind: str, key: dict) -> None:
        keyed = rows.withColumns({name: F.lit(value) for name, value in key.items()})
        writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*key).parquet(f"{self.path}/{kind}")

    def _read(self, kind: str, schema: str) -> DataFrame:
        schema = f"{schema}, run_key string, model string, selector string, split_id int"
        if not path_exists(self.spark, f"{self.path}/{kind}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").where(F.col("run_key") == self.run)

    def results(self) -> DataFrame:
        return self._read("results", "section string, name string, value string, n_fields int")

    def predictions(self, id_type: str) -> DataFrame:
        return self._read("predictions", f"sample_id {id_type}, label double, p1 double")

    def pending(self, model: str, selector: str, split_ids: Sequence[int]) -> list[int]:
        """The splits that are still to do, in the given order."""
        planned = self.spark.createDataFrame([(model, selector, int(s)) for s in split_ids], "model string, selector string, split_id int")
        left = {r["split_id"] for r in pending_splits(planned, self.results(), "n_fields").collect()}  # one row per planned split
        return [int(s) for s in split_ids if int(s) in left]


def flatten_grid(candidates: DataFrame) -> DataFrame:
    """Every parameter name and value that occurs in any grid."""
    return candidates.select(F.explode("params").alias("name", "value")).distinct()


def parameter_names(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.explode(F.map_keys("params")).alias("name")).distinct()


def pending_splits(planned: DataFrame, results: DataFrame, n_fields: int | str) -> DataFrame:
    """Planned ``(model, selector, split_id)`` whose stored result is absent or incomplete.

    ``n_fields`` is the number of fields of a whole result, or the column that says it in every stored row.
    """
    keys = [*RESULT_KEY, "split_id"]
    whole = F.lit(n_fields) if isinstance(n_fields, int) else F.max(n_fields)
    done = (
        results.where(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(F.count_distinct("section", "name").alias("n"), whole.alias("_whole"))
        .where(F.col("n") >= F.col("_whole"))
        .select(*keys)
    )
    return planned.join(done, keys, "left_anti")


def replace_rerun(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of other models, with the rows of a model that ran again replaced."""
    again = fresh.select(*RESULT_KEY).distinct()
    return stored.join(again, RESULT_KEY, "left_anti").unionByName(fresh)


def compare_models(results: DataFrame) -> DataFrame:
    """Mean and sample variance of every numeric result over the splits."""
    numbers = results.withColumn("_v", F.col("value").try_cast("double")).where(F.col("_v").isNotNull())
    return numbers.groupBy("selector", "model", "section", "name").agg(
        F.avg("_v").alias("mean"), F.var_samp("_v").alias("variance")
    )


def metric_table(summary: DataFrame, metric: str, selectors: Sequence[str] | None = None) -> DataFrame:
    """Mean of one test metric per model, one column per selector when several are named."""
    rows = summary.where((F.col("section") == "Test") & (F.col("name") == metric))
    if selectors is None:
        return rows.select("selector", "model", "mean", "variance")
    return rows.groupBy("model").pivot("selector", list(selectors)).agg(F.first("mean"))


def combine_repeats(repeats: Sequence[DataFrame], name: str = "name", value: str = "value") -> DataFrame:
    """Rows of all repeats and one ``average`` row per result name."""
    rows = reduce(DataFrame.unionByName, repeats).withColumn("row", F.col("row").cast("string"))
    average = rows.groupBy(name).agg(F.avg(value).alias(value)).withColumn("row", F.lit("average"))
    return rows.unionByName(average.select(*rows.columns))
