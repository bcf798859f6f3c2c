"""Read, clean and write the three tables of a cohort: clinical, measurements, platform."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from riskloom.functions.joins import join_by_key
from riskloom.functions.rowindex import with_row_index


@dataclass(frozen=True)
class Cohort:
    """The three tables of one cohort; ``platform`` may be absent."""

    clinical: DataFrame
    expr: DataFrame
    platform: DataFrame | None = None


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a stated schema (no inference pass over the file)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


# -- A1 ---------------------------------------------------------------------------------


def clean_clinical(
    raw: DataFrame,
    keep: Sequence[str],
    rename: Mapping[str, str],
    sample_ids: DataFrame | None = None,
    not_null: Sequence[str] = (),
) -> DataFrame:
    """Keep and rename columns, restrict to measured samples, drop rows with missing values."""
    out = raw.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in keep])
    if not_null:
        out = out.dropna(subset=list(not_null))
    if sample_ids is not None:
        out = out.join(sample_ids.select("sample_id").distinct(), "sample_id", "left_semi")
    return out


# -- A2, A3 -----------------------------------------------------------------------------


def long_expression(wide: DataFrame, id_column: str, samples_are: str = "columns") -> DataFrame:
    """``(sample_id, gene_id, value)`` from a wide matrix in either orientation."""
    others = [c for c in wide.columns if c != id_column]
    row, column = ("gene_id", "sample_id") if samples_are == "columns" else ("sample_id", "gene_id")
    narrow = wide.unpivot([id_column], others, column, "value")
    return narrow.select(
        *[
            (F.col(id_column).cast("string").alias(row) if name == row else F.col(column))
            for name in ("sample_id", "gene_id")
        ],
        F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"),
    )


def complete_samples(expr: DataFrame) -> DataFrame:
    """Drop every sample that lacks any gene value."""
    lacking = expr.where(F.col("value").isNull() | F.isnan("value")).select("sample_id").distinct()
    return expr.join(lacking, "sample_id", "left_anti")


def wide_expression(expr: DataFrame, genes: Sequence) -> DataFrame:
    """One row per sample and one column per chosen gene."""
    return expr.groupBy("sample_id").pivot("gene_id", list(genes)).agg(F.first("value"))


# -- A4, A5 -----------------------------------------------------------------------------


def clean_platform(
    raw: DataFrame, keep: Sequence[str], rename: Mapping[str, str], remove_control: bool = False
) -> DataFrame:
    """Keep and rename annotation columns; control spots go, unmarked spots stay."""
    if remove_control:
        raw = raw.where(~F.col("SPOT_ID").eqNullSafe(F.lit("--Control")))
    return raw.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in keep])


def load_cohort(
    expression: DataFrame,
    clinical: DataFrame,
    platform: DataFrame | None = None,
    *,
    gene_column: str,
    samples_are: str = "columns",
    keep_clinical: Sequence[str],
    rename_clinical: Mapping[str, str],
    not_null: Sequence[str] = (),
    keep_platform: Sequence[str] = (),
    rename_platform: Mapping[str, str] | None = None,
    remove_control: bool = False,
) -> Cohort:
    """Clean all tables of a cohort in one call."""
    expr = complete_samples(long_expression(expression, gene_column, samples_are))
    return Cohort(
        clean_clinical(clinical, keep_clinical, rename_clinical, expr, not_null),
        expr,
        None
        if platform is None
        else clean_platform(platform, keep_platform, rename_platform or {}, remove_control),
    )


# -- A6, A7 -----------------------------------------------------------------------------


def one_hot(df: DataFrame, columns: Mapping[str, Sequence]) -> DataFrame:
    """One 0/1 column ``col_value`` per named value of each column; a missing value is 0 everywhere.

    The caller names the values, since each becomes a column.
    """
    flags = []
    for c, values in columns.items():
        flags += [
            F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values
        ]
    return df.select(*[x for x in df.columns if x not in columns], *flags)


def standardise(expr: DataFrame) -> DataFrame:
    """Every gene to mean 0 and (population) variance 1; a constant gene becomes 0."""
    stats = expr.groupBy("gene_id").agg(
        F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"), F.count("*").alias("_n")
    )
    scaled = F.when(F.col("_sd") > 0, (F.col("value") - F.col("_mean")) / F.col("_sd")).otherwise(
        F.col("value") - F.col("_mean")
    )
    return join_by_key(expr, stats, ["gene_id"], "_n").select("sample_id", "gene_id", scaled.alias("value"))


# -- A8, A9 -----------------------------------------------------------------------------


def write_task(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store task rows by cohort and horizon; a missing horizon marks the regression task."""
    df.write.mode(mode).partitionBy("cohort", "horizon").parquet(path)


def read_task(spark: SparkSession, path: str, cohort: str, horizon: int | None) -> DataFrame:
    """Rows of one cohort and horizon; only that folder is read."""
    rows = spark.read.parquet(path).where(F.col("cohort") == cohort)
    return rows.where(F.col("horizon").isNull() if horizon is None else F.col("horizon") == horizon)


# -- A10 --------------------------------------------------------------------------------


def toy_subset(expr: DataFrame, size_data: int, size_var: int) -> DataFrame:
    """Samples 1..size_data-1 and genes 1..size_var-1 by position: the first of each is skipped."""

    def slice_of(column: str, size: int) -> DataFrame:
        ids = with_row_index(expr.select(column).distinct(), [column], name="_ix")
        return ids.where((F.col("_ix") >= 1) & (F.col("_ix") < size)).select(column)

    return expr.join(slice_of("sample_id", size_data), "sample_id", "left_semi").join(
        slice_of("gene_id", size_var), "gene_id", "left_semi"
    )


# -- A11, A12 ---------------------------------------------------------------------------


def export_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV part files with headers."""
    df.write.option("header", True).mode("overwrite").csv(path)


def save_statistics(fit_stats: DataFrame, path: str) -> None:
    """Store ``(fit_id, kind, name, value)`` rows, one folder per kind."""
    fit_stats.write.mode("overwrite").partitionBy("kind").parquet(path)


def load_statistics(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read stored statistics, optionally one kind only."""
    rows = spark.read.parquet(path)
    return rows if kind is None else rows.where(F.col("kind") == kind)
