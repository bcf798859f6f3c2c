"""Out-of-fold predictions to survival curves per risk group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.survival import align_survival, by_repeat, mean_prediction, risk_group, survival_curves


def risk_rows(
    predictions: DataFrame,
    times: DataFrame,
    undead: DataFrame,
    thresholds: Sequence[float],
    n_splits: int,
    n_repeats: int,
    fold: int | str = "mean",
    variable: str = "os",
) -> DataFrame:
    """Samples with their time and risk group, from one repeat or from the mean of all."""
    stacked = by_repeat(predictions, n_splits, n_repeats)
    chosen = mean_prediction(stacked) if fold == "mean" else stacked.where(F.col("repeat") == fold)
    aligned = align_survival(chosen.select("sample_id", "p1"), times, undead, variable)
    return aligned.withColumn("risk_group", risk_group(F.col("p1"), thresholds))


def curves_by_risk(*args, grid: Sequence[int] = range(1, 101), **options) -> DataFrame:
    return survival_curves(risk_rows(*args, **options), grid)
