"""Scores of predictions against labels, over the whole table or per group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.rowindex import with_running_sum
from riskloom.functions.scalar import clipped

INPUTS = {"probability": "p1", "class": "prediction", "value": "prediction"}


@dataclass(frozen=True)
class Metric:
    """A score and what it reads: the ``probability`` of class 1, the ``class`` or the predicted ``value``.

    ``column(y, predicted)`` is an aggregate; a score that needs an order is instead ``frame(df, y, predicted, by)``,
    one row per group with the score in the last column.
    """

    needs: str
    column: Callable[[Column, Column], Column] | None = None
    frame: Callable[..., DataFrame] | None = None

    def __post_init__(self):
        if self.needs not in INPUTS:
            raise ValueError(f"needs is one of {', '.join(INPUTS)}")
        if (self.column is None) == (self.frame is None):
            raise ValueError("a metric is either an aggregate column or a frame function")

    def __call__(self, y: Column, predicted: Column) -> Column:
        return self.column(y, predicted)


def metric(needs: str) -> Callable[[Callable], Metric]:
    return lambda column: Metric(needs, column)


@metric("probability")
def log_loss(y: Column, p: Column) -> Column:
    """Mean log loss of the probability of class 1, labels 0 and 1."""
    p = clipped(p)
    return -F.avg(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))


@metric("probability")
def negative_log_loss(y: Column, p: Column) -> Column:
    """Log loss as a score: higher is better."""
    return -log_loss(y, p)


@metric("class")
def accuracy(y: Column, predicted: Column) -> Column:
    return F.avg((y == predicted).cast("double"))


@metric("class")
def precision(y: Column, predicted: Column) -> Column:
    found = F.sum((predicted == 1).cast("long"))
    return F.when(found > 0, F.sum(((predicted == 1) & (y == 1)).cast("long")) / found).otherwise(F.lit(0.0))


@metric("class")
def recall(y: Column, predicted: Column) -> Column:
    real = F.sum((y == 1).cast("long"))
    return F.when(real > 0, F.sum(((predicted == 1) & (y == 1)).cast("long")) / real).otherwise(F.lit(0.0))


@metric("value")
def mean_squared_error(y: Column, predicted: Column) -> Column:
    return F.avg((y - predicted) * (y - predicted))


@metric("value")
def mean_absolute_error(y: Column, predicted: Column) -> Column:
    return F.avg(F.abs(y - predicted))


@metric("value")
def r_squared(y: Column, predicted: Column) -> Column:
    return 1 - F.sum((y - predicted) * (y - predicted)) / (F.var_pop(y) * F.count(y))


def score(df: DataFrame, metrics: dict[str, Metric], y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Any column metrics, the caller's own included, in one aggregation."""
    return df.groupBy(*by).agg(*[m(F.col(y), F.col(predicted)).alias(name) for name, m in metrics.items()])


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.

    Equal scores are counted together first; the ranks come from running sums over score
    ranges, so the table is never sorted in one task.
    """
    counts = df.groupBy(*by, F.col(p).alias("_p")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("_hits"), F.sum((F.col(y) != 1).cast("long")).alias("_misses")
    )
    ranked = with_running_sum(counts, ["_p"], "_misses", by, "_below")
    wins = F.sum(F.col("_hits") * (F.col("_below") - F.col("_misses") / 2))
    pairs = F.sum("_hits") * F.sum("_misses")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


auc = Metric("probability", frame=roc_auc)


def model_scores(scored: DataFrame, metrics: Mapping[str, Metric], by: str | None = None) -> dict:
    """Every metric of rows with ``label`` and predictions: ``{group: {metric: value}}``, under None without groups.

    All aggregates take one pass, and each metric of its own order one more.
    """
    for name, m in metrics.items():
        if not isinstance(m, Metric):
            raise TypeError(f"{name}: say what the metric reads, Metric(needs, column)")
    keys = [by] if by else []
    cells = [m.column(F.col("label"), F.col(INPUTS[m.needs])).alias(name) for name, m in metrics.items() if m.column]
    found: dict = {}
    tables = [([n for n, m in metrics.items() if m.column], scored.groupBy(*keys).agg(*cells))] if cells else []
    tables += [([name], m.frame(scored, "label", INPUTS[m.needs], keys)) for name, m in metrics.items() if m.frame]
    for names, table in tables:
        for r in table.collect():  # one row per side
            values = tuple(r)[len(keys):]
            found.setdefault(r[by] if by else None, {}).update(zip(names, values))
    return {k: {name: v[name] for name in metrics} for k, v in found.items()}


def fold_sum_over_n(df: DataFrame, y: str, predicted: str, fold: str) -> DataFrame:
    """The report's error: mean squared error of each fold, summed and divided by n."""
    folds = df.groupBy(fold).agg(
        mean_squared_error(F.col(y), F.col(predicted)).alias("mse"), F.count("*").alias("n")
    )
    return folds.agg((F.sum("mse") / F.sum("n")).alias("error"))


def average_over_folds(df: DataFrame, metric: Metric, y: str, predicted: str, fold: str) -> DataFrame:
    """A metric worked out per fold, then averaged."""
    folds = df.groupBy(fold).agg(metric(F.col(y), F.col(predicted)).alias("value"))
    return folds.agg(F.avg("value").alias("value"))
