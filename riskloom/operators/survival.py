"""Labels from censored survival times, and survival curves per predicted risk group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.rowindex import with_row_index
from riskloom.functions.scalar import censored_months, whole_months

SHORT_FOLLOW_UP = 100  # months: samples still alive at or before this are listed apart


# -- B1..B9 -----------------------------------------------------------------------------


def parse_survival(df: DataFrame, text: str) -> DataFrame:
    """Add ``months`` and ``event`` (died) from a text such as ``"37+"`` or ``"37"``."""
    parsed = censored_months(F.col(text))
    return df.withColumn("months", parsed["months"]).withColumn("event", parsed["event"])


def label_unknown(months: Column, event: Column, horizon: Column | int, boundary: str = "le") -> Column:
    """Alive and not followed past the horizon, so the label cannot be known.

    ``boundary='lt'`` keeps a sample that is alive exactly at the horizon.
    """
    if boundary not in ("le", "lt"):
        raise ValueError("boundary is 'le' or 'lt'")
    short = months <= horizon if boundary == "le" else months < horizon
    return ~event & short


def censor(df: DataFrame, horizon: int, boundary: str = "le", months: str = "months", event: str = "event") -> DataFrame:
    """Keep only samples whose label at ``horizon`` is known."""
    return df.where(~label_unknown(F.col(months), F.col(event), F.lit(horizon), boundary))


def label_at(months: Column, event: Column, horizon: Column | int, text_form: bool) -> Column:
    """1 when alive after the horizon.  In text cohorts every living patient counts as 1."""
    later = (months > horizon).cast("int")
    return F.when(~event, 1).otherwise(later) if text_form else later


def endpoint(df: DataFrame, kind: str, os: str = "os", dfs: str = "dfs") -> DataFrame:
    """Choose overall survival or disease-free survival as the ``target`` of the label."""
    if kind not in ("OS", "DFS"):
        raise ValueError("endpoint is 'OS' or 'DFS'")
    return df.withColumn("target", F.col(os if kind == "OS" else dfs))


def label_horizons(
    df: DataFrame,
    horizons: Sequence[int | None],
    text_form: bool,
    boundary: str = "le",
    target: str = "months",
    censor_on: str = "months",
    event: str = "event",
) -> DataFrame:
    """Labels at every horizon in one pass over the table.

    A horizon of ``None`` is the regression task: all samples, ``y`` = months.  Every
    other horizon drops its unknown labels from the full table and gives 0 or 1.
    """
    listed = F.array(*[F.lit(h).cast("int") for h in horizons])
    rows = df.withColumn("horizon", F.explode(listed))
    regression = F.col("horizon").isNull()
    known = ~label_unknown(F.col(censor_on), F.col(event), F.col("horizon"), boundary)
    y = label_at(F.col(target), F.col(event), F.col("horizon"), text_form)
    return rows.where(regression | known).withColumn(
        "y", F.when(regression, F.col(target).cast("double")).otherwise(y.cast("double"))
    )


def short_follow_up(df: DataFrame, horizon: int, limit: int = SHORT_FOLLOW_UP) -> DataFrame:
    """Samples that keep a label at ``horizon`` but are alive with at most ``limit`` months."""
    return censor(df, horizon).where(~F.col("event") & (F.col("months") <= limit))


def survival_times(df: DataFrame, os: str, dfs: str | None = None, ident: str = "sample_id") -> DataFrame:
    """Months of overall (and disease-free) survival, rounded up, from text or numbers."""

    def rounded(name: str) -> Column:
        is_text = df.schema[name].dataType.simpleString() == "string"
        return whole_months(F.col(name)) if is_text else F.ceil(F.col(name))

    out = [ident, rounded(os).alias("os")]
    return df.select(*out, *([rounded(dfs).alias("dfs")] if dfs else []))


# -- B11, B12 ---------------------------------------------------------------------------


def labelled_expression(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """Measurement rows of the labelled samples, each with its label.

    The label side has one row per sample; a sample carries one row per gene, so no join
    key is hot on its own, and AQE splits what the data makes uneven.
    """
    return expr.join(labels.select("sample_id", "y"), "sample_id")


def two_classes(
    df: DataFrame, column: str, codes: Sequence, name: str = "y", cut_above: float | None = None
) -> DataFrame:
    """Keep two category codes and map them to 0 and 1, by list position or by a threshold."""
    first, second = codes
    kept = df.where(F.col(column).isin(first, second))
    if cut_above is not None:
        return kept.withColumn(name, (F.col(column) > cut_above).cast("int"))
    return kept.withColumn(name, F.when(F.col(column) == first, 0).otherwise(1))


# -- V1..V8 -----------------------------------------------------------------------------


def by_repeat(predictions: DataFrame, n_splits: int, n_repeats: int) -> DataFrame:
    """Out-of-fold predictions stacked per repeat: repeat k owns ``n_splits // n_repeats`` splits."""
    size = n_splits // n_repeats
    rows = predictions.where(F.col("p1").isNotNull()).withColumn("repeat", F.floor(F.col("split_id") / size))
    return rows.where(F.col("repeat") < n_repeats).select("sample_id", "repeat", "p1")


def single_set(predictions: DataFrame) -> DataFrame:
    """One prediction per sample, as from training on one cohort and predicting another."""
    return predictions.where(F.col("p1").isNotNull()).select("sample_id", F.lit(0).cast("long").alias("repeat"), "p1")


def align_survival(predictions: DataFrame, times: DataFrame, undead: DataFrame, variable: str = "os") -> DataFrame:
    """Predicted samples with a known time that are not on the short-follow-up list."""
    known = times.where(F.col(variable).isNotNull()).select("sample_id", F.col(variable).alias("time"))
    return predictions.join(known, "sample_id").join(
        undead.select("sample_id"), "sample_id", "left_anti"
    )


def mean_prediction(predictions: DataFrame) -> DataFrame:
    """Mean probability of each sample over the repeats."""
    return predictions.groupBy("sample_id").agg(F.avg("p1").alias("p1"))


def risk_group(p: Column, thresholds: Sequence[float]) -> Column:
    """1-based group of the first threshold above ``p``; null at or above the last one."""
    chain = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(sorted(thresholds)))):
        chain = F.when(p < t, i + 1).otherwise(chain)
    return chain


def survival_curves(rows: DataFrame, grid: Sequence[int] = range(1, 101)) -> DataFrame:
    """Share of each group not yet past its time, per month: ``(risk_group, month, n, share)``.

    Point 0 is 1; month g is ``(N - #{time < g}) / N``.  Times beyond the grid count as
    alive throughout; this is not a censoring-aware estimate, since short follow-up was
    taken out before.  One aggregation over the rows, then a running sum over a table
    that holds one row per group and month.
    """
    grid = sorted(grid)
    months = F.array(F.lit(0), *[F.lit(int(g)) for g in grid])
    if grid == list(range(grid[0], grid[-1] + 1)):  # consecutive months need no chain of cases
        first = F.floor(F.col("time")) - grid[0] + 2
        slot = F.when(first < 1, 1).when(first > len(grid), len(grid) + 1).otherwise(first)
    else:
        slot = F.lit(len(grid) + 1)
        for i in range(len(grid) - 1, -1, -1):
            slot = F.when(F.col("time") < grid[i], i + 1).otherwise(slot)
    lost = (
        rows.where(F.col("risk_group").isNotNull())
        .groupBy("risk_group", slot.cast("int").alias("slot"))
        .agg(F.count("*").alias("lost"))
    )
    sizes = lost.groupBy("risk_group").agg(
        F.sum("lost").alias("n"), F.map_from_entries(F.collect_list(F.struct("slot", "lost"))).alias("by_slot")
    )
    points = sizes.select("risk_group", "n", "by_slot", F.posexplode(months).alias("slot", "month"))
    running = Window.partitionBy("risk_group").orderBy("slot")
    gone = F.sum(F.coalesce(F.element_at("by_slot", F.col("slot")), F.lit(0))).over(running)
    return points.select("risk_group", "month", "n", ((F.col("n") - gone) / F.col("n")).alias("share"))


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("risk_group").isNotNull()).groupBy("risk_group").agg(F.count("*").alias("n"))


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    """Predictions in rising order with their position."""
    return with_row_index(predictions.select("sample_id", "p1"), ["p1", "sample_id"], name="place")
