"""Descriptive statistics of clinical tables, fits and curves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.rowindex import with_row_index
from riskloom.functions.scalar import above

WINDOW_SHAPES = ("flat", "hanning", "hamming", "bartlett", "blackman")


def health_status(df: DataFrame, histology: str = "histology") -> DataFrame:
    """A sample without histology is healthy."""
    return df.withColumn("status", F.when(F.col(histology).isNull(), "healthy").otherwise("diseased"))


def counts_by_status(df: DataFrame, column: str) -> DataFrame:
    """Samples per category value (a missing value is a value of its own) and status."""
    return (
        df.groupBy(F.col(column).alias("category"))
        .pivot("status", ["healthy", "diseased"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["healthy", "diseased"])
    )


def histogram(df: DataFrame, column: str, bins: int = 13) -> DataFrame:
    """Counts in equal bins over [min, max]; the last bin is closed.  All bins are listed."""
    spark = df.sparkSession
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise ValueError("no values to count")
    low, high = float(low), float(high)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def mean_and_population_variance(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def mean_and_sample_variance(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def participation(weights: DataFrame, threshold: float = 0.0, weight: str = "value") -> DataFrame:
    """Share of fits in which a gene's absolute weight passes the threshold."""
    return weights.groupBy("gene_id").agg(
        F.avg(above(F.abs(F.col(weight)), threshold).cast("double")).alias("frequency")
    )


def genes_above(importance: DataFrame, thresholds: Sequence[float], value: str = "importance") -> DataFrame:
    """Number of genes strictly above each threshold.

    One pass: every gene is counted at the number of thresholds it passes, and counts are
    summed from the top over that short list.
    """
    grid = sorted(thresholds)
    passed = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: F.col(value) > t))
    counts = importance.groupBy(passed.alias("passed")).agg(F.count("*").alias("c"))
    reached = counts.where("passed > 0").select(F.explode(F.sequence(F.lit(1), "passed")).alias("place"), "c")
    listed = importance.sparkSession.range(1, len(grid) + 1).select(F.col("id").cast("int").alias("place"), F.lit(0).alias("c"))
    totals = reached.unionByName(listed).groupBy("place").agg(F.sum("c").alias("n_genes"))
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("place"))
    return totals.select(threshold.alias("threshold"), "n_genes")


def confidence_band(mean: Column, variance: Column) -> tuple[Column, Column]:
    half = 1.96 * F.sqrt(variance)
    return mean - half, mean + half


# -- curves -----------------------------------------------------------------------------

BLOCK = 65_536  # places per window partition


def _in_blocks(series: DataFrame, back: int, ahead: int) -> DataFrame:
    """Cut a series with places ``i`` into blocks that overlap by what a window can reach.

    Adds ``block``; a row near an edge is also sent to the neighbour, where ``own`` is
    false.  Windows over a block then give the same values as over the whole series, and
    no task holds more than one block.
    """
    size = max(BLOCK, 4 * (back + ahead))
    reach = F.sequence(F.floor((F.col("i") - ahead) / size), F.floor((F.col("i") + back) / size))
    return series.withColumn("block", F.explode(reach)).withColumn("own", F.floor(F.col("i") / size) == F.col("block"))


def moving_average(df: DataFrame, order: Sequence[str], value: str, w: int) -> DataFrame:
    """Mean over places ``[i-w, i+w)``, cut at both ends; adds ``i`` and ``average``."""
    rows = _in_blocks(with_row_index(df, order, name="i"), w, w - 1)
    near = Window.partitionBy("block").orderBy("i").rowsBetween(-w, w - 1)
    return rows.withColumn("average", F.avg(value).over(near)).where("own").drop("block", "own")


def window_weights(size: int, shape: str) -> list[float]:
    """Normalised weights of the usual smoothing windows."""
    last = size - 1
    turn = [2 * math.pi * k / last for k in range(size)]
    raw = {
        "flat": lambda: [1.0] * size,
        "hanning": lambda: [0.5 - 0.5 * math.cos(t) for t in turn],
        "hamming": lambda: [0.54 - 0.46 * math.cos(t) for t in turn],
        "bartlett": lambda: [1 - abs(2 * k / last - 1) for k in range(size)],
        "blackman": lambda: [0.42 - 0.5 * math.cos(t) + 0.08 * math.cos(2 * t) for t in turn],
    }[shape]()
    return [v / sum(raw) for v in raw]


def smooth(df: DataFrame, order: Sequence[str], value: str, window: int = 11, shape: str = "hanning") -> DataFrame:
    """Weighted smoothing with mirrored ends; adds ``i`` and ``smoothed``.

    An even window loses one.  A window under 3 leaves the series as it is; a series
    shorter than the window is an error.
    """
    if shape not in WINDOW_SHAPES:
        raise ValueError(f"window shape is one of {WINDOW_SHAPES}")
    window = window + window % 2 - 1
    rows = with_row_index(df, order, name="i", count="n")
    n = rows.count()
    if n < window:
        raise ValueError("the series is shorter than the window")
    if window < 3:
        return rows.withColumn("smoothed", F.col(value)).drop("n")
    half = window // 2
    last = F.col("n") - 1
    # the mirror images of the first and last rows become places outside 0..n-1
    image = F.filter(
        F.array(
            F.struct(F.col("i").alias("i"), F.lit(True).alias("real")),
            F.struct(F.when(F.col("i").between(1, half), -F.col("i")).alias("i"), F.lit(False).alias("real")),
            F.struct(
                F.when(F.col("i").between(last - half, last - 1), 2 * last - F.col("i")).alias("i"),
                F.lit(False).alias("real"),
            ),
        ),
        lambda p: p["i"].isNotNull(),
    )
    longer = rows.withColumn("_p", F.explode(image)).withColumn("i", F.col("_p.i")).withColumn("_real", F.col("_p.real"))
    near = Window.partitionBy("block").orderBy("i")
    weighted = [
        F.lit(v) * (F.lead(value, d).over(near) if d >= 0 else F.lag(value, -d).over(near))
        for d, v in zip(range(-half, half + 1), window_weights(window, shape))
    ]
    out = _in_blocks(longer, half, half).withColumn("smoothed", reduce(lambda a, b: a + b, weighted))
    return out.where("own AND _real").drop("block", "own", "_p", "_real", "n")
