"""Global positions, ranks and running sums without a one-task window.

A plain ``row_number()`` over the whole table, or over one large class, sends all of
those rows to one task.  Here rows are first spread over ranges of
about equal size, numbered inside each, and shifted by the size of the ranges before.
The shift table has one row per range and group, never one per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.runtime import cut

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in its partition


def _placed(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows sorted over range partitions, with range number ``_ri_part`` and place ``_ri_pos``.

    ``order`` must be total (end with an id): ties then never share one range whole.
    The result is written, since a second evaluation could draw other range bounds.
    """
    keys = [F.col(g) for g in groups] + list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(
        spread.withColumn("_ri_part", F.spark_partition_id()).withColumn(
            "_ri_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        ),
        "ranges",
    )


def _shift(sizes: DataFrame, groups: Sequence[str], by: str, amount: str) -> DataFrame:
    """Add ``_ri_before`` (sum of ``amount`` in earlier ranges) and ``_ri_all`` (sum over the group)."""
    group = Window.partitionBy(*groups)
    earlier = group.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_ri_before", F.coalesce(F.sum(amount).over(earlier), F.lit(0))).withColumn(
        "_ri_all", F.sum(amount).over(group)
    )


def _rejoin(rows: DataFrame, shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` that also matches null group values."""
    renamed = shifts.select(*[F.col(k).alias(f"_ri_k_{k}") if k in keys else F.col(k) for k in shifts.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_ri_k_{k}")) for k in keys]
    return rows.join(renamed, on).drop(*[f"_ri_k_{k}" for k in keys])


def with_row_index(
    df: DataFrame,
    order: Sequence[str | Column],
    groups: Sequence[str] = (),
    name: str = "row_ix",
    count: str | None = None,
) -> DataFrame:
    """0-based position of every row in ``order``, inside its group when groups are given.

    ``count`` names an extra column with the size of the whole group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _placed(df, groups, order)
    sizes = rows.groupBy("_ri_part", *groups).agg(F.min("_ri_pos").alias("_ri_first"), F.count("*").alias("_ri_n"))
    shifts = _shift(sizes, groups, "_ri_part", "_ri_n").drop("_ri_n")
    out = _rejoin(rows, shifts, ["_ri_part", *groups])
    out = out.withColumn(name, F.col("_ri_pos") - F.col("_ri_first") + F.col("_ri_before"))
    if count:
        out = out.withColumn(count, F.col("_ri_all"))
    return out.drop("_ri_part", "_ri_pos", "_ri_first", "_ri_before", "_ri_all")


def with_running_sum(
    df: DataFrame,
    order: Sequence[str | Column],
    value: str,
    groups: Sequence[str] = (),
    name: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Sum of ``value`` over this row and all rows before it in its group."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _placed(df, groups, order)
    sizes = rows.groupBy("_ri_part", *groups).agg(F.sum(value).alias("_ri_sum"))
    shifts = _shift(sizes, groups, "_ri_part", "_ri_sum")
    inside = Window.partitionBy("_ri_part", *groups).orderBy("_ri_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_ri_inside", F.sum(value).over(inside))
    out = _rejoin(rows, shifts.drop("_ri_sum"), ["_ri_part", *groups])
    out = out.withColumn(name, F.col("_ri_inside") + F.col("_ri_before"))
    if total:
        out = out.withColumn(total, F.col("_ri_all"))
    return out.drop("_ri_part", "_ri_pos", "_ri_inside", "_ri_before", "_ri_all")


def shuffle_key(seed: int, repeat: str | Column, ident: str | Column) -> Column:
    """Hash that stands for a random draw: the same in every engine with md5."""
    rep = F.col(repeat) if isinstance(repeat, str) else repeat
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), ident.cast("string")))


def with_shuffled_index(
    df: DataFrame,
    ident: str,
    seed: int,
    repeat: str,
    groups: Sequence[str] = (),
    name: str = "row_ix",
    count: str | None = None,
) -> DataFrame:
    """0-based position in hash order, per value of the ``repeat`` column (and group)."""
    rows = df.withColumn("_ri_key", shuffle_key(seed, repeat, ident))
    return with_row_index(rows, ["_ri_key", ident], [repeat, *groups], name, count).drop("_ri_key")


def order_statistics(
    df: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float], count: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``shares``.

    Equal values are counted before the sort, so a value that fills a third of the table
    is one row here; the quantile is read off the running counts.  ``count`` names an
    extra column with the number of values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    ranked = with_running_sum(counts, [value], "_c", groups, "_upto", "_n")
    low = {k: F.floor((F.col("_n") - 1) * q) for k, q in shares.items()}
    high = {k: F.ceil((F.col("_n") - 1) * q) for k, q in shares.items()}

    def at(place: Column) -> Column:  # value at a 0-based place of the sorted column
        return F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c")), F.col(value)))

    picked = ranked.groupBy(*groups).agg(
        F.max("_n").alias("_n"),
        *[at(low[k]).alias(f"_lo_{k}") for k in shares],
        *[at(high[k]).alias(f"_hi_{k}") for k in shares],
    )
    out = []
    for k, q in shares.items():
        place = (F.col("_n") - 1) * q
        part = place - F.floor(place)
        out.append((F.col(f"_lo_{k}") + part * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k))
    return picked.select(*groups, *out, *([F.col("_n").alias(count)] if count else []))
