"""Join to a table of keys when one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.runtime import cut

ROWS_PER_COPY = 1_000_000  # rows of one key that may meet in one task


def _with_parts(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_parts`` of the row's key, 1 unless the key is listed; null keys match null keys."""
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_parts")
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    joined = df.join(named, same, "left").drop(*[f"_hot_{k}" for k in keys])
    return joined.withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def join_by_key(
    rows: DataFrame, side: DataFrame, keys: Sequence[str], size: str, spread: Column | str = "sample_id"
) -> DataFrame:
    """Inner join of ``rows`` with ``side``, whose ``size`` says how many rows a key has; null is a key too.

    A key with more than ``ROWS_PER_COPY`` rows is split: its side rows are repeated once
    per part, and its rows choose a part by the hash of ``spread``.  The list of such keys
    is written once, so both sides see the same one; it has at most rows / ``ROWS_PER_COPY``
    entries by construction, and Spark broadcasts it while its bytes allow.  If none is listed
    the join is plain.
    """
    spread = F.col(spread) if isinstance(spread, str) else spread
    side = cut(side.withColumn("_parts", F.ceil(F.col(size) / ROWS_PER_COPY).cast("int")), "side")
    hot = cut(side.where("_parts > 1").select(*keys, "_parts").distinct(), "hot_keys")
    if hot.isEmpty():
        renamed = side.drop("_parts", size).withColumnsRenamed({k: f"_side_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_side_{k}")) for k in keys]
        return rows.join(renamed, same).drop(*[f"_side_{k}" for k in keys])
    marked = _with_parts(rows, hot, keys)
    marked = marked.withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts"))).drop("_parts")
    listed = _with_parts(side.drop("_parts"), hot, keys)
    last = F.col("_parts").cast("long") - 1
    listed = listed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_parts", size)
    renamed = listed.withColumnsRenamed({k: f"_side_{k}" for k in [*keys, "_part"]})
    same = [F.col(k).eqNullSafe(F.col(f"_side_{k}")) for k in keys] + [F.col("_part") == F.col("_side__part")]
    return marked.join(renamed, same).drop("_part", *[f"_side_{k}" for k in [*keys, "_part"]])
