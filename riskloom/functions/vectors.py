"""From the long measurement table to one vector per sample, for the chosen genes only."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.rowindex import with_row_index


def gene_index(genes: DataFrame) -> DataFrame:
    """Dense 0-based ``gene_ix`` in the order of ``gene_id``."""
    return with_row_index(genes.select("gene_id").distinct(), ["gene_id"], name="gene_ix")


def assemble(expr: DataFrame, index: DataFrame, fill_missing: bool = False) -> DataFrame:
    """``(sample_id, features ARRAY)``: values in ``gene_ix`` order.

    A group is one sample, so it holds at most as many rows as genes were chosen.  A
    missing gene is an error unless ``fill_missing`` sets it to 0.
    """
    width = index.count()
    chosen = expr.join(index, "gene_id")
    rows = chosen.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("gene_ix", "value"))).alias("_cells")
    )
    if fill_missing:
        cells = F.map_from_entries("_cells")
        values = F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")),
            lambda i: F.coalesce(F.element_at(cells, i), F.lit(0.0)),
        )
    else:
        values = F.when(F.size("_cells") == width, F.transform("_cells", lambda c: c["value"])).otherwise(
            F.raise_error(F.lit("a sample lacks some of the chosen genes"))
        )
    return rows.select("sample_id", values.alias("features"))


def with_vector(df: DataFrame, array: str = "features", name: str = "features") -> DataFrame:
    """Turn an array column into the vector column that ``pyspark.ml`` reads."""
    return df.withColumn(name, array_to_vector(F.col(array)))
