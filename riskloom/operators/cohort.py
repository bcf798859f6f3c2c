"""Stacking cohorts and giving their probes shared gene names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.joins import join_by_key
from riskloom.functions.rowindex import order_statistics, with_running_sum
from riskloom.functions.scalar import inverse_normal, normal_probe
from riskloom.runtime import cut

NORMAL_EDGE = 1e-7  # ranks are kept this far from 0 and 1 before the normal map


def stack(cohorts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all cohorts with a ``cohort`` column; columns a cohort lacks are null."""
    tagged = [df.withColumn("cohort", F.lit(name)) for name, df in cohorts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def common_genes(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("gene_id").intersect(second.select("gene_id"))


def restrict_to_common(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both measurement tables cut to the genes they share.

    The gene list is written first, so that neither table is read once more per side.
    """
    genes = cut(common_genes(first, second), "common")
    return first.join(genes, "gene_id", "left_semi"), second.join(genes, "gene_id", "left_semi")


def genes_in_all(expr: DataFrame, n_cohorts: int) -> DataFrame:
    """Genes measured in every one of ``n_cohorts`` cohorts of a stacked table."""
    pairs = expr.select("cohort", "gene_id").distinct()
    return pairs.groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") == n_cohorts).select("gene_id")


def normal_ranks(expr: DataFrame) -> DataFrame:
    """Average rank of every value within its cohort and gene: adds ``avg_rank`` and ``n``.

    Equal values are counted first; ranks are worked out on distinct values only and
    joined back with frequent values split, so neither a long gene nor a value that many
    samples share lands in one task.
    """
    keys = ["cohort", "gene_id"]
    counts = expr.groupBy(*keys, "value").agg(F.count("*").alias("_c"))
    ranked = with_running_sum(counts, ["value"], "_c", keys, "_upto", "n")
    ranked = ranked.select(
        *keys, "value", (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias("avg_rank"), "n", "_c"
    )
    return join_by_key(expr, ranked, [*keys, "value"], "_c")


def quantile_normalise(expr: DataFrame) -> DataFrame:
    """Each gene within each cohort mapped to a standard normal by its ranks."""
    ranked = normal_ranks(expr)
    p = F.when(F.col("n") > 1, (F.col("avg_rank") - 1) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    p = F.greatest(F.least(p, F.lit(1 - NORMAL_EDGE)), F.lit(NORMAL_EDGE))
    return ranked.select("cohort", "sample_id", "gene_id", inverse_normal(p).alias("value"))


def merge_normalised(expr: DataFrame, n_cohorts: int, normalise: bool = True) -> DataFrame:
    """Normalise per cohort, then keep the genes all cohorts share."""
    genes = genes_in_all(expr, n_cohorts)
    kept = expr.join(genes, "gene_id", "left_semi")
    return quantile_normalise(kept) if normalise else kept


# -- gene names -------------------------------------------------------------------------


def map_symbols(probes: DataFrame, gene_map: DataFrame) -> DataFrame:
    """``(gene_id, gene_symbol)``: current symbols of the probes that have one."""
    known = gene_map.where(F.col("gene_symbol").isNotNull()).select("old_symbol", "gene_symbol").distinct()
    named = probes.select("gene_id", normal_probe(F.col("gene_id")).alias("old_symbol"))
    return named.join(known, "old_symbol").select("gene_id", "gene_symbol")


def inter_quartile_range(expr: DataFrame) -> DataFrame:
    """``(gene_id, iqr, n)`` from exact quartiles; n counts the gene's values."""
    quartiles = order_statistics(expr, ["gene_id"], "value", {"q1": 0.25, "q3": 0.75}, count="n")
    return quartiles.select("gene_id", (F.col("q3") - F.col("q1")).alias("iqr"), "n")


def widest_probe(symbols: DataFrame, iqr: DataFrame) -> DataFrame:
    """Of several probes of one symbol, the one with the largest spread (first id on ties).

    A maximum over a struct is combined before the shuffle, so a symbol with very many
    probes needs no sort of its group.
    """
    best = F.min_by("gene_id", F.struct((-F.col("iqr")).alias("down"), F.col("gene_id")))
    return symbols.join(iqr, "gene_id").groupBy("gene_symbol").agg(best.alias("gene_id"))


def copied_symbols(symbols: DataFrame, present: DataFrame) -> DataFrame:
    """For probes with several symbols: one probe for each symbol not already present.

    Where several such probes offer the same symbol the first probe id wins.
    """
    several = symbols.groupBy("gene_id").agg(F.count("*").alias("_n")).where("_n > 1").select("gene_id")
    offers = symbols.join(several, "gene_id", "left_semi").join(
        present.select("gene_symbol"), "gene_symbol", "left_anti"
    )
    return offers.groupBy("gene_symbol").agg(F.min("gene_id").alias("gene_id"))


def symbol_assignment(symbols: DataFrame, iqr: DataFrame) -> DataFrame:
    """Which probe carries each symbol after the update: ``(gene_id, gene_symbol)``.

    One-to-one probes keep their symbol, several probes of one symbol are settled by
    spread, and probes with several symbols are copied to those still missing.
    """
    counts = symbols.groupBy("gene_symbol").agg(F.count("*").alias("_probes"))
    fans = symbols.groupBy("gene_id").agg(F.count("*").alias("_symbols"))
    per_symbol = symbols.join(counts, "gene_symbol").join(fans, "gene_id")
    single = per_symbol.where("_probes = 1 and _symbols = 1").select("gene_id", "gene_symbol")
    shared = per_symbol.where("_probes > 1").select("gene_id", "gene_symbol")
    won = widest_probe(shared, iqr).select("gene_id", "gene_symbol")
    settled = cut(single.unionByName(won), "settled")
    return settled.unionByName(copied_symbols(symbols, settled).select("gene_id", "gene_symbol"))


def update_genes(expr: DataFrame, gene_map: DataFrame) -> DataFrame:
    """Measurement table under current gene symbols.

    ``expr`` is read for the quartiles and for the result; the probes that have values come
    from the quartile table, a probe without any cannot carry a symbol.
    """
    spread = cut(inter_quartile_range(expr), "iqr")
    symbols = cut(map_symbols(spread, gene_map), "symbols")
    chosen = symbol_assignment(symbols, spread).join(spread.select("gene_id", "n"), "gene_id")
    return join_by_key(expr, chosen, ["gene_id"], "n").select("sample_id", F.col("gene_symbol").alias("gene_id"), "value")


def annotate(genes: DataFrame, platform: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Platform columns of the selected genes; unknown genes stay with nulls."""
    return genes.join(platform.select("gene_id", *columns), "gene_id", "left")
