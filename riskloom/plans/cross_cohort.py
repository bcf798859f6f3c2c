"""Train on one cohort, test on another."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from riskloom.operators import metrics as M
from riskloom.operators.cohort import common_genes
from riskloom.operators.selection import slice_genes
from riskloom.operators.search import predictions_of
from riskloom.plans.nested import design
from riskloom.runtime import cut


def train_on_first_test_on_second(
    first: tuple[DataFrame, DataFrame],
    second: tuple[DataFrame, DataFrame],
    select: Callable[[int | None, DataFrame, DataFrame], DataFrame],
    spec,
) -> DataFrame:
    """Predictions for the second cohort ``(sample_id, label, p1, prediction, ...)``.

    Each cohort is ``(expr, labels)``.  Only genes measured in both are used, and genes
    are selected on the first cohort alone, by ``select(None, train_rows, index)``.
    """
    genes = cut(common_genes(first[0], second[0]), "common")
    train, index = design(*first, genes)
    test, _ = design(*second, genes)
    train = cut(train, "train")
    chosen = select(None, train, index)
    places = sorted(r[0] for r in index.join(chosen, "gene_id", "left_semi").select("gene_ix").collect())
    fitted = spec.fit(slice_genes(train, places))
    return predictions_of(fitted, slice_genes(test, places))


def score_second(predictions: DataFrame, metrics: Mapping[str, M.Metric]) -> DataFrame:
    """One row of scores, AUC included."""
    found = M.model_scores(cut(predictions.select("label", "p1", "prediction"), "scored"), metrics)[None]
    return predictions.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"`{name}` double" for name in found))
