"""Nested evaluation: select genes, search and refit inside each outer split, score outside."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.vectors import assemble, gene_index, with_vector
from riskloom.operators import metrics as M
from riskloom.operators.folds import attach_splits, sides, stratified_k_fold
from riskloom.operators.runs import RunStore
from riskloom.operators.search import GridSearch, scores_of
from riskloom.operators.selection import read_selection, select_by_model, slice_genes
from riskloom.runtime import cut, scratch_path

RESULT_SCHEMA = "model string, selector string, split_id int, section string, name string, value string"


def design(expr: DataFrame, labels: DataFrame, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Model rows ``(sample_id, features, label)`` and the gene index behind the vectors."""
    index = cut(gene_index(expr if genes is None else genes), "genes")
    rows = with_vector(assemble(expr, index)).join(
        labels.select("sample_id", F.col("y").cast("double").alias("label")), "sample_id"
    )
    return rows, index


def inner_rows(train: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """Train rows with their inner stratified folds."""
    return attach_splits(train, stratified_k_fold(train.select("sample_id", "label"), "label", n_splits, seed=seed))


def nested_evaluation(
    expr: DataFrame,
    labels: DataFrame,
    outer: DataFrame,
    split_ids: Sequence[int],
    model: str,
    spec,
    grid: Mapping[str, Sequence],
    selector: str,
    select: Callable[[int | None, DataFrame, DataFrame], DataFrame],
    metrics: Mapping[str, M.Metric],
    inner_splits: int = 5,
    refit: str | None = None,
    seed: int = 0,
    search_type: type = GridSearch,
    derive: Callable[[DataFrame], object] | None = None,
    store: RunStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Result rows and out-of-fold predictions of one model and selector.

    ``outer`` is the test side of the outer splits.  ``select(split, train_rows, index)`` sees train
    rows only, or reads what is stored for the split.  ``derive(train_rows)`` fits new variables on the chosen
    genes of the train side, such as components; its ``transform`` makes them on both sides.  ``search_type`` is
    ``GridSearch``, ``SequentialSearch`` (``grid`` is then a list of grids) or a class like them.

    Every split is committed to ``store`` as soon as it is done (without one, to scratch tables of this call).  With a
    store of the same run key a stopped evaluation goes on: splits that have a whole result are not fitted again.
    """
    spark = expr.sparkSession
    store = store or RunStore(spark, scratch_path(spark, "run"), "run")
    pending = store.pending(model, selector, split_ids)
    whole, index = design(expr, labels)
    whole = cut(attach_splits(whole, outer), "design") if pending else whole
    for split in pending:
        train, test = sides(whole, split)
        genes = cut(select(int(split), train, index), "selected")
        chosen = sorted(r[0] for r in index.join(genes, "gene_id", "left_semi").select("gene_ix").collect())
        if not chosen:
            raise ValueError(f"no gene was selected in split {split}")
        train, test = cut(slice_genes(train, chosen), "train"), slice_genes(test, chosen)
        if derive is not None:
            made = derive(train)
            train, test = cut(made.transform(train), "derived"), made.transform(test)
        search = search_type(spec, grid, metrics, refit).fit(
            cut(inner_rows(train, inner_splits, seed), "inner"), range(inner_splits), train
        )
        scored = cut(search.best_model.transform(test), "scored")
        values = scores_of(AlreadyScored(), scored, metrics)[None]
        lines = [(model, selector, split, "general", "fs_size", str(len(chosen)))]
        lines += [(model, selector, split, "general", "Class", type(spec).__name__)]
        lines += [(model, selector, split, "Test", "score", str(values[search.refit]))]
        lines += [(model, selector, split, "Test", name, str(v)) for name, v in values.items()]
        lines += [(model, selector, split, "Validation", "score", str(search.best_score))]
        lines += [(model, selector, split, "Validation", k, str(v)) for k, v in search.best_params.items()]
        found = spark.createDataFrame(lines, RESULT_SCHEMA).select("section", "name", "value")
        store.commit(model, selector, split, found, scored.select("sample_id", "label", "p1"))
    mine = F.col("split_id").isin([int(s) for s in split_ids]) & (F.col("model") == model) & (F.col("selector") == selector)
    predictions = store.predictions(labels.schema["sample_id"].dataType.simpleString()).where(mine)
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    return store.results().where(mine).select(*names), predictions.select("model", "split_id", "sample_id", "label", "p1")


class AlreadyScored:
    """Stands for a model whose predictions are in the rows."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows


def l1_selector(spec) -> Callable[[int | None, DataFrame, DataFrame], DataFrame]:
    """Genes with a positive weight in ``spec``, which may be a ``TunedSpec``."""
    return lambda split, rows, index: select_by_model(spec, rows, index)


def stored_selector(spark: SparkSession, path: str, selector_key: str) -> Callable[[int | None, DataFrame, DataFrame], DataFrame]:
    """The selection stored for each split under the selector's key."""
    return lambda split, rows, index: read_selection(spark, path, selector_key, split).select("gene_id")


def all_genes(split: int | None, rows: DataFrame, index: DataFrame) -> DataFrame:
    return index.select("gene_id")
