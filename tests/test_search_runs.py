import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.operators import folds as E
from riskloom.operators import metrics as H
from riskloom.operators import runs as R
from riskloom.operators import search as G
from riskloom.functions.vectors import gene_index
from riskloom.operators.models import LogisticSpec, fit_components
from riskloom.operators.selection import select_by_model, store_selection
from riskloom.plans.nested import all_genes, l1_selector, nested_evaluation, stored_selector
from riskloom.runtime import scratch_path


@pytest.fixture(scope="module")
def expr(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(int)
    long = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(60) for g in range(3)], "sample_id int, gene_id int, value double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "sample_id int, y int")
    rows = spark.createDataFrame([(i, Vectors.dense(x[i]), float(y[i])) for i in range(60)], ["sample_id", "features", "label"])
    rows = rows.withColumn("sample_id", F.col("sample_id").cast("int"))
    sides = E.stratified_k_fold(labels, "y", 3)
    return long, labels, E.attach_splits(rows, sides).cache(), rows.cache()


def log(spark, cells):
    return spark.createDataFrame(cells, "candidate_id int, split_id int, n_test long, metric string, test_score double")


def test_ranks_and_best(spark):
    rows = log(spark, [(c, 0, 5, "m", s) for c, s in enumerate([0.3, 0.1, 0.3, 0.2])])
    summary = G.search_summary(rows)
    assert [r["rank"] for r in summary.orderBy("candidate_id").collect()] == [1, 4, 1, 3]
    assert G.best_candidate(summary).first()["candidate_id"] == 0


def test_weighted_mean(spark):
    rows = log(spark, [(0, 0, 3, "m", 1.0), (0, 1, 1, "m", 0.0)])
    r = G.search_summary(rows).first()
    assert (r["mean_score"], r["std_score"]) == (0.75, pytest.approx(np.sqrt(0.1875)))
    assert G.search_summary(rows, iid=False).first()["mean_score"] == 0.5


def test_candidates_agree(spark):
    grids = [{"b": [1, 2], "a": ["x", "y", "z"]}, {"c": [0.5]}]
    table = [r["params"] for r in G.candidate_table(spark, grids).orderBy("candidate_id").collect()]
    assert table == [{k: str(v) for k, v in c.items()} for c in G.candidate_list(grids)]


def test_p_value(spark):
    scores = spark.createDataFrame([(s,) for s in (0.5, 0.8, 0.9, 0.1)], "score double")
    assert G.permutation_p_value(scores, 0.8).first()[0] == pytest.approx(0.6)


def test_permuted_labels_keep_groups(spark):
    rows = spark.createDataFrame([(i, i % 4, i) for i in range(40)], "sample_id int, g int, y int")
    out = G.permuted_labels(rows, 2, 1, "g").toPandas()
    assert (out.g == out.y % 4).all() and sorted(out[out.permutation == 0].y) == list(range(40))
    assert (out.y != out.sample_id).any()


def test_train_sizes():
    assert G.train_size_list([0.1, 0.5, 1.0], 10) == [1, 5, 10]
    assert G.train_size_list([0.001, 0.002], 10) == [1]
    assert G.train_size_list([3, 3, 7], 10) == [3, 7]
    for bad in ([0.0, 0.5], [0.5, 1.5], [0, 3], [11]):
        with pytest.raises(ValueError):
            G.train_size_list(bad, 10)


def test_scores_to_columns(spark):
    cells = [(i, "a", a) for i, a in enumerate([1, 2, 3, 10])] + [(i, "b", b) for i, b in enumerate([10, 2, 3, 10])]
    out = G.aggregate_scores(spark.createDataFrame(cells, "place int, metric string, score int"), ["a", "b"]).orderBy("place")
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 10), (2, 2), (3, 3), (10, 10)]


def test_refit_must_be_named():
    with pytest.raises(ValueError):
        G.check_refit({"a": None, "b": None}, None)
    assert G.check_refit({"a": None}, None) == "a"


def step(spark, values, p_aug=0.3, lo=0.0, hi=4.0):
    chosen = spark.createDataFrame([("C", i, v) for i, v in enumerate(values)], "name string, split_id int, value double")
    ends = spark.createDataFrame(
        [("C", lo, hi, -2.0, 10.0, 0.0, 4.0, "linear")],
        "name string, lo double, hi double, lo_limit double, hi_limit double, grid_lo double, grid_hi double, scale string",
    )
    return tuple(G.interval_step(chosen, ends, p_aug).first())[1:]


def test_interval_step(spark):
    assert step(spark, [1.0, 2.0, 3.0]) == (1.0, 3.0, False)  # inside: shrink both ends
    assert step(spark, [0.0, 0.0, 4.0, 2.0]) == (-1.0, 4.0, False)  # lower edge in half of the splits
    assert step(spark, [0.0, 2.0, 4.0, 2.0]) == (0.0, 4.0, True)  # edges, but rarely
    assert step(spark, [0.0, 4.0, 4.0, 2.0]) == (0.0, 7.0, False)


def test_adaptive_search_stops_when_settled(spark):
    seen = []

    def pick(grid):
        seen.append(grid["C"])
        values = [min(grid["C"]), max(grid["C"])] + [grid["C"][1]] * 3
        return spark.createDataFrame([("C", i, float(v)) for i, v in enumerate(values)], "name string, split_id int, value double")

    start = {"C": {"lo": -1.0, "hi": 1.0, "lo_limit": -3.0, "hi_limit": 3.0, "n": 3, "scale": "log"}}
    assert G.adaptive_search(None, start, pick)["C"]["lo"] == -1.0 and len(seen) == 1
    assert seen[0] == [0.1, 1.0, 10.0]


def test_out_of_fold(expr):
    _, _, rows, _ = expr
    out = G.cross_val_predict(LogisticSpec(), rows, range(3)).toPandas()
    assert sorted(out.sample_id) == list(range(60))
    assert np.allclose(out.log_p1, np.log(out.p1)) and (out.prediction == (out.p1 > 0.5)).all()
    with pytest.raises(ValueError):
        G.cross_val_predict(LogisticSpec(), rows, range(2))


def test_grid_search_and_failure(expr):
    _, _, rows, plain = expr
    found = G.GridSearch(LogisticSpec(), {"C": [1e-4, 1.0]}).fit(rows, range(3), plain)
    assert found.best_params == {"C": 1.0}
    with pytest.raises(ValueError):
        G.fit_and_score(LogisticSpec(), [{"C": -1.0}], rows, [0])
    log = G.fit_and_score(LogisticSpec(), [{"C": -1.0}], rows, [0], error_score=-9.0)
    assert log.first()["test_score"] == -9.0
    times = G.time_summary(found.log).collect()
    assert len(times) == 2 and all(t["mean_fit_s"] > 0 for t in times)


def test_sequential_search_merges(expr):
    _, _, rows, plain = expr
    merged, score, model = G.sequential_search(
        LogisticSpec(), [{"C": [1e-4, 1.0]}, {"C": [0.5]}], rows, range(3), plain, carry_over=True
    )
    assert merged == {"C": 0.5} and score < 0


def test_learning_curve(expr):
    _, _, rows, _ = expr
    out = G.learning_curve(LogisticSpec(), rows, range(3), [0.5, 1.0], H.log_loss).toPandas()
    smallest = min(n for n, _ in E.side_sizes(rows, range(3)).values())
    assert sorted(out.train_size.unique()) == [smallest // 2, smallest] and len(out) == 6


def test_permutation_test(expr):
    _, labels, rows, _ = expr
    score, permuted, p = G.permutation_test(LogisticSpec(), rows, range(3), labels, H.accuracy, 3)
    assert score > max(permuted) and p == 0.25


def test_nested_with_stored_selection_components_and_sequential_search(spark, expr):
    long, labels, rows, index = expr
    outer = E.stratified_k_fold(labels, "y", 2)
    path = scratch_path(spark, "selected")
    genes = sorted(r["gene_id"] for r in long.select("gene_id").distinct().collect())
    chosen = [(s, g) for s in range(2) for g in genes[: 2 + s]]  # two genes in split 0, three in split 1
    store_selection(spark.createDataFrame(chosen, long.select(F.lit(0).alias("split_id"), "gene_id").schema), path, "kept")
    results, predictions = nested_evaluation(
        long, labels, outer, range(2), "lr", LogisticSpec(), [{"C": [0.1, 1.0]}, {"penalise_intercept": [False, True]}], "stored",
        stored_selector(spark, path, "kept"), {"auc": H.auc, "accuracy": H.accuracy}, 2, "auc",
        search_type=G.SequentialSearch, derive=lambda train: fit_components(train, 1),
    )
    found = {(r["split_id"], r["section"], r["name"]): r["value"] for r in results.collect()}
    assert [found[s, "general", "fs_size"] for s in range(2)] == ["2", "3"]
    for s in range(2):
        assert {"C", "penalise_intercept", "score"} == {n for split, section, n in found if split == s and section == "Validation"}
        assert float(found[s, "Test", "score"]) == float(found[s, "Test", "auc"])
    assert sorted(r["sample_id"] for r in predictions.collect()) == list(range(60))


def test_tuned_model_selects_genes(spark, expr):
    long, _, rows, _ = expr
    index = gene_index(long)
    spec = LogisticSpec(penalty="l1", tol=1e-9)
    plain = rows.select("sample_id", "features", "label")
    tuned = G.TunedSpec(spec, {"C": [0.05, 0.5]}, n_splits=3, seed=1)
    search = G.GridSearch(spec, {"C": [0.05, 0.5]})
    folds = E.stratified_k_fold(plain.select("sample_id", "label"), "label", 3, seed=1)
    best = search.fit(E.attach_splits(plain, folds), range(3), plain).best_spec
    got, want = (sorted(r[0] for r in select_by_model(s, plain, index, "nonzero").collect()) for s in (tuned, best))
    assert got == want and got


def test_nested_with_resume(spark, expr):
    long, labels, _, _ = expr
    outer = E.stratified_k_fold(labels, "y", 2)
    metrics = {"log_loss": H.negative_log_loss, "accuracy": H.accuracy}
    planned = spark.createDataFrame([("lr", "l1", s) for s in range(2)], "model string, selector string, split_id int")

    def run(splits):
        spec = LogisticSpec(C=1.0, penalty="l1")
        return nested_evaluation(
            long, labels, outer, splits, "lr", LogisticSpec(), {"C": [0.1, 1.0]}, "l1", l1_selector(spec), metrics, 2, "log_loss"
        )

    first, predictions = run([0])
    left = [r["split_id"] for r in R.pending_splits(planned, first, 7).collect()]
    assert left == [1]
    second, more = run(left)
    whole = first.unionByName(second)
    assert R.pending_splits(planned, whole, 7).count() == 0
    assert sorted(r["sample_id"] for r in predictions.unionByName(more).collect()) == list(range(60))
    summary = R.compare_models(whole)
    accuracy = R.metric_table(summary, "accuracy").first()
    assert accuracy["mean"] > 0.6
    table = R.metric_table(summary, "accuracy", ["l1"]).first()
    assert table["l1"] == accuracy["mean"]


def test_nested_goes_on_where_it_stopped(spark, expr):
    """Stopped inside a split: started again, only what is left is fitted, and the answer is that of a whole run."""
    long, labels, _, _ = expr
    outer = E.stratified_k_fold(labels, "y", 3)
    fitted = []

    def run(store, stop=None):
        def select(split, rows, index):
            fitted.append(split)
            if split == stop:
                raise RuntimeError("executor gone")
            return all_genes(split, rows, index)

        metrics = {"log_loss": H.negative_log_loss, "accuracy": H.accuracy}
        return nested_evaluation(long, labels, outer, range(3), "lr", LogisticSpec(), {"C": [0.1, 1.0]}, "all", select, metrics, 2, "log_loss", store=store)

    path = scratch_path(spark, "runs")
    with pytest.raises(RuntimeError, match="executor gone"):
        run(R.RunStore(spark, path, "key"), stop=1)
    assert fitted == [0, 1]
    # predictions whose results were never written do not count
    R.RunStore(spark, path, "key")._write(labels.selectExpr("sample_id", "1.0D AS label", "0.5D AS p1"), "predictions", {"run_key": "key", "model": "lr", "selector": "all", "split_id": 1})
    fitted.clear()
    results, predictions = run(R.RunStore(spark, path, "key"))
    assert fitted == [1, 2]
    whole, wanted = run(R.RunStore(spark, path, "other"))
    assert fitted == [1, 2, 0, 1, 2]
    assert sorted(map(tuple, results.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, predictions.collect())) == sorted(map(tuple, wanted.collect())) and predictions.count() == 60
    fitted.clear()
    run(R.RunStore(spark, path, "key"))
    assert fitted == []


def test_passthrough_selector(expr):
    long, _, _, _ = expr
    assert all_genes(None, None, long.select("gene_id").distinct()).count() == 3


def test_run_key_ignores_order(spark):
    rows = [("r1", "C", "1"), ("r1", "k", "rbf"), ("r2", "k", "rbf"), ("r2", "C", "1"), ("r3", "C", "2")]
    keys = {r["run"]: r["run_key"] for r in R.run_key(spark.createDataFrame(rows, "run string, name string, value string")).collect()}
    assert keys["r1"] == keys["r2"] != keys["r3"]


def test_parameter_names(spark):
    table = G.candidate_table(spark, [{"a": [1, 2]}, {"a": [2], "b": [3]}])
    assert sorted(r[0] for r in R.parameter_names(table).collect()) == ["a", "b"]
    assert sorted(map(tuple, R.flatten_grid(table).collect())) == [("a", "1"), ("a", "2"), ("b", "3")]
