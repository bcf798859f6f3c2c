"""Parameter search and validation curves.

Rows of a search are ``(sample_id, features, label, test_in, train_in)``: each row once, with
the splits it belongs to.  The driver only loops over candidates and splits; every fit and
every score is a Spark job, and a small thread pool keeps several of them going.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from math import prod
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.rowindex import shuffle_key, with_row_index, with_running_sum, with_shuffled_index
from riskloom.operators import batch
from riskloom.operators import metrics as M
from riskloom.operators.folds import attach_sides, attach_splits, is_train_in, side_sizes, sides, stratified_k_fold
from riskloom.operators.models import LinearClassifier, LogisticSpec
from riskloom.runtime import cut

DEFAULT_METRICS: dict[str, M.Metric] = {"neg_log_loss": M.negative_log_loss}
LOG_SCHEMA = (
    "candidate_id int, params map<string,string>, split_id int, n_test long, metric string, "
    "test_score double, train_score double, fit_s double, score_s double"
)


# -- G1, G9 -----------------------------------------------------------------------------


def candidate_list(grids: Mapping | Sequence[Mapping]) -> list[dict]:
    """Every parameter combination; names in order, the last name changes fastest."""
    grids = [grids] if isinstance(grids, Mapping) else grids
    out = []
    for grid in grids:
        names = sorted(grid)
        out += [dict(zip(names, values)) for values in product(*[grid[k] for k in names])]
    return out


def candidate_table(spark: SparkSession, grids: Mapping | Sequence[Mapping]) -> DataFrame:
    """The same combinations as a table ``(candidate_id, params)``.

    A candidate's values follow from its number by division with remainder, so large grids
    are made in parallel from a range and no tables are multiplied.  Values are a list, or a
    table of one column, which is numbered in its order, once for all grids, and joined by number.
    """
    grids = [grids] if isinstance(grids, Mapping) else grids
    numbered_once: dict[int, tuple[DataFrame, int]] = {}
    parts, offset = [], 0
    for grid in grids:
        names = sorted(grid)
        tables = {k: v for k, v in grid.items() if isinstance(v, DataFrame)}
        for v in tables.values():
            if id(v) not in numbered_once:
                values = cut(with_row_index(v.select(F.col(v.columns[0]).alias("_v")), ["_v"], name="_n"), "values")
                numbered_once[id(v)] = values.select("_n", F.col("_v").cast("string").alias("_v")), values.count()
        sizes = {k: numbered_once[id(tables[k])][1] if k in tables else len(grid[k]) for k in names}
        total = prod(sizes.values())
        stride, cells, rows = total, [], spark.range(total)
        for i, k in enumerate(names):
            stride //= sizes[k]
            place = F.floor(F.col("id") / stride) % sizes[k]
            if k in tables:
                numbered = numbered_once[id(tables[k])][0].toDF(f"_n{i}", f"_v{i}")
                rows = rows.withColumn(f"_p{i}", place.cast("long")).join(numbered, F.col(f"_p{i}") == F.col(f"_n{i}"))
                cells += [F.lit(k), F.col(f"_v{i}")]
            else:
                cells += [F.lit(k), F.element_at(F.array(*[F.lit(str(v)) for v in grid[k]]), place.cast("int") + 1)]
        parts.append(rows.select((F.col("id") + offset).alias("candidate_id"), F.create_map(*cells).alias("params")))
        offset += total
    return reduce(DataFrame.unionByName, parts)


def random_candidates(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` candidates in hash order."""
    return candidates.orderBy(shuffle_key(seed, F.lit(0), "candidate_id"), "candidate_id").limit(n)


# -- G2, G5, G6 -------------------------------------------------------------------------


def scores_of(fitted, rows: DataFrame, metrics: Mapping[str, M.Metric], side: Column | None = None) -> dict:
    """Every metric of a fitted model in one pass: ``{side: {metric: value}}``.

    ``side`` splits the rows, for instance into train and test; without it there is one
    entry, under None.
    """
    if side is None:
        return M.model_scores(fitted.transform(rows), metrics)
    return M.model_scores(fitted.transform(rows.withColumn("_side", side)), metrics, "_side")


def fit_and_score(
    spec,
    candidates: Sequence[dict],
    rows: DataFrame,
    split_ids: Sequence[int],
    metrics: Mapping[str, M.Metric] | None = None,
    train_scores: bool = False,
    error_score: float | None = None,
    parallelism: int = 8,
    keep_models: dict | None = None,
) -> DataFrame:
    """Fit every candidate on every split and score it on the split's test rows.

    A failed fit raises, or is recorded with ``error_score`` when one is given.  Logistic models are all fitted at
    once; each then shows an equal share of the time.
    """
    metrics = metrics or DEFAULT_METRICS
    spark = rows.sparkSession
    split_ids = [int(s) for s in split_ids]
    if isinstance(spec, LogisticSpec):
        log = _fit_at_once(spec, candidates, rows, split_ids, metrics, train_scores, error_score, keep_models)
        return spark.createDataFrame(log, LOG_SCHEMA)
    mine = not (rows.storageLevel.useMemory or rows.storageLevel.useDisk)
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK) if mine else rows  # each row once, for all splits
    sizes = side_sizes(kept, split_ids)

    def one(job: tuple[int, tuple[int, dict]]) -> list[tuple]:
        split, (number, params) = job
        n_train, n_test = sizes[split]
        began = time.monotonic()
        try:
            train, test = sides(kept, split)
            fitted = spec.with_params(**params).fit(train, n_train)
            fit_s = time.monotonic() - began
            if train_scores:
                side = is_train_in(split)
                found = scores_of(fitted, kept.where(side.isNotNull()), metrics, side)
                on_test, on_train = found[False], found[True]
            else:
                on_test, on_train = scores_of(fitted, test, metrics)[None], dict.fromkeys(metrics)
            if keep_models is not None:
                keep_models[number, split] = fitted
        except Exception:
            if error_score is None:
                raise
            fit_s = time.monotonic() - began
            on_test = dict.fromkeys(metrics, float(error_score))
            on_train = dict.fromkeys(metrics, float(error_score) if train_scores else None)
        score_s = time.monotonic() - began - fit_s
        shown = {k: str(v) for k, v in params.items()}
        return [(number, shown, split, n_test, m, on_test[m], on_train[m], fit_s, score_s) for m in metrics]

    jobs = list(product(split_ids, enumerate(candidates)))
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        log = [line for lines in pool.map(inheritable_thread_target(spark)(one), jobs, chunksize=1) for line in lines]
    if mine:
        kept.unpersist()
    return spark.createDataFrame(log, LOG_SCHEMA)


def _fit_at_once(spec, candidates, rows, split_ids, metrics, train_scores, error_score, keep_models) -> list[tuple]:
    sizes = side_sizes(rows, split_ids)
    began = time.monotonic()
    jobs, bad = [], set()
    for split, (number, params) in product(split_ids, enumerate(candidates)):
        try:
            if not sizes[split][0]:
                raise ValueError(f"split {split} has no train rows")
            jobs.append((split, number, batch.Fit(spec.with_params(**params).checked(), split)))
        except Exception:
            if error_score is None:
                raise
            bad.add((split, number))
    fits = [f for _, _, f in jobs]
    found: dict = {}
    fit_s = score_s = 0.0
    if fits:
        design = batch.pack(rows, split_ids)
        weights = batch.solve(design, fits)
        fit_s = (time.monotonic() - began) / len(fits)
        scored = batch.scores(design, fits, weights, metrics, train_scores)
        score_s = (time.monotonic() - began) / len(fits) - fit_s
        design.drop()
        for (split, number, _), w, s in zip(jobs, weights, scored):
            found[split, number] = s
            if keep_models is not None:
                keep_models[number, split] = LinearClassifier(w[:-1], float(w[-1]))
    log = []
    for split, (number, params) in product(split_ids, enumerate(candidates)):
        shown = {k: str(v) for k, v in params.items()}
        for m in metrics:
            if (split, number) in bad:
                test, train = float(error_score), float(error_score) if train_scores else None
            else:
                test, train = found[split, number][False][m], found[split, number][True][m] if train_scores else None
            log.append((number, shown, split, sizes[split][1], m, test, train, fit_s, score_s))
    return log


def check_refit(metrics: Mapping[str, M.Metric], refit: str | None) -> str:
    """With several metrics the one that picks the best candidate must be named."""
    if refit is None and len(metrics) == 1:
        return next(iter(metrics))
    if refit not in metrics:
        raise ValueError("name one of the metrics to choose the best candidate by")
    return refit


# -- G3, G4 -----------------------------------------------------------------------------


def search_summary(log: DataFrame, iid: bool = True, score: str = "test_score") -> DataFrame:
    """Mean, deviation and rank per candidate and metric; best is 1, ties share a rank.

    With ``iid`` both mean and deviation weigh splits by their test size.
    """
    w = F.col("n_test").cast("double") if iid else F.lit(1.0)
    s = F.col(score)
    sums = log.groupBy("metric", "candidate_id").agg(
        F.sum(w).alias("_w"), F.sum(w * s).alias("_ws"), F.sum(w * s * s).alias("_wss"), F.count("*").alias("n_splits")
    )
    mean = F.col("_ws") / F.col("_w")
    variance = F.greatest(F.col("_wss") / F.col("_w") - mean * mean, F.lit(0.0))
    return _with_rank(
        sums.select("metric", "candidate_id", mean.alias("mean_score"), F.sqrt(variance).alias("std_score"), "n_splits")
    )


def _with_rank(means: DataFrame) -> DataFrame:
    """Minimum rank by falling mean within each metric, through range-spread positions."""
    keyed = means.withColumn("_down", -F.col("mean_score"))
    tied = keyed.groupBy("metric", "_down").agg(F.count("*").alias("_c"))
    ranked = with_running_sum(tied, ["_down"], "_c", ["metric"], "_upto")
    ranked = ranked.select("metric", "_down", (F.col("_upto") - F.col("_c") + 1).cast("int").alias("rank"))
    return keyed.join(ranked, ["metric", "_down"]).drop("_down")


def split_columns(log: DataFrame, split_ids: Sequence[int], score: str = "test_score") -> DataFrame:
    """One column ``split<i>_<score>`` per split."""
    wide = log.groupBy("metric", "candidate_id").pivot("split_id", list(split_ids)).agg(F.first(score))
    return wide.select("metric", "candidate_id", *[F.col(str(s)).alias(f"split{s}_{score}") for s in split_ids])


def time_summary(log: DataFrame) -> DataFrame:
    """Mean and deviation of fit and score times per candidate."""
    once = log.groupBy("candidate_id", "split_id").agg(F.max("fit_s").alias("fit_s"), F.max("score_s").alias("score_s"))
    return once.groupBy("candidate_id").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("fit_s", "score_s") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def best_candidate(summary: DataFrame) -> DataFrame:
    """The first candidate of rank 1 for each metric."""
    return summary.groupBy("metric").agg(
        F.min_by("candidate_id", F.struct("rank", "candidate_id")).alias("candidate_id"),
        F.min_by("mean_score", F.struct("rank", "candidate_id")).alias("best_score"),
    )


class GridSearch:
    """Search a grid on given splits, then fit the best candidate on all rows."""

    def __init__(self, spec, grids, metrics=None, refit=None, iid=True, error_score=None, parallelism=8):
        self.spec, self.grids, self.iid = spec, grids, iid
        self.metrics = metrics or DEFAULT_METRICS
        self.refit = check_refit(self.metrics, refit)
        self.error_score, self.parallelism = error_score, parallelism

    def fit(self, rows: DataFrame, split_ids: Sequence[int], all_rows: DataFrame) -> GridSearch:
        listed = candidate_list(self.grids)
        self.log = fit_and_score(
            self.spec, listed, rows, split_ids, self.metrics,
            error_score=self.error_score, parallelism=self.parallelism,
        )
        self.summary = search_summary(self.log, self.iid)
        best = best_candidate(self.summary).where(F.col("metric") == self.refit).first()
        self.best_params, self.best_score = listed[best["candidate_id"]], best["best_score"]
        self.best_spec = self.spec.with_params(**self.best_params)
        self.best_model = self.best_spec.fit(all_rows)
        return self


@dataclass(frozen=True)
class TunedSpec:
    """A spec whose fit is a search over stratified folds of the rows it is given.

    It stands wherever a spec does, so tuned models select genes and count participation.
    """

    spec: object
    grids: object
    n_splits: int = 5
    seed: int = 0
    metrics: object = None
    refit: str | None = None

    def with_params(self, **params) -> TunedSpec:
        return replace(self, spec=self.spec.with_params(**params))

    def fit(self, rows: DataFrame, n: int | None = None):
        plain = cut(rows.select("sample_id", "features", "label"), "tuned")
        folds = stratified_k_fold(plain.select("sample_id", "label"), "label", self.n_splits, seed=self.seed)
        inner = attach_splits(plain, folds)
        return GridSearch(self.spec, self.grids, self.metrics, self.refit).fit(inner, range(self.n_splits), plain).best_model


# -- G7, G8 -----------------------------------------------------------------------------


def merge_best(best: DataFrame) -> DataFrame:
    """Best parameters of several grids ``(step, name, value)``: the later grid wins."""
    return best.groupBy("name").agg(F.max_by("value", "step").alias("value"))


def sequential_search(
    spec, grids: Sequence[Mapping], rows: DataFrame, split_ids: Sequence[int], all_rows: DataFrame,
    carry_over: bool = False, **options,
):
    """Grids one after the other; parameters are merged and the last grid gives the score.

    Each grid starts from the given spec, or from the best so far with ``carry_over``.
    """
    merged: dict = {}
    for grid in grids:
        start = spec.with_params(**merged) if carry_over else spec
        found = GridSearch(start, grid, **options).fit(rows, split_ids, all_rows)
        merged.update(found.best_params)
    return merged, found.best_score, spec.with_params(**merged).fit(all_rows)


class SequentialSearch:
    """:func:`sequential_search` in the form of :class:`GridSearch`; ``grids`` is the list of grids."""

    def __init__(self, spec, grids, metrics=None, refit=None, carry_over: bool = False, **options):
        self.spec, self.grids, self.carry_over = spec, grids, carry_over
        self.metrics = metrics or DEFAULT_METRICS
        self.refit, self.options = check_refit(self.metrics, refit), options

    def fit(self, rows: DataFrame, split_ids: Sequence[int], all_rows: DataFrame) -> SequentialSearch:
        self.best_params, self.best_score, self.best_model = sequential_search(
            self.spec, self.grids, rows, split_ids, all_rows, self.carry_over, metrics=self.metrics, refit=self.refit, **self.options
        )
        return self


def interval_step(chosen: DataFrame, intervals: DataFrame, p_aug: float = 0.3) -> DataFrame:
    """One round of interval updates.

    ``chosen(name, split_id, value)`` are the values picked per split; ``intervals(name, lo,
    hi, lo_limit, hi_limit, grid_lo, grid_hi, scale)`` the present ends, in log10 units for
    ``scale='log'``.  A smallest value inside the range pulls the lower end to it; on the
    edge in more than ``p_aug`` of the splits it pushes the end toward its limit in
    proportion; otherwise that end is settled.  The upper end works the same way.
    """
    # combined per value first, so the splits of one parameter never meet in one task
    values = chosen.groupBy("name", "value").agg(F.count("*").alias("c"))
    seen = values.groupBy("name").agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        (F.min_by("c", "value") / F.sum("c")).alias("share_min"),
        (F.max_by("c", "value") / F.sum("c")).alias("share_max"),
    )
    rows = intervals.join(seen, "name")
    log = F.col("scale") == "log"

    def in_units(v: Column) -> Column:
        return F.when(log, F.log10(v)).otherwise(v)

    inside_lo, inside_hi = F.col("min_value") > F.col("grid_lo"), F.col("max_value") < F.col("grid_hi")
    low = (
        F.when(inside_lo, in_units(F.col("min_value")))
        .when(F.col("share_min") > p_aug, F.col("lo") - F.abs(F.col("share_min") * (F.col("lo") - F.col("lo_limit"))))
        .otherwise(F.col("lo"))
    )
    high = (
        F.when(inside_hi, in_units(F.col("max_value")))
        .when(F.col("share_max") > p_aug, F.col("hi") + F.abs(F.col("share_max") * (F.col("hi_limit") - F.col("hi"))))
        .otherwise(F.col("hi"))
    )
    settled = ~inside_lo & (F.col("share_min") <= p_aug) & ~inside_hi & (F.col("share_max") <= p_aug)
    return rows.select(
        "name", F.least(low, high).alias("lo"), F.greatest(low, high).alias("hi"), settled.alias("settled")
    )


def interval_values(lo: float, hi: float, n: int, scale: str) -> list[float]:
    """Evenly spaced values, in log10 units for ``scale='log'``."""
    steps = [lo + (hi - lo) * k / (n - 1) for k in range(n)] if n > 1 else [lo]
    return [10.0**s for s in steps] if scale == "log" else steps


def adaptive_search(spec, intervals: Mapping[str, dict], pick, n_rounds: int = 5, p_aug: float = 0.3) -> dict:
    """Repeat: make the grid, let ``pick(grid)`` choose values per split, update the ends.

    ``intervals[name]`` has ``lo, hi, lo_limit, hi_limit, n, scale``; ``pick`` returns rows
    ``(name, split_id, value)``.  Stops when every end is settled.
    """
    state = {k: dict(v) for k, v in intervals.items()}
    for _ in range(n_rounds):
        grid = {k: interval_values(v["lo"], v["hi"], v["n"], v["scale"]) for k, v in state.items()}
        chosen = pick(grid)
        table = chosen.sparkSession.createDataFrame(
            [
                (k, *(float(v[c]) for c in ("lo", "hi", "lo_limit", "hi_limit")), min(grid[k]), max(grid[k]), v["scale"])
                for k, v in state.items()
            ],
            "name string, lo double, hi double, lo_limit double, hi_limit double, grid_lo double, grid_hi double, scale string",
        )
        settled = True
        for r in interval_step(chosen, table, p_aug).collect():  # one row per parameter
            state[r["name"]].update(lo=r["lo"], hi=r["hi"])
            settled &= r["settled"]
        if settled:
            break
    return state


# -- G10..G12, G17 ----------------------------------------------------------------------


def cross_validate(spec, rows: DataFrame, split_ids: Sequence[int], metrics=None, train_scores=False, **options) -> DataFrame:
    """Scores and times of one model on every split."""
    log = fit_and_score(spec, [{}], rows, split_ids, metrics, train_scores, **options)
    return log.drop("candidate_id", "params")


def cross_val_score(spec, rows: DataFrame, split_ids: Sequence[int], metric: M.Metric, **options) -> DataFrame:
    return cross_validate(spec, rows, split_ids, {"score": metric}, **options).select("split_id", "test_score")


def check_partition(test_side: DataFrame, samples: DataFrame) -> DataFrame:
    """Whether every sample is tested exactly once: ``(n_samples, n_tests, n_tested, exact)``."""
    tested = test_side.groupBy("sample_id").agg(F.count("*").alias("n"))
    both = samples.select("sample_id").join(tested, "sample_id", "full")
    return both.agg(
        F.count("*").alias("n_samples"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tests"),
        F.count("n").alias("n_tested"),
    ).withColumn("exact", (F.col("n_tests") == F.col("n_samples")) & (F.col("n_tested") == F.col("n_samples")))


def cross_val_predict(spec, rows: DataFrame, split_ids: Sequence[int]) -> DataFrame:
    """Out-of-fold class, probability, log probability and decision value of every sample."""
    split_ids = [int(s) for s in split_ids]
    listed = F.array(*[F.lit(s) for s in split_ids])
    tests = F.size(F.array_intersect("test_in", listed))
    if rows.where(F.col("test_in").isNull() | (tests != 1)).limit(1).count():
        raise ValueError("every sample has to be tested exactly once")
    parts = []
    for split in split_ids:
        train, test = sides(rows, split)
        parts.append(predictions_of(spec.fit(train), test.withColumn("split_id", F.lit(split))))
    return cut(reduce(DataFrame.unionByName, parts), "predictions")


def predictions_of(fitted, rows: DataFrame) -> DataFrame:
    """Class, probabilities, log probabilities and decision value of a fitted model."""
    kept = [c for c in rows.columns if c != "features"]
    scored = fitted.transform(rows)
    return scored.select(
        *kept, "prediction", "p1", "decision", F.log(1 - F.col("p1")).alias("log_p0"), F.log("p1").alias("log_p1")
    )


# -- G13 --------------------------------------------------------------------------------


def permuted_labels(labels: DataFrame, n_permutations: int, seed: int, group: str | None = None) -> DataFrame:
    """``(permutation, sample_id, y)``: labels dealt out in hash order, within groups if given."""
    groups = [group] if group else []
    slots = with_row_index(labels, ["sample_id"], groups=groups, name="_ix")
    slots = slots.select("sample_id", *groups, "_ix").withColumn(
        "permutation", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))
    )
    dealt = labels.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    dealt = with_shuffled_index(dealt, "sample_id", seed, "permutation", groups, "_ix")
    dealt = dealt.select("permutation", *groups, "_ix", "y")
    return slots.join(dealt, ["permutation", *groups, "_ix"]).select("permutation", "sample_id", *groups, "y")


def permutation_p_value(scores: DataFrame, true_score: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """(number of permuted scores at least as good + 1) / (number of permutations + 1)."""
    better = F.sum((F.col("score") >= true_score).cast("long"))
    return scores.groupBy(*by).agg(((better + 1) / (F.count("*") + 1)).alias("p_value"))


def permutation_test(
    spec, rows: DataFrame, split_ids: Sequence[int], labels: DataFrame, metric: M.Metric,
    n_permutations: int = 100, seed: int = 0, group: str | None = None,
) -> tuple[float, list[float], float]:
    """Mean score with the true labels, the permuted scores, and the p value."""

    if isinstance(spec, LogisticSpec):
        scored = _permuted_at_once(spec.checked(), rows, [int(s) for s in split_ids], labels, metric, n_permutations, seed, group)
        true_score, permuted = scored[0], scored[1:]
    else:
        true_score, permuted = _permuted_one_by_one(spec, rows, split_ids, labels, metric, n_permutations, seed, group)
    p = (sum(s >= true_score for s in permuted) + 1) / (n_permutations + 1)
    return true_score, permuted, p


def _permuted_at_once(spec, rows, split_ids, labels, metric, n_permutations, seed, group) -> list[float]:
    """Mean score with the true labels, then with each permutation: labels are an array per row, all fits share the passes."""
    dealt = permuted_labels(labels, n_permutations, seed, group).groupBy(F.col("sample_id").alias("_id"))
    dealt = dealt.agg(F.array_sort(F.collect_list(F.struct("permutation", F.col("y").cast("double").alias("y")))).alias("_dealt"))
    every = F.concat(F.array(F.col("label").cast("double")), F.transform("_dealt", lambda d: d["y"]))
    held = rows.join(dealt, F.col("sample_id") == F.col("_id")).withColumn("_labels", every)
    design = batch.pack(held, split_ids, labels="_labels")
    fits = [batch.Fit(spec, s, labels=k) for k in range(n_permutations + 1) for s in split_ids]
    found = [s[False]["score"] for s in batch.scores(design, fits, batch.solve(design, fits), {"score": metric})]
    design.drop()
    return [sum(found[at : at + len(split_ids)]) / len(split_ids) for at in range(0, len(found), len(split_ids))]


def _permuted_one_by_one(spec, rows, split_ids, labels, metric, n_permutations, seed, group) -> tuple[float, list[float]]:
    def mean_score(data: DataFrame) -> float:
        return cross_val_score(spec, data, split_ids, metric).agg(F.avg("test_score")).first()[0]

    true_score = mean_score(rows)
    shuffled = cut(permuted_labels(labels, n_permutations, seed, group), "permuted")
    permuted = []
    for k in range(n_permutations):
        one = shuffled.where(F.col("permutation") == k).select("sample_id", F.col("y").cast("double").alias("label"))
        permuted.append(mean_score(cut(rows.drop("label").join(one, "sample_id"), "dealt")))
    return true_score, permuted


# -- G14..G16 ---------------------------------------------------------------------------


def train_size_list(sizes: Sequence[float | int], n_max: int) -> list[int]:
    """Absolute, rising and distinct train sizes from shares in (0, 1] or numbers."""
    if any(isinstance(s, float) for s in sizes):
        if min(sizes) <= 0 or max(sizes) > 1:
            raise ValueError("shares of the training set lie within (0, 1]")
        sizes = [min(max(int(s * n_max), 1), n_max) for s in sizes]
    elif min(sizes) <= 0 or max(sizes) > n_max:
        raise ValueError(f"train sizes lie within (0, {n_max}]")
    return sorted(set(sizes))


def train_subsets(folds: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """For every size the first train rows of each split, and all of its test rows.

    ``(split_id, train_size, sample_id, is_train)``; one index per split serves all sizes.
    """
    listed = F.array(*[F.lit(int(s)).cast("long") for s in sizes])
    train = with_row_index(folds.where("is_train"), ["sample_id"], groups=["split_id"], name="_ix")
    train = train.withColumn("train_size", F.explode(F.filter(listed, lambda s: F.col("_ix") < s))).drop("_ix")
    test = folds.where("not is_train").withColumn("train_size", F.explode(listed))
    return train.unionByName(test).select("split_id", "train_size", "sample_id", "is_train")


def learning_curve(
    spec, rows: DataFrame, split_ids: Sequence[int], sizes: Sequence[float | int], metric: M.Metric
) -> DataFrame:
    """Train and test score per training size and split."""
    split_ids = [int(s) for s in split_ids]
    listed = train_size_list(sizes, min(n for n, _ in side_sizes(rows, split_ids).values()))
    every = rows.select("sample_id", "test_in", "train_in").withColumn(
        "split_id", F.explode(F.array(*[F.lit(s) for s in split_ids]))
    )
    folds = every.select("sample_id", "split_id", is_train_in(F.col("split_id")).alias("is_train")).where("is_train is not null")
    if isinstance(spec, LogisticSpec):
        return _curve_at_once(spec.checked(), rows, split_ids, listed, folds, metric)
    subsets = cut(train_subsets(folds, listed), "subsets")
    logs = []
    for size in listed:
        part = cut(attach_sides(rows.drop("test_in", "train_in"), subsets.where(F.col("train_size") == size)), "part")
        log = fit_and_score(spec, [{}], part, split_ids, {"score": metric}, train_scores=True)
        logs.append(log.select(F.lit(size).alias("train_size"), "split_id", "train_score", "test_score"))
    return reduce(DataFrame.unionByName, logs)


def _curve_at_once(spec, rows, split_ids, listed, folds, metric) -> DataFrame:
    """One design for all sizes: a fit reads the train rows whose place in their split is below its size."""
    train = with_row_index(folds.where("is_train"), ["sample_id"], groups=["split_id"], name="_ix")
    places = train.groupBy(F.col("sample_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("split_id").cast("int"), "_ix"))).alias("_places"))
    design = batch.pack(rows.join(places, F.col("sample_id") == F.col("_id"), "left"), split_ids, places="_places")
    fits = [batch.Fit(spec, split, size=size) for size in listed for split in split_ids]
    found = batch.scores(design, fits, batch.solve(design, fits), {"score": metric}, train=True)
    design.drop()
    lines = [(f.size, f.split, s[True]["score"], s[False]["score"]) for f, s in zip(fits, found)]
    return rows.sparkSession.createDataFrame(lines, "train_size int, split_id int, train_score double, test_score double")


def validation_curve(
    spec, name: str, values: Sequence, rows: DataFrame, split_ids: Sequence[int], metric: M.Metric
) -> DataFrame:
    """Train and test score per value of one parameter and split."""
    log = fit_and_score(spec, [{name: v} for v in values], rows, split_ids, {"score": metric}, train_scores=True)
    return log.select(F.col("params")[name].alias("value"), "split_id", "train_score", "test_score")


def aggregate_scores(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Score rows ``(place, metric, score)`` as one column per metric, a row per fit."""
    return scores.groupBy("place").pivot("metric", list(metrics)).agg(F.first("score"))
