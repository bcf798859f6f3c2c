"""Assigning samples to training and test sets.

Splitters return the test side, ``(sample_id, split_id)``, one row per test sample; the
train side is the complement and is spelled out by :func:`with_train_side` only when a
caller needs it.  Draws are ordered by a hash of seed, repeat and id, so they are
repeatable and every engine can check them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, comb, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.functions.joins import join_by_key
from riskloom.functions.rowindex import shuffle_key, with_row_index, with_shuffled_index
from riskloom.runtime import cut

ID = "sample_id"


def fold_of(ix: Column, n: Column | int, k: int) -> Column:
    """Contiguous blocks: the first ``n % k`` folds hold one row more."""
    n = n if isinstance(n, Column) else F.lit(n)
    size, extra = F.floor(n / k), n % k
    edge = extra * (size + 1)
    rest = extra + F.floor((ix - edge) / F.greatest(size, F.lit(1)))
    return F.when(ix < edge, F.floor(ix / (size + 1))).otherwise(rest).cast("int")


def _repeats(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _check_k(n_splits: int, n: int) -> None:
    if n_splits < 2:
        raise ValueError("at least 2 folds are needed")
    if n_splits > n:
        raise ValueError(f"cannot have {n_splits} folds from {n} samples")


def sample_sizes(n: int, test_size: float | int | None, train_size: float | int | None, default: float) -> tuple[int, int]:
    """Numbers of (train, test) rows: fractions round up for test, down for train."""
    if test_size is None and train_size is None:
        test_size = default
    for name, size in (("test_size", test_size), ("train_size", train_size)):
        if size is None:
            continue
        if isinstance(size, float) and not 0 < size < 1:
            raise ValueError(f"{name} as a share lies between 0 and 1")
        if isinstance(size, int) and not 0 < size < n:
            raise ValueError(f"{name} as a number lies between 0 and {n}")
    if isinstance(test_size, float) and isinstance(train_size, float) and test_size + train_size > 1:
        raise ValueError("train and test shares exceed the whole")
    n_test = ceil(test_size * n) if isinstance(test_size, float) else test_size
    n_train = floor(train_size * n) if isinstance(train_size, float) else train_size
    n_train = n - n_test if n_train is None else n_train
    n_test = n - n_train if n_test is None else n_test
    if n_train + n_test > n:
        raise ValueError("train and test sizes exceed the number of samples")
    return n_train, n_test


# -- E1..E4 -----------------------------------------------------------------------------


def k_fold(samples: DataFrame, n_splits: int, seed: int | None = None, order: Sequence[str] = (ID,)) -> DataFrame:
    """Every sample in exactly one test fold; with a seed the order is a hash order."""
    _check_k(n_splits, samples.count())
    if seed is None:
        rows = with_row_index(samples, order, name="_ix", count="_n")
        return rows.withColumn("split_id", fold_of(F.col("_ix"), F.col("_n"), n_splits)).drop("_ix", "_n")
    return repeated_k_fold(samples, n_splits, 1, seed)


def repeated_k_fold(samples: DataFrame, n_splits: int, n_repeats: int, seed: int) -> DataFrame:
    """``n_repeats`` shuffles: split ``r * n_splits + f`` tests fold f of repeat r."""
    rows = with_shuffled_index(_repeats(samples, n_repeats), ID, seed, "_repeat", name="_ix", count="_n")
    fold = fold_of(F.col("_ix"), F.col("_n"), n_splits)
    return rows.withColumn("split_id", F.col("_repeat") * n_splits + fold).drop("_repeat", "_ix", "_n")


def check_classes(samples: DataFrame, label: str, n_splits: int) -> bool:
    """Refuse when every class is smaller than the number of folds; tell if the least one is."""
    sizes = samples.groupBy(label).agg(F.count("*").alias("n"))
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    if n_splits > most:
        raise ValueError(f"no class has {n_splits} members")
    return n_splits > least


def stratified_k_fold(
    samples: DataFrame, label: str, n_splits: int, seed: int | None = None, order: Sequence[str] = (ID,)
) -> DataFrame:
    """K folds inside every class, so that the class shares carry over to the folds."""
    check_classes(samples, label, n_splits)
    if seed is None:
        rows = with_row_index(samples, order, groups=[label], name="_ix", count="_n")
        return rows.withColumn("split_id", fold_of(F.col("_ix"), F.col("_n"), n_splits)).drop("_ix", "_n")
    return repeated_stratified_k_fold(samples, label, n_splits, 1, seed, checked=True)


def repeated_stratified_k_fold(
    samples: DataFrame, label: str, n_splits: int, n_repeats: int, seed: int, checked: bool = False
) -> DataFrame:
    if not checked:
        check_classes(samples, label, n_splits)
    rows = with_shuffled_index(_repeats(samples, n_repeats), ID, seed, "_repeat", [label], "_ix", "_n")
    fold = fold_of(F.col("_ix"), F.col("_n"), n_splits)
    return rows.withColumn("split_id", F.col("_repeat") * n_splits + fold).drop("_repeat", "_ix", "_n")


# -- E5 ---------------------------------------------------------------------------------


def _water_fill(loads: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Give ``rank`` groups of equal ``size`` to the lightest fold, one after the other.

    ``loads`` is (rows, folds).  Returns how many groups each fold takes, and the fold of
    the next group.  A fold's j-th group arrives at level load + j*size, so the answer is a
    binary search for the level reached by ``rank`` groups.
    """
    size, rank = size[:, None], rank[:, None]

    def taken(level: np.ndarray) -> np.ndarray:
        return np.maximum(0, -((loads - level[:, None]) // size))

    low = loads.min(axis=1)
    high = low + (rank[:, 0] + 1) * size[:, 0]
    while np.any(high - low > 1):
        middle = (low + high) // 2
        fits = taken(middle).sum(axis=1) <= rank[:, 0]
        low, high = np.where(fits, middle, low), np.where(fits, high, middle)
    counts = taken(low)
    left = rank[:, 0] - counts.sum(axis=1)
    at_level = loads + counts * size == low[:, None]
    place = np.cumsum(at_level, axis=1) - 1
    extra = at_level & (place < left[:, None])
    following = np.argmax(at_level & (place == left[:, None]), axis=1)
    return counts + extra, following


def group_k_fold(samples: DataFrame, group: str, n_splits: int) -> DataFrame:
    """Groups by falling size, each to the lightest fold so far; the larger code first on ties.

    Groups of equal size are interchangeable, so the pass over folds needs only the
    histogram of group sizes.  n rows have at most sqrt(2n) different sizes, which bounds
    what the driver holds; each group then works out its own fold from its rank.
    """
    sizes = cut(samples.groupBy(group).agg(F.count("*").alias("size")), "sizes")
    histogram = sizes.groupBy("size").agg(F.count("*").alias("m")).orderBy(F.desc("size")).collect()
    if n_splits < 2 or sum(r["m"] for r in histogram) < n_splits:
        raise ValueError("the number of folds lies between 2 and the number of groups")
    loads, before = np.zeros((1, n_splits), dtype=np.int64), []
    for size, m in histogram:
        before.append((size, loads[0].tolist()))
        counts, _ = _water_fill(loads, np.array([size]), np.array([m]))
        loads = loads + counts * size
    table = samples.sparkSession.createDataFrame(before, "size long, loads array<long>")
    ranked = with_row_index(sizes, [F.desc(group)], groups=["size"], name="rank")

    @F.pandas_udf("int")
    def fold(loads: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(loads):
            return pd.Series([], dtype="int32")
        filled = _water_fill(np.stack(loads.to_numpy()), size.to_numpy(), rank.to_numpy())
        return pd.Series(filled[1])

    folds = ranked.join(table, "size").select(
        group, "size", fold("loads", "size", "rank").alias("split_id")
    )
    return join_by_key(samples, folds, [group], "size").select(*samples.columns, "split_id")


# -- E6..E10 ----------------------------------------------------------------------------


def time_series_split(
    samples: DataFrame, n_splits: int, order: Sequence[str], max_train_size: int | None = None
) -> DataFrame:
    """Past rows train, the next block tests: ``(sample_id, split_id, is_train)``."""
    n = samples.count()
    if n_splits + 1 > n:
        raise ValueError(f"cannot have {n_splits + 1} folds from {n} samples")
    size = n // (n_splits + 1)
    first = size + n % (n_splits + 1)
    rows = with_row_index(samples, order, name="_ix")
    rows = rows.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.lit(first) + F.col("split_id") * size
    train = F.col("_ix") < start
    if max_train_size:
        train = train & (F.col("_ix") >= start - max_train_size)
    test = (F.col("_ix") >= start) & (F.col("_ix") < start + size)
    return rows.where(train | test).withColumn("is_train", train).drop("_ix")


def leave_one_out(samples: DataFrame, order: Sequence[str] = (ID,)) -> DataFrame:
    """Every sample is its own test set; train sides come from :func:`with_train_side`."""
    return with_row_index(samples, order, name="split_id")


def _combinations(split: Column, n: int, p: int) -> Column:
    """Members (rising) of the combination at a lexicographic place among C(n, p)."""
    total = comb(n, p)

    @F.pandas_udf("array<long>")
    def members(place: pd.Series) -> pd.Series:
        out = []
        for s in place:
            if not 0 <= s < total:
                raise ValueError(f"split {s} is none of {total}")
            left, chosen = total - 1 - int(s), []
            for i in range(p, 0, -1):
                low, high = i - 1, n
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if comb(middle, i) <= left else (low, middle)
                chosen.append(n - 1 - low)
                left -= comb(low, i)
            out.append(chosen)
        return pd.Series(out)

    return members(split)


def every_combination(spark: SparkSession, n: int, p: int) -> DataFrame:
    """``split_id``: the numbers of all C(n, p) test sets of p out of n samples or groups."""
    return spark.range(comb(n, p)).withColumnRenamed("id", "split_id")


def _chosen_splits(n: int, p: int, splits: DataFrame) -> DataFrame:
    if comb(n, p) >= 1 << 62:
        raise ValueError("too many combinations to number")
    return splits.select("split_id").select("split_id", F.explode(_combinations(F.col("split_id"), n, p)).alias("_ix"))


def leave_p_out(samples: DataFrame, p: int, splits: DataFrame, order: Sequence[str] = (ID,)) -> DataFrame:
    """Test sets of size p, numbered in lexicographic order.

    There are C(n, p) of them.  ``splits`` names the wanted numbers (``every_combination`` for
    all); a number is turned into its members by arithmetic, so the cost follows the request
    and not n to the p.  A number outside the range is an error.
    """
    n = samples.count()
    if not 0 < p < n:
        raise ValueError("p lies between 1 and the number of samples minus 1")
    wanted = _chosen_splits(n, p, splits)
    return with_row_index(samples, order, name="_ix").join(wanted, "_ix").drop("_ix")


def _group_index(samples: DataFrame, group: str) -> DataFrame:
    """``(group, _size, _ix)``: rows and dense place of every group."""
    return with_row_index(samples.groupBy(group).agg(F.count("*").alias("_size")), [group], name="_ix")


def leave_one_group_out(samples: DataFrame, group: str) -> DataFrame:
    """One test set per group."""
    index = _group_index(samples, group)
    if index.count() < 2:
        raise ValueError("at least 2 groups are needed")
    return join_by_key(samples, index.withColumnRenamed("_ix", "split_id"), [group], "_size").select(
        *samples.columns, "split_id"
    )


def leave_p_groups_out(samples: DataFrame, group: str, p: int, splits: DataFrame) -> DataFrame:
    """Test sets made of p groups, numbered in lexicographic order of the groups; ``splits`` as in :func:`leave_p_out`."""
    index = _group_index(samples, group)
    n = index.count()
    if n <= p:
        raise ValueError(f"leaving out {p} groups needs more than {p} groups, there are {n}")
    wanted = _chosen_splits(n, p, splits)
    return join_by_key(samples, index.join(wanted, "_ix").drop("_ix"), [group], "_size").select(
        *samples.columns, "split_id"
    )


# -- E11..E13 ---------------------------------------------------------------------------


def _drawn(rows: DataFrame, n_train: int, n_test: int, position: str) -> DataFrame:
    ix = F.col(position)
    return rows.where(ix < n_train + n_test).withColumn("is_train", ix >= n_test)


def shuffle_split(
    samples: DataFrame,
    n_splits: int,
    seed: int,
    test_size: float | int | None = None,
    train_size: float | int | None = None,
    ident: str = ID,
    default_test: float = 0.1,
) -> DataFrame:
    """Independent draws: the first rows in hash order test, the next ones train."""
    n_train, n_test = sample_sizes(samples.count(), test_size, train_size, default_test)
    rows = samples.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rows = with_shuffled_index(rows, ident, seed, "split_id", name="_ix")
    return _drawn(rows, n_train, n_test, "_ix").drop("_ix")


def group_shuffle_split(
    samples: DataFrame,
    group: str,
    n_splits: int,
    seed: int,
    test_size: float | int | None = None,
    train_size: float | int | None = None,
) -> DataFrame:
    """A shuffle split of the groups, carried to their samples."""
    groups = samples.groupBy(group).agg(F.count("*").alias("_size"))
    drawn = shuffle_split(groups, n_splits, seed, test_size, train_size, ident=group, default_test=0.2)
    return join_by_key(samples, drawn, [group], "_size").select(*samples.columns, "split_id", "is_train")


def draw_quota(sizes: DataFrame, n_draws: int, by: Sequence[str], label: str, size: str, seed: int, name: str) -> DataFrame:
    """Share ``n_draws`` among classes: floors first, then the largest remainders.

    ``sizes`` holds one row per class (and repeat); ties go by hash.
    """
    group = Window.partitionBy(*by)
    exact = F.lit(n_draws) * F.col(size) / F.sum(size).over(group)
    rows = sizes.withColumn("_floor", F.floor(exact).cast("long")).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    rows = rows.withColumn("_left", F.lit(n_draws) - F.sum("_floor").over(group))
    tie = shuffle_key(seed, by[0], label)
    place = F.row_number().over(group.orderBy(F.desc("_rest"), tie))
    # a class without any remainder takes nothing beyond its floor
    return rows.withColumn(name, F.col("_floor") + (place <= F.col("_left")).cast("long")).drop(
        "_floor", "_rest", "_left"
    )


def stratified_quotas(
    samples: DataFrame, label: str, n_splits: int, seed: int, n_train: int, n_test: int
) -> DataFrame:
    """``(split_id, label, n_class, train_quota, test_quota)``; train is served first."""
    sizes = samples.groupBy(label).agg(F.count("*").alias("n_class"))
    sizes = sizes.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rows = draw_quota(sizes, n_train, ["split_id"], label, "n_class", seed, "train_quota")
    rows = rows.withColumn("_left_over", F.col("n_class") - F.col("train_quota"))
    rows = draw_quota(rows, n_test, ["split_id"], label, "_left_over", seed + 1, "test_quota")
    return rows.drop("_left_over")


def stratified_shuffle_split(
    samples: DataFrame,
    label: str,
    n_splits: int,
    seed: int,
    test_size: float | int | None = None,
    train_size: float | int | None = None,
    default_test: float = 0.1,
) -> DataFrame:
    """Draws that keep the class shares in the train and in the test part."""
    sizes = samples.groupBy(label).agg(F.count("*").alias("n"))
    n, least, classes = sizes.agg(F.sum("n"), F.min("n"), F.count("*")).first()
    n_train, n_test = sample_sizes(n, test_size, train_size, default_test)
    if least < 2:
        raise ValueError("a class has a single member")
    if min(n_train, n_test) < classes:
        raise ValueError("train and test need at least one row per class")
    quotas = stratified_quotas(samples, label, n_splits, seed, n_train, n_test)
    rows = samples.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rows = with_shuffled_index(rows, ID, seed, "split_id", [label], name="_ix")
    rows = rows.join(quotas.drop("n_class"), ["split_id", label])
    ix = F.col("_ix")
    return (
        rows.where(ix < F.col("train_quota") + F.col("test_quota"))
        .withColumn("is_train", ix < F.col("train_quota"))
        .select(*samples.columns, "split_id", "is_train")
    )


# -- E14..E21 ---------------------------------------------------------------------------


def predefined_split(samples: DataFrame, fold: str) -> DataFrame:
    """Given fold numbers; -1 never tests.  Split ids are dense in the order of the numbers."""
    tested = samples.where(F.col(fold) != -1)
    numbers = _group_index(tested, fold).withColumnRenamed("_ix", "split_id")
    return join_by_key(tested, numbers, [fold], "_size").select(*samples.columns, "split_id")


def given_split(pairs: DataFrame) -> DataFrame:
    """A caller's own ``(sample_id, split_id, is_train)`` rows, checked for overlap."""
    both = pairs.groupBy(ID, "split_id").agg(F.count_distinct("is_train").alias("sides")).where("sides > 1")
    if not both.isEmpty():
        raise ValueError("a sample is on both sides of a split")
    return pairs.select(ID, "split_id", "is_train")


def train_test_split(
    samples: DataFrame,
    seed: int = 0,
    test_size: float | int | None = None,
    train_size: float | int | None = None,
    shuffle: bool = True,
    stratify: str | None = None,
    order: Sequence[str] = (ID,),
) -> DataFrame:
    """One split into train and test rows: adds ``is_train``."""
    if not shuffle:
        if stratify is not None:
            raise ValueError("a stratified split needs shuffling")
        n_train, n_test = sample_sizes(samples.count(), test_size, train_size, 0.25)
        rows = with_row_index(samples, order, name="_ix").where(F.col("_ix") < n_train + n_test)
        return rows.withColumn("is_train", F.col("_ix") < n_train).drop("_ix")
    if stratify is not None:
        return stratified_shuffle_split(samples, stratify, 1, seed, test_size, train_size, 0.25).drop("split_id")
    return shuffle_split(samples, 1, seed, test_size, train_size, default_test=0.25).drop("split_id")


def with_train_side(test_side: DataFrame, split_ids: Sequence[int], samples: DataFrame | None = None) -> DataFrame:
    """Long form ``(sample_id, split_id, is_train)`` of the named splits.

    A sample trains in every named split that does not test it.  ``samples`` lists all of
    them; without it they are those that some split tests.  The test splits of one sample
    are gathered first (a sample tests at most once per repeat), so the table is spread out
    by ``explode`` and no join over all pairs takes place.
    """
    own = test_side.groupBy(ID).agg(F.collect_set("split_id").alias("_own"))
    if samples is not None:
        own = samples.select(ID).join(own, ID, "left")
    listed = F.array(*[F.lit(int(s)).cast("long") for s in split_ids])
    rows = own.withColumn("split_id", F.explode(listed))
    tested = F.coalesce(F.array_contains(F.col("_own").cast("array<long>"), F.col("split_id")), F.lit(False))
    return rows.select(ID, "split_id", (~tested).alias("is_train"))


def attach_splits(rows: DataFrame, test_side: DataFrame) -> DataFrame:
    """Rows with ``test_in``, the splits that test them; every other split trains on them.

    Each row is kept once, however many splits there are.
    """
    own = test_side.groupBy(ID).agg(F.collect_set(F.col("split_id").cast("int")).alias("test_in"))
    nothing = F.lit(None).cast("array<int>")
    return rows.join(own, ID, "left").withColumn("train_in", nothing)


def attach_sides(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with ``test_in`` and ``train_in`` from a long assignment that may leave rows out."""
    split = F.col("split_id").cast("int")
    own = folds.groupBy(ID).agg(
        F.collect_set(F.when(~F.col("is_train"), split)).alias("test_in"),
        F.collect_set(F.when(F.col("is_train"), split)).alias("train_in"),
    )
    return rows.join(own, ID)


def is_train_in(split_id: int | Column) -> Column:
    """True on the train side of a split, false on its test side, null when unused."""
    tested = F.coalesce(F.array_contains("test_in", split_id), F.lit(False))
    trains = F.col("train_in").isNull() | F.array_contains("train_in", split_id)
    return F.when(tested, False).when(trains, True)


def sides(rows: DataFrame, split_id: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one split, without the split columns."""
    plain = rows.withColumn("_side", is_train_in(split_id)).drop("test_in", "train_in")
    return plain.where("_side").drop("_side"), plain.where("not _side").drop("_side")


def side_sizes(rows: DataFrame, split_ids: Sequence[int]) -> dict[int, tuple[int, int]]:
    """(train, test) row counts of every split in one pass."""
    cells = []
    for s in split_ids:
        side = is_train_in(s)
        cells += [F.sum(side.cast("long")).alias(f"a{s}"), F.sum((~side).cast("long")).alias(f"b{s}")]
    row = rows.agg(*cells).first()
    return {s: (row[f"a{s}"] or 0, row[f"b{s}"] or 0) for s in split_ids}


def store_folds(folds: DataFrame, path: str, fold_key: str) -> None:
    """Write an assignment under its configuration key."""
    folds.withColumn("fold_key", F.lit(fold_key)).write.mode("append").partitionBy("fold_key").parquet(path)


def read_folds(spark: SparkSession, path: str, fold_key: str) -> DataFrame:
    """Read the assignment of one configuration; other keys are not scanned."""
    return spark.read.parquet(path).where(F.col("fold_key") == fold_key).drop("fold_key")


def one_split(folds: DataFrame, split_id: int) -> tuple[DataFrame, DataFrame]:
    """Train and test sample ids of one split of a long assignment."""
    rows = folds.where(F.col("split_id") == split_id)
    return rows.where("is_train").select(ID), rows.where("not is_train").select(ID)


def split_data(rows: DataFrame, folds: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Sample rows with ``split_id`` and ``is_train``, optionally for the chosen genes only."""
    if genes is not None:
        rows = rows.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    return rows.join(folds.select(ID, "split_id", "is_train"), ID)


def head_test(samples: DataFrame, n_test: int = 73, order: Sequence[str] = (ID,)) -> DataFrame:
    """The first ``n_test`` rows test, the others train."""
    rows = with_row_index(samples, order, name="_ix")
    return rows.withColumn("is_train", F.col("_ix") >= n_test).drop("_ix")
