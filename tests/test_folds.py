"""Golden examples and errors of the splitters."""

from math import comb

import numpy as np
import pytest

from riskloom.operators import folds as E


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(range(len(columns[names[0]])), *columns.values()))
    return spark.createDataFrame(rows, ["sample_id", *names])


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "sample_id")


def test_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["split_id"], set()).add(r["sample_id"])
    return [out[k] for k in sorted(out)]


test_sets.__test__ = False


def test_k_fold(spark):
    assert test_sets(E.k_fold(ids(spark, 4), 2)) == [{0, 1}, {2, 3}]
    assert [len(s) for s in test_sets(E.k_fold(ids(spark, 11), 3))] == [4, 4, 3]


@pytest.mark.parametrize("k", [1, 6])
def test_k_fold_refuses(spark, k):
    with pytest.raises(ValueError):
        E.k_fold(ids(spark, 5), k)


def test_stratified(spark):
    assert test_sets(E.stratified_k_fold(frame(spark, y=[0, 0, 1, 1]), "y", 2)) == [{0, 2}, {1, 3}]


def test_stratified_small_class(spark):
    rows = frame(spark, y=[0, 0, 0, 0, 1])
    assert E.check_classes(rows, "y", 3) is True
    with pytest.raises(ValueError):
        E.stratified_k_fold(rows, "y", 5)


def test_repeats_cover_every_sample(spark):
    rows = E.repeated_k_fold(ids(spark, 23), 4, 3, seed=3).toPandas()
    for r in range(3):
        part = rows[rows.split_id // 4 == r]
        assert sorted(part.sample_id) == list(range(23))
        assert sorted(part.groupby("split_id").size()) == [5, 6, 6, 6]


def test_group_k_fold(spark):
    assert test_sets(E.group_k_fold(frame(spark, g=[0, 0, 2, 2]), "g", 2)) == [{2, 3}, {0, 1}]


def test_group_k_fold_equals_greedy(spark):
    rng = np.random.default_rng(0)
    sizes = list(rng.integers(1, 9, 60)) + [70, 33]  # one hot group, many equal sizes
    groups = [g for g, s in enumerate(sizes) for _ in range(s)]
    got = E.group_k_fold(frame(spark, g=groups), "g", 5).select("g", "split_id").distinct().toPandas()
    loads, want = [0] * 5, {}
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], -g)):
        f = loads.index(min(loads))
        loads[f] += sizes[g]
        want[g] = f
    assert dict(zip(got.g, got.split_id)) == want


def test_time_series(spark):
    rows = E.time_series_split(ids(spark, 6), 5, ["sample_id"]).toPandas()
    for s in range(5):
        part = rows[rows.split_id == s]
        assert set(part[~part.is_train].sample_id) == {s + 1}
        assert set(part[part.is_train].sample_id) == set(range(s + 1))


def test_leave_out(spark):
    assert test_sets(E.leave_one_out(ids(spark, 2))) == [{0}, {1}]
    assert test_sets(E.leave_p_out(ids(spark, 4), 2, E.every_combination(spark, 4, 2))) == [{0, 1}, {0, 2}, {0, 3}, {1, 2}, {1, 3}, {2, 3}]
    assert [sorted(s) for s in test_sets(E.leave_p_out(ids(spark, 5), 3, E.every_combination(spark, 5, 3)))][:3] == [[0, 1, 2], [0, 1, 3], [0, 1, 4]]
    assert test_sets(E.leave_p_out(ids(spark, 2000), 3, spark.createDataFrame([(0,), (comb(2000, 3) - 1,)], "split_id long"))) == [{0, 1, 2}, {1997, 1998, 1999}]
    with pytest.raises(Exception, match="is none of"):
        E.leave_p_out(ids(spark, 4), 2, spark.createDataFrame([(6,)], "split_id long")).collect()


def test_leave_groups_out(spark):
    assert test_sets(E.leave_one_group_out(frame(spark, g=[1, 1, 2, 2]), "g")) == [{0, 1}, {2, 3}]
    assert test_sets(E.leave_p_groups_out(frame(spark, g=[1, 2, 3]), "g", 2, E.every_combination(spark, 3, 2))) == [{0, 1}, {0, 2}, {1, 2}]
    with pytest.raises(ValueError):
        E.leave_one_group_out(frame(spark, g=[1, 1]), "g")
    with pytest.raises(ValueError):
        E.leave_p_groups_out(frame(spark, g=[1, 2]), "g", 2, E.every_combination(spark, 2, 2))


def test_shuffle_split_sizes(spark):
    rows = E.shuffle_split(ids(spark, 11), 3, 1, test_size=0.25, train_size=0.5).toPandas()
    counts = rows.groupby(["split_id", "is_train"]).size().unstack()
    assert set(counts[False]) == {3} and set(counts[True]) == {5}
    assert not rows.duplicated(["split_id", "sample_id"]).any()


@pytest.mark.parametrize("sizes", [(1.5, None), (11, None), (0.6, 0.6), (6, 6)])
def test_sizes_refused(sizes):
    with pytest.raises(ValueError):
        E.sample_sizes(11, *sizes, default=0.1)


@pytest.mark.parametrize("counts,draws,want", [((4, 2), 3, [2, 1]), ((5, 2), 4, [3, 1])])
def test_quota(spark, counts, draws, want):
    sizes = spark.createDataFrame([(0, k, c) for k, c in enumerate(counts)], "split_id int, y int, n long")
    got = E.draw_quota(sizes, draws, ["split_id"], "y", "n", 0, "q").orderBy("y")
    assert [r["q"] for r in got.collect()] == want


def test_stratified_shuffle_refuses_single_member(spark):
    with pytest.raises(ValueError):
        E.stratified_shuffle_split(frame(spark, y=[0] * 9 + [1]), "y", 1, 0, 0.5)


def test_predefined(spark):
    assert test_sets(E.predefined_split(frame(spark, f=[0, 1, -1, 1]), "f")) == [{0}, {1, 3}]


def test_given_split_refuses_overlap(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 0, False)], "sample_id int, split_id int, is_train boolean")
    with pytest.raises(ValueError):
        E.given_split(rows)


def test_train_test_split_in_order(spark):
    rows = E.train_test_split(ids(spark, 5), shuffle=False).toPandas()
    assert set(rows[rows.is_train].sample_id) == {0, 1, 2}
    with pytest.raises(ValueError):
        E.train_test_split(frame(spark, y=[0, 1]), shuffle=False, stratify="y")
    halves = E.train_test_split(frame(spark, y=[0] * 8 + [1] * 4), seed=1, test_size=0.5, stratify="y").toPandas()
    assert halves.groupby(["is_train", "y"]).size().tolist() == [4, 2, 4, 2]


def test_sides_without_copies(spark):
    rows = ids(spark, 10)
    kept = E.attach_splits(rows, E.repeated_k_fold(rows, 5, 2, 0))
    assert kept.count() == 10
    assert E.side_sizes(kept, range(10)) == {s: (8, 2) for s in range(10)}
    long = E.time_series_split(rows, 3, ["sample_id"], max_train_size=2)
    some = E.attach_sides(rows, long)
    assert E.side_sizes(some, range(3)) == {0: (2, 2), 1: (2, 2), 2: (2, 2)}
