"""Fold assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from riskloom.operators import folds as E
from riskloom.runtime import scratch_path

SEED = 7


def fold_sql(i: str, n: str, k: int) -> str:
    """Fold of the row at place i among n."""
    edge = f"(({n} % {k}) * ({n} // {k} + 1))"
    return (
        f"CASE WHEN {i} < {edge} THEN {i} // ({n} // {k} + 1) "
        f"ELSE {n} % {k} + ({i} - {edge}) // greatest({n} // {k}, 1) END"
    )


def draw(repeat: str, ident: str = "sample_id", seed: int = SEED) -> str:
    """The hash that orders a draw."""
    return f"md5(concat_ws(':', '{seed}', CAST({repeat} AS VARCHAR), CAST({ident} AS VARCHAR)))"


PEOPLE = "people AS (SELECT c_custkey AS sample_id, c_mktsegment AS y, c_nationkey AS grp FROM customer)"


def _people(t):
    return t.raw("customer").selectExpr("c_custkey AS sample_id", "c_mktsegment AS y", "c_nationkey AS grp")


@query("e01_k_fold", f"""
WITH ix AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i, count(*) OVER () AS n FROM orders_y)
SELECT sample_id, CAST({fold_sql('i', 'n', 7)} AS INTEGER) AS split_id FROM ix""", "orders_y")
def e01(t):
    """Contiguous folds in the order of the ids."""
    return E.k_fold(t.orders_y.select("sample_id"), 7)


@query("e01_k_fold_shuffled", f"""
WITH ix AS (SELECT sample_id, row_number() OVER (ORDER BY {draw('0')}) - 1 AS i, count(*) OVER () AS n FROM orders_y)
SELECT sample_id, CAST({fold_sql('i', 'n', 7)} AS INTEGER) AS split_id FROM ix""", "orders_y")
def e01s(t):
    return E.k_fold(t.orders_y.select("sample_id"), 7, seed=SEED)


@query("e02_stratified_k_fold", f"""
WITH ix AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM orders_y)
SELECT sample_id, y, CAST({fold_sql('i', 'n', 5)} AS INTEGER) AS split_id FROM ix""", "orders_y")
def e02(t):
    return E.stratified_k_fold(t.orders_y.select("sample_id", "y"), "y", 5)


@query("e03_repeated_k_fold", f"""
WITH ix AS (SELECT sample_id, r, row_number() OVER (PARTITION BY r ORDER BY {draw('r')}) - 1 AS i, count(*) OVER (PARTITION BY r) AS n
  FROM orders_y CROSS JOIN (SELECT unnest(range(3)) AS r) x)
SELECT sample_id, CAST(r * 5 + {fold_sql('i', 'n', 5)} AS INTEGER) AS split_id FROM ix""", "orders_y")
def e03(t):
    """Three shuffles of five folds."""
    return E.repeated_k_fold(t.orders_y.select("sample_id"), 5, 3, SEED)


@query("e04_repeated_stratified", f"""
WITH ix AS (SELECT sample_id, y, r, row_number() OVER (PARTITION BY r, y ORDER BY {draw('r')}) - 1 AS i, count(*) OVER (PARTITION BY r, y) AS n
  FROM orders_y CROSS JOIN (SELECT unnest(range(3)) AS r) x)
SELECT sample_id, y, CAST(r * 5 + {fold_sql('i', 'n', 5)} AS INTEGER) AS split_id FROM ix""", "orders_y")
def e04(t):
    return E.repeated_stratified_k_fold(t.orders_y.select("sample_id", "y"), "y", 5, 3, SEED)


@query("e05_group_k_fold", """
WITH RECURSIVE sizes AS (SELECT grp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, grp DESC) AS k FROM orders_y GROUP BY grp),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS fold, [CAST(0 AS BIGINT), 0, 0, 0] AS loads
  UNION ALL
  SELECT s.k, list_position(w.loads, list_min(w.loads)) - 1,
    list_transform(range(4), lambda f: w.loads[f + 1] + CASE WHEN f = list_position(w.loads, list_min(w.loads)) - 1 THEN s.size ELSE 0 END)
  FROM walk w JOIN sizes s ON s.k = w.k + 1)
SELECT o.sample_id, o.grp, CAST(w.fold AS INTEGER) AS split_id FROM orders_y o JOIN sizes s ON o.grp = s.grp JOIN walk w ON w.k = s.k""", "orders_y")
def e05(t):
    """Customers stay together; the largest go first, to the lightest fold."""
    return E.group_k_fold(t.orders_y.select("sample_id", "grp"), "grp", 4)


NULLED = "nulled AS (SELECT sample_id, CASE WHEN grp % 5 <> 0 THEN grp END AS grp FROM orders_y)"


def _nulled(t):
    """A fifth of the customers has no group: together they are one."""
    return t.orders_y.selectExpr("sample_id", "CASE WHEN grp % 5 <> 0 THEN grp END AS grp")


@query("e05_null_group", f"""
WITH RECURSIVE {NULLED}, sizes AS (SELECT grp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, grp DESC NULLS LAST) AS k FROM nulled GROUP BY grp),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS fold, [CAST(0 AS BIGINT), 0, 0, 0] AS loads
  UNION ALL
  SELECT s.k, list_position(w.loads, list_min(w.loads)) - 1,
    list_transform(range(4), lambda f: w.loads[f + 1] + CASE WHEN f = list_position(w.loads, list_min(w.loads)) - 1 THEN s.size ELSE 0 END)
  FROM walk w JOIN sizes s ON s.k = w.k + 1)
SELECT o.sample_id, o.grp, CAST(w.fold AS INTEGER) AS split_id FROM nulled o JOIN sizes s ON o.grp IS NOT DISTINCT FROM s.grp JOIN walk w ON w.k = s.k""", "orders_y")
def e05_null(t):
    return E.group_k_fold(_nulled(t), "grp", 4)


@query("e09_null_group", f"WITH {NULLED} SELECT sample_id, grp, dense_rank() OVER (ORDER BY grp NULLS FIRST) - 1 AS split_id FROM nulled", "orders_y")
def e09_null(t):
    return E.leave_one_group_out(_nulled(t), "grp")


def _time_sql(k: int, cap: int | None) -> str:
    low = f" AND i >= start - {cap}" if cap else ""
    return f"""
WITH ix AS (SELECT event_id AS sample_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
s AS (SELECT *, n // {k + 1} AS size, n // {k + 1} + n % {k + 1} + s * (n // {k + 1}) AS start FROM ix CROSS JOIN (SELECT unnest(range({k})) AS s) x)
SELECT sample_id, CAST(s AS INTEGER) AS split_id, i < start AS is_train FROM s
WHERE (i < start{low}) OR (i >= start AND i < start + size)"""


@query("e06_time_series_split", _time_sql(4, None))
def e06(t):
    rows = t.raw("events").selectExpr("event_id AS sample_id", "ts")
    return E.time_series_split(rows, 4, ["ts", "sample_id"]).select("sample_id", "split_id", "is_train")


@query("e06_time_series_split_capped", _time_sql(4, 500))
def e06c(t):
    rows = t.raw("events").selectExpr("event_id AS sample_id", "ts")
    return E.time_series_split(rows, 4, ["ts", "sample_id"], max_train_size=500).select("sample_id", "split_id", "is_train")


@query("e07_leave_one_out", "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS split_id FROM orders_y", "orders_y")
def e07(t):
    return E.leave_one_out(t.orders_y.select("sample_id"))


@query("e08_leave_two_out", """
WITH ix AS (SELECT vec_id AS sample_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
wanted AS (SELECT DISTINCT (i * 7919) % (n * (n - 1) // 2) AS split_id FROM ix),
firsts AS (SELECT i, i * n - i * (i + 1) // 2 AS base FROM ix),
pairs AS (SELECT split_id, max(i) AS a FROM wanted JOIN firsts ON base <= split_id GROUP BY split_id),
both_ids AS (SELECT p.split_id, a, a + 1 + p.split_id - f.base AS b FROM pairs p JOIN firsts f ON f.i = p.a)
SELECT sample_id, split_id FROM both_ids JOIN ix ON ix.i = a UNION ALL SELECT sample_id, split_id FROM both_ids JOIN ix ON ix.i = b""")
def e08(t):
    """As many numbered pairs as there are samples, spread over all C(n, 2) of them."""
    samples = t.raw("embeddings").select(F.col("vec_id").alias("sample_id"))
    n = samples.count()
    splits = E.leave_one_out(samples).select(((F.col("split_id") * 7919) % (n * (n - 1) // 2)).alias("split_id")).distinct()
    return E.leave_p_out(samples, 2, splits)


@query("e09_leave_one_group_out", "SELECT sample_id, grp, dense_rank() OVER (ORDER BY grp) - 1 AS split_id FROM orders_y", "orders_y")
def e09(t):
    return E.leave_one_group_out(t.orders_y.select("sample_id", "grp"), "grp")


@query("e10_leave_two_groups_out", f"""
WITH {PEOPLE}, g AS (SELECT grp, row_number() OVER (ORDER BY grp) AS i FROM (SELECT DISTINCT grp FROM people)),
pairs AS (SELECT a.grp AS ga, b.grp AS gb, row_number() OVER (ORDER BY a.grp, b.grp) - 1 AS split_id FROM g a JOIN g b ON a.i < b.i)
SELECT sample_id, grp, split_id FROM people JOIN pairs ON grp = ga OR grp = gb""")
def e10(t):
    """Every pair of nations as the test set of the customers."""
    people = _people(t).select("sample_id", "grp")
    return E.leave_p_groups_out(people, "grp", 2, E.every_combination(t.spark, people.select("grp").distinct().count(), 2))


@query("e11_shuffle_split", f"""
WITH ix AS (SELECT sample_id, r, row_number() OVER (PARTITION BY r ORDER BY {draw('r')}) - 1 AS i, count(*) OVER (PARTITION BY r) AS n
  FROM orders_y CROSS JOIN (SELECT unnest(range(4)) AS r) x)
SELECT sample_id, CAST(r AS INTEGER) AS split_id, i >= ceil(CAST(0.15 AS DOUBLE) * n) AS is_train FROM ix
WHERE i < ceil(CAST(0.15 AS DOUBLE) * n) + floor(CAST(0.5 AS DOUBLE) * n)""", "orders_y")
def e11(t):
    """Four draws: 15% test, 50% train."""
    return E.shuffle_split(t.orders_y.select("sample_id"), 4, SEED, 0.15, 0.5)


@query("e12_group_shuffle_split", f"""
WITH g AS (SELECT grp, r, row_number() OVER (PARTITION BY r ORDER BY {draw('r', 'grp')}) - 1 AS i, count(*) OVER (PARTITION BY r) AS n
  FROM (SELECT DISTINCT grp FROM orders_y) CROSS JOIN (SELECT unnest(range(3)) AS r) x)
SELECT sample_id, o.grp, CAST(r AS INTEGER) AS split_id, i >= ceil(CAST(0.2 AS DOUBLE) * n) AS is_train
FROM orders_y o JOIN g ON o.grp = g.grp""", "orders_y")
def e12(t):
    return E.group_shuffle_split(t.orders_y.select("sample_id", "grp"), "grp", 3, SEED)


def _quota_sql(draws: str, size: str, source: str, seed: int, name: str, out: str) -> str:
    return f"""{out}_e AS (SELECT *, {draws} * {size} / CAST(sum({size}) OVER (PARTITION BY r) AS DOUBLE) AS ex FROM {source}),
{out}_f AS (SELECT *, CAST(floor(ex) AS BIGINT) AS fl, {draws} - sum(CAST(floor(ex) AS BIGINT)) OVER (PARTITION BY r) AS need FROM {out}_e),
{out} AS (SELECT * EXCLUDE (ex, fl, need), fl + CASE WHEN row_number() OVER (PARTITION BY r ORDER BY round(ex - floor(ex), 9) DESC, {draw('r', 'y', seed)}) <= need THEN 1 ELSE 0 END AS {name} FROM {out}_f)"""


QUOTAS = f"""total AS (SELECT count(*) AS n FROM orders_y),
sizes AS (SELECT y, r, count(*) AS c, (SELECT CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) FROM total) AS n_test,
  (SELECT CAST(floor(CAST(0.35 AS DOUBLE) * n) AS BIGINT) FROM total) AS n_train
  FROM orders_y CROSS JOIN (SELECT unnest(range(3)) AS r) x GROUP BY y, r),
{_quota_sql('n_train', 'c', 'sizes', SEED, 'train_quota', 'qa')},
rest AS (SELECT *, c - train_quota AS remaining FROM qa),
{_quota_sql('n_test', 'remaining', 'rest', SEED + 1, 'test_quota', 'qb')}"""


@query("e13_stratified_quotas", f"""WITH {QUOTAS}
SELECT y, CAST(r AS INTEGER) AS split_id, c AS n_class, CAST(train_quota AS BIGINT) AS train_quota, CAST(test_quota AS BIGINT) AS test_quota FROM qb""", "orders_y")
def e13q(t):
    """Rows each class gives to the train and the test part of every draw."""
    n = t.orders_y.count()
    n_train, n_test = E.sample_sizes(n, 0.1, 0.35, 0.1)
    return E.stratified_quotas(t.orders_y, "y", 3, SEED, n_train, n_test)


@query("e13_stratified_shuffle_split", f"""WITH {QUOTAS},
ix AS (SELECT sample_id, y, r, row_number() OVER (PARTITION BY r, y ORDER BY {draw('r')}) - 1 AS i
  FROM orders_y CROSS JOIN (SELECT unnest(range(3)) AS r) x)
SELECT sample_id, ix.y, CAST(ix.r AS INTEGER) AS split_id, i < train_quota AS is_train
FROM ix JOIN qb ON ix.r = qb.r AND ix.y = qb.y WHERE i < train_quota + test_quota""", "orders_y")
def e13(t):
    return E.stratified_shuffle_split(t.orders_y.select("sample_id", "y"), "y", 3, SEED, 0.1, 0.35)


@query("e14_predefined_split", """
WITH f AS (SELECT sample_id, CAST(sample_id % 6 - 1 AS INTEGER) * 10 AS fold FROM orders_y)
SELECT sample_id, fold, dense_rank() OVER (ORDER BY fold) - 1 AS split_id FROM
  (SELECT sample_id, CASE WHEN fold < 0 THEN -1 ELSE fold END AS fold FROM f) WHERE fold <> -1""", "orders_y")
def e14(t):
    """Fold numbers 0, 10, ... 40; -1 never tests."""
    rows = t.orders_y.selectExpr(
        "sample_id", "CASE WHEN sample_id % 6 = 0 THEN -1 ELSE CAST(sample_id % 6 - 1 AS INT) * 10 END AS fold"
    )
    return E.predefined_split(rows, "fold")


@query("e14_train_side", """
SELECT sample_id, CAST(s AS BIGINT) AS split_id, sample_id % 6 = 0 OR sample_id % 6 - 1 <> s AS is_train
FROM orders_y CROSS JOIN (SELECT unnest(range(5)) AS s) x""", "orders_y")
def e14_train(t):
    """Samples that never test train in every split."""
    rows = t.orders_y.selectExpr(
        "sample_id", "CASE WHEN sample_id % 6 = 0 THEN -1 ELSE CAST(sample_id % 6 - 1 AS INT) * 10 END AS fold"
    )
    return E.with_train_side(E.predefined_split(rows, "fold"), range(5), rows)


@query("e15_given_pairs", """
SELECT sample_id, CAST(s AS INTEGER) AS split_id, (sample_id + s) % 4 <> 0 AS is_train
FROM orders_y CROSS JOIN (SELECT unnest(range(2)) AS s) x WHERE (sample_id + s) % 5 <> 0""", "orders_y")
def e15(t):
    """A caller's own pairs, checked."""
    rows = t.orders_y.select("sample_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("split_id"))
    return E.given_split(
        rows.where("(sample_id + split_id) % 5 <> 0").withColumn("is_train", F.expr("(sample_id + split_id) % 4 <> 0"))
    )


@query("e17_train_test_split", f"""
WITH ix AS (SELECT sample_id, row_number() OVER (ORDER BY {draw('0')}) - 1 AS i, count(*) OVER () AS n FROM orders_y)
SELECT sample_id, i >= ceil(CAST(0.25 AS DOUBLE) * n) AS is_train FROM ix""", "orders_y")
def e17(t):
    return E.train_test_split(t.orders_y.select("sample_id"), SEED)


@query("e17_unshuffled_split", """
WITH ix AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i, count(*) OVER () AS n FROM orders_y)
SELECT sample_id, i < n - ceil(CAST(0.25 AS DOUBLE) * n) AS is_train FROM ix""", "orders_y")
def e17u(t):
    return E.train_test_split(t.orders_y.select("sample_id"), shuffle=False)


REPEATED = f"""ix AS (SELECT sample_id, r, row_number() OVER (PARTITION BY r ORDER BY {draw('r')}) - 1 AS i, count(*) OVER (PARTITION BY r) AS n
  FROM (SELECT c_custkey AS sample_id FROM customer) CROSS JOIN (SELECT unnest(range(2)) AS r) x),
test_side AS (SELECT sample_id, r * 5 + {fold_sql('i', 'n', 5)} AS split_id FROM ix),
folds AS (SELECT c_custkey AS sample_id, CAST(s AS BIGINT) AS split_id,
  NOT EXISTS (SELECT 1 FROM test_side x WHERE x.sample_id = c_custkey AND x.split_id = s) AS is_train
  FROM customer CROSS JOIN (SELECT unnest(range(10)) AS s) y)"""


def _folds(t):
    return E.with_train_side(E.repeated_k_fold(_people(t).select("sample_id"), 5, 2, SEED), range(10))


@query("e18_stored_folds", f"WITH {REPEATED} SELECT * FROM folds")
def e18(t):
    """Two assignments stored by configuration key, one read back."""
    path = scratch_path(t.spark, "folds")
    E.store_folds(_folds(t), path, "repeated-5-2")
    E.store_folds(E.with_train_side(E.k_fold(_people(t).select("sample_id"), 3), range(3)), path, "plain-3")
    return E.read_folds(t.spark, path, "repeated-5-2")


@query("e19_sides_of_a_split", f"""WITH {REPEATED}
SELECT sample_id, CASE WHEN is_train THEN 'train' ELSE 'test' END AS side FROM folds WHERE split_id = 6""")
def e19(t):
    train, test = E.one_split(_folds(t), 6)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("e20_split_data", f"""
WITH ix AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM classes),
f AS (SELECT sample_id, y, {fold_sql('i', 'n', 4)} AS fold FROM ix),
top AS (SELECT gene_id FROM expr GROUP BY gene_id HAVING avg(value) > 0)
SELECT CAST(s AS BIGINT) AS split_id, fold <> s AS is_train, f.sample_id, y, gene_id, value
FROM expr JOIN f ON expr.sample_id = f.sample_id CROSS JOIN (SELECT unnest(range(4)) AS s) x WHERE gene_id IN (SELECT gene_id FROM top)""", "expr classes")
def e20(t):
    """Train and test rows of every split for the genes with a positive mean."""
    labels = t.classes.select("sample_id", "y")
    folds = E.with_train_side(E.stratified_k_fold(labels, "y", 4), range(4))
    genes = t.expr.groupBy("gene_id").agg(F.avg("value").alias("m")).where("m > 0")
    rows = E.split_data(t.expr.join(labels, "sample_id"), folds, genes)
    return rows.select("split_id", "is_train", "sample_id", "y", "gene_id", "value")


@query("e21_manual_cut", """
SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 >= 73 AS is_train FROM orders_y""", "orders_y")
def e21(t):
    """The first 73 rows test, the others train."""
    return E.head_test(t.orders_y.select("sample_id"), 73)
