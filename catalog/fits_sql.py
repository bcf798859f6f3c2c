"""SQL that fits small logistic models by iteration, to check the Spark fits by value."""

from __future__ import annotations

from catalog.tables import GENES


def newton(name: str, data: str, pa: str, pb: str, keys: str = "", steps: int = 25) -> str:
    """CTE ``name(keys, it, u, v)``: Newton steps for p = 1/(1+exp(-(u*a + v*b))).

    ``data`` is a CTE with columns keys, y, a, b.  ``pa`` and ``pb`` are the penalties
    (one over C) on u and v, as SQL over the key columns.
    """
    ks = [k.strip() for k in keys.split(",") if k.strip()]
    head = "".join(f"{k}, " for k in ks)
    w_head = "".join(f"w.{k}, " for k in ks)
    on = " AND ".join(f"d.{k} = w.{k}" for k in ks) or "TRUE"
    p = "(1 / (1 + exp(-(u * a + v * b))))"
    start = f"SELECT {'DISTINCT ' if ks else ''}{head}0 AS it, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v FROM {data}"
    if not ks:
        start = "SELECT 0 AS it, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v"
    return f"""{name} AS ({start}
UNION ALL
SELECT {head}it + 1, u - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), v - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
FROM (SELECT {w_head}it, u, v,
    sum(({p} - y) * a) + any_value({pa}) * u AS g1, sum(({p} - y) * b) + any_value({pb}) * v AS g2,
    sum({p} * (1 - {p}) * a * a) + any_value({pa}) AS h11, sum({p} * (1 - {p}) * a * b) AS h12,
    sum({p} * (1 - {p}) * b * b) + any_value({pb}) AS h22
  FROM {name} w JOIN {data} d ON {on} WHERE it < {steps} GROUP BY {w_head}it, u, v)),
{name}_fit AS (SELECT {head}u, v FROM {name} WHERE it = {steps})"""


def descent(
    name: str, data: str, width: int, l1: float = 0.0, l2: float | str = 0.0, free: int = 0, keys: str = "", sweeps: int = 20, last: str = "0"
) -> str:
    """CTE ``name_fit(keys, w)``: logistic weights by cyclic coordinate descent.

    ``data`` has keys, y and the array x of ``width`` values.  ``l1`` and ``l2`` are the
    penalties (one over C) on all but the last ``free`` places, which have the ridge penalty ``last``.
    ``l2`` and ``last`` may be SQL over the columns of ``data``.
    """
    ks = [k.strip() for k in keys.split(",") if k.strip()]
    head = "".join(f"{k}, " for k in ks)
    w_head = "".join(f"c.{k}, " for k in ks)
    on = " AND ".join(f"d.{k} = c.{k}" for k in ks) or "TRUE"
    j = f"(it % {width} + 1)"
    p = "(1 / (1 + exp(-list_dot_product(w, x))))"
    bound = f"CASE WHEN it % {width} < {width - free} THEN CAST({{v}} AS DOUBLE) ELSE {{e}} END"
    a, b = bound.format(v=float(l1), e="0"), bound.format(v=l2, e=last)
    start = f"SELECT {'DISTINCT ' if ks else ''}{head}0 AS it, list_transform(range({width}), lambda k: CAST(0 AS DOUBLE)) AS w"
    return f"""{name} AS ({start}{f' FROM {data}' if ks else ''}
UNION ALL
SELECT {head}it + 1, list_transform(range({width}), lambda k: CASE WHEN k = it % {width} THEN moved ELSE w[k + 1] END)
FROM (SELECT {head}it, w, CASE WHEN h > 0 THEN sign(target) * greatest(abs(target) - {a} / h, 0) ELSE 0 END AS moved FROM (
  SELECT {head}it, w, h, w[{j}] - (g + pen * w[{j}]) / h AS target FROM (
    SELECT {w_head}it, w, any_value({b}) AS pen, sum(({p} - y) * x[{j}]) AS g, sum({p} * (1 - {p}) * x[{j}] * x[{j}]) + any_value({b}) AS h
    FROM {name} c JOIN {data} d ON {on} WHERE it < {width * sweeps} GROUP BY {w_head}it, w)))),
{name}_fit AS (SELECT {head}w FROM {name} WHERE it = {width * sweeps})"""


# Gene 0 and gene 1 of the embeddings scaled up, class as label.
TWO_GENES = """two_genes AS (SELECT vec_id AS sample_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
  10 * CAST(embedding[1] AS DOUBLE) AS a, 10 * CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)"""
# Plain stratified folds of the same samples, as in the fold queries.
FOLD4 = """fold4 AS (SELECT sample_id, CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1)
  ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS fold
  FROM (SELECT vec_id AS sample_id, row_number() OVER (PARTITION BY label >= 5 ORDER BY vec_id) - 1 AS i,
    count(*) OVER (PARTITION BY label >= 5) AS n FROM embeddings))"""
# All genes scaled up, and the same with a constant at the end; train rows of each fold split.
ALL_GENES = """scaled AS (SELECT vec_id AS sample_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
  list_transform(embedding, lambda e: 10 * CAST(e AS DOUBLE)) AS x FROM embeddings)"""


def split_genes(k: int) -> str:
    """CTEs ``foldk`` and ``all_splits``: all genes on the sides of k plain stratified folds."""
    fold = FOLD4.replace("fold4", "foldk").replace("% 4", f"% {k}").replace("// 4", f"// {k}")
    return f"""{ALL_GENES}, {fold}, all_splits AS (SELECT s.*, sp AS split_id, fold <> sp AS is_train
  FROM scaled s JOIN foldk f ON s.sample_id = f.sample_id CROSS JOIN (SELECT unnest(range({k})) AS sp) t),
train_splits AS (SELECT * FROM all_splits WHERE is_train)"""


# The same with a constant at the end: all rows, and the rows of four splits.
WHOLE = f"{ALL_GENES}, whole AS (SELECT sample_id, y, list_append(x, CAST(1 AS DOUBLE)) AS x FROM scaled)"
SPLITS4 = f"""{split_genes(4)}, whole AS (SELECT sample_id, y, list_append(x, CAST(1 AS DOUBLE)) AS x FROM scaled),
splits4 AS (SELECT sample_id, y, split_id, is_train, list_append(x, CAST(1 AS DOUBLE)) AS x FROM all_splits)"""


def log_loss_of(d: str) -> str:
    """Mean log loss from the label y and the decision value."""
    return f"avg(ln(1 + exp(CASE WHEN y = 1 THEN -({d}) ELSE {d} END)))"


def auc_of(source: str, keys: str) -> str:
    """Query of ``(keys, auc)`` from y and decision values, ties counted half."""
    return f"""SELECT {keys}, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * sum(1 - y)) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY decision) + (count(*) OVER (PARTITION BY {keys}, decision) - 1) / CAST(2 AS DOUBLE) AS r FROM {source}) GROUP BY {keys}"""


LOSS = "-avg(CASE WHEN y = 1 THEN ln(p1) ELSE ln(1 - p1) END)"


def binned_cells(most: int) -> str:
    """CTE ``cells(sample_id, gene, v)``: every value of ``scaled`` as the number of its bin among ``most``."""
    return f"""cells AS MATERIALIZED (SELECT sample_id, gene, (r - 1) * {most} // greatest(max(r) OVER (PARTITION BY gene), {most}) AS v
  FROM (SELECT sample_id, gene, dense_rank() OVER (PARTITION BY gene ORDER BY e) AS r FROM (SELECT sample_id, x[i + 1] AS e, i AS gene FROM (SELECT sample_id, x, unnest(range({GENES})) AS i FROM scaled))))"""


def grown_tree(name: str, start: str, depth: int, alpha: float = 0.0, penalty: float = 0.0, least: float = 0.0) -> str:
    """CTE ``name_leaf(sample_id, weight)``: a tree over ``start(sample_id, g, h)`` and ``cells``, level by level.

    The first gene and the least bin win ties; a child needs ``least`` of h.
    """
    pull = f"(sign({{g}}) * greatest(abs({{g}}) - {float(alpha)}, 0))"
    score = lambda g, h: f"({pull.format(g=g)} ** 2 / ({h} + {float(penalty)}))"
    parts = [f"{name}_0 AS MATERIALIZED (SELECT sample_id, 1 AS node, g, h FROM {start})"]
    for k in range(depth):
        parts.append(f"""{name}_b{k} AS MATERIALIZED (SELECT node, gene, v FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, gene, v) AS place FROM (
    SELECT node, gene, v, ({score('gl', 'hl')} + {score('(gw - gl)', '(hw - hl)')} - {score('gw', 'hw')}) / 2 AS gain FROM (
      SELECT node, gene, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, gene) AS gw, sum(h) OVER (PARTITION BY node, gene) AS hw
      FROM (SELECT node, gene, v, sum(g) AS g, sum(h) AS h FROM {name}_{k} n JOIN cells c ON n.sample_id = c.sample_id GROUP BY node, gene, v)
      WINDOW w AS (PARTITION BY node, gene ORDER BY v))
    WHERE hw - hl > 1e-9 AND hl >= {float(least)} AND hw - hl >= {float(least)}) WHERE gain > 1e-12) WHERE place = 1),
{name}_{k + 1} AS MATERIALIZED (SELECT n.sample_id, CASE WHEN b.node IS NULL THEN n.node WHEN c.v <= b.v THEN 2 * n.node ELSE 2 * n.node + 1 END AS node, g, h
  FROM {name}_{k} n LEFT JOIN {name}_b{k} b ON n.node = b.node LEFT JOIN cells c ON c.sample_id = n.sample_id AND c.gene = b.gene)""")
    parts.append(f"""{name}_leaf AS MATERIALIZED (SELECT sample_id, -{pull.format(g='gs')} / (hs + {float(penalty)}) AS weight
  FROM (SELECT sample_id, sum(g) OVER (PARTITION BY node) AS gs, sum(h) OVER (PARTITION BY node) AS hs FROM {name}_{depth}))""")
    return ",\n".join(parts)


def boosted_trees(rounds: int, depth: int, rate: float, alpha: float, penalty: float, least: float) -> str:
    """CTE ``margins(sample_id, y, margin)``: the sum of boosted trees over ``scaled`` and ``cells``."""
    parts = ["margin_0 AS MATERIALIZED (SELECT sample_id, y, CAST(0 AS DOUBLE) AS margin FROM scaled)"]
    for r in range(rounds):
        parts.append(f"gh_{r} AS MATERIALIZED (SELECT sample_id, p - y AS g, p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM margin_{r}))")
        parts.append(grown_tree(f"t{r}", f"gh_{r}", depth, alpha, penalty, least))
        parts.append(f"margin_{r + 1} AS MATERIALIZED (SELECT m.sample_id, y, margin + {float(rate)} * weight AS margin FROM margin_{r} m JOIN t{r}_leaf l ON m.sample_id = l.sample_id)")
    return ",\n".join(parts) + f",\nmargins AS (SELECT * FROM margin_{rounds})"
