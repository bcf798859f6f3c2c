"""Cohort merge and gene identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from riskloom.functions import scalar
from riskloom.operators import cohort as C
from riskloom.runtime import cut


def _part(t, flag):
    return t.cohort_expr.where(F.col("cohort") == flag).drop("cohort")


@query("c01_stacked_cohorts", """
SELECT sample_id, gene_id, value, CAST(NULL AS INTEGER) AS months, 'first' AS cohort FROM cohort_expr WHERE cohort = 'A'
UNION ALL SELECT sample_id, NULL, NULL, months, 'second' FROM patients""", "cohort_expr patients")
def c01(t):
    """Two tables with different columns stacked under a cohort name."""
    stacked = C.stack({"first": _part(t, "A"), "second": t.patients.select("sample_id", "months")})
    return stacked.select("sample_id", "gene_id", "value", "months", "cohort")


@query("c02_common_genes_of_two", """
SELECT * FROM cohort_expr WHERE cohort IN ('A', 'N') AND gene_id IN (SELECT gene_id FROM cohort_expr WHERE cohort = 'A')
AND gene_id IN (SELECT gene_id FROM cohort_expr WHERE cohort = 'N')""", "cohort_expr")
def c02(t):
    first, second = C.restrict_to_common(_part(t, "A"), _part(t, "N"))
    return C.stack({"A": first, "N": second}).select("cohort", "sample_id", "gene_id", "value")


@query("c03_common_genes_of_all", "SELECT gene_id FROM cohort_expr GROUP BY gene_id HAVING count(DISTINCT cohort) = 3", "cohort_expr")
def c03(t):
    return C.genes_in_all(t.cohort_expr, 3)


def _inverse_normal_sql(p: str) -> str:
    def poly(x: str, values: list[float]) -> str:
        out = f"CAST({values[0]!r} AS DOUBLE)"
        for v in values[1:]:
            out = f"({out} * {x} + CAST({v!r} AS DOUBLE))"
        return out

    def tail(u: str) -> str:
        s = f"sqrt(-2 * ln({u}))"
        return f"{poly(s, scalar.INVERSE_NORMAL_C)} / {poly(s, scalar.INVERSE_NORMAL_D + [1.0])}"

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low = scalar.INVERSE_NORMAL_TAIL
    return (
        f"CASE WHEN {p} < {low} THEN {tail(p)} WHEN {p} > {1 - low} THEN -({tail(f'(1 - {p})')}) "
        f"ELSE {poly(r, scalar.INVERSE_NORMAL_A)} * {q} / {poly(r, scalar.INVERSE_NORMAL_B + [1.0])} END"
    )


RANKED = """ranked AS (SELECT sample_id % 2 AS cohort, sample_id, gene_id, value,
  rank() OVER w + (count(*) OVER (PARTITION BY sample_id % 2, gene_id, value) - 1) / CAST(2 AS DOUBLE) AS avg_rank,
  count(*) OVER (PARTITION BY sample_id % 2, gene_id) AS n
  FROM expr WINDOW w AS (PARTITION BY sample_id % 2, gene_id ORDER BY value))"""


@query("c04_quantile_normalised", f"""WITH {RANKED},
p AS (SELECT cohort, sample_id, gene_id,
  greatest(least((avg_rank - 1) / (n - 1), CAST(0.9999999 AS DOUBLE)), CAST(1e-7 AS DOUBLE)) AS p FROM ranked)
SELECT cohort, sample_id, gene_id, round({_inverse_normal_sql('p')}, 5) + 0 AS value FROM p""", "expr")
def c04(t):
    """Each gene of each cohort on a normal scale, genes shared by both cohorts."""
    both = t.expr.withColumn("cohort", F.col("sample_id") % 2)
    return C.merge_normalised(both, 2).withColumn("value", rounded("value", 5))


@query("c05_probe_names", """
SELECT gene_id, CASE WHEN contains(gene_id, 'HS.') THEN 'Hs' || substr(gene_id, 3)
  WHEN contains(gene_id, '.') THEN regexp_replace(gene_id, '\\.[^.]*$', '') ELSE gene_id END AS name
FROM (SELECT DISTINCT gene_id FROM probes)""", "probes")
def c05(t):
    return t.probes.select("gene_id").distinct().withColumn("name", scalar.normal_probe(F.col("gene_id")))


SYMBOLS = """named AS (SELECT DISTINCT gene_id, CASE WHEN contains(gene_id, 'HS.') THEN 'Hs' || substr(gene_id, 3)
    WHEN contains(gene_id, '.') THEN regexp_replace(gene_id, '\\.[^.]*$', '') ELSE gene_id END AS old_symbol FROM probes),
symbols AS (SELECT DISTINCT gene_id, gene_symbol FROM named JOIN gene_map USING (old_symbol) WHERE gene_symbol IS NOT NULL),
iqr AS (SELECT gene_id, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM probes GROUP BY gene_id)"""
SETTLED = f"""{SYMBOLS},
fan AS (SELECT *, count(*) OVER (PARTITION BY gene_symbol) AS np, count(*) OVER (PARTITION BY gene_id) AS ns FROM symbols),
won AS (SELECT gene_id, gene_symbol FROM (SELECT f.gene_id, gene_symbol,
  row_number() OVER (PARTITION BY gene_symbol ORDER BY iqr DESC, f.gene_id) AS rn
  FROM fan f JOIN iqr ON f.gene_id = iqr.gene_id WHERE np > 1) WHERE rn = 1),
settled AS (SELECT gene_id, gene_symbol FROM fan WHERE np = 1 AND ns = 1 UNION ALL SELECT * FROM won),
copied AS (SELECT min(gene_id) AS gene_id, gene_symbol FROM fan
  WHERE ns > 1 AND gene_symbol NOT IN (SELECT gene_symbol FROM settled) GROUP BY gene_symbol),
assigned AS (SELECT * FROM settled UNION ALL SELECT * FROM copied)"""


def _symbols(t):
    return cut(C.map_symbols(t.probes.select("gene_id").distinct(), t.gene_map), "symbols")


@query("c06_symbol_lookup", f"WITH {SYMBOLS} SELECT gene_id, gene_symbol FROM symbols", "probes gene_map")
def c06(t):
    return _symbols(t)


@query("c07_widest_probe", f"""WITH {SYMBOLS}
SELECT gene_symbol, gene_id FROM (SELECT gene_symbol, s.gene_id,
  row_number() OVER (PARTITION BY gene_symbol ORDER BY iqr DESC, s.gene_id) AS rn
  FROM symbols s JOIN iqr ON s.gene_id = iqr.gene_id) WHERE rn = 1""", "probes gene_map")
def c07(t):
    """Of the probes of one symbol the one with the largest inter-quartile range."""
    return C.widest_probe(_symbols(t), C.inter_quartile_range(t.probes))


@query("c08_copied_symbols", f"""WITH {SYMBOLS},
several AS (SELECT gene_id FROM symbols GROUP BY gene_id HAVING count(*) > 1),
present AS (SELECT DISTINCT gene_symbol FROM symbols WHERE gene_id NOT IN (SELECT gene_id FROM several))
SELECT gene_symbol, min(gene_id) AS gene_id FROM symbols WHERE gene_id IN (SELECT gene_id FROM several)
AND gene_symbol NOT IN (SELECT gene_symbol FROM present) GROUP BY gene_symbol""", "probes gene_map")
def c08(t):
    """Symbols that only probes with several symbols can provide."""
    symbols = _symbols(t)
    several = symbols.groupBy("gene_id").agg(F.count("*").alias("n")).where("n > 1")
    present = symbols.join(several, "gene_id", "left_anti").select("gene_symbol").distinct()
    return C.copied_symbols(symbols, present)


@query("c09_updated_genes", f"""WITH {SETTLED}
SELECT sample_id, gene_symbol AS gene_id, value FROM probes p JOIN assigned a ON p.gene_id = a.gene_id""", "probes gene_map")
def c09(t):
    """The measurement table under current gene symbols."""
    return C.update_genes(t.probes, t.gene_map)


@query("c10_annotated_genes", """
SELECT g.gene_id, p_brand AS brand, p_type AS type FROM (SELECT DISTINCT gene_id FROM weights) g
LEFT JOIN part ON g.gene_id = p_partkey AND p_size <= 25""", "weights")
def c10(t):
    """Annotation of genes; those without a platform row keep nulls."""
    platform = t.raw("part").where("p_size <= 25").selectExpr("p_partkey AS gene_id", "p_brand AS brand", "p_type AS type")
    return C.annotate(t.weights.select("gene_id").distinct(), platform, ["brand", "type"])
