"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from riskloom.functions.scalar import above
from riskloom.operators import describe as D

STATUS = "CASE WHEN histology IS NULL THEN 'healthy' ELSE 'diseased' END"


@query("d01_health_status", f"SELECT sample_id, {STATUS} AS status FROM patients", "patients")
def d01(t):
    return D.health_status(t.patients).select("sample_id", "status")


@query("d02_counts_by_status", f"""
SELECT center AS category, count(*) FILTER ({STATUS} = 'healthy') AS healthy, count(*) FILTER ({STATUS} = 'diseased') AS diseased
FROM (SELECT histology, CASE WHEN center = 7 THEN NULL ELSE center END AS center FROM patients) GROUP BY 1""", "patients")
def d02(t):
    """Patients per center and status; a missing center is a category of its own."""
    rows = D.health_status(t.patients).withColumn("center", F.when(F.col("center") != 7, F.col("center")))
    return D.counts_by_status(rows, "center")


@query("d03_histogram", """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 13)) AS INTEGER), 12) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 13), 4) + 0 AS low, round(lo + (b + 1) * ((hi - lo) / 13), 4) + 0 AS high,
  coalesce(n, 0) AS n FROM (SELECT unnest(range(13)) AS b) x CROSS JOIN e LEFT JOIN c ON c.bin = b""")
def d03(t):
    bars = D.histogram(t.raw("orders"), "o_totalprice")
    return bars.select("bin", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "n")


@query("d04_mean_population_variance", """
SELECT split_id, round(avg(loss), 8) + 0 AS mean, round(var_pop(loss), 8) + 0 AS variance FROM score_log GROUP BY 1""", "score_log")
def d04(t):
    s = D.mean_and_population_variance(t.score_log, ["split_id"], "loss")
    return s.select("split_id", rounded("mean", 8).alias("mean"), rounded("variance", 8).alias("variance"))


@query("d05_mean_sample_variance", """
SELECT candidate_id, round(avg(loss), 8) + 0 AS mean, round(var_samp(loss), 8) + 0 AS variance FROM score_log GROUP BY 1""", "score_log")
def d05(t):
    s = D.mean_and_sample_variance(t.score_log, ["candidate_id"], "loss")
    return s.select("candidate_id", rounded("mean", 8).alias("mean"), rounded("variance", 8).alias("variance"))


@query("d06_share_of_fits", """
SELECT gene_id, round(avg(CASE WHEN abs(value) > 10 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 8) + 0 AS frequency
FROM weights GROUP BY gene_id""", "weights")
def d06(t):
    return D.participation(t.weights, threshold=10).withColumn("frequency", rounded("frequency", 8))


@query("d07_threshold", "SELECT sample_id, CAST(p1 > CAST(0.15 AS DOUBLE) AS INTEGER) AS passed FROM scored", "scored")
def d07(t):
    return t.scored.select("sample_id", above(F.col("p1"), 0.15).alias("passed"))


@query("d08_genes_above_thresholds", """
SELECT CAST(t / CAST(20 AS DOUBLE) AS DOUBLE) AS threshold, (SELECT count(*) FROM frequency WHERE frequency > t / CAST(20 AS DOUBLE)) AS n_genes
FROM (SELECT unnest(range(21)) AS t) x""", "frequency")
def d08(t):
    return D.genes_above(t.frequency, [k / 20 for k in range(21)], "frequency")


@query("d09_confidence_band", """
SELECT split_id, round(m - 1.96 * sqrt(v), 6) + 0 AS low, round(m + 1.96 * sqrt(v), 6) + 0 AS high
FROM (SELECT split_id, avg(loss) AS m, var_pop(loss) AS v FROM score_log GROUP BY 1)""", "score_log")
def d09(t):
    s = D.mean_and_population_variance(t.score_log, ["split_id"], "loss")
    low, high = D.confidence_band(F.col("mean"), F.col("variance"))
    return s.select("split_id", rounded(low).alias("low"), rounded(high).alias("high"))


@query("d10_moving_average", """
SELECT row_number() OVER w - 1 AS i, event_id, round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0 AS average
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def d10(t):
    """Event values in time order, ten at a time."""
    out = D.moving_average(t.raw("events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", 5)
    return out.select("i", "event_id", rounded("average").alias("average"))


def _smooth_sql(window: int, shape: str) -> str:
    weights = D.window_weights(window, shape)
    half = window // 2
    listed = ", ".join(f"({d - half}, CAST({w!r} AS DOUBLE))" for d, w in enumerate(weights))
    return f"""
WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n, value FROM events),
k(d, w) AS (VALUES {listed}),
r AS (SELECT i, w, CASE WHEN i + d < 0 THEN -(i + d) WHEN i + d > n - 1 THEN 2 * (n - 1) - (i + d) ELSE i + d END AS j FROM s CROSS JOIN k)
SELECT r.i, round(sum(w * s.value), 6) + 0 AS smoothed FROM r JOIN s ON s.i = r.j GROUP BY r.i"""


def _smoothed(t, window, shape):
    rows = t.raw("events").select("event_id", "ts", "value")
    return D.smooth(rows, ["ts", "event_id"], "value", window, shape).select("i", rounded("smoothed").alias("smoothed"))


@query("d11_smoothed_hanning", _smooth_sql(11, "hanning"))
def d11(t):
    return _smoothed(t, 11, "hanning")


@query("d11_smoothed_blackman_even", _smooth_sql(7, "blackman"))
def d11b(t):
    """A window of 8 behaves as 7."""
    return _smoothed(t, 8, "blackman")


@query("d11_smoothed_flat", _smooth_sql(5, "flat"))
def d11c(t):
    return _smoothed(t, 5, "flat")
