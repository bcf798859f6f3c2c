"""Metrics on the scored events: whole table or per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from riskloom.operators import metrics as H

CLIP = "greatest(least(p1, CAST(0.999999999999999 AS DOUBLE)), CAST(1e-15 AS DOUBLE))"
LOSS = f"-avg(CASE WHEN y = 1 THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END)"


def _per_user(t, metrics, predicted):
    out = H.score(t.scored, metrics, "y", predicted, ["grp"])
    return out.select("grp", *[rounded(m).alias(m) for m in metrics])


@query("h1_log_loss", f"SELECT grp, round({LOSS}, 6) + 0 AS log_loss FROM scored GROUP BY grp", "scored")
def h1(t):
    return _per_user(t, {"log_loss": H.log_loss}, "p1")


@query("h2_negative_log_loss", f"SELECT grp, round(-({LOSS}), 6) + 0 AS neg_log_loss FROM scored GROUP BY grp", "scored")
def h2(t):
    return _per_user(t, {"neg_log_loss": H.negative_log_loss}, "p1")


AUC = """SELECT {by}round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * sum(1 - y)), 8) + 0 AS auc
FROM (SELECT grp, y, rank() OVER ({over} ORDER BY p1) + (count(*) OVER (PARTITION BY {tie}p1) - 1) / CAST(2 AS DOUBLE) AS r FROM scored){group}"""


@query("h3_roc_auc", AUC.format(by="", over="", tie="", group=""), "scored")
def h3(t):
    """Over the whole table."""
    return H.roc_auc(t.scored, "y", "p1").select(rounded("auc", 8).alias("auc"))


@query("h3_roc_auc_per_user", AUC.format(by="grp, ", over="PARTITION BY grp", tie="grp, ", group=" GROUP BY grp"), "scored")
def h3g(t):
    return H.roc_auc(t.scored, "y", "p1", ["grp"]).select("grp", rounded("auc", 8).alias("auc"))


@query("h4_accuracy", "SELECT grp, round(avg(CASE WHEN y = predicted THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) + 0 AS accuracy FROM scored GROUP BY grp", "scored")
def h4(t):
    return _per_user(t, {"accuracy": H.accuracy}, "predicted")


@query("h5_precision_recall", """
SELECT grp, round(CASE WHEN sum(predicted) > 0 THEN sum(y * predicted) / CAST(sum(predicted) AS DOUBLE) ELSE 0 END, 6) + 0 AS precision,
  round(CASE WHEN sum(y) > 0 THEN sum(y * predicted) / CAST(sum(y) AS DOUBLE) ELSE 0 END, 6) + 0 AS recall FROM scored GROUP BY grp""", "scored")
def h5(t):
    return _per_user(t, {"precision": H.precision, "recall": H.recall}, "predicted")


@query("h6_mean_squared_error", "SELECT grp, round(avg((y - p1) * (y - p1)), 6) + 0 AS mse FROM scored GROUP BY grp", "scored")
def h6(t):
    return _per_user(t, {"mse": H.mean_squared_error}, "p1")


@query("h6_fold_errors_over_n", """
SELECT round(sum(mse) / sum(n), 9) + 0 AS error FROM (SELECT sample_id % 5 AS f, avg((y - p1) * (y - p1)) AS mse, count(*) AS n FROM scored GROUP BY 1)""", "scored")
def h6n(t):
    rows = t.scored.withColumn("f", F.col("sample_id") % 5)
    return H.fold_sum_over_n(rows, "y", "p1", "f").select(rounded("error", 9).alias("error"))


@query("h7_absolute_error_r2", """
SELECT grp, round(avg(abs(y - p1)), 6) + 0 AS mae, round(1 - sum((y - p1) * (y - p1)) / (var_pop(y) * count(*)), 6) + 0 AS r2 FROM scored GROUP BY grp""", "scored")
def h7(t):
    return _per_user(t, {"mae": H.mean_absolute_error, "r2": H.r_squared}, "p1")


@query("h8_user_metric", """
SELECT grp, round(avg(CASE WHEN abs(y - p1) > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) + 0 AS far_off FROM scored GROUP BY grp""", "scored")
def h8(t):
    """A caller's own column metric."""
    return _per_user(t, {"far_off": lambda y, p: F.avg((F.abs(y - p) > 0.5).cast("double"))}, "p1")


@query("h9_average_over_folds", f"""
SELECT round(avg(v), 6) + 0 AS value FROM (SELECT sample_id % 5 AS f, {LOSS} AS v FROM scored GROUP BY 1)""", "scored")
def h9(t):
    rows = t.scored.withColumn("f", F.col("sample_id") % 5)
    return H.average_over_folds(rows, H.log_loss, "y", "p1", "f").select(rounded("value").alias("value"))
