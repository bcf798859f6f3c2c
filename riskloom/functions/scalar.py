"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Coefficients of Acklam's rational approximation of the inverse normal CDF.
INVERSE_NORMAL_A = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
INVERSE_NORMAL_B = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
]
INVERSE_NORMAL_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
INVERSE_NORMAL_D = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00,
]
INVERSE_NORMAL_TAIL = 0.02425


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    r = q * q
    middle = _poly(r, INVERSE_NORMAL_A) * q / _poly(r, INVERSE_NORMAL_B + [1.0])

    def tail(t: Column) -> Column:
        s = F.sqrt(-2.0 * F.log(t))
        return _poly(s, INVERSE_NORMAL_C) / _poly(s, INVERSE_NORMAL_D + [1.0])

    return (
        F.when(p < INVERSE_NORMAL_TAIL, tail(p))
        .when(p > 1 - INVERSE_NORMAL_TAIL, -tail(1.0 - p))
        .otherwise(middle)
    )


def censored_months(text: Column) -> Column:
    """``"37+"`` is alive at 37 months, ``"37"`` died at 37: struct<months, event>."""
    text = F.trim(text)
    return F.struct(
        F.regexp_extract(text, r"^(\d+)", 1).try_cast("int").alias("months"),
        (~text.endswith("+")).alias("event"),
    )


def whole_months(text: Column) -> Column:
    """Months of a text with or without the mark of a living patient, rounded up."""
    return F.ceil(F.regexp_replace(F.trim(text), r"\+$", "").try_cast("double"))


def normal_probe(name: Column) -> Column:
    """Shared spelling of a probe name: ``HS.x`` to ``Hs.x``, else cut after the last point."""
    return (
        F.when(name.contains("HS."), F.concat(F.lit("Hs"), F.substr(name, F.lit(3))))
        .when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))
        .otherwise(name)
    )


def above(value: Column, threshold: float | Column) -> Column:
    """1 when strictly above the threshold, else 0."""
    return (value > threshold).cast("int")


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def clipped(p: Column, eps: float = 1e-15) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
