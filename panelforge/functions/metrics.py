"""Forecast metrics as aggregate Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wmape(a: Column, f: Column) -> Column:
    """Sum of absolute errors over sum of absolute actuals; null where that is 0."""
    return F.try_divide(F.sum(F.abs(a - f)), F.nullif(F.sum(F.abs(a)), F.lit(0.0)))


def normalized_bias(a: Column, f: Column) -> Column:
    """Sum of (forecast - actual) over sum of absolute actuals; 0 where that is 0."""
    return F.coalesce(F.try_divide(F.sum(f - a), F.nullif(F.sum(F.abs(a)), F.lit(0.0))), F.lit(0.0))


def mape(a: Column, f: Column) -> Column:
    """Mean of relative errors over non-zero actuals; null if there are none."""
    return F.avg(F.when(a != 0, F.abs(a - f) / F.nullif(F.abs(a), F.lit(0.0))))


def mae(a: Column, f: Column) -> Column:
    return F.avg(F.abs(a - f))


def rmse(a: Column, f: Column) -> Column:
    return F.sqrt(F.avg((a - f) * (a - f)))


def rmspe(a: Column, f: Column) -> Column:
    ratio = F.when(a != 0, (a - f) / F.nullif(a, F.lit(0.0)))
    return F.sqrt(F.avg(ratio * ratio))


def mape_percent(a: Column, f: Column) -> Column:
    return mape(a, f) * 100


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "wmape": wmape,
    "normalized_bias": normalized_bias,
    "mape": mape,
    "mae": mae,
    "rmse": rmse,
    "rmspe": rmspe,
}


def register_metric(name: str, build: Callable[[Column, Column], Column]) -> None:
    """A user's metric: a function of the actual and forecast columns to an aggregate."""
    METRICS[name] = build


def metric_set(names, actual="actual", forecast="forecast") -> list[Column]:
    """The named metrics, aliased; an unknown name is a KeyError."""
    missing = [n for n in names if n not in METRICS]
    if missing:
        raise KeyError(f"unknown metrics: {missing}; known: {sorted(METRICS)}")
    return [METRICS[n](F.col(actual), F.col(forecast)).alias(n) for n in names]


def fva_class(value: Column, threshold: float = 0.02) -> Column:
    """ADDS_VALUE, DESTROYS_VALUE or NEUTRAL."""
    return F.when(value > threshold, "ADDS_VALUE").when(value < -threshold, "DESTROYS_VALUE").otherwise("NEUTRAL")


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by the polynomial 26.2.17 of Abramowitz and Stegun."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    #: The published coefficients.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def nearest_quantile(sorted_values: Column, q: float) -> Column:
    """The element at round(q * (n - 1)) of a sorted array."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.round(q * (n - 1)).cast("int")))


def linear_quantile(sorted_values: Column, q: Column) -> Column:
    """Linear interpolation in a sorted array at a share that may be a column."""
    n = F.size(sorted_values)
    at = q * (n - 1)
    low = F.get(sorted_values, F.floor(at).cast("int"))
    high = F.get(sorted_values, F.ceil(at).cast("int"))
    return F.when(n > 0, low + (high - low) * (at - F.floor(at)))


def slope(y: Column | str, x: Column | str) -> Column:
    """Aggregate: the least-squares slope of y on x; null where x does not vary."""
    return F.try_divide(F.covar_pop(y, x), F.nullif(F.var_pop(x), F.lit(0.0)))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Aggregate: the correlation on complete rows; null where either side does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, b)))
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))
