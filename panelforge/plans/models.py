"""Forecasters: a panel in, (series_id, week, step, forecast) out.

Point models are SQL: the seasonal naive is an index into the series' own array, and the
intermittent models fold it with a higher-order function.  Models that need a loop over a
state with more than that are grouped-map plug-ins.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import calendar
from panelforge.functions.metrics import linear_quantile
from panelforge.operators.panel import ID, TIME, VALUE

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Registers a forecaster: a function (panel, horizon, **options) -> forecasts."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def forecast(name: str, panel: DataFrame, horizon: int, **options) -> DataFrame:
    """The named model's forecast; options that it does not take are ignored."""
    if name not in REGISTRY:
        raise KeyError(f"unknown forecaster {name!r}; known: {sorted(REGISTRY)}")
    build = REGISTRY[name]
    takes = inspect.signature(build).parameters
    return build(panel, horizon, **{k: v for k, v in options.items() if k in takes}).withColumn("model", F.lit(name))


def histories(panel: DataFrame, id_col=ID, time=TIME, value=VALUE, keep=()) -> DataFrame:
    """(series_id, last, y): each series as one array in time order; a series is a few hundred values."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("y"))))
    out = panel.groupBy(id_col, *keep).agg(pairs.alias("p"))
    return out.select(id_col, *keep, F.element_at("p.t", -1).alias("last"), F.transform("p", lambda x: F.coalesce(x["y"], F.lit(0.0))).alias("y"))


def steps(hist: DataFrame, horizon: int, freq: str, value: Callable[[Column], Column], id_col=ID, time=TIME, keep=(), name="forecast") -> DataFrame:
    """One row per step: its date and the value of an expression of the step."""
    out = hist.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return out.select(id_col, *keep, calendar.shift(F.col("last"), F.col("step"), freq).alias(time), "step", value(F.col("step")).alias(name))


def season_index(step: Column, season: int) -> Column:
    """Index of the value one season before a step; a shorter series wraps around from its start."""
    n = F.size("y")
    back = n - season + (step - 1) % season
    return F.when(n >= season, back).otherwise((step - 1) % F.nullif(n, F.lit(0)))


@register("naive_seasonal")
def naive_seasonal(panel: DataFrame, horizon: int, season: int | None = None, freq: str = "W", keep=()) -> DataFrame:
    season = season or calendar.frequency(freq).season
    return steps(histories(panel, keep=keep), horizon, freq, lambda s: F.get("y", season_index(s, season)), keep=keep)


@register("last_value")
def last_value(panel: DataFrame, horizon: int, freq: str = "W", keep=()) -> DataFrame:
    return steps(histories(panel, keep=keep), horizon, freq, lambda s: F.element_at("y", -1), keep=keep)


@register("moving_average")
def moving_average(panel: DataFrame, horizon: int, window: int = 13, freq: str = "W", keep=()) -> DataFrame:
    hist = histories(panel, keep=keep)
    tail = F.slice("y", F.greatest(F.lit(1), F.size("y") - window + 1), window)
    hist = hist.withColumn("m", F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail))
    return steps(hist, horizon, freq, lambda s: F.col("m"), keep=keep)


def naive_quantiles(panel: DataFrame, horizon: int, quantiles: list[float], season: int | None = None, freq: str = "W") -> DataFrame:
    """Seasonal naive plus quantiles of its seasonal differences at each position; 0.5 is the point."""
    season = season or calendar.frequency(freq).season
    hist = histories(panel)
    # differences y[i] - y[i - season] at the step's position in the season, counted back from the end
    out = hist.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("point", F.get("y", season_index(F.col("step"), season)))
    pos = (F.size("y") - season + (F.col("step") - 1) % season).cast("int")
    diffs = F.array_sort(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("y") - 1)), lambda i: (i >= season) & ((i - pos) % season == 0)),
            lambda i: F.get("y", i) - F.get("y", i - season),
        )
    )
    out = out.withColumn("d", diffs).withColumn(TIME, calendar.shift(F.col("last"), F.col("step"), freq))
    cols = []
    for q in quantiles:
        offset = F.lit(0.0) if q == 0.5 else F.coalesce(linear_quantile(F.col("d"), F.lit(q)), F.lit(0.0))
        cols.append((F.col("point") + offset).alias(quantile_name(q)))
    return out.select(ID, TIME, "step", *cols)


def quantile_name(q: float) -> str:
    return f"forecast_p{int(round(q * 100))}"


def croston_state(alpha: float) -> Column:
    """struct(z, x): smoothed size and interval of demand; intervals start at 1."""
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(1.0).alias("x"), F.lit(1.0).alias("gap"))

    def merge(a, v):
        first = a["z"].isNull()
        return F.when(
            v > 0,
            F.struct(
                F.when(first, v).otherwise(a["z"] + alpha * (v - a["z"])).alias("z"),
                F.when(first, F.lit(1.0)).otherwise(a["x"] + alpha * (a["gap"] - a["x"])).alias("x"),
                F.lit(1.0).alias("gap"),
            ),
        ).otherwise(F.struct(a["z"].alias("z"), a["x"].alias("x"), F.when(first, a["gap"]).otherwise(a["gap"] + 1).alias("gap")))

    return F.aggregate("y", start, merge)


@register("croston")
def croston(panel: DataFrame, horizon: int, alpha: float = 0.1, freq: str = "W", factor: float = 1.0, keep=()) -> DataFrame:
    """Flat z / x; a series without demand forecasts 0."""
    hist = histories(panel, keep=keep).withColumn("s", croston_state(alpha))
    return steps(hist, horizon, freq, lambda s: F.coalesce(factor * F.col("s.z") / F.greatest(F.col("s.x"), F.lit(1.0)), F.lit(0.0)), keep=keep)


@register("croston_sba")
def croston_sba(panel: DataFrame, horizon: int, alpha: float = 0.1, freq: str = "W", keep=()) -> DataFrame:
    return croston(panel, horizon, alpha, freq, 1 - alpha / 2, keep)


def croston_quantiles(panel: DataFrame, horizon: int, quantiles: list[float], alpha: float = 0.1, freq: str = "W") -> DataFrame:
    """A zero with probability 1 - 1/x, otherwise the sizes seen so far."""
    hist = histories(panel).withColumn("s", croston_state(alpha)).withColumn("nz", F.array_sort(F.filter("y", lambda v: v > 0)))
    p = 1 / F.greatest(F.col("s.x"), F.lit(1.0))
    out = hist.withColumn("p", F.when(F.size("nz") > 0, p).otherwise(0.0)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    cols = []
    for q in quantiles:
        share = F.try_divide(q - (1 - F.col("p")), F.nullif("p", F.lit(0.0)))
        cols.append(F.when((F.col("p") == 0) | (q <= 1 - F.col("p")), 0.0).otherwise(linear_quantile(F.col("nz"), share)).alias(quantile_name(q)))
    return out.select(ID, calendar.shift(F.col("last"), F.col("step"), freq).alias(TIME), "step", *cols)


@register("tsb")
def tsb(panel: DataFrame, horizon: int, alpha_z: float = 0.1, alpha_p: float = 0.1, freq: str = "W", keep=()) -> DataFrame:
    """Smoothed probability and size of demand, from the share of non-zero values and the first of them."""
    hist = histories(panel, keep=keep).withColumn("nz", F.filter("y", lambda v: v > 0))
    start = F.struct((F.size("nz") / F.nullif(F.size("y"), F.lit(0))).alias("p"), F.get("nz", F.lit(0)).alias("z"))

    def merge(a, v):
        up = v > 0
        return F.struct(
            (a["p"] + alpha_p * (F.when(up, 1.0).otherwise(0.0) - a["p"])).alias("p"),
            F.when(up, a["z"] + alpha_z * (v - a["z"])).otherwise(a["z"]).alias("z"),
        )

    hist = hist.withColumn("s", F.aggregate(F.slice("y", 2, F.greatest(F.lit(0), F.size("y") - 1)), start, merge))
    return steps(hist, horizon, freq, lambda s: F.coalesce(F.col("s.p") * F.col("s.z"), F.lit(0.0)), keep=keep)


def per_series(panel: DataFrame, horizon: int, freq: str, kernel, keep=()) -> DataFrame:
    """A grouped-map model: kernel(values, horizon) -> forecasts; a failed series has its error and no value."""
    hist = histories(panel, keep=keep)

    def run(batches):
        for pdf in batches:
            made, errors = [], []
            for y in pdf["y"]:
                try:
                    made.append([float(v) for v in kernel(np.asarray(y, float), horizon)])
                    errors.append(None)
                except Exception as e:  # reported in the error column, per series
                    made.append([None] * horizon)
                    errors.append(str(e)[:200])
            yield pdf.drop(columns="y").assign(f=made, error=errors)

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in hist.schema.fields if f.name != "y"], T.StructField("f", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    out = hist.mapInPandas(run, schema)
    return steps(out, horizon, freq, lambda s: F.get("f", s - 1), keep=(*keep, "error"))


def holt_winters_kernel(season: int, alpha=0.3, beta=0.05, gamma=0.2):
    """Additive level, trend and season; without a second season, level and trend alone."""

    def run(y, horizon):
        n = len(y)
        if n == 0:
            return np.zeros(horizon)
        if n < 2 * season:
            level, trend, seas, m = y[0], 0.0, np.zeros(1), 1
        else:
            level, trend, m = y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season, season
            seas = y[:season] - level
        seas = seas.copy()
        for i, v in enumerate(y):
            old = level
            level = alpha * (v - seas[i % m]) + (1 - alpha) * (level + trend)
            trend = beta * (level - old) + (1 - beta) * trend
            if m > 1:
                seas[i % m] = gamma * (v - level) + (1 - gamma) * seas[i % m]
        h = np.arange(1, horizon + 1)
        return level + trend * h + seas[(n + h - 1) % m]

    return run


@register("holt_winters")
def holt_winters(panel: DataFrame, horizon: int, freq: str = "W", season: int | None = None, keep=()) -> DataFrame:
    """Additive Holt-Winters with fixed smoothing: the stand-in for automatic exponential smoothing."""
    return per_series(panel, horizon, freq, holt_winters_kernel(season or calendar.frequency(freq).season), keep)


def theta_kernel(season: int, alpha=0.3):
    def run(y, horizon):
        n = len(y)
        if n == 0:
            return np.zeros(horizon)
        seas, m = np.zeros(season), season
        if n >= 2 * season:
            for k in range(season):
                seas[k] = y[k::season].mean() - y.mean()
        d = y - seas[np.arange(n) % m]
        slope = np.polyfit(np.arange(n), d, 1)[0] if n > 1 else 0.0
        level = d[0]
        for v in d:
            level += alpha * (v - level)
        h = np.arange(1, horizon + 1)
        return level + slope / 2 * (h - 1 + (1 - (1 - alpha) ** n) / alpha) + seas[(n + h - 1) % m]

    return run


@register("theta_ses")
def theta_ses(panel: DataFrame, horizon: int, freq: str = "W", season: int | None = None, keep=()) -> DataFrame:
    """Classic theta: exponential smoothing with half the linear drift, on seasonally adjusted values."""
    return per_series(panel, horizon, freq, theta_kernel(season or calendar.frequency(freq).season), keep)


def decomposition_kernel(season: int):
    def run(y, horizon):
        n = len(y)
        if n == 0:
            return np.zeros(horizon)
        m = season if n >= 2 * season else 1
        # a centred mean over whole seasons: even ones count their ends by half
        weights = np.ones(m) if m % 2 else np.concatenate([[0.5], np.ones(m - 1), [0.5]])
        half = len(weights) // 2
        trend = np.convolve(y, weights / m, "valid")
        at = np.arange(half, half + len(trend))
        off = y[at] - trend
        seas = np.array([off[at % m == k].mean() if (at % m == k).any() else 0.0 for k in range(m)])
        tail = trend[-12:]
        slope = np.polyfit(np.arange(len(tail)), tail, 1)[0] if len(tail) > 1 else 0.0
        h = np.arange(1, horizon + 1)
        return trend[-1] + slope * (half + h) + seas[(n + h - 1) % m]

    return run


@register("decomposition_drift")
def decomposition_drift(panel: DataFrame, horizon: int, freq: str = "W", season: int | None = None, keep=()) -> DataFrame:
    """Trend by a centred average, positional season, linear drift: the stand-in for multi-season models."""
    return per_series(panel, horizon, freq, decomposition_kernel(season or calendar.frequency(freq).season), keep)


@register("autoregression")
def autoregression(panel: DataFrame, horizon: int, freq: str = "W", order: int = 8, ridge: float = 1.0, keep=()) -> DataFrame:
    """Ridge autoregression, recursive: the stand-in for automatic ARIMA."""

    def run(y, h):
        p = min(order, max(1, len(y) // 4))
        if len(y) < p + 3:
            return np.full(h, y.mean() if len(y) else 0.0)
        mean = y.mean()
        d = y - mean
        x = np.column_stack([d[p - 1 - k : len(d) - 1 - k] for k in range(p)])
        b = np.linalg.solve(x.T @ x + ridge * np.eye(p), x.T @ d[p:])
        past = list(d[-p:][::-1])
        out = []
        for _ in range(h):
            v = float(np.dot(b, past[:p]))
            out.append(v + mean)
            past.insert(0, v)
        return np.array(out)

    return per_series(panel, horizon, freq, run, keep)


@register("gbt_direct")
def gbt_direct(panel: DataFrame, horizon: int, freq: str = "W", lags=(1, 2, 4, 8, 13, 26, 52), trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """One global gradient-boosted model over lags known at the origin: direct, for every step at once.

    Each step is a feature, so no step is fed by another's forecast; unknown lags are 0.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    hist = histories(panel)
    names = [f"lag_{k}" for k in lags]

    def features(end: Column) -> list[Column]:
        return [F.coalesce(F.when(end - k >= 0, F.get("y", (end - k).cast("int"))), F.lit(0.0)).alias(n) for k, n in zip(lags, names, strict=True)]

    # every origin of the last two years with every step that stays inside the series
    train = hist.withColumn("end", F.explode(F.sequence(F.greatest(F.lit(1), F.size("y") - 104), F.greatest(F.lit(1), F.size("y") - 1))))
    train = train.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).where(F.col("end") + F.col("step") <= F.size("y"))
    train = train.select(F.get("y", F.col("end") + F.col("step") - 1).alias("label"), F.col("step").cast("double").alias("step"), *features(F.col("end")))
    build = VectorAssembler(inputCols=["step", *names], outputCol="features")
    model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(build.transform(train))
    ahead = hist.withColumn("end", F.size("y")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.select(ID, "last", F.col("n").cast("double").alias("step"), *features(F.col("end")))
    out = model.transform(build.transform(ahead))
    return out.select(ID, calendar.shift(F.col("last"), F.col("step"), freq).alias(TIME), F.col("step").cast("int").alias("step"), F.col("prediction").alias("forecast"))


def weighted_ensemble(forecasts: dict[str, DataFrame], weights: dict[str, float], columns=("forecast",)) -> DataFrame:
    """Sum of the models' values by normalised non-negative weights; uniform if all are 0."""
    w = {m: max(0.0, weights.get(m, 0.0)) for m in forecasts}
    total = sum(w.values())
    w = {m: v / total if total > 0 else 1 / len(w) for m, v in w.items()}
    parts = [f.select(ID, TIME, *[(F.lit(w[m]) * F.col(c)).alias(c) for c in columns]) for m, f in forecasts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(ID, TIME).agg(*[F.sum(c).alias(c) for c in columns])


def constrain(forecasts: DataFrame, floor: float | None = None, cap: float | None = None, capacity: str | None = None, total_cap: float | None = None, quantiles=(), value="forecast") -> DataFrame:
    """Floor and cap by row or by a capacity column; a cap on each period's total scales it down."""
    v = F.col(value)
    limit = F.least(*[c for c in (F.lit(cap) if cap is not None else None, F.col(capacity) if capacity else None, F.lit(None).cast("double"), F.lit(float("inf"))) if c is not None])
    v = F.least(v, limit)
    if floor is not None:
        v = F.greatest(v, F.lit(floor))
    out = forecasts.withColumn(value, v)
    if total_cap is not None:
        from pyspark.sql import Window as W

        total = F.sum(value).over(W.partitionBy(TIME))
        out = out.withColumn(value, F.when(total > total_cap, F.col(value) * total_cap / total).otherwise(F.col(value)))
        if floor is not None:
            out = out.withColumn(value, F.greatest(F.col(value), F.lit(floor)))
    for q in quantiles:
        c = F.col(q)
        c = F.least(c, F.lit(cap)) if cap is not None else c
        out = out.withColumn(q, F.greatest(c, F.lit(floor)) if floor is not None else c)
    return out


def monotone_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The row's quantile columns, in ascending order of their values."""
    ordered = F.sort_array(F.array(*columns))
    return df.withColumn("_s", ordered).withColumns({c: F.get("_s", F.lit(i)) for i, c in enumerate(columns)}).drop("_s")
