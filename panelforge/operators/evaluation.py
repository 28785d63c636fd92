"""Calibration, value added, drift, comparison, exceptions, explanation of forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.metrics import fva_class, mae, normalized_bias, slope, wmape
from panelforge.operators.panel import ID, TIME, VALUE
from panelforge.plans.models import quantile_name

# ------------------------------------------------------------------ calibration


def interval_coverage(rows: DataFrame, low: str, high: str, actual="actual") -> DataFrame:
    """Share of actuals inside the interval, 0 for no rows."""
    inside = F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double"))
    return rows.agg(F.coalesce(inside, F.lit(0.0)).alias("coverage"), F.count("*").alias("n"))


def interval_pairs(quantiles: list[float]) -> list[tuple[str, float, str, str]]:
    """(label, nominal, low column, high column) of symmetric quantiles."""
    out = []
    for q in sorted(q for q in quantiles if q < 0.5):
        if any(abs(1 - q - p) < 1e-9 for p in quantiles):
            nominal = round(1 - 2 * q, 6)
            out.append((f"{int(round(nominal * 100))}", nominal, quantile_name(q), quantile_name(1 - q)))
    return out


def stacked_intervals(rows: DataFrame, quantiles: list[float], actual="actual") -> DataFrame:
    items = [F.struct(F.lit(n).alias("label"), F.lit(p).alias("nominal"), F.col(a).alias("low"), F.col(b).alias("high")) for n, p, a, b in interval_pairs(quantiles)]
    return rows.withColumn("i", F.explode(F.array(*items))).select("model_id", ID, F.col(actual).alias("actual"), "i.*")


def calibration_report(rows: DataFrame, quantiles: list[float]) -> DataFrame:
    """Coverage and sharpness of each model and interval, overall (series_id null) and by series, in one pass."""
    x = stacked_intervals(rows, quantiles)
    out = x.groupingSets([["model_id", "label", "nominal"], ["model_id", "label", "nominal", ID]], "model_id", "label", "nominal", ID).agg(
        F.avg(F.col("actual").between(F.col("low"), F.col("high")).cast("double")).alias("e"), F.avg(F.col("high") - F.col("low")).alias("s"), F.count("*").alias("n")
    )
    return out.select("model_id", "label", "nominal", ID, F.round("e", 4).alias("empirical"), F.round(F.col("e") - F.col("nominal"), 4).alias("miscalibration"), F.round("s", 2).alias("sharpness"), "n")


def conformal_scores(rows: DataFrame, quantiles: list[float]) -> DataFrame:
    """How far each actual lies outside its interval; negative inside."""
    x = stacked_intervals(rows, quantiles)
    return x.withColumn("score", F.greatest(F.col("low") - F.col("actual"), F.col("actual") - F.col("high")))


def conformal_correction(scores: DataFrame) -> DataFrame:
    """(model_id, label, correction): the score at rank ceil((n + 1) * nominal), clamped to 1..n.

    Found by ranks within each model and interval, so no list of scores is gathered.
    """
    keys = ["model_id", "label", "nominal"]
    w = W.partitionBy(*keys).orderBy("score")
    x = scores.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.col("nominal"))))
    return x.where(F.col("r") == k).select("model_id", "label", F.col("score").alias("correction"))


def apply_conformal(forecasts: DataFrame, correction: DataFrame, quantiles: list[float], model_id: str) -> DataFrame:
    """Both ends of each interval move out by its correction."""
    wide = correction.where(F.col("model_id") == model_id).agg(*[F.max(F.when(F.col("label") == n, F.col("correction"))).alias(f"c{n}") for n, *_ in interval_pairs(quantiles)])
    out = forecasts.join(F.broadcast(wide))
    for n, _, a, b in interval_pairs(quantiles):
        c = F.coalesce(f"c{n}", F.lit(0.0))
        out = out.withColumn(a, F.col(a) - c).withColumn(b, F.col(b) + c).drop(f"c{n}")
    return out


# ------------------------------------------------------------------ forecast value added
#: The layer of each model; others are of the layer ml.
MODEL_LAYERS = {
    "naive_seasonal": "naive", "last_value": "naive", "auto_arima": "statistical", "auto_ets": "statistical", "auto_theta": "statistical", "mstl": "statistical",
    "croston": "statistical", "croston_sba": "statistical", "tsb": "statistical", "moving_average": "statistical", "holt_winters": "statistical", "theta_ses": "statistical",
    "decomposition_drift": "statistical", "autoregression": "statistical", "lgbm_direct": "ml", "xgboost_direct": "ml", "gbt_direct": "ml", "weighted_ensemble": "ml", "override": "override",
}
LAYER_ORDER = ("naive", "statistical", "ml", "override")


def model_layer(model: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODEL_LAYERS.items() for x in kv])
    return F.coalesce(F.element_at(table, model), F.lit("ml"))


def layer_rank(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LAYER_ORDER]), layer)


def layer_metrics(rows: DataFrame) -> DataFrame:
    """(layer, wmape, normalized_bias, mae) of rows (layer, actual, forecast)."""
    a, f = F.col("actual"), F.col("forecast")
    return rows.groupBy("layer").agg(wmape(a, f).alias("wmape"), normalized_bias(a, f).alias("normalized_bias"), mae(a, f).alias("mae"))


def fva_cascade(rows: DataFrame) -> DataFrame:
    """Each layer's metrics and what it adds over the layer before it."""
    m = layer_metrics(rows).withColumn("ord", layer_rank(F.col("layer")))
    w = W.orderBy("ord")  # at most one row a layer
    out = m.withColumn("parent", F.lag("layer").over(w)).withColumn("fva_wmape", F.lag("wmape").over(w) - F.col("wmape"))
    out = out.withColumn("fva_bias", F.lag(F.abs("normalized_bias")).over(w) - F.abs("normalized_bias"))
    return out.withColumn("fva_class", F.when(F.col("parent").isNull(), "BASELINE").otherwise(fva_class(F.col("fva_wmape")))).drop("ord")


def total_fva(rows: DataFrame) -> DataFrame:
    m = layer_metrics(rows).withColumn("ord", layer_rank(F.col("layer")))
    return m.agg((F.min_by("wmape", "ord") - F.max_by("wmape", "ord")).alias("total_fva"))


def fva_detail(scores: DataFrame) -> DataFrame:
    """Per series and fold: the best model of each layer and what the layer adds.

    scores: (model_id, fold, series_id, wmape, volume).
    """
    x = scores.withColumn("layer", model_layer(F.col("model_id")))
    best = x.groupBy(ID, "fold", "layer").agg(F.min("wmape").alias("wmape"), F.min_by("model_id", F.struct("wmape", "model_id")).alias("model_id"), F.max("volume").alias("volume"))
    w = W.partitionBy(ID, "fold").orderBy(layer_rank(F.col("layer")))
    out = best.withColumn("parent_layer", F.lag("layer").over(w)).withColumn("parent_wmape", F.lag("wmape").over(w))
    fva = F.when(F.col("parent_layer").isNotNull(), F.col("parent_wmape") - F.col("wmape")).otherwise(0.0)
    return out.withColumn("fva_wmape", fva).withColumn("fva_class", F.when(F.col("parent_layer").isNull(), "BASELINE").otherwise(fva_class(F.col("fva_wmape"))))


def fva_summary(detail: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    x = detail.where("parent_layer IS NOT NULL")
    n = F.count("*")
    count = lambda c: F.count_if(F.col("fva_class") == c)
    return x.groupBy(*by).agg(
        n.alias("n"),
        count("ADDS_VALUE").alias("n_adds"),
        count("NEUTRAL").alias("n_neutral"),
        count("DESTROYS_VALUE").alias("n_destroys"),
        F.round(100.0 * count("ADDS_VALUE") / n, 1).alias("pct_adds"),
        F.avg("fva_wmape").alias("mean_fva"),
        F.avg("wmape").alias("mean_wmape"),
        F.sum("volume").alias("volume"),
    )


def layer_leaderboard(detail: DataFrame) -> DataFrame:
    """Mean value added and its robustness by layer, with a recommendation."""
    x = detail.where("parent_layer IS NOT NULL").groupBy("layer").agg(F.avg("fva_wmape").alias("mean_fva"), F.round(100.0 * F.count_if(F.col("fva_wmape") > 0) / F.count("*"), 1).alias("robustness_pct"))
    x = x.withColumn("recommendation", F.when(F.col("robustness_pct") >= 60, "Keep").when(F.col("robustness_pct") >= 30, "Review").otherwise("Remove"))
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_fva"), "layer")))


# ------------------------------------------------------------------ drift
def drift_windows(rows: DataFrame, recent: int = 8, baseline: int = 26, time="target_week") -> DataFrame:
    """Per series: sums over its last `recent` rows and the `baseline` rows before them."""
    r = F.row_number().over(W.partitionBy(ID).orderBy(F.desc(time)))
    x = rows.withColumn("r", r).where(F.col("r") <= recent + baseline).withColumn("new", F.col("r") <= recent)
    a, f = F.col("actual"), F.col("forecast")
    pick = lambda c, new: F.when(F.col("new") == F.lit(new), c)
    aggs = []
    for name, new in (("r", True), ("b", False)):
        aggs += [
            F.count(pick(a, new)).alias(f"n_{name}"),
            F.sum(pick(F.abs(a - f), new)).alias(f"err_{name}"),
            F.sum(pick(F.abs(a), new)).alias(f"abs_{name}"),
            F.sum(pick(f - a, new)).alias(f"bias_{name}"),
            F.avg(pick(a, new)).alias(f"mean_{name}"),
            F.stddev_samp(pick(a, new)).alias(f"sd_{name}"),
        ]
    return x.groupBy(ID).agg(*aggs)


def drift_alerts(rows: DataFrame, recent=8, baseline=26, min_baseline=4, time="target_week") -> DataFrame:
    """(series_id, signal, severity, value): accuracy, bias and volume alerts, critical ones first by number."""
    x = drift_windows(rows, recent, baseline, time)
    ok = F.col("n_b") >= min_baseline
    wr, wb = F.try_divide("err_r", F.nullif("abs_r", F.lit(0.0))), F.try_divide("err_b", F.nullif("abs_b", F.lit(0.0)))
    ratio = F.when(ok & (wb > 0), F.try_divide(wr, F.nullif(wb, F.lit(0.0))))
    bias = F.abs(F.try_divide("bias_r", F.nullif("abs_r", F.lit(0.0))))
    z = F.when(ok & (F.col("sd_b") > 0), F.abs(F.col("mean_r") - F.col("mean_b")) / F.nullif("sd_b", F.lit(0.0)))
    grade = lambda v, high, low: F.when(v > high, "critical").when(v > low, "warning")
    items = F.array(
        F.struct(F.lit("accuracy").alias("signal"), grade(ratio, 1.5, 1.25).alias("severity"), ratio.alias("value")),
        F.struct(F.lit("bias").alias("signal"), grade(bias, 0.25, 0.10).alias("severity"), bias.alias("value")),
        F.struct(F.lit("volume").alias("signal"), grade(z, 3.0, 2.0).alias("severity"), z.alias("value")),
    )
    out = x.select(ID, F.explode(items).alias("i")).select(ID, "i.*").where("severity IS NOT NULL")
    return out.withColumn("severity_order", F.when(F.col("severity") == "critical", 0).otherwise(1))


def model_drift(backtest: DataFrame, live: DataFrame, metric="wmape", recent_weeks: int = 8, min_weeks: int = 4, time="target_week") -> DataFrame:
    """Per model: mean of its recent live weeks over its backtest mean, with a status."""
    weekly = live.groupBy("model_id", time).agg(F.avg(metric).alias("m"))
    r = F.row_number().over(W.partitionBy("model_id").orderBy(F.desc(time)))
    now = weekly.withColumn("r", r).where(F.col("r") <= recent_weeks).groupBy("model_id").agg(F.avg("m").alias("live"), F.count("*").alias("weeks"))
    out = backtest.groupBy("model_id").agg(F.avg(metric).alias("backtest")).join(now, "model_id", "left")
    out = out.withColumn("ratio", F.try_divide("live", F.nullif("backtest", F.lit(0.0))))
    status = F.when(F.coalesce("weeks", F.lit(0)) < min_weeks, "insufficient").when(F.col("ratio") <= 1.25, "ok").when(F.col("ratio") <= 1.5, "warning").otherwise("alert")
    return out.withColumn("status", status)


def model_cards(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_id").agg(F.avg("wmape").alias("mean_wmape"), F.avg("normalized_bias").alias("mean_bias"), F.countDistinct(ID).alias("n_series"), F.sum("n_obs").alias("n_obs"))


# ------------------------------------------------------------------ comparison and exceptions
def compare_forecasts(model: DataFrame, externals: dict[str, DataFrame], prior: DataFrame | None = None, value="forecast") -> DataFrame:
    """The model beside other forecasts: gaps, their percentages, change since the prior cycle, uncertainty."""
    out = model.withColumnRenamed(value, "model_forecast")
    m = F.col("model_forecast")
    if {"forecast_p10", "forecast_p90"} <= set(out.columns):
        out = out.withColumn("uncertainty_ratio", F.when(m > 0, (F.col("forecast_p90") - F.col("forecast_p10")) / F.nullif(m, F.lit(0.0))))
    others = [(n, f"{n}_forecast", f"{n}_gap", f"{n}_gap_pct", d) for n, d in externals.items()]
    if prior is not None:
        others.append(("prior", "prior_model_forecast", "cycle_change", "cycle_change_pct", prior))
    for _, c, gap, pct, d in others:
        out = out.join(d.select(ID, TIME, F.col(value).alias(c)), [ID, TIME], "left")
        base = F.nullif(F.abs(F.col(c)), F.lit(0.0))
        out = out.withColumn(gap, m - F.col(c)).withColumn(pct, F.try_divide(m - F.col(c), base) * 100.0)
    return out


def comparison_summary(comparison: DataFrame) -> DataFrame:
    cols = [c for c in comparison.columns if c.endswith(("_gap", "_gap_pct")) or c in ("cycle_change", "cycle_change_pct", "uncertainty_ratio")]
    return comparison.groupBy(ID).agg(*[F.avg(c).alias(c) for c in cols])


def exception_flags(comparison: DataFrame, cycle=20.0, uncertainty=0.5, disagree=25.0, over=30.0, under=-30.0) -> DataFrame:
    """Six rules; a rule whose input is missing does not fire, one whose input is null does not either."""
    have = set(comparison.columns)
    pct = [F.col(c) for c in comparison.columns if c.endswith("_gap_pct")]
    some = lambda tests: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)) if tests else F.lit(False)
    flags = {
        "exc_large_cycle_change": some([F.abs("cycle_change_pct") > cycle] if "cycle_change_pct" in have else []),
        "exc_high_uncertainty": some([F.col("uncertainty_ratio") > uncertainty] if "uncertainty_ratio" in have else []),
        "exc_field_disagree": some([F.abs(c) > disagree for c in pct]),
        "exc_overforecast": some([c > over for c in pct]),
        "exc_underforecast": some([c < under for c in pct]),
        "exc_no_prior": F.col("prior_model_forecast").isNull() if "prior_model_forecast" in have else F.lit(False),
    }
    out = comparison.withColumns(flags)
    return out.withColumn("has_exception", reduce(lambda a, b: a | b, [F.col(c) for c in flags]))


def exception_summary(flagged: DataFrame) -> DataFrame:
    cols = [c for c in flagged.columns if c.startswith("exc_") or c == "has_exception"]
    return flagged.groupBy(ID).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in cols])


# ------------------------------------------------------------------ explanation
def decompose(df: DataFrame, season: int = 52, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Trend (a centred mean, null at the edges), seasonal (mean deviation by position) and residual."""
    half = season // 2
    w = W.partitionBy(id_col).orderBy(time)
    span = w.rowsBetween(-half, half)
    x = df.withColumn("trend", F.when(F.count("*").over(span) == 2 * half + 1, F.avg(value).over(span))).withColumn("_p", (F.row_number().over(w) - 1) % season)
    x = x.withColumn("seasonal", F.coalesce(F.avg(F.col(value) - F.col("trend")).over(W.partitionBy(id_col, "_p")), F.lit(0.0)))
    return x.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def decompose_forecast(history: DataFrame, forecasts: DataFrame, season: int = 52, tail: int = 12) -> DataFrame:
    """Forecasts split as the last trend plus its slope, the position's season, and what is left."""
    x = decompose(history, season)
    r = F.row_number().over(W.partitionBy(ID).orderBy(F.desc(TIME)))
    known = x.where("trend IS NOT NULL").withColumn("_r", r).where(F.col("_r") <= tail)
    line = known.groupBy(ID).agg(F.max_by("trend", TIME).alias("level"), F.coalesce(slope("trend", -F.col("_r")), F.lit(0.0)).alias("slope"))
    n = history.groupBy(ID).agg(F.count("*").alias("n"))
    seas = x.groupBy(ID, "_p").agg(F.max("seasonal").alias("seasonal"))
    out = forecasts.join(line, ID).join(n, ID).withColumn("_p", (F.col("n") + F.col("step") - 1) % season).join(seas, [ID, "_p"], "left")
    out = out.withColumn("trend", F.col("level") + F.col("slope") * F.col("step")).withColumn("seasonal", F.coalesce("seasonal", F.lit(0.0)))
    return out.withColumn("residual", F.col("forecast") - F.col("trend") - F.col("seasonal")).drop("level", "slope", "n", "_p")


def narrative(comparison: DataFrame, history: DataFrame) -> DataFrame:
    """One sentence a series: the forecast against the same weeks a year before, and its uncertainty."""
    ahead = comparison.groupBy(ID).agg(F.sum("model_forecast").alias("f"), F.min(TIME).alias("a"), F.max(TIME).alias("b"), (F.avg("uncertainty_ratio") if "uncertainty_ratio" in comparison.columns else F.lit(None).cast("double")).alias("u"))
    past = history.join(ahead.select(ID, "a", "b"), ID).where((F.col(TIME) >= F.date_sub("a", 364)) & (F.col(TIME) <= F.date_sub("b", 364))).groupBy(ID).agg(F.sum(VALUE).alias("y"))
    x = ahead.join(past, ID, "left").withColumn("yoy", F.try_divide(F.col("f") - F.col("y"), F.nullif("y", F.lit(0.0))) * 100)
    head = F.when(F.col("yoy").isNull(), F.lit("No year-ago base")).otherwise(F.format_string("%+.1f%% against a year ago", "yoy"))
    tail = F.when(F.col("u").isNotNull(), F.format_string("; uncertainty band %.0f%%", F.col("u") * 100)).otherwise("")
    return x.select(ID, F.concat(head, tail).alias("narrative"))


def top_features(contributions: DataFrame, k: int = 5, keys=(ID, TIME)) -> DataFrame:
    """The k largest absolute contributions (feature, value) of each row."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.abs("value")), "feature"))
    return contributions.withColumn("rank", r).where(F.col("rank") <= k)
