"""Walk-forward evaluation: folds, scoring, leaderboards, champions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import calendar
from panelforge.functions.metrics import METRICS
from panelforge.operators.panel import ID, TIME, VALUE
from panelforge.plans import models

#: The canonical columns of a metric record.
METRIC_SCHEMA = (
    "run_id string, run_type string, run_date date, lob string, model_id string, fold int, grain_level string, series_id string, channel string, "
    "target_week date, forecast_step int, actual double, forecast double, wmape double, normalized_bias double, mape double, mae double, rmse double, mase double"
)


def folds(panel: DataFrame, n_folds: int = 3, horizon: int = 13, freq: str = "W", min_train: int = 52, time=TIME) -> DataFrame:
    """(fold, train_start, train_end, val_start, val_end), counted back from the last date.

    Fold numbers are positions from the earliest; a fold whose training part would be shorter
    than min_train periods is left out and its number stays unused.
    """
    bounds = panel.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    out = bounds.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    back = (F.lit(n_folds - 1) - F.col("fold")) * horizon
    out = out.withColumn("val_end", calendar.shift(F.col("b"), -back, freq))
    out = out.withColumn("val_start", calendar.shift(F.col("val_end"), 1 - horizon, freq)).withColumn("train_end", calendar.shift(F.col("val_start"), -1, freq))
    out = out.where(calendar.periods_between(F.col("a"), F.col("train_end"), freq) + 1 >= min_train)
    return out.select("fold", F.col("a").alias("train_start"), "train_end", "val_start", "val_end")


def split(panel: DataFrame, fold_rows: DataFrame, time=TIME) -> tuple[DataFrame, DataFrame]:
    """(train, validation), each row once per fold it belongs to; folds are a handful of rows."""
    f = F.broadcast(fold_rows)
    train = panel.join(f, (F.col(time) >= F.col("train_start")) & (F.col(time) <= F.col("train_end"))).select("fold", *panel.columns)
    val = panel.join(f, (F.col(time) >= F.col("val_start")) & (F.col(time) <= F.col("val_end"))).select("fold", "val_start", *panel.columns)
    return train, val


def naive_mae(panel: DataFrame, season: int, keys=(ID,), time=TIME, value=VALUE) -> DataFrame:
    """In-sample mean absolute seasonal difference of each series."""
    w = W.partitionBy(*keys).orderBy(time)
    d = panel.withColumn("_d", F.abs(F.col(value) - F.lag(value, season).over(w)))
    return d.groupBy(*keys).agg(F.avg("_d").alias("naive_mae"))


def mase(scores: DataFrame, scale: DataFrame, keys=(ID,)) -> DataFrame:
    """MAE over the in-sample naive MAE; null where that is unknown or 0."""
    out = scores.join(scale, list(keys), "left")
    return out.withColumn("mase", F.try_divide("mae", F.nullif("naive_mae", F.lit(0.0)))).drop("naive_mae")


def predictions(panel: DataFrame, fold_rows: DataFrame, names: list[str], horizon: int, freq: str = "W", **options) -> DataFrame:
    """Forecasts of every model for every fold: (model_id, fold, series_id, week, step, forecast).

    All folds of a model are one job: the fold is part of the group key.
    """
    train, _ = split(panel, fold_rows)
    out = None
    for name in names:
        f = models.forecast(name, train, horizon, freq=freq, keep=("fold",), **options)
        f = f.select(F.col("model").alias("model_id"), "fold", ID, TIME, "step", "forecast")
        out = f if out is None else out.unionByName(f)
    return out


def scored(panel: DataFrame, predicted: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Predictions with their actuals, joined once on (fold, series, date)."""
    _, val = split(panel, fold_rows)
    actual = val.select("fold", ID, TIME, F.col(VALUE).alias("actual"))
    return predicted.join(actual, ["fold", ID, TIME]).withColumnRenamed("step", "forecast_step")


def metric_rows(rows: DataFrame, names=("wmape", "normalized_bias", "mape", "mae", "rmse"), keys=("model_id", "fold", ID)) -> DataFrame:
    """Each row with the metrics of its series, model and fold."""
    w = W.partitionBy(*keys)
    return rows.withColumns({n: over(METRICS[n], w) for n in names})


def over(metric, w) -> Column:
    """A metric as window aggregate: its sums and means run over w."""
    a, f = F.col("actual"), F.col("forecast")
    total = F.nullif(F.sum(F.abs(a)).over(w), F.lit(0.0))
    ape = F.when(a != 0, F.abs(a - f) / F.nullif(F.abs(a), F.lit(0.0)))
    built = {
        METRICS["wmape"]: F.try_divide(F.sum(F.abs(a - f)).over(w), total),
        METRICS["normalized_bias"]: F.coalesce(F.try_divide(F.sum(f - a).over(w), total), F.lit(0.0)),
        METRICS["mape"]: F.avg(ape).over(w),
        METRICS["mae"]: F.avg(F.abs(a - f)).over(w),
        METRICS["rmse"]: F.sqrt(F.avg((a - f) * (a - f)).over(w)),
    }
    return built[metric]


def series_scores(rows: DataFrame, names=("wmape", "normalized_bias", "mape", "mae", "rmse"), keys=("model_id", "fold", ID)) -> DataFrame:
    a, f = F.col("actual"), F.col("forecast")
    return rows.groupBy(*keys).agg(*[METRICS[n](a, f).alias(n) for n in names], F.count("*").alias("n_obs"), F.sum("actual").alias("volume"))


def run_backtest(panel: DataFrame, names: list[str], n_folds=3, horizon=13, freq="W", **options) -> DataFrame:
    """The canonical metric records of a backtest."""
    fold_rows = folds(panel, n_folds, horizon, freq)
    rows = metric_rows(scored(panel, predictions(panel, fold_rows, names, horizon, freq, **options), fold_rows))
    train, _ = split(panel, fold_rows)
    scale = naive_mae(train, calendar.frequency(freq).season, ("fold", ID))
    rows = mase(rows, scale, ("fold", ID))
    have = {"target_week": F.col(TIME), "run_type": F.lit("backtest"), "run_date": F.lit(dt.date.today())}
    cols = []
    for field in METRIC_SCHEMA.split(", "):
        name, kind = field.split()
        source = have.get(name, F.col(name) if name in rows.columns else F.lit(None))
        cols.append(source.cast(kind).alias(name))
    return rows.select(*cols)


def leaderboard(scores: DataFrame, primary="wmape", secondary="normalized_bias") -> DataFrame:
    """Mean metrics and series of each model, ranked; undefined metrics last."""
    out = scores.groupBy("model_id").agg(F.avg(primary).alias(primary), F.avg(secondary).alias(secondary), F.countDistinct(ID).alias("n_series"))
    return out.withColumn("rank", F.rank().over(W.orderBy(F.asc_nulls_last(primary))))


def accuracy_over_time(rows: DataFrame, model_id: str | None = None, metric="wmape", time="target_week") -> DataFrame:
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    return rows.groupBy("model_id", time).agg(F.avg(metric).alias(metric))


def accuracy_by(rows: DataFrame, grain: str, metric="wmape") -> DataFrame:
    return rows.groupBy(grain).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.countDistinct(ID).alias("n_series"))


def model_by_fold(scores: DataFrame, metric="wmape") -> DataFrame:
    return scores.groupBy("model_id", "fold").agg(F.avg(metric).alias(metric))


def bias_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy(ID).agg(F.avg("normalized_bias").alias("mean_bias"), F.stddev_samp("normalized_bias").alias("std_bias"), F.avg("wmape").alias("mean_wmape"))


def transition_impact(scores: DataFrame, old: str, new: str, metric="wmape") -> DataFrame:
    return scores.where(F.col(ID).isin(old, new)).groupBy(ID, "model_id").agg(F.avg(metric).alias(metric))


def backtest_vs_live(backtest: DataFrame, live: DataFrame, metric="wmape") -> DataFrame:
    """Both means per model in one pass over the stacked records."""
    both = backtest.select("model_id", F.col(metric).alias("b"), F.lit(None).cast("double").alias("l")).unionByName(live.select("model_id", F.lit(None).cast("double").alias("b"), F.col(metric).alias("l")))
    out = both.groupBy("model_id").agg(F.avg("b").alias("backtest"), F.avg("l").alias("live"))
    return out.withColumn("gap", F.col("live") - F.col("backtest"))


def champions(scores: DataFrame, group: list[str] | None = None, primary="wmape", secondary="normalized_bias") -> DataFrame:
    """The best model of each group (of all, without group) by mean primary, then absolute secondary."""
    group = group or []
    means = scores.groupBy(*group, "model_id").agg(F.avg(primary).alias(primary), F.avg(secondary).alias(secondary))
    if not group:
        return means.orderBy(F.asc_nulls_last(primary), F.asc_nulls_last(F.abs(secondary)), "model_id").limit(1)
    w = W.partitionBy(*group).orderBy(F.asc_nulls_last(primary), F.asc_nulls_last(F.abs(F.col(secondary))), "model_id")
    return means.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def horizon_bucket(buckets: dict[str, tuple[int, int]], step="forecast_step") -> Column:
    """The bucket of a step; where buckets overlap, the later one."""
    out = F.lit(None).cast("string")
    for name, (low, high) in buckets.items():
        out = F.when(F.col(step).between(low, high), F.lit(name)).otherwise(out)
    return out


def champions_by_horizon(rows: DataFrame, buckets: dict[str, tuple[int, int]], group: list[str] | None = None) -> DataFrame:
    rows = rows.withColumn("bucket", horizon_bucket(buckets)).where("bucket IS NOT NULL")
    keys = ["model_id", "bucket", *(group or [])]
    scores = series_scores(rows, ("wmape", "normalized_bias"), tuple(keys))
    return champions(scores, ["bucket", *(group or [])])


def stitch_horizons(forecasts: DataFrame, chosen: DataFrame, buckets: dict[str, tuple[int, int]], group: list[str] | None = None) -> DataFrame:
    """Each step's forecast from the champion of its bucket (and group)."""
    out = forecasts.withColumn("bucket", horizon_bucket(buckets))
    return out.join(chosen.select("bucket", "model_id", *(group or [])), ["bucket", "model_id", *(group or [])])


def ensemble_weights(scores: DataFrame, metric="wmape") -> DataFrame:
    """Weights that go as the inverse of the mean metric and sum to 1."""
    out = scores.groupBy("model_id").agg(F.avg(metric).alias("m")).where("m IS NOT NULL")
    out = out.withColumn("raw", F.when(F.col("m") <= 1e-9, 1e9).otherwise(1 / F.nullif("m", F.lit(0.0))))
    total = out.agg(F.sum("raw").alias("total"))
    return out.join(F.broadcast(total)).select("model_id", (F.col("raw") / F.col("total")).alias("weight"))


def compare_models(rows: DataFrame) -> DataFrame:
    """All registered metrics of each model over all rows."""
    return rows.groupBy("model_id").agg(*[m(F.col("actual"), F.col("forecast")).alias(n) for n, m in METRICS.items()])
