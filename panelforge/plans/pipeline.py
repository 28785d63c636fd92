"""The two drivers: series building with backtest, and forecasting with a champion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import calendar
from panelforge.operators import cleansing, demand, evaluation, panel, transition
from panelforge.plans import backtest, models


@dataclass
class Config:
    frequency: str = "W"
    horizon: int = 13
    n_folds: int = 3
    forecasters: tuple[str, ...] = ("naive_seasonal", "moving_average")
    sparse_forecasters: tuple[str, ...] = ("croston_sba", "tsb")
    min_length: int | None = None
    drop_zero: bool = True
    gap_strategy: str = "zero"
    cleanse: bool = False
    truncate_breaks: bool = False
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    horizon_buckets: dict = field(default_factory=dict)


def build_series(df: DataFrame, config: Config, features: DataFrame | None = None, plans: DataFrame | None = None) -> DataFrame:
    """Transitions, gap fill, breaks, cleansing, length and zero filters, features: one lazy plan."""
    if plans is not None:
        df = transition.stitch_series(df, plans)
    df = panel.fill_gaps(df, config.frequency, config.gap_strategy)
    if config.truncate_breaks:
        df = demand.truncate_to_last_break(df, demand.detect_breaks(df))
    if config.cleanse:
        df = cleansing.cleanse(df, freq=config.frequency, keep_flags=False)
    df = panel.drop_short(df, config.min_length or calendar.frequency(config.frequency).min_length)
    if config.drop_zero:
        df = panel.drop_zero(df)
    return panel.join_features(df, features) if features is not None else df


@dataclass
class BacktestResult:
    records: DataFrame
    scores: DataFrame
    leaderboard: DataFrame
    champions: DataFrame
    weights: DataFrame


def run_backtest(df: DataFrame, config: Config, **build) -> BacktestResult:
    """Dense series meet the dense models, sparse ones the intermittent models."""
    series = build_series(df, config, **build)
    dense, sparse = panel.route_sparse(series, demand.classify_demand(series))
    rows = backtest.run_backtest(dense, list(config.forecasters), config.n_folds, config.horizon, config.frequency)
    if config.sparse_forecasters:
        rows = rows.unionByName(backtest.run_backtest(sparse, list(config.sparse_forecasters), config.n_folds, config.horizon, config.frequency))
    scores = backtest.series_scores(rows)
    return BacktestResult(rows, scores, backtest.leaderboard(scores), backtest.champions(scores), backtest.ensemble_weights(scores))


def run_forecast(df: DataFrame, champion: str | DataFrame, config: Config, correction: DataFrame | None = None, **build) -> DataFrame:
    """The champion's forecast with quantiles; a table of champions by bucket stitches their steps."""
    series = build_series(df, config, **build)
    if not isinstance(champion, str):
        names = [r.model_id for r in champion.select("model_id").distinct().collect()]
        out = None
        for n in names:
            f = models.forecast(n, series, config.horizon, freq=config.frequency).withColumnsRenamed({"model": "model_id", "step": "forecast_step"}).select(panel.ID, panel.TIME, "forecast_step", "forecast", "model_id")
            out = f if out is None else out.unionByName(f)
        return backtest.stitch_horizons(out, champion, config.horizon_buckets)
    out = models.forecast(champion, series, config.horizon, freq=config.frequency)
    qs = list(config.quantiles)
    quantiles = models.croston_quantiles(series, config.horizon, qs, freq=config.frequency) if champion.startswith("croston") else models.naive_quantiles(series, config.horizon, qs, freq=config.frequency)
    out = out.join(quantiles.drop("step"), [panel.ID, panel.TIME], "left")
    out = models.monotone_quantiles(out, [models.quantile_name(q) for q in qs])
    return evaluation.apply_conformal(out, correction, qs, champion) if correction is not None else out.withColumn("model", F.lit(champion))
