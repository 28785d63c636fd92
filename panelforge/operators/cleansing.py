"""Outliers, stock-outs, period exclusion: panel cleansing as windows, without joins on statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import calendar
from panelforge.operators.panel import ID, TIME, VALUE


def with_fences(df: DataFrame, k: float = 1.5, id_col=ID, value=VALUE) -> DataFrame:
    """Adds low and high, the series' quartiles widened by k interquartile ranges."""
    stats = df.groupBy(id_col).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    stats = stats.select(id_col, (low - k * (high - low)).alias("low"), (high + k * (high - low)).alias("high"))
    return df.join(stats, id_col, "left")


def outliers_iqr(df: DataFrame, k: float = 1.5, id_col=ID, value=VALUE) -> DataFrame:
    v = F.col(value)
    return with_fences(df, k, id_col, value).withColumn("is_outlier", F.coalesce((v < F.col("low")) | (v > F.col("high")), F.lit(False)))


def outliers_zscore(df: DataFrame, threshold: float = 3.0, id_col=ID, value=VALUE) -> DataFrame:
    w = W.partitionBy(id_col)
    sd = F.stddev_samp(value).over(w)
    z = F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(F.abs(F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0)))
    return df.withColumn("zscore", z).withColumn("is_outlier", F.coalesce(F.col("zscore") > threshold, F.lit(False)))


def detect_outliers(df: DataFrame, method: str = "iqr", **kw) -> DataFrame:
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method {method!r}")
    return outliers_iqr(df, **kw) if method == "iqr" else outliers_zscore(df, **kw)


def clip_outliers(df: DataFrame, k: float = 1.5, id_col=ID, value=VALUE, flag="is_outlier") -> DataFrame:
    """Flagged values are clamped to the quartile fences, whatever found them."""
    if "low" not in df.columns:
        df = with_fences(df, k, id_col, value)
    return df.withColumn(value, F.when(F.col(flag), F.greatest(F.col("low"), F.least(F.col("high"), F.col(value)))).otherwise(F.col(value))).drop("low", "high")


def interpolate_flagged(df: DataFrame, flag: str, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Flagged values on the line between unflagged neighbours; at the edges the nearest one."""
    w = W.partitionBy(id_col).orderBy(time)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_r", F.row_number().over(w)).withColumn("_v", F.when(~F.col(flag), F.col(value)))
    at = F.when(F.col("_v").isNotNull(), F.col("_r"))
    df = df.withColumns(
        {
            "_v0": F.last("_v", True).over(before),
            "_r0": F.last(at, True).over(before),
            "_v1": F.first("_v", True).over(after),
            "_r1": F.first(at, True).over(after),
        }
    )
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col("_r") - F.col("_r0"), F.col("_r1") - F.col("_r0"))
    out = F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.coalesce(line, F.col("_v0"), F.col("_v1")))
    return df.withColumn(value, out).drop("_r", "_v", "_v0", "_r0", "_v1", "_r1")


def detect_stockouts(df: DataFrame, min_run: int = 2, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Runs of at least min_run zeros that end before the series does; a last run is an end of life."""
    w = W.partitionBy(id_col).orderBy(time)
    df = df.withColumn("_z", F.coalesce(F.col(value) == 0, F.lit(False)))
    change = F.coalesce((F.col("_z") != F.lag("_z").over(w)).cast("int"), F.lit(1))
    df = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    one = W.partitionBy(id_col, "_run")
    last = F.max(time).over(one) < F.max(time).over(W.partitionBy(id_col))
    hit = F.col("_z") & (F.count("*").over(one) >= min_run) & last
    return df.withColumn("is_stockout", hit).drop("_z", "_c", "_run")


def seasonal_impute(df: DataFrame, flag="is_stockout", freq="W", id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Flagged values from one season earlier; if that is not positive, the mean of its neighbours.

    Days and weeks lie a fixed number of days apart: ranges of dates in the series' window, so a panel
    that is dealt by series stays where it is.  Months and quarters are looked up by a join.
    """
    season, days = calendar.frequency(freq).season, calendar.frequency(freq).days
    if freq in ("D", "W"):
        w = W.partitionBy(id_col).orderBy("_d")
        at = {k: w.rangeBetween(-(season + k) * days, -(season + k) * days) for k in (-1, 0, 1)}
        total, n = (sum(F.coalesce(f(value).over(at[k]), F.lit(0)) for k in (-1, 1)) for f in (F.sum, F.count))
        # as in a join on dates, a series or a date that is null meets nothing, nor does a time within a day
        known = F.col(id_col).isNotNull() & (F.col(time) == F.col(time).cast("date"))
        out = df.withColumn("_d", F.unix_date(F.col(time).cast("date")))
        out = out.withColumns({"_s": F.when(known, F.max(value).over(at[0])), "_n": F.when(known, F.try_divide(total, n))}).drop("_d")
    else:
        base = df.select(id_col, F.col(time).alias("_t"), F.col(value).alias("_v"))
        # each row offers itself to the dates one season later, and one period about them: one join instead of three
        offers = base.select(id_col, "_v", F.explode(F.array(*[F.struct(calendar.shift(F.col("_t"), season + k, freq).alias(time), F.lit(k).alias("k")) for k in (-1, 0, 1)])).alias("o"))
        offers = offers.select(id_col, F.col("o")[time].alias(time), F.col("o.k").alias("k"), "_v").groupBy(id_col, time).agg(
            F.max(F.when(F.col("k") == 0, F.col("_v"))).alias("_s"), F.avg(F.when(F.col("k") != 0, F.col("_v"))).alias("_n")
        )
        out = df.join(offers, [id_col, time], "left")
    new = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.coalesce("_n", value))
    return out.withColumn(value, F.when(F.col(flag), new).otherwise(F.col(value))).drop("_s", "_n")


def exclude_periods(df: DataFrame, periods: list[tuple[str, str]], action: str = "flag", id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Dates in closed ranges are dropped, interpolated or flagged (is_excluded)."""
    inside = F.lit(False)
    for a, b in periods:
        inside = inside | F.col(time).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    if action == "drop":
        return df.where(~inside)
    df = df.withColumn("is_excluded", inside)
    if action == "interpolate":
        return interpolate_flagged(df, "is_excluded", id_col, time, value)
    if action != "flag":
        raise ValueError(f"unknown action {action!r}")
    return df


def cleanse(df: DataFrame, method="iqr", action="clip", k=1.5, min_run=2, freq="W", impute="seasonal", periods=(), keep_flags=True, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Exclude periods, correct outliers, impute stock-outs; flags stay unless told otherwise."""
    if periods:
        df = exclude_periods(df, list(periods), "interpolate", id_col, time, value)
    df = detect_outliers(df, method, id_col=id_col, value=value)
    if action == "clip":
        df = clip_outliers(df, k, id_col, value)
    elif action == "interpolate":
        df = interpolate_flagged(df, "is_outlier", id_col, time, value)
    df = detect_stockouts(df.drop("low", "high", "zscore"), min_run, id_col, time, value)
    if impute == "seasonal":
        df = seasonal_impute(df, "is_stockout", freq, id_col, time, value)
    elif impute == "interpolate":
        df = interpolate_flagged(df, "is_stockout", id_col, time, value)
    return df if keep_flags else df.drop("is_outlier", "is_stockout", "is_excluded")


def cleansing_report(original: DataFrame, cleaned: DataFrame, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """One row of counts: series, outliers, stock-outs, values that changed (matched by key)."""
    old = original.select(id_col, time, F.col(value).alias("_old"))
    both = cleaned.join(old, [id_col, time], "left")
    return both.agg(
        F.countDistinct(id_col).alias("total_series"),
        F.count_if("is_outlier").alias("total_outliers"),
        F.countDistinct(F.when(F.col("is_outlier"), F.col(id_col))).alias("series_with_outliers"),
        F.count_if("is_stockout").alias("total_stockout_periods"),
        F.countDistinct(F.when(F.col("is_stockout"), F.col(id_col))).alias("series_with_stockouts"),
        F.count_if(~F.col(value).eqNullSafe(F.col("_old"))).alias("rows_modified"),
    )
