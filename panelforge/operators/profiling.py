"""Profiles of columns and frames, and tie-out of two frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.metrics import pearson, slope
from panelforge.operators.validation import NUMERIC


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k.split("(")[0] in NUMERIC]


def distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a numeric column: moments, percentiles, outliers, shape; columns are stacked and grouped once."""
    columns = columns or numeric_columns(df)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL AND NOT isnan(v)")
    qs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    s = long.groupBy("column").agg(
        F.count("*").alias("n"), F.countDistinct("v").alias("n_unique"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("q"), F.skewness("v").alias("g"), F.kurtosis("v").alias("k"),
    )
    s = s.select("*", *[F.col("q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(qs)]).drop("q")
    n = F.col("n").cast("double")
    # sample-adjusted skewness, and excess kurtosis on the scale of the sample variance
    s = s.withColumn("skewness", F.when((n > 2) & (F.col("std") > 0), F.col("g") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))
    s = s.withColumn("kurtosis", F.when((n > 3) & (F.col("std") > 0), (F.col("k") + 3) * ((n - 1) / n) * ((n - 1) / n) - 3)).drop("g", "k")
    fence = long.join(F.broadcast(s.select("column", "p25", "p75")), "column")
    iqr = F.col("p75") - F.col("p25")
    out = fence.groupBy("column").agg(F.count_if((F.col("v") < F.col("p25") - 1.5 * iqr) | (F.col("v") > F.col("p75") + 1.5 * iqr)).alias("n_outliers"))
    shape = F.when(F.col("n_unique") <= 1, "constant").when(F.abs("skewness") < 0.5, "symmetric").when(F.col("skewness") > 0, "right-skewed").otherwise("left-skewed")
    advice = F.when((F.col("skewness") > 1) & (F.col("min") >= 0), "log1p").when(F.abs("skewness") > 1, "yeo-johnson").otherwise("none")
    return s.join(out, "column").withColumn("shape", shape).withColumn("transform", advice)


def correlations(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Pairs with an absolute Pearson correlation at the threshold or over it, on complete rows, in one pass."""
    columns = columns or numeric_columns(df)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = rows.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    out = row.select(F.explode(items).alias("x")).select("x.*").where(F.abs("r") >= threshold)
    return out.withColumn("strength", F.when(F.abs("r") >= 0.7, "strong").otherwise("moderate"))


def temporal_profile(df: DataFrame, date_col: str, metric: str, step_days: int = 1) -> DataFrame:
    """Coverage of the calendar, gaps over 1.5 steps, trend and the share of weekday variation."""
    days = df.groupBy(F.col(date_col).cast("date").alias("d")).agg(F.sum(metric).alias("v"))
    w = W.orderBy("d")  # one row a day
    days = days.withColumn("gap", F.datediff("d", F.lag("d").over(w))).withColumn("i", F.row_number().over(w))
    out = days.agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n_dates"),
        F.count_if(F.col("gap") > 1.5 * step_days).alias("n_gaps"),
        F.coalesce(slope("v", "i"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_r2("v", "i"), F.lit(0.0)).alias("trend_r2"),
    )
    out = out.withColumn("coverage_pct", F.round(100.0 * F.col("n_dates") / (F.datediff("last", "first") / step_days + 1), 2))
    week = days.groupBy(F.weekday("d").alias("wd")).agg(F.avg("v").alias("m")).agg(F.try_divide(F.stddev_samp("m"), F.nullif(F.abs(F.avg("m")), F.lit(0.0))).alias("weekday_cv"))
    return out.join(F.broadcast(week)).withColumn("is_seasonal", F.col("weekday_cv") > 0.2)


def weekday_pattern(df: DataFrame, date_col: str, metric: str) -> DataFrame:
    return df.groupBy((F.weekday(F.col(date_col)) + 1).alias("weekday")).agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def month_pattern(df: DataFrame, date_col: str, metric: str) -> DataFrame:
    return df.groupBy(F.month(date_col).alias("month")).agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def frame_profile(df: DataFrame, label: str) -> DataFrame:
    """(label, measure, value): rows, and each column's nulls, distinct values, sum or date bounds."""
    aggs = {"rows": F.count("*").cast("double")}
    for c, kind in df.dtypes:
        aggs[f"{c}.nulls"] = F.count_if(F.col(c).isNull()).cast("double")
        aggs[f"{c}.distinct"] = F.countDistinct(c).cast("double")
        if kind.split("(")[0] in NUMERIC:
            aggs[f"{c}.sum"] = F.sum(F.col(c).cast("double"))
        elif kind.startswith(("date", "timestamp")):
            aggs[f"{c}.min"] = F.min(F.unix_date(F.col(c).cast("date"))).cast("double")
            aggs[f"{c}.max"] = F.max(F.unix_date(F.col(c).cast("date"))).cast("double")
    row = df.agg(*[v.alias(f"m{i}") for i, v in enumerate(aggs.values())])
    items = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m{i}").alias("value")) for i, k in enumerate(aggs)])
    return row.select(F.lit(label).alias("label"), F.explode(items).alias("x")).select("label", "x.*")


def tie_out(source: DataFrame, target: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Every measure of both frames with PASS, WARN (within ten tolerances) or FAIL."""
    a = frame_profile(source, "source").select("measure", F.col("value").alias("source"))
    b = frame_profile(target, "target").select("measure", F.col("value").alias("target"))
    out = a.join(b, "measure", "full")
    gap = F.abs(F.coalesce("source", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)))
    limit = F.when(F.col("measure").endswith(".sum"), F.greatest(F.lit(0.01), tolerance * F.abs(F.coalesce("source", F.lit(0.0))))).otherwise(F.lit(0.0))
    status = F.when(F.col("source").isNull() != F.col("target").isNull(), "FAIL").when(gap <= limit, "PASS").when(gap <= 10 * limit, "WARN").otherwise("FAIL")
    return out.withColumn("gap", gap).withColumn("status", status)


def gate(results: DataFrame) -> DataFrame:
    """The worst status and the number of each."""
    out = results.agg(F.count_if(F.col("status") == "FAIL").alias("n_fail"), F.count_if(F.col("status") == "WARN").alias("n_warn"), F.count("*").alias("n"))
    return out.withColumn("decision", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))


def outlier_rate(df: DataFrame, column: str, method: str = "iqr", k: float = 1.5, z: float = 3.0) -> DataFrame:
    v = F.col(column).cast("double")
    s = df.agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"))
    x = df.select(v.alias("v")).where("v IS NOT NULL").join(F.broadcast(s))
    iqr = F.col("q")[1] - F.col("q")[0]
    out = (F.col("v") < F.col("q")[0] - k * iqr) | (F.col("v") > F.col("q")[1] + k * iqr) if method == "iqr" else F.abs(F.col("v") - F.col("m")) > z * F.col("sd")
    r = x.agg(F.count("*").alias("n"), F.count_if(out).alias("n_outliers"))
    r = r.withColumn("rate", F.coalesce(F.try_divide("n_outliers", F.nullif("n", F.lit(0))), F.lit(0.0)))
    return r.withColumn("status", F.when(F.col("rate") > 0.05, "FAIL").when(F.col("n_outliers") > 0, "WARN").otherwise("PASS"))


def dq_series(df: DataFrame, id_col="series_id", time="week", value="quantity", days: int = 7) -> DataFrame:
    """Per series: length, moments, zero and missing shares."""
    v = F.col(value)
    out = df.groupBy(id_col).agg(
        F.count("*").alias("n_weeks"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (100.0 * F.count_if(v == 0) / F.count("*")).alias("zero_pct"),
        (F.datediff(F.max(time), F.min(time)) / days + 1).cast("long").alias("expected"),
    )
    return out.withColumn("missing_pct", 100.0 * (1 - F.col("n_weeks") / F.col("expected"))).withColumn("cv", F.try_divide("std", F.nullif(F.abs("mean"), F.lit(0.0)))).drop("expected")


def dq_report(df: DataFrame, min_length: int = 52, id_col="series_id", time="week", value="quantity") -> DataFrame:
    """One row over all series, from one row a series."""
    s = df.groupBy(id_col).agg(F.count("*").alias("n"), F.min(time).alias("a"), F.max(time).alias("b"), F.count_if(F.col(value) == 0).alias("z"), F.sum(F.abs(F.col(value))).alias("t"))
    e = F.datediff("b", "a") / 7 + 1
    return s.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_series"), F.min("a").alias("first"), F.max("b").alias("last"),
        F.round(100.0 * (1 - F.sum("n") / F.sum(e)), 4).alias("missing_pct"),
        F.count_if(F.col("n") < e).alias("n_gappy"), F.count_if(F.col("n") < min_length).alias("n_short"), F.count_if(F.col("t") == 0).alias("n_zero"),
        F.count_if(F.col("z") > 0.5 * F.col("n")).alias("n_zero_inflated"),
    )
