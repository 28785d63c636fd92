"""External regressors: holidays, screening, validation, future values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import calendar
from panelforge.functions.metrics import pearson
from panelforge.operators.panel import ID, TIME, VALUE


def holiday_calendar(holidays: DataFrame, start: str, end: str, freq: str = "W", date_col: str = "date", time=TIME) -> DataFrame:
    """(week, holiday_count, is_holiday): holidays in each period; the holidays are given as data."""
    spark = holidays.sparkSession
    first = F.to_date(F.date_trunc({"D": "day", "W": "week", "M": "month", "Q": "quarter"}[freq], F.lit(start).cast("date")))
    grid = spark.range(1).select(F.explode(calendar.grid(first, F.lit(end).cast("date"), freq)).alias(time))
    n = holidays.select(calendar.period_start(F.col(date_col), freq).alias(time)).groupBy(time).agg(F.count("*").alias("holiday_count"))
    out = grid.join(n, time, "left").withColumn("holiday_count", F.coalesce("holiday_count", F.lit(0)))
    return out.withColumn("is_holiday", (F.col("holiday_count") > 0).cast("int"))


def screen_variance(df: DataFrame, columns: list[str], low: float = 1e-6) -> DataFrame:
    """(column, variance, keep) in one pass."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns])
    return row.select(F.explode(items).alias("x")).select("x.*").withColumn("keep", F.coalesce(F.col("variance") >= low, F.lit(False)))


def screen_correlation(df: DataFrame, columns: list[str], high: float = 0.95) -> DataFrame:
    """Pairs so correlated that one could go; a warning only."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("x")).select("x.*").where(F.abs("r") >= high)


def mutual_information(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """Mutual information of the two, each cut into bins of equal width: an estimate from counts."""
    b = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((column, target)) for n, f in (("a", F.min), ("b", F.max))])

    def cut(c, i):
        span = F.nullif(F.col(f"b{i}") - F.col(f"a{i}"), F.lit(0))
        return F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"a{i}")) * bins, span), F.lit(0.0)))).alias("xy"[i])

    x = df.join(F.broadcast(b)).where(F.col(column).isNotNull() & F.col(target).isNotNull()).select(cut(column, 0), cut(target, 1))
    c = x.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    w = lambda *k: W.partitionBy(*k)
    c = c.withColumn("nx", F.sum("n").over(w("x"))).withColumn("ny", F.sum("n").over(w("y"))).withColumn("t", F.sum("n").over(w(F.lit(0))))
    return c.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def screen(df: DataFrame, columns: list[str], target: str, low=1e-6, min_mi=0.0) -> list[str]:
    """The columns worth keeping: with variance, and with information about the target."""
    kept = [r.column for r in screen_variance(df, columns, low).where("keep").collect()]
    if min_mi > 0:
        kept = [c for c in kept if (mutual_information(df, c, target).first().mi or 0) >= min_mi]
    return kept


def validate_regressors(features: DataFrame, actuals: DataFrame, columns: list[str], horizon: int = 0, freq="W", future_known=(), id_col=ID, time=TIME) -> DataFrame:
    """(rule, n) at fault: nulls, missing periods, missing series, future periods without values of known features."""
    rules = []
    n = features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rules.append(n.select(F.explode(F.array(*[F.struct(F.lit(f"null:{c}").alias("rule"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*"))
    on = [c for c in (id_col, time) if c in features.columns]
    lost = actuals.select(*on).distinct().join(features.select(*on).distinct(), on, "left_anti")
    rules.append(lost.agg(F.lit("uncovered_rows").alias("rule"), F.count("*").alias("n")))
    if id_col in features.columns:
        gone = actuals.select(id_col).distinct().join(features.select(id_col).distinct(), id_col, "left_anti")
        rules.append(gone.agg(F.lit("uncovered_series").alias("rule"), F.count("*").alias("n")))
    if future_known and horizon:
        last = actuals.agg(F.max(time).alias("last"))
        end = features.agg(F.max(time).alias("end")).join(F.broadcast(last))
        rules.append(end.select(F.lit("short_future").alias("rule"), F.greatest(F.lit(0), F.datediff(calendar.shift(F.col("last"), horizon, freq), F.col("end"))).cast("long").alias("n")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def detect_features(df: DataFrame, id_col=ID, time=TIME, value=VALUE) -> list[str]:
    """Numeric columns beside id, time and target."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, k in df.dtypes if c not in (id_col, time, value) and k.split("(")[0] in kinds]


def prepare_fit(df: DataFrame, columns: list[str], id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    return df.select(id_col, time, value, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def future_features(df: DataFrame, columns: list[str], horizon: int, freq="W", known: DataFrame | None = None, id_col=ID, time=TIME) -> DataFrame:
    """Each series' next periods with its last values, or with the given ones where known."""
    last = df.groupBy(id_col).agg(F.max(time).alias("_l"), *[F.max_by(c, time).alias(c) for c in columns])
    out = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(time, calendar.shift(F.col("_l"), F.col("step"), freq)).drop("_l")
    if known is not None:
        cols = [c for c in columns if c in known.columns]
        on = [c for c in (id_col, time) if c in known.columns]
        out = out.join(known.select(*on, *[F.col(c).alias(f"_k_{c}") for c in cols]), on, "left")
        out = out.withColumns({c: F.coalesce(f"_k_{c}", c) for c in cols}).drop(*[f"_k_{c}" for c in cols])
    return out
