"""Building and shaping panels of time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import calendar

ID, TIME, VALUE = "series_id", "week", "quantity"


def series_id(columns: list[str], sep: str = "|") -> Column:
    """Grain columns joined into one id; null if any part is null."""
    anynull = F.lit(False)
    for c in columns:
        anynull = anynull | F.col(c).isNull()
    return F.when(~anynull, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))


def ensure_series_id(df: DataFrame, grain: list[str], id_col: str = ID, sep: str = "|") -> DataFrame:
    if id_col in df.columns:
        return df
    missing = [c for c in grain if c not in df.columns]
    if missing:
        raise ValueError(f"grain columns are missing: {missing}")
    return df.withColumn(id_col, series_id(grain, sep))


def build_panel(df: DataFrame, grain: list[str], date_col: str, target: str, freq: str = "W", where: Column | None = None, sep: str = "|") -> DataFrame:
    """Raw rows to one row per series and period: (series_id, week, quantity)."""
    if where is not None:
        df = df.where(where)
    keyed = df.select(series_id(grain, sep).alias(ID), calendar.period_start(F.col(date_col), freq).alias(TIME), F.col(target).cast("double").alias(VALUE))
    return keyed.groupBy(ID, TIME).agg(F.sum(VALUE).alias(VALUE))


def fill_gaps(df: DataFrame, freq: str = "W", strategy: str = "zero", fill: float = 0.0, per_series: bool = False, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Every series on the full grid of periods.

    The grid runs between the dates of the whole panel, or of each series with per_series.
    strategy: zero fills with `fill`; ffill carries values forward, then back at the start.
    Columns other than the target stay null on new rows.

    On the panel's grid a row is followed by the periods that are missing up to its series' next row:
    the rows are dealt by series once, and the grid, which may be many times larger, is never dealt.
    """
    if per_series:
        grid = df.groupBy(id_col).agg(F.min(time).alias("a"), F.max(time).alias("b")).select(id_col, F.explode(calendar.grid(F.col("a"), F.col("b"), freq)).alias(time))
        out = grid.join(df, [id_col, time], "left")
    else:
        out = on_grid(df, freq, id_col, time)
    if strategy == "zero":
        return out.withColumn(value, F.coalesce(value, F.lit(fill)))
    if strategy != "ffill":
        raise ValueError(f"unknown strategy {strategy!r}")
    return out.withColumn(value, carried(F.col(value), id_col, time))


def on_grid(df: DataFrame, freq: str, id_col=ID, time=TIME) -> DataFrame:
    """Every series on the grid of the whole panel, as a left join of the grid would give it: rows off the
    grid go, equal dates stay as many, and a null series has new rows only."""
    rest = [c for c in df.columns if c not in (id_col, time)]
    bounds = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    grid = bounds.select(calendar.grid(F.col("a"), F.col("b"), freq).alias("grid")).scalar()
    near = calendar.periods_between(F.get(grid, F.lit(0)), F.col(time), freq).cast("int")
    # a month's last days may lie a period further than they count
    place = F.when(F.get(grid, near) == F.col(time), near).when(F.get(grid, near + 1) == F.col(time), near + 1)
    df = df.withColumn("_i", F.coalesce(F.when(F.col(id_col).isNotNull(), place), F.lit(-1)))
    w = W.partitionBy(id_col).orderBy("_i")
    first, following = F.lag("_i").over(w).isNull(), F.coalesce(F.lead("_i").over(w), F.size(grid))
    df = df.withColumns({"_a": F.when(first, 0).otherwise(F.greatest("_i", F.lit(0))), "_b": F.greatest(following - 1, "_i")})
    df = df.where("_b >= _a").withColumn("_j", F.explode(F.sequence("_a", "_b")))
    return df.select(id_col, F.get(grid, F.col("_j")).alias(time), *[F.when(F.col("_j") == F.col("_i"), F.col(c)).alias(c) for c in rest])


def carried(value: Column, id_col=ID, time=TIME) -> Column:
    """Last value so far, or else the first to come."""
    w = W.partitionBy(id_col).orderBy(time)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return F.coalesce(back, ahead)


def drop_short(df: DataFrame, min_length: int, id_col=ID) -> DataFrame:
    n = F.count("*").over(W.partitionBy(id_col))
    return df.withColumn("_n", n).where(F.col("_n") >= min_length).drop("_n")


def drop_zero(df: DataFrame, id_col=ID, value=VALUE) -> DataFrame:
    total = F.sum(F.abs(F.col(value))).over(W.partitionBy(id_col))
    return df.withColumn("_t", total).where(F.col("_t") > 0).drop("_t")


def join_features(df: DataFrame, features: DataFrame, id_col=ID, time=TIME) -> DataFrame:
    """External features by (id, time), or by time alone; what is missing becomes 0."""
    on = [c for c in (id_col, time) if c in features.columns]
    extra = [c for c in features.columns if c not in on and c not in df.columns]
    out = df.join(features.select(*on, *extra), on, "left")
    numeric = {f.name for f in features.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal")}
    return out.select(*df.columns, *[F.coalesce(c, F.lit(0)).alias(c) if c in numeric else F.col(c) for c in extra])


def temporal_features(df: DataFrame, date_col: str = TIME) -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            "Year": F.year(d),
            "Month": F.month(d),
            "Day": F.dayofmonth(d),
            "DayOfWeek": F.weekday(d) + 1,
            "WeekOfYear": F.weekofyear(d),
            "Quarter": F.quarter(d),
            "IsWeekend": (F.weekday(d) >= 5).cast("int"),
            "IsMonthStart": (F.dayofmonth(d) == 1).cast("int"),
            "IsMonthEnd": (d == F.last_day(d)).cast("int"),
        }
    )


def lag_features(df: DataFrame, lags=(1, 7, 14, 30), group=ID, date_col=TIME, target=VALUE) -> DataFrame:
    w = W.partitionBy(group).orderBy(date_col)
    return df.withColumns({f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags})


def rolling_features(df: DataFrame, windows=(7, 14, 30), group=ID, date_col=TIME, target=VALUE) -> DataFrame:
    """Means and deviations of the `w` rows before each row: the row itself does not leak in."""
    out = {}
    for n in windows:
        w = W.partitionBy(group).orderBy(date_col).rowsBetween(-n, -1)
        out[f"{target}_rolling_mean_{n}"] = F.avg(target).over(w)
        out[f"{target}_rolling_std_{n}"] = F.stddev_samp(target).over(w)
    return df.withColumns(out)


def months_open(df: DataFrame, date_col: str, year_col: str, month_col: str, out: str = "CompetitionOpenMonths") -> DataFrame:
    """Whole months since a given year and month, not below 0; null where these are unknown."""
    n = 12 * (F.year(date_col) - F.col(year_col)) + (F.month(date_col) - F.col(month_col))
    return df.withColumn(out, F.when(n < 0, 0).otherwise(n))


def weeks_open(df: DataFrame, date_col: str, year_col: str, week_col: str, out: str = "Promo2OpenWeeks") -> DataFrame:
    n = 52 * (F.year(date_col) - F.col(year_col)) + (F.weekofyear(date_col) - F.col(week_col))
    return df.withColumn(out, F.when(n < 0, 0).otherwise(n))


def clean_retail(df: DataFrame, open_col="Open", sales="Sales", distance="CompetitionDistance") -> DataFrame:
    """Open days with sales; unknown distances get the median; other missing numbers 0."""
    kept = df.where((F.col(open_col) == 1) & (F.col(sales) > 0))
    middle = kept.agg(F.median(distance).alias("_m"))
    out = kept.join(F.broadcast(middle)).withColumn(distance, F.coalesce(distance, "_m")).drop("_m")
    numeric = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    return out.fillna(0, numeric)


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each value's rank among the column's distinct values, from 0."""
    for c in columns:
        codes = df.select(c).where(F.col(c).isNotNull()).distinct()
        codes = codes.withColumn(f"{c}_code", (F.dense_rank().over(W.orderBy(c)) - 1).cast("int"))
        df = df.join(codes, c, "left")
    return df


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], name="period", value=VALUE) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def resample(df: DataFrame, freq: str, id_col=ID, time=TIME, value=VALUE, dims: tuple[str, ...] = ()) -> DataFrame:
    """Coarser periods: sums of the target, the first value of dimensions."""
    out = df.withColumn("_t", calendar.period_start(F.col(time), freq))
    return out.groupBy(id_col, F.col("_t").alias(time)).agg(F.sum(value).alias(value), *[F.min_by(d, time).alias(d) for d in dims])


def repartition_by_series(df: DataFrame, id_col=ID) -> DataFrame:
    """One shuffle by series; adaptive execution sizes the partitions."""
    return df.repartition(id_col)


def period_gaps(df: DataFrame, freq: str = "W", id_col=ID, time=TIME) -> DataFrame:
    """Rows that follow their predecessor by other than one period."""
    w = W.partitionBy(id_col).orderBy(time)
    out = df.withColumn("gap_days", F.datediff(time, F.lag(time).over(w)))
    low, high = {"D": (1, 1), "W": (7, 7), "M": (28, 31), "Q": (89, 92)}[freq]
    return out.where(~F.col("gap_days").between(low, high))


def route_sparse(df: DataFrame, classes: DataFrame, id_col=ID) -> tuple[DataFrame, DataFrame]:
    """(dense, sparse) parts of a panel by the flag is_sparse of its classes."""
    sparse = classes.where("is_sparse").select(id_col)
    return df.join(sparse, id_col, "left_anti"), df.join(sparse, id_col, "left_semi")
