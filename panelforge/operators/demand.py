"""Demand classes, structural breaks, forecastability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.panel import ID, TIME, VALUE


def classify_demand(df: DataFrame, adi: float = 1.32, cv2: float = 0.49, min_periods: int = 10, min_nonzero: int = 2, id_col=ID, value=VALUE) -> DataFrame:
    """Smooth, intermittent, erratic or lumpy by interval and squared variation of non-zero demand."""
    nz = F.when(F.col(value) > 0, F.col(value))
    stats = df.groupBy(id_col).agg(F.count("*").alias("n"), F.count(nz).alias("nz"), F.avg(nz).alias("m"), F.stddev_pop(nz).alias("sd"))
    enough = (F.col("n") >= min_periods) & (F.col("nz") >= min_nonzero)
    a = F.when(enough, F.col("n") / F.nullif("nz", F.lit(0)))
    c = F.when(enough, (F.col("sd") / F.nullif("m", F.lit(0.0))) * (F.col("sd") / F.nullif("m", F.lit(0.0))))
    out = stats.select(id_col, a.alias("adi"), c.alias("cv2"))
    name = (
        F.when(F.col("adi").isNull(), "insufficient_data")
        .when((F.col("adi") < adi) & (F.col("cv2") < cv2), "smooth")
        .when((F.col("adi") >= adi) & (F.col("cv2") < cv2), "intermittent")
        .when(F.col("adi") < adi, "erratic")
        .otherwise("lumpy")
    )
    return out.withColumn("demand_class", name).withColumn("is_sparse", F.coalesce(F.col("adi") >= adi, F.lit(False)))


def cusum_breaks(y: np.ndarray, min_segment: int = 13, penalty: float = 3.0, most: int = 5) -> list[int]:
    """Binary segmentation on the largest gap of means, against the spread within the two parts."""
    found: list[int] = []
    todo = [(0, len(y))]
    while todo and len(found) < most:
        a, b = todo.pop()
        n = b - a
        if n < 2 * min_segment:
            continue
        part = y[a:b]
        size = np.arange(min_segment, n - min_segment + 1)
        total = np.cumsum(part)
        gap = np.abs(total[size - 1] / size - (total[-1] - total[size - 1]) / (n - size))
        at = int(gap.argmax())
        if gap[at] <= 0:
            continue
        cut = int(size[at])
        spread = max((part[:cut].std() * cut + part[cut:].std() * (n - cut)) / n, 1e-9)
        if gap[at] > penalty * spread:
            found.append(a + cut)
            todo += [(a + cut, b), (a, a + cut)]  # the left part is looked at first
    return found


def detect_breaks(df: DataFrame, min_segment=13, penalty=3.0, most=5, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """(series_id, break_date, break_index) of every break; series too short have none."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("y"))))
    hist = df.groupBy(id_col).agg(pairs.alias("p")).select(id_col, F.col("p.t").alias("t"), F.col("p.y").alias("y"))

    def run(batches):
        for pdf in batches:
            yield pdf[[id_col, "t"]].assign(at=[cusum_breaks(np.asarray(y, float), min_segment, penalty, most) for y in pdf["y"]])

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in hist.schema.fields if f.name != "y"], T.StructField("at", T.ArrayType(T.IntegerType()))])
    out = hist.mapInPandas(run, schema)
    return out.select(id_col, "t", F.explode("at").alias("break_index")).select(id_col, F.get("t", F.col("break_index")).alias("break_date"), "break_index")


def best_split(df: DataFrame, min_segment: int = 13, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """The first split of binary segmentation, in windows: per series the cut with the largest gap of means."""
    w = W.partitionBy(id_col).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(id_col)
    out = df.withColumns({"_i": F.count("*").over(w), "_s": F.coalesce(F.sum(value).over(w), F.lit(0.0)), "_n": F.count("*").over(every), "_t": F.sum(value).over(every)})
    out = out.where((F.col("_i") >= min_segment) & (F.col("_n") - F.col("_i") >= min_segment))
    gap = F.abs(F.col("_s") / F.nullif("_i", F.lit(0)) - (F.col("_t") - F.col("_s")) / F.nullif(F.col("_n") - F.col("_i"), F.lit(0)))
    out = out.withColumn("gap", gap)
    r = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc(F.round("gap", 6)), time))
    return out.withColumn("_r", r).where("_r = 1").select(id_col, F.col(time).alias("split_date"), F.col("_i").alias("split_index"), "gap")


def truncate_to_last_break(df: DataFrame, breaks: DataFrame, id_col=ID, time=TIME) -> DataFrame:
    """Rows after each series' last break; all of them if none would be left."""
    last = breaks.groupBy(id_col).agg(F.max("break_date").alias("_b"))
    out = df.join(last, id_col, "left")
    some = F.max(F.col(time)).over(W.partitionBy(id_col)) > F.col("_b")
    out = out.withColumn("_k", F.col("_b").isNull() | ~some | (F.col(time) > F.col("_b")))
    return out.where("_k").drop("_b", "_k")


# ------------------------------------------------------------------ forecastability
def variation(df: DataFrame, id_col=ID, value=VALUE) -> DataFrame:
    return df.groupBy(id_col).agg(F.try_divide(F.stddev_samp(value), F.nullif(F.abs(F.avg(value)), F.lit(0.0))).alias("cv"))


def trend_strength(df: DataFrame, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """R squared of the values on their position."""
    r = F.row_number().over(W.partitionBy(id_col).orderBy(time)).cast("double")
    return df.withColumn("_r", r).groupBy(id_col).agg(F.coalesce(F.regr_r2(value, "_r"), F.lit(0.0)).alias("trend_strength"))


def seasonal_strength(df: DataFrame, season: int = 52, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """One less the share of variance left around the means by position in the season."""
    r = F.row_number().over(W.partitionBy(id_col).orderBy(time)) - 1
    out = df.withColumn("_p", r % season)
    out = out.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy(id_col, "_p")))
    share = F.try_divide(F.var_pop("_d"), F.nullif(F.var_pop(value), F.lit(0.0)))
    n = F.count("*")
    return out.groupBy(id_col).agg(F.when(n < 2 * season, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(share, F.lit(1.0)))).alias("seasonal_strength"))


def signal_to_noise(df: DataFrame, season: int = 52, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Variance of a centred moving average over the variance of what it leaves; at most 100."""
    half = season // 2
    w = W.partitionBy(id_col).orderBy(time).rowsBetween(-half, half)
    out = df.withColumn("_s", F.when(F.count("*").over(w) == 2 * half + 1, F.avg(value).over(w)))
    noise = F.var_pop(F.when(F.col("_s").isNotNull(), F.col(value) - F.col("_s")))
    return out.groupBy(id_col).agg(F.least(F.lit(100.0), F.when(noise <= 1e-12, 100.0).otherwise(F.try_divide(F.var_pop("_s"), noise))).alias("snr"))


def approximate_entropy(y: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    n = len(y)
    sd = y.std()
    if n < m + 2 or sd == 0:
        return 0.0

    def phi(k):
        x = np.lib.stride_tricks.sliding_window_view(y, k)
        near = (np.abs(x[:, None] - x[None]).max(2) <= r * sd).mean(1)
        return np.log(near).mean()

    return float(abs(phi(m) - phi(m + 1)))


def spectral_entropy(y: np.ndarray) -> float:
    """Entropy of the detrended power spectrum, between 0 (a tone) and 1 (noise)."""
    n = len(y)
    if n < 4 or y.std() == 0:
        return 1.0
    x = np.arange(n)
    d = y - np.polyval(np.polyfit(x, y, 1), x)
    p = np.abs(np.fft.rfft(d))[1:] ** 2
    if p.sum() <= 0:
        return 1.0
    p = p / p.sum()
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / np.log(max(2, n // 2)))


def entropies(df: DataFrame, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("y"))))
    hist = df.groupBy(id_col).agg(pairs.alias("p")).select(id_col, F.col("p.y").alias("y"))
    kind = dict(hist.dtypes)[id_col]

    def run(batches):
        for pdf in batches:
            ys = [np.asarray(y, float) for y in pdf["y"]]
            yield pdf[[id_col]].assign(approximate_entropy=[approximate_entropy(y) for y in ys], spectral_entropy=[spectral_entropy(y) for y in ys])

    return hist.mapInPandas(run, f"{id_col} {kind}, approximate_entropy double, spectral_entropy double")


def forecastability(df: DataFrame, season: int = 52) -> DataFrame:
    """All signals of each series, their weighted score and its band."""
    out = variation(df)
    for part in (entropies(df), signal_to_noise(df, season), trend_strength(df), seasonal_strength(df, season)):
        out = out.join(part, ID)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = (
        0.25 * unit(1 - F.col("spectral_entropy"))
        + 0.20 * unit(1 - F.coalesce("cv", F.lit(1.0)) / 2)
        + 0.20 * unit(F.col("snr") / (1 + F.col("snr")))
        + 0.15 * unit(1 - F.col("approximate_entropy") / 2)
        + 0.10 * F.col("trend_strength")
        + 0.10 * F.col("seasonal_strength")
    )
    return out.withColumn("score", score).withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")
