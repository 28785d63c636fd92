"""Tests and intervals: sums and ranks in Spark, tail probabilities of the one-row results as plain numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions import distributions as D
from panelforge.functions.metrics import two_sided_p


def proportion_test(df: DataFrame, group: str, a, b, success) -> DataFrame:
    """(p_a, p_b, diff, z, p_value): pooled two-proportion z test of a condition between two groups."""
    hit = success.cast("long")
    row = df.agg(*[f.alias(n) for n, f in (("xa", F.sum(F.when(F.col(group) == a, hit))), ("na", F.count_if(F.col(group) == a)), ("xb", F.sum(F.when(F.col(group) == b, hit))), ("nb", F.count_if(F.col(group) == b)))])
    pa, pb = F.col("xa") / F.nullif("na", F.lit(0)), F.col("xb") / F.nullif("nb", F.lit(0))
    pool = (F.col("xa") + F.col("xb")) / F.nullif(F.col("na") + F.col("nb"), F.lit(0))
    se = F.sqrt(pool * (1 - pool) * (1 / F.nullif("na", F.lit(0)) + 1 / F.nullif("nb", F.lit(0))))
    out = row.select(pa.alias("p_a"), pb.alias("p_b"), (pa - pb).alias("diff"), F.try_divide(pa - pb, F.nullif(se, F.lit(0.0))).alias("z"))
    return out.withColumn("p_value", two_sided_p(F.col("z")))


def mean_test(df: DataFrame, group: str, a, b, value: str) -> DataFrame:
    """(mean_a, mean_b, t, df, cohen_d): Welch's test between two groups."""
    row = df.groupBy().agg(
        *[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{s}") for s, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    ea, eb = F.col("va") / F.nullif("na", F.lit(0)), F.col("vb") / F.nullif("nb", F.lit(0))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.nullif(F.sqrt(ea + eb), F.lit(0.0)))
    dof = F.try_divide((ea + eb) * (ea + eb), F.nullif(ea * ea / F.nullif(F.col("na") - 1, F.lit(0)) + eb * eb / F.nullif(F.col("nb") - 1, F.lit(0)), F.lit(0.0)))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(F.col("na") + F.col("nb") - 2, F.lit(0)))
    return row.select(F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), t.alias("t"), dof.alias("df"), F.try_divide(F.col("ma") - F.col("mb"), F.nullif(pooled, F.lit(0.0))).alias("cohen_d"))


def mean_test_p(df: DataFrame, group: str, a, b, value: str) -> dict:
    r = mean_test(df, group, a, b, value).first().asDict()
    return r | {"p_value": D.t_two_sided(r["t"], r["df"]) if r["t"] is not None and r["df"] else None}


def mann_whitney(df: DataFrame, group: str, a, b, value: str) -> DataFrame:
    """(u, z, p_value) from average ranks; ties correct the variance.

    Ranks come from counts by distinct value, so equal values never gather in one task as rows.
    """
    c = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count("*").alias("n"))
    w = W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    s = c.agg(F.sum(F.col("rank") * F.col("na")).alias("ra"), F.sum("na").alias("na"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    nb = F.col("n") - F.col("na")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    n = F.col("n").cast("double")
    var = F.col("na").cast("double") * nb / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    out = s.select(u.alias("u"), F.try_divide(u - F.col("na").cast("double") * nb / 2, F.nullif(F.sqrt(var), F.lit(0.0))).alias("z"))
    return out.withColumn("p_value", two_sided_p(F.col("z")))


def mean_interval(df: DataFrame, value: str, confidence: float = 0.95) -> dict:
    r = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n")).first()
    if not r.n or r.n < 2:
        return {"mean": r.m, "low": None, "high": None, "n": r.n}
    half = D.t_ppf(0.5 + confidence / 2, r.n - 1) * r.s / math.sqrt(r.n)
    return {"mean": r.m, "low": r.m - half, "high": r.m + half, "n": r.n}


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof, n, cramers_v) of a cross table, from its counts and margins."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = c.groupBy(a).agg(F.sum("o").alias("ra")), c.groupBy(b).agg(F.sum("o").alias("rb"))
    t = c.agg(F.sum("o").alias("n"))
    # absent cells add their expectation: sum of o^2/e over present cells, less n
    cells = c.join(ra, a).join(rb, b).join(F.broadcast(t))
    s = cells.agg((F.sum(F.col("o").cast("double") * F.col("o") * F.col("n") / (F.col("ra").cast("double") * F.col("rb"))) - F.max("n")).alias("chi2"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.max("n").alias("n"))
    k = F.least("ka", "kb") - 1
    return s.select("chi2", ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), "n", F.sqrt(F.try_divide("chi2", F.nullif(F.col("n") * k, F.lit(0)))).alias("cramers_v"))


def chi_squared_p(df: DataFrame, a: str, b: str) -> dict:
    r = chi_squared(df, a, b).first().asDict()
    return r | {"p_value": D.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else None}


def bootstrap(df: DataFrame, value: str, statistic=np.mean, rounds: int = 1000, confidence: float = 0.95, seed: int = 7, blocks: int = 64) -> DataFrame:
    """(estimate, low, high) by a bag of little bootstraps: each block of rows is resampled to full size `rounds` times.

    Blocks hold their rows' values only, and their number grows with the rows.
    """
    n = df.where(F.col(value).isNotNull()).count()
    blocks = max(1, min(n // 50 or 1, max(blocks, n // 100_000)))
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).alias("b"))

    def run(pdf):
        rng = np.random.default_rng(seed + int(pdf["b"].iloc[0]))
        v = pdf["v"].to_numpy()
        made = []
        for _ in range(rounds):
            pick = rng.multinomial(n, np.full(len(v), 1 / len(v)))
            made.append(statistic(np.repeat(v, pick)) if statistic is not np.mean else float(pick @ v / n))
        tail = (1 - confidence) / 2
        import pandas as pd

        return pd.DataFrame({"estimate": [float(statistic(v))], "low": [float(np.quantile(made, tail))], "high": [float(np.quantile(made, 1 - tail))]})

    return rows.groupBy("b").applyInPandas(run, "estimate double, low double, high double").agg(F.avg("estimate").alias("estimate"), F.avg("low").alias("low"), F.avg("high").alias("high"))


def adjust_p(df: DataFrame, p: str = "p", method: str = "bh", blocks: int = 64) -> DataFrame:
    """p_adjusted by Bonferroni, Holm or Benjamini-Hochberg; null where p is null, which counts as no test.

    Ranks come from counts by distinct value.  The values are dealt in order to `blocks` ranges, and
    only one row a range is summed over all of them, so no task holds the whole column.
    """
    if method not in ("bonferroni", "holm", "bh"):
        raise ValueError(f"unknown method {method!r}")
    v = F.col("_p")
    bounds = df.select(F.col(p).cast("double").alias("_p")).approxQuantile("_p", [i / blocks for i in range(1, blocks)], 0.001)
    block = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= v.cast("double"))) if bounds else F.lit(0)
    c = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_b", block)

    every, rows = W.orderBy("_b"), (W.unboundedPreceding, W.unboundedFollowing)
    sums = c.groupBy("_b").agg(F.sum("_n").alias("_n"))
    sums = sums.select("_b", F.sum("_n").over(every.rowsBetween(*rows)).alias("_m"), F.coalesce(F.sum("_n").over(every.rowsBetween(rows[0], -1)), F.lit(0)).alias("_before"))
    own = W.partitionBy("_b").orderBy("_p")
    c = c.join(F.broadcast(sums), "_b").withColumn("_r", F.col("_before") + F.sum("_n").over(own.rowsBetween(rows[0], 0)))
    if method == "bonferroni":
        c = c.withColumn("_v", v * F.col("_m"))
    else:
        # equal p-values take the value of their first rank (Holm) or of their last (Benjamini-Hochberg)
        holm = method == "holm"
        c = c.withColumn("_v", v * (F.col("_m") - F.col("_r") + F.col("_n")) if holm else v * F.col("_m") / F.col("_r"))
        best, pick = (F.max, F.greatest) if holm else (F.min, F.least)
        ends = c.groupBy("_b").agg(best("_v").alias("_v"))
        ends = ends.select("_b", best("_v").over(every.rowsBetween(rows[0], -1) if holm else every.rowsBetween(1, rows[1])).alias("_others"))
        c = c.withColumn("_v", best("_v").over(own.rowsBetween(rows[0], 0) if holm else own.rowsBetween(0, rows[1])))
        c = c.join(F.broadcast(ends), "_b").withColumn("_v", pick("_v", "_others"))
    c = c.select("_p", F.least(F.lit(1.0), "_v").alias("p_adjusted"))
    return df.join(c, F.col(p) == v, "left").drop("_p")


def characterise(df: DataFrame, value: str, bins: int = 20) -> dict:
    """Moments, Jarque-Bera normality and the number of modes of a histogram."""
    v = F.col(value).cast("double")
    r = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), F.min(v).alias("a"), F.max(v).alias("b")).first().asDict()
    if not r["n"] or r["a"] == r["b"]:
        return r | {"normal_p": None, "modes": min(1, r["n"] or 0)}
    jb = r["n"] / 6 * (r["skew"] ** 2 + r["kurt"] ** 2 / 4)
    width = (r["b"] - r["a"]) / bins
    h = df.where(v.isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((v - r["a"]) / width)).alias("i")).count().collect()
    c = np.zeros(bins + 2)
    for x in h:
        c[int(x.i) + 1] = x["count"]
    c[1:-1] = np.convolve(c, [0.25, 0.5, 0.25], "valid")
    top = (c[1:-1] > c[:-2]) & (c[1:-1] >= c[2:]) & (c[1:-1] > 0.05 * c.max())
    return r | {"normal_p": D.chi2_sf(jb, 2), "modes": int(top.sum())}


def rank_dimensions(df: DataFrame, metric: str, dimensions: list[str]) -> DataFrame:
    """(dimension, eta2, f, n_groups): the share of variance that each dimension explains; groups of two rows or more."""
    m = F.col(metric).cast("double")
    long = df.where(m.isNotNull()).select(m.alias("v"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("g")) for d in dimensions])).alias("x")).select("v", "x.*").where("g IS NOT NULL")
    g = long.groupBy("dimension", "g").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).where("n >= 2")
    t = g.groupBy("dimension").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    ssb, sst = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = F.try_divide(ssb / F.nullif(F.col("k") - 1, F.lit(0)), F.nullif((sst - ssb) / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0)))
    return t.select("dimension", F.try_divide(ssb, F.nullif(sst, F.lit(0.0))).alias("eta2"), f.alias("f"), F.col("k").alias("n_groups"))


def paired_test(df: DataFrame, errors_a: str, errors_b: str) -> DataFrame:
    """(mean_difference, t, n) of two models' absolute errors on the same rows."""
    d = F.abs(errors_a) - F.abs(errors_b)
    r = df.agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("s"), F.count(d).alias("n"))
    return r.select("mean_difference", F.try_divide("mean_difference", F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).alias("t"), "n")


# ------------------------------------------------------------------ plain planning arithmetic
def sample_size_proportion(rate: float, effect: float, alpha=0.05, power=0.8) -> int:
    p2 = rate + effect
    z = D.normal_ppf(1 - alpha / 2) + D.normal_ppf(power)
    return math.ceil(z * z * (rate * (1 - rate) + p2 * (1 - p2)) / effect**2)


def sample_size_mean(std: float, effect: float, alpha=0.05, power=0.8) -> int:
    z = D.normal_ppf(1 - alpha / 2) + D.normal_ppf(power)
    return math.ceil(2 * (z * std / effect) ** 2)


def detectable_effect(n: int, rate: float | None = None, std: float | None = None, alpha=0.05, power=0.8) -> float:
    z = D.normal_ppf(1 - alpha / 2) + D.normal_ppf(power)
    return z * math.sqrt(2 * (rate * (1 - rate) if rate is not None else std * std) / n)


def significance_label(p: float | None, alpha: float = 0.05) -> str:
    return "unknown" if p is None else f"{'significant' if p < alpha else 'not significant'} (p = {p:.4f})"


def effect_label(d: float) -> str:
    return "negligible" if abs(d) < 0.2 else "small" if abs(d) < 0.5 else "medium" if abs(d) < 0.8 else "large"
