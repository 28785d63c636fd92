"""Hierarchies: paths, roll-ups, disaggregation and reconciliation.

A hierarchy is the table of distinct level paths, from the root's level to the leaves'.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import calendar


def paths(df: DataFrame, levels: list[str]) -> DataFrame:
    """One row per leaf; where a leaf has several parents, the least path."""
    leaf = levels[-1]
    rows = df.select(*levels).where(F.col(leaf).isNotNull())
    return rows.groupBy(leaf).agg(F.min(F.struct(*levels)).alias("p")).select("p.*")


def parent_child(path: DataFrame, parent: str, child: str) -> DataFrame:
    return path.select(F.col(parent).alias("parent"), F.col(child).alias("child")).distinct()


def nodes(path: DataFrame, levels: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("node_level"), F.col(n).cast("string").alias("node_key")) for n in levels])
    return path.select(F.explode(items).alias("n")).select("n.*").distinct()


def summing_matrix(path: DataFrame, levels: list[str]) -> DataFrame:
    """(node_level, node_key, leaf_key) for every node and each leaf under it: the matrix in long form."""
    items = F.array(*[F.struct(F.lit(n).alias("node_level"), F.col(n).cast("string").alias("node_key")) for n in levels])
    return path.select(F.col(levels[-1]).cast("string").alias("leaf_key"), F.explode(items).alias("n")).select("n.*", "leaf_key").distinct()


def functional_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(child, parent, holds) for all column pairs: each child value has exactly one parent value."""
    pairs = [(c, p) for c in columns for p in columns if c != p]
    out = None
    for c, p in pairs:
        one = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct(p).alias("_n")).agg(F.max("_n").alias("m"))
        one = one.select(F.lit(c).alias("child"), F.lit(p).alias("parent"), (F.col("m") == 1).alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out


def roll_up(df: DataFrame, path: DataFrame, levels: list[str], target: str, values: list[str], time: str, how: str = "sum") -> DataFrame:
    agg = {"sum": F.sum, "mean": F.avg}[how]
    leaf = levels[-1]
    rows = df.join(path.select(*dict.fromkeys([leaf, target])), leaf)
    return rows.groupBy(target, time).agg(*[agg(v).alias(v) for v in values])


def roll_up_all(df: DataFrame, path: DataFrame, levels: list[str], value: str, time: str) -> DataFrame:
    """(node_level, node_key, time, value) of every level in one pass of grouping sets."""
    rows = df.join(path, levels[-1]).select(*levels, time, value)
    sets = [[n, time] for n in levels]
    out = rows.groupingSets(sets, *levels, time).agg(F.sum(value).alias(value), *[F.grouping(n).alias(f"g_{n}") for n in levels])
    level, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in levels:
        level = F.when(F.col(f"g_{n}") == 0, F.lit(n)).otherwise(level)
        key = F.when(F.col(f"g_{n}") == 0, F.col(n).cast("string")).otherwise(key)
    return out.select(level.alias("node_level"), key.alias("node_key"), time, value)


def proportions(df: DataFrame, path: DataFrame, source: str, target: str, value: str, time: str, leaf: str, recent: int | None = None, freq: str = "W") -> DataFrame:
    """(source, target, proportion) of history, over the last `recent` periods if given; equal shares of nothing."""
    from pyspark.sql import Window as W

    if recent:
        last = df.agg(F.max(time).alias("_m"))
        df = df.join(F.broadcast(last)).where(F.col(time) > calendar.shift(F.col("_m"), -recent, freq)).drop("_m")
    rows = df.join(path.select(*dict.fromkeys([leaf, source, target])), leaf)
    s = rows.groupBy(source, target).agg(F.sum(value).alias("s"))
    w = W.partitionBy(source)
    total = F.sum("s").over(w)
    share = F.coalesce(F.try_divide("s", F.nullif(total, F.lit(0.0))), 1.0 / F.count("*").over(w))
    return s.select(source, target, share.alias("proportion"))


def disaggregate(df: DataFrame, path: DataFrame, source: str, target: str, values: list[str], shares: DataFrame | None = None) -> DataFrame:
    """Source-level values spread over the target level, equally where no shares are given."""
    from pyspark.sql import Window as W

    if shares is None:
        pairs = path.select(source, target).distinct()
        shares = pairs.withColumn("proportion", 1.0 / F.count("*").over(W.partitionBy(source)))
    rest = [c for c in df.columns if c != source and c not in values]
    return df.join(shares, source).select(target, *rest, *[(F.col(v) * F.col("proportion")).alias(v) for v in values])


def top_down(forecast: DataFrame, actuals: DataFrame, path: DataFrame, levels: list[str], value: str, time: str, forecast_value: str = "forecast") -> DataFrame:
    """The root's forecast by historical shares of the leaves."""
    return middle_out(forecast, actuals, path, levels, levels[0], value, time, forecast_value)


def middle_out(forecast: DataFrame, actuals: DataFrame, path: DataFrame, levels: list[str], middle: str, value: str, time: str, forecast_value: str = "forecast") -> DataFrame:
    shares = proportions(actuals, path, middle, levels[-1], value, time, levels[-1])
    return disaggregate(forecast, path, middle, levels[-1], [forecast_value], shares)


def bottom_up(forecast: DataFrame, path: DataFrame, levels: list[str], value: str, time: str) -> DataFrame:
    return roll_up_all(forecast, path, levels, value, time)


def residual_variances(residuals: DataFrame, floor: float = 1e-10) -> DataFrame:
    return residuals.groupBy("node_level", "node_key").agg(F.greatest(F.var_pop("residual"), F.lit(floor)).alias("variance"))


def projection(path: DataFrame, levels: list[str], method: str = "ols", residuals: DataFrame | None = None, time: str = "week"):
    """(nodes, leaves, G): the matrix from forecasts of all nodes to leaves, for ols, wls, wls_var or mint.

    The hierarchy's own size bounds this: one row a node, one column a leaf, on the driver.
    """
    long = summing_matrix(path, levels).orderBy("node_level", "node_key", "leaf_key").collect()
    leaves = sorted({r.leaf_key for r in long})
    keys = sorted({(levels.index(r.node_level), r.node_key) for r in long})
    at, col = {k: i for i, k in enumerate(keys)}, {k: i for i, k in enumerate(leaves)}
    s = np.zeros((len(keys), len(leaves)))
    for r in long:
        s[at[levels.index(r.node_level), r.node_key], col[r.leaf_key]] = 1
    n = len(keys)
    if method == "ols":
        w = np.eye(n)
    elif method == "wls":
        w = np.diag(1.0 / s.sum(1))
    else:
        var = np.ones(n)
        for r in residual_variances(residuals).collect():
            k = (levels.index(r.node_level), r.node_key)
            if k in at:
                var[at[k]] = r.variance
        w = np.diag(1 / var)
        if method == "mint":
            t = F.dense_rank().over(_order(time))
            rows = residuals.withColumn("t", t).collect()
            e = np.zeros((max(r.t for r in rows), n))
            for r in rows:
                k = (levels.index(r.node_level), r.node_key)
                if k in at:
                    e[r.t - 1, at[k]] = r.residual
            cov = np.cov(e.T, bias=True)
            lam = min(1.0, n / max(1, len(e)))
            cov = (1 - lam) * cov + lam * np.diag(np.maximum(np.diag(cov), 1e-10))
            low = np.linalg.eigvalsh(cov)[0]
            if low < 1e-8:
                cov += (1e-8 - low) * np.eye(n)
            w = np.linalg.inv(cov)
    m = s.T @ w @ s
    m += np.eye(len(leaves)) * 1e-8 * np.trace(m) / len(leaves)
    return [(levels[i], k) for i, k in keys], leaves, np.linalg.solve(m, s.T @ w)


def _order(time):
    from pyspark.sql import Window as W

    return W.orderBy(time)


def reconcile(forecasts: DataFrame, path: DataFrame, levels: list[str], time: str, method: str = "ols", residuals: DataFrame | None = None, value: str = "forecast") -> DataFrame:
    """Coherent leaf forecasts from forecasts (node_level, node_key, time, value); not below 0.

    Nodes without a forecast get the sum of their leaves'.
    """
    keys, leaves, g = projection(path, levels, method, residuals, time)
    spark = forecasts.sparkSession
    weights = [(lv, k, leaf, float(g[j, i])) for i, (lv, k) in enumerate(keys) for j, leaf in enumerate(leaves) if abs(g[j, i]) > 1e-15]
    g_long = spark.createDataFrame(weights, "node_level string, node_key string, leaf_key string, g double")
    leaf_rows = forecasts.where(F.col("node_level") == levels[-1]).select(F.col("node_key").alias("leaf_key"), time, F.col(value).alias("_leaf"))
    default = summing_matrix(path, levels).join(leaf_rows, "leaf_key").groupBy("node_level", "node_key", time).agg(F.sum("_leaf").alias("_d"))
    full = default.join(forecasts.select("node_level", "node_key", time, value), ["node_level", "node_key", time], "left").withColumn(value, F.coalesce(value, "_d"))
    out = full.join(g_long, ["node_level", "node_key"]).groupBy("leaf_key", time).agg(F.sum(F.col("g") * F.col(value)).alias(value))
    return out.withColumn(value, F.greatest(F.lit(0.0), F.col(value)))
