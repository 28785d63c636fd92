"""Price elasticity, cannibalisation, promotion lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.metrics import pearson, two_sided_p
from panelforge.operators.panel import ID, TIME, VALUE


def price_elasticity(df: DataFrame, price: str = "unit_price", min_obs: int = 20, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Per series: the slope of log demand on log price beside a linear trend, in closed form from covariances."""
    x = df.where((F.col(value) > 0) & (F.col(price) > 0)).select(
        id_col, F.ln(F.col(value).cast("double")).alias("y"), F.ln(F.col(price).cast("double")).alias("p"), F.row_number().over(W.partitionBy(id_col).orderBy(time)).cast("double").alias("t")
    )
    s = x.groupBy(id_col).agg(
        F.count("*").alias("n"), F.covar_samp("p", "y").alias("py"), F.covar_samp("t", "y").alias("ty"), F.covar_samp("p", "t").alias("pt"),
        F.var_samp("p").alias("pp"), F.var_samp("t").alias("tt"), F.var_samp("y").alias("yy"),
    ).where(F.col("n") >= min_obs)
    det = F.col("pp") * F.col("tt") - F.col("pt") * F.col("pt")
    det = F.when(F.abs(det) > 1e-12 * F.col("pp") * F.col("tt"), det)
    s = s.withColumn("elasticity", (F.col("py") * F.col("tt") - F.col("ty") * F.col("pt")) / det).withColumn("trend", (F.col("ty") * F.col("pp") - F.col("py") * F.col("pt")) / det)
    s = s.withColumn("r2", F.try_divide(F.col("elasticity") * F.col("py") + F.col("trend") * F.col("ty"), F.nullif("yy", F.lit(0.0))))
    var = (1 - F.col("r2")) * F.col("yy") * (F.col("n") - 1) / F.nullif(F.col("n") - 3, F.lit(0))
    se = F.sqrt(F.greatest(F.lit(0.0), var * F.col("tt") / det / (F.col("n") - 1)))
    s = s.withColumn("se", se).withColumn("p_value", two_sided_p(F.try_divide("elasticity", F.nullif("se", F.lit(0.0)))))
    label = F.when(F.col("elasticity").isNull(), "undefined").when(F.col("elasticity") > 0, "positive").when(F.abs("elasticity") >= 1, "elastic").otherwise("inelastic")
    return s.select(id_col, "n", "elasticity", "se", "p_value", "r2", label.alias("label"))


def residuals(df: DataFrame, season: int = 52, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Values without their linear trend and the mean by position in the season."""
    w = W.partitionBy(id_col)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(time)).cast("double"))
    b = F.coalesce(F.try_divide(F.covar_pop(value, "_r").over(w), F.nullif(F.var_pop("_r").over(w), F.lit(0.0))), F.lit(0.0))
    x = x.withColumn("_d", F.col(value) - F.avg(value).over(w) - b * (F.col("_r") - F.avg("_r").over(w)))
    return x.withColumn("residual", F.col("_d") - F.avg("_d").over(W.partitionBy(id_col, F.col("_r") % season))).drop("_r", "_d")


def cannibalisation(df: DataFrame, group: str, threshold: float = -0.3, season: int = 52, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Pairs of series of a group whose residuals correlate at the threshold or below, over the group's common dates."""
    x = residuals(df, season, id_col, time, value).select(group, id_col, time, "residual")
    size = x.groupBy(group).agg(F.countDistinct(id_col).alias("size"))
    common = x.groupBy(group, time).agg(F.countDistinct(id_col).alias("n")).join(size, group).where("n = size").select(group, time)
    x = x.join(common, [group, time], "left_semi")
    other = x.select(group, time, F.col(id_col).alias("other"), F.col("residual").alias("r2"))
    pairs = x.join(other, [group, time]).where(F.col(id_col) < F.col("other"))
    out = pairs.groupBy(group, F.col(id_col).alias("series_a"), F.col("other").alias("series_b")).agg(pearson("residual", "r2").alias("correlation"), F.count("*").alias("n"))
    return out.where(F.col("correlation") <= threshold)


def promo_lift(df: DataFrame, promo: str = "promo_flag", id_col=ID, value=VALUE, price: str | None = None) -> DataFrame:
    """Per series: means on and off promotion, lift, Welch's t with a normal p-value."""
    on, off = F.when(F.col(promo) > 0, F.col(value).cast("double")), F.when(F.col(promo) <= 0, F.col(value).cast("double"))
    aggs = [f(c).alias(f"{n}_{s}") for s, c in (("promo", on), ("base", off)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    if price:
        aggs += [F.avg(F.when(F.col(promo) > 0, F.col(price))).alias("price_promo"), F.avg(F.when(F.col(promo) <= 0, F.col(price))).alias("price_base")]
    s = df.groupBy(id_col).agg(*aggs).where("n_promo > 0 AND n_base > 0")
    lift = F.try_divide(F.col("mean_promo") - F.col("mean_base"), F.nullif("mean_base", F.lit(0.0)))
    t = F.try_divide(F.col("mean_promo") - F.col("mean_base"), F.nullif(F.sqrt(F.col("var_promo") / F.col("n_promo") + F.col("var_base") / F.col("n_base")), F.lit(0.0)))
    out = s.withColumn("lift", lift).withColumn("t", t).withColumn("p_value", two_sided_p(F.col("t")))
    return out.select(id_col, "n_promo", "n_base", "mean_promo", "mean_base", "lift", "t", "p_value", *(["price_promo", "price_base"] if price else []))
