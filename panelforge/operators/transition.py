"""Product transitions: plans, ramps and stitched histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import calendar
from panelforge.operators.panel import ID, TIME, VALUE


def transition_plans(mapping: DataFrame, products: DataFrame, origin: str, horizon: int = 39, window: int = 13, shape: str = "linear", freq: str = "W", overrides: DataFrame | None = None) -> DataFrame:
    """(old_sku, new_sku, scenario, proportion, ramp_start, ramp_end, ramp_shape) of each mapping.

    An override wins; a launch that is unknown or past is A, within the horizon B, later C.
    """
    launch = products.select(F.col("sku_id").alias("new_sku"), "launch_date")
    out = mapping.join(launch, "new_sku", "left").withColumn("o", F.lit(origin).cast("date"))
    over = F.lit(None).cast("boolean")
    proportion, ramp = F.coalesce("proportion", F.lit(1.0)), F.lit(shape)
    if overrides is not None:
        o = overrides.select("old_sku", "new_sku", F.col("proportion").alias("_p"), F.col("ramp_shape").alias("_s"), F.lit(True).alias("_o"))
        out = out.join(o, ["old_sku", "new_sku"], "left")
        over, proportion, ramp = F.col("_o"), F.coalesce("_p", proportion), F.coalesce("_s", ramp)
    scenario = (
        F.when(over, "MANUAL")
        .when(F.col("launch_date").isNull() | (F.col("launch_date") <= F.col("o")), "A")
        .when(F.col("launch_date") <= calendar.shift(F.col("o"), horizon, freq), "B")
        .otherwise("C")
    )
    out = out.withColumn("scenario", scenario)
    half = window // 2
    return out.select(
        "old_sku",
        "new_sku",
        "scenario",
        proportion.alias("proportion"),
        F.when(F.col("scenario") == "B", calendar.shift(F.col("launch_date"), -half, freq)).alias("ramp_start"),
        F.when(F.col("scenario") == "B", calendar.shift(F.col("launch_date"), half, freq)).alias("ramp_end"),
        ramp.alias("ramp_shape"),
    )


def ramp_weight(t: Column, start: Column, end: Column, shape: Column, down: bool) -> Column:
    """A share that goes from 0 to 1 over the ramp (from 1 to 0 downwards); 1 where there is no ramp."""
    total = F.datediff(end, start)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.datediff(t, start).cast("double"), F.nullif(total, F.lit(0)))))
    w = F.when(shape == "scurve", 3 * p * p - 2 * p * p * p).when(shape == "step", (p >= 0.5).cast("double")).otherwise(p)
    w = 1 - w if down else w
    outside = F.when(t > end, 0.0 if down else 1.0).when(t < start, 1.0 if down else 0.0)
    return F.when(start.isNull() | end.isNull() | (total <= 0), 1.0).otherwise(F.coalesce(outside, w))


def stitch_series(df: DataFrame, plans: DataFrame, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Histories after transitions, one row per series and date.

    A and MANUAL: the old product's history from before the new one's first date goes under the
    new name, and the old series ends.  B: the old series ramps down and its ramped-up part joins
    the new series, dates that both have being summed.  C and unmapped series stay.
    """
    base = df.select(id_col, time, F.col(value).cast("double").alias(value))
    first = base.groupBy(F.col(id_col).alias("new_sku")).agg(F.min(time).alias("first"))
    plan = plans.select("old_sku", "new_sku", "scenario", "ramp_start", "ramp_end", "ramp_shape").join(first, "new_sku", "left")
    old = base.join(plan, F.col(id_col) == F.col("old_sku"))
    moved = old.where(F.col("scenario").isin("A", "MANUAL") & (F.col("first").isNull() | (F.col(time) < F.col("first"))))
    moved = moved.select(F.col("new_sku").alias(id_col), time, value)
    up = ramp_weight(F.col(time), F.col("ramp_start"), F.col("ramp_end"), F.col("ramp_shape"), False)
    down = ramp_weight(F.col(time), F.col("ramp_start"), F.col("ramp_end"), F.col("ramp_shape"), True)
    ramping = old.where(F.col("scenario") == "B")
    ramped = ramping.select(F.col("new_sku").alias(id_col), time, (F.col(value) * up).alias(value)).unionByName(ramping.select(id_col, time, (F.col(value) * down).alias(value)))
    gone = plan.where(F.col("scenario").isin("A", "MANUAL", "B")).select(F.col("old_sku").alias(id_col)).distinct()
    rest = base.join(gone, id_col, "left_anti")
    out = rest.unionByName(moved).unionByName(ramped)
    return out.groupBy(id_col, time).agg(F.sum(value).alias(value))
