import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import cleansing, demand, panel, transition


def weeks(n, start="2024-01-01"):
    d = dt.date.fromisoformat(start)
    return [d + dt.timedelta(7 * i) for i in range(n)]


def series(spark, values, name="a", start="2024-01-01"):
    return spark.createDataFrame([(name, w, None if v is None else float(v)) for w, v in zip(weeks(len(values), start), values, strict=True)], "series_id string, week date, quantity double")


def values(df, column="quantity"):
    return [r[column] for r in df.orderBy("series_id", "week").collect()]


def test_series_id_is_null_if_a_part_is(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "a string, b int")
    assert [r[0] for r in df.select(panel.series_id(["a", "b"])).collect()] == ["x|1", None]
    with pytest.raises(ValueError):
        panel.ensure_series_id(df, ["c"])


def test_gap_fill(spark):
    df = series(spark, [1, 2, 3, 4, 5]).where("quantity NOT IN (2, 3)").unionByName(series(spark, [7], "b", "2024-01-15"))
    assert values(panel.fill_gaps(df)) == [1, 0, 0, 4, 5, 0, 0, 7, 0, 0]
    assert values(panel.fill_gaps(df, strategy="ffill")) == [1, 1, 1, 4, 5, 7, 7, 7, 7, 7]
    assert panel.fill_gaps(df, per_series=True).where("series_id = 'b'").count() == 1
    with pytest.raises(ValueError):
        panel.fill_gaps(df, strategy="other")


def test_short_and_zero_series(spark):
    df = series(spark, [1, 2, 3]).unionByName(series(spark, [0, 0], "b"))
    assert {r.series_id for r in panel.drop_short(df, 3).collect()} == {"a"}
    assert {r.series_id for r in panel.drop_zero(df).collect()} == {"a"}


def test_rolling_features_do_not_see_their_row(spark):
    out = panel.rolling_features(series(spark, [1, 2, 3, 4]), (2,))
    assert values(out, "quantity_rolling_mean_2") == [None, 1.0, 1.5, 2.5]


def test_temporal_features_monday_is_one(spark):
    row = panel.temporal_features(spark.createDataFrame([(dt.date(2015, 1, 1),)], "week date")).first()
    assert (row.DayOfWeek, row.WeekOfYear, row.IsMonthStart, row.IsWeekend) == (4, 1, 1, 0)


def test_interpolation_and_edges(spark):
    df = series(spark, [9, 1, 9, 9, 4, 9]).withColumn("f", F.col("quantity") == 9)
    assert values(cleansing.interpolate_flagged(df, "f")) == [1, 1, 2, 3, 4, 4]


def test_stockouts_leave_the_last_run(spark):
    out = cleansing.detect_stockouts(series(spark, [0, 0, 5, 0, 0, 0, 5, 0, 0]), 2)
    assert values(out, "is_stockout") == [True, True, False, True, True, True, False, False, False]


def test_seasonal_impute(spark):
    v = [10.0] * 52 + [0.0] + [10.0] * 3
    v[0] = 4.0
    out = cleansing.seasonal_impute(series(spark, v).withColumn("is_stockout", F.col("quantity") == 0))
    assert values(out)[52] == 4.0


def test_seasonal_impute_neighbours_and_nulls(spark):
    v = [8.0, 0.0, 2.0] + [1.0] * 50 + [0.0, 0.0]
    df = series(spark, v).unionByName(series(spark, v).withColumn("series_id", F.lit(None).cast("string")))
    out = cleansing.seasonal_impute(df.withColumn("is_stockout", F.col("quantity") == 0)).where("series_id IS NOT NULL")
    assert values(out)[53:] == [5.0, 2.0]  # week 1 is no more than 0: the mean of weeks 0 and 2
    null = cleansing.seasonal_impute(df.withColumn("is_stockout", F.col("quantity") == 0)).where("series_id IS NULL")
    assert values(null)[53:] == [0.0, 0.0]
    noon = df.selectExpr("series_id", "CAST(week AS timestamp) + INTERVAL 12 HOURS AS week", "quantity")
    assert values(cleansing.seasonal_impute(noon.where("series_id IS NOT NULL").withColumn("is_stockout", F.col("quantity") == 0)))[53:] == [0.0, 0.0]


def test_imputing_a_filled_panel_deals_its_rows_once(spark):
    filled = panel.fill_gaps(series(spark, [1, 0, 3]))
    plan = cleansing.seasonal_impute(cleansing.detect_stockouts(filled))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_fill_gaps_off_the_grid_repeated_and_null(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [("a", day(8), 1.0), ("a", day(8), 2.0), ("a", day(10), 9.0), ("b", day(1), 3.0), ("b", day(22), 4.0), (None, day(8), 5.0), ("c", None, 6.0)]
    out = panel.fill_gaps(spark.createDataFrame(rows, "series_id string, week date, quantity double"))
    got = {k: sorted((r.week.day, r.quantity) for r in out.collect() if r.series_id == k) for k in ("a", "b", "c", None)}
    nothing = [(1, 0.0), (8, 0.0), (15, 0.0), (22, 0.0)]
    assert got == {"a": [(1, 0.0), (8, 1.0), (8, 2.0), (15, 0.0), (22, 0.0)], "b": [(1, 3.0), (8, 0.0), (15, 0.0), (22, 4.0)], "c": nothing, None: nothing}
    ends = [("a", dt.date(2024, m, d), float(m)) for m, d in ((1, 30), (2, 29), (4, 30))]
    assert values(panel.fill_gaps(spark.createDataFrame(ends, "series_id string, week date, quantity double"), "M")) == [1.0, 2.0, 0.0, 4.0]


def test_outliers_and_constant_series(spark):
    df = series(spark, [5, 5, 5, 5, 50]).unionByName(series(spark, [3] * 5, "b"))
    assert values(cleansing.outliers_iqr(df), "is_outlier") == [False] * 4 + [True] + [False] * 5
    assert values(cleansing.outliers_zscore(df, 1.5), "zscore")[5:] == [0.0] * 5
    clean = cleansing.cleanse(df, min_run=2)
    assert set(clean.columns) >= {"is_outlier", "is_stockout"}
    assert cleansing.cleansing_report(df, clean).first().total_outliers == 1


def test_exclusion(spark):
    df = series(spark, [1, 2, 3, 4])
    period = [("2024-01-08", "2024-01-15")]
    assert cleansing.exclude_periods(df, period, "drop").count() == 2
    assert values(cleansing.exclude_periods(df, period, "interpolate")) == [1, 2, 3, 4]


def test_classes(spark):
    rows = {"smooth": [5] * 12, "intermittent": [5, 0] * 6, "erratic": [1, 1, 1, 30] * 3, "lumpy": [1, 0, 0, 40] * 3, "insufficient_data": [1] * 5}
    df = None
    for name, v in rows.items():
        s = series(spark, v, name)
        df = s if df is None else df.unionByName(s)
    assert all(r.demand_class == r.series_id for r in demand.classify_demand(df).collect())


def test_breaks(spark):
    df = series(spark, [10 + (i % 2) for i in range(30)] + [50 + (i % 2) for i in range(30)])
    found = demand.detect_breaks(df).collect()
    assert [r.break_index for r in found] == [30]
    assert demand.truncate_to_last_break(df, demand.detect_breaks(df)).count() == 29
    assert demand.best_split(df).first().split_index == 30
    assert demand.detect_breaks(series(spark, [1, 2, 3])).count() == 0


def test_ramp_and_stitch(spark):
    plans = spark.createDataFrame([("old", "new", "A", None, None, "linear")], "old_sku string, new_sku string, scenario string, ramp_start date, ramp_end date, ramp_shape string")
    df = series(spark, [1, 2, 3, 4], "old").unionByName(series(spark, [9, 9], "new", "2024-01-15"))
    out = transition.stitch_series(df, plans)
    assert {r.series_id for r in out.collect()} == {"new"}
    assert values(out) == [1, 2, 9, 9]


def test_scenarios(spark):
    products = spark.createDataFrame([("n1", dt.date(2024, 1, 1)), ("n2", dt.date(2024, 6, 1)), ("n3", dt.date(2026, 1, 1))], "sku_id string, launch_date date")
    maps = spark.createDataFrame([("o", f"n{i}", None) for i in range(1, 6)], "old_sku string, new_sku string, proportion double")
    over = spark.createDataFrame([("o", "n5", 0.4, "step")], "old_sku string, new_sku string, proportion double, ramp_shape string")
    got = {r.new_sku: (r.scenario, r.proportion) for r in transition.transition_plans(maps, products, "2024-03-04", overrides=over).collect()}
    assert got == {"n1": ("A", 1.0), "n2": ("B", 1.0), "n3": ("C", 1.0), "n4": ("A", 1.0), "n5": ("MANUAL", 0.4)}
