"""The catalogue: every query of the panel operators on the supplied tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.metrics import METRICS
from panelforge.operators import causal, cleansing, demand, evaluation, files, hierarchy, mapping, panel, profiling, regressors, statistics, transition, validation
from panelforge.plans import backtest, models
from panelforge.sources import stores
from panelforge.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def sold(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return items.join(parts, "l_partkey")


def brands(spark, sf) -> DataFrame:
    return panel.build_panel(sold(spark, sf), ["p_brand"], "l_shipdate", "l_quantity")


def dense(spark, sf) -> DataFrame:
    return panel.fill_gaps(brands(spark, sf))


def parts_weekly(spark, sf) -> DataFrame:
    return panel.build_panel(table(spark, sf, "lineitem"), ["l_partkey"], "l_shipdate", "l_quantity")


PANEL = """panel AS (
  SELECT p_brand AS series_id, date_trunc('week', l_shipdate)::DATE AS week, sum(l_quantity)::DOUBLE AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""
PARTS = """parts AS (
  SELECT l_partkey::VARCHAR AS series_id, date_trunc('week', l_shipdate)::DATE AS week, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2
)"""


def filled(base: str, name: str = "filled") -> str:
    return f"""{name}_grid AS (
  SELECT s.series_id, g.week FROM (SELECT DISTINCT series_id FROM {base}) s,
    (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM {base}) g
), {name} AS (
  SELECT g.series_id, g.week, coalesce(p.quantity, 0.0) AS quantity FROM {name}_grid g LEFT JOIN {base} p ON p.series_id = g.series_id AND p.week = g.week
)"""


DENSE = f"{PANEL}, {filled('panel')}"
SPARSE = f"{PARTS}, {filled('parts')}"


# ------------------------------------------------------------------ panels
@query(f"WITH {PANEL} SELECT * FROM panel")
def panel_brand_weekly(spark, sf):
    return brands(spark, sf)


@query("SELECT p_type || '|' || l_returnflag AS series_id, date_trunc('month', l_shipdate)::DATE AS week, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def panel_composite_monthly(spark, sf):
    return panel.build_panel(sold(spark, sf), ["p_type", "l_returnflag"], "l_shipdate", "l_quantity", "M")


@query(f"WITH {DENSE} SELECT * FROM filled")
def panel_gap_fill_zero(spark, sf):
    return dense(spark, sf)


@query(f"""WITH {PARTS}, {filled('parts')}, j AS (SELECT g.series_id, g.week, p.quantity FROM filled_grid g LEFT JOIN parts p ON p.series_id = g.series_id AND p.week = g.week)
SELECT series_id, week, coalesce(last_value(quantity IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY week),
  first_value(quantity IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS quantity FROM j""")
def panel_gap_fill_ffill(spark, sf):
    return panel.fill_gaps(parts_weekly(spark, sf), strategy="ffill")


@query(f"WITH {PARTS} SELECT series_id, week, quantity FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM parts) WHERE n >= 30")
def panel_drop_short(spark, sf):
    return panel.drop_short(parts_weekly(spark, sf), 30)


@query(f"WITH {PARTS} SELECT * FROM parts WHERE quantity <> 0 OR series_id IN (SELECT series_id FROM parts GROUP BY 1 HAVING sum(abs(quantity)) > 0)")
def panel_drop_zero(spark, sf):
    return panel.drop_zero(parts_weekly(spark, sf))


@query(f"""WITH {PANEL}, f AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, count(*)::BIGINT AS n_orders FROM orders GROUP BY 1)
SELECT p.series_id, p.week, p.quantity, coalesce(n_orders, 0) AS n_orders FROM panel p LEFT JOIN f ON f.week = p.week""")
def panel_join_features(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("week")).agg(F.count("*").alias("n_orders"))
    return panel.join_features(brands(spark, sf), orders)


@query("""SELECT d, year(d)::INT AS "Year", month(d)::INT AS "Month", day(d)::INT AS "Day", isodow(d)::INT AS "DayOfWeek", weekofyear(d)::INT AS "WeekOfYear", quarter(d)::INT AS "Quarter",
  (isodow(d) >= 6)::INT AS "IsWeekend", (day(d) = 1)::INT AS "IsMonthStart", (d = last_day(d))::INT AS "IsMonthEnd" FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)""")
def temporal_features(spark, sf):
    return panel.temporal_features(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct(), "d")


@query(f"""WITH {DENSE} SELECT series_id, week, quantity, lag(quantity, 1) OVER w AS quantity_lag_1, lag(quantity, 4) OVER w AS quantity_lag_4, lag(quantity, 52) OVER w AS quantity_lag_52
FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY week)""")
def lag_features(spark, sf):
    return panel.lag_features(dense(spark, sf), (1, 4, 52))


@query(f"""WITH {DENSE} SELECT series_id, week, quantity,
  round(avg(quantity) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS quantity_rolling_mean_4,
  round(stddev_samp(quantity) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS quantity_rolling_std_4,
  round(avg(quantity) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 6) AS quantity_rolling_mean_13,
  round(stddev_samp(quantity) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 6) AS quantity_rolling_std_13 FROM filled""")
def rolling_features(spark, sf):
    out = panel.rolling_features(dense(spark, sf), (4, 13))
    return rounded(out, *[c for c in out.columns if "rolling" in c])


@query(f"""WITH {PARTS}, g AS (SELECT *, (week - lag(week) OVER (PARTITION BY series_id ORDER BY week))::INT AS gap_days FROM parts) SELECT * FROM g WHERE gap_days <> 7""")
def period_gaps(spark, sf):
    return panel.period_gaps(parts_weekly(spark, sf))


@query("""SELECT o_orderpriority, o_orderstatus, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority_code FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)""")
def label_encode(spark, sf):
    return panel.label_encode(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus").distinct(), ["o_orderpriority"])


@query("""SELECT o_orderkey, CASE WHEN n < 0 THEN 0 ELSE n END::INT AS months FROM (SELECT o_orderkey, 12 * (year(o_orderdate) - 1998) + month(o_orderdate) - 6 AS n FROM orders)""")
def months_open(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.lit(1998).alias("y"), F.lit(6).alias("m"))
    return panel.months_open(o, "d", "y", "m", "months").select("o_orderkey", "months")


@query("""SELECT o_orderkey, CASE WHEN n < 0 THEN 0 ELSE n END::INT AS weeks FROM (SELECT o_orderkey, 52 * (year(o_orderdate) - 1998) + weekofyear(o_orderdate) - 20 AS n FROM orders)""")
def weeks_open(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.lit(1998).alias("y"), F.lit(20).alias("w"))
    return panel.weeks_open(o, "d", "y", "w", "weeks").select("o_orderkey", "weeks")


@query(f"""WITH {PANEL} SELECT series_id, date_trunc('month', week)::DATE AS week, sum(quantity) AS quantity FROM panel GROUP BY 1, 2""")
def resample_monthly(spark, sf):
    return panel.resample(brands(spark, sf), "M")


@query("""SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS period, unnest([l_quantity, l_discount, l_tax])::DOUBLE AS quantity FROM lineitem""")
def wide_to_long(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return panel.wide_to_long(items, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(f"""WITH {PARTS} SELECT series_id, week, quantity FROM parts WHERE series_id IN (SELECT series_id FROM parts GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (WHERE quantity > 0) >= 2
  AND count(*)::DOUBLE / count(*) FILTER (WHERE quantity > 0) >= 1.32)""")
def route_sparse(spark, sf):
    p = parts_weekly(spark, sf)
    return panel.route_sparse(p, demand.classify_demand(p))[1]


# ------------------------------------------------------------------ evaluation
FOLDS = """folds AS (
  SELECT fold, min_week AS train_start, (max_week - ((2 - fold) * 13 + 13) * 7)::DATE AS train_end,
    (max_week - ((2 - fold) * 13 + 12) * 7)::DATE AS val_start, (max_week - (2 - fold) * 13 * 7)::DATE AS val_end
  FROM (SELECT min(week) AS min_week, max(week) AS max_week FROM filled), (SELECT unnest([0, 1, 2]) AS fold)
)"""
SCORED = f"""{FOLDS}, naive AS (
  SELECT 'naive_seasonal' AS model_id, fold, v.series_id, v.week, v.quantity AS actual, h.quantity AS forecast, ((v.week - f.train_end) / 7)::INT AS forecast_step
  FROM filled v JOIN folds f ON v.week BETWEEN f.val_start AND f.val_end JOIN filled h ON h.series_id = v.series_id AND h.week = v.week - 364
), ma AS (
  SELECT fold, t.series_id, avg(t.quantity) AS forecast FROM filled t JOIN folds f ON t.week BETWEEN f.train_end - 84 AND f.train_end GROUP BY 1, 2
), moving AS (
  SELECT 'moving_average' AS model_id, f.fold, v.series_id, v.week, v.quantity AS actual, ma.forecast, ((v.week - f.train_end) / 7)::INT AS forecast_step
  FROM filled v JOIN folds f ON v.week BETWEEN f.val_start AND f.val_end JOIN ma ON ma.fold = f.fold AND ma.series_id = v.series_id
), last AS (
  SELECT 'last_value' AS model_id, f.fold, v.series_id, v.week, v.quantity AS actual, l.quantity AS forecast, ((v.week - f.train_end) / 7)::INT AS forecast_step
  FROM filled v JOIN folds f ON v.week BETWEEN f.val_start AND f.val_end JOIN filled l ON l.series_id = v.series_id AND l.week = f.train_end
), scored AS (SELECT * FROM naive UNION ALL SELECT * FROM moving UNION ALL SELECT * FROM last), scores AS (
  SELECT model_id, fold, series_id, sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) AS wmape, coalesce(sum(forecast - actual) / nullif(sum(abs(actual)), 0), 0) AS normalized_bias,
    avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) END) AS mape, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse, count(*) AS n_obs, sum(actual) AS volume
  FROM scored GROUP BY 1, 2, 3
)"""
EVAL = f"WITH {DENSE}, {SCORED}"
THREE = ["naive_seasonal", "moving_average", "last_value"]


def scored_rows(spark, sf) -> DataFrame:
    p = dense(spark, sf)
    f = backtest.folds(p)
    return backtest.scored(p, backtest.predictions(p, f, THREE, 13), f)


def scores(spark, sf) -> DataFrame:
    return backtest.series_scores(scored_rows(spark, sf))


@query(f"WITH {DENSE}, {FOLDS} SELECT fold::INT AS fold, train_start, train_end, val_start, val_end FROM folds")
def cv_folds(spark, sf):
    return backtest.folds(dense(spark, sf))


@query(f"{EVAL} SELECT fold, count(*) FILTER (WHERE week < val_start) AS n_train, count(*) FILTER (WHERE week BETWEEN val_start AND val_end) AS n_val FROM filled, folds WHERE week <= val_end GROUP BY 1")
def cv_split(spark, sf):
    p = dense(spark, sf)
    train, val = backtest.split(p, backtest.folds(p))
    return train.groupBy("fold").agg(F.count("*").alias("n_train")).join(val.groupBy("fold").agg(F.count("*").alias("n_val")), "fold")


@query(f"{EVAL} SELECT model_id, fold::INT AS fold, series_id, week, forecast_step, actual, round(forecast, 6) AS forecast FROM scored")
def backtest_predictions(spark, sf):
    return rounded(scored_rows(spark, sf), "forecast").select("model_id", "fold", "series_id", "week", "forecast_step", "actual", "forecast")


@query(f"{EVAL} SELECT model_id, fold::INT AS fold, series_id, round(wmape, 6) AS wmape, round(normalized_bias, 6) AS normalized_bias, round(mape, 6) AS mape, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n_obs, volume FROM scores")
def metric_set(spark, sf):
    return rounded(scores(spark, sf), "wmape", "normalized_bias", "mape", "mae", "rmse")


@query(f"""{EVAL} SELECT model_id, round(sqrt(avg(CASE WHEN actual <> 0 THEN ((actual - forecast) / actual) ** 2 END)), 6) AS rmspe,
  round(100 * avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) END), 5) AS mape_percent FROM scored GROUP BY 1""")
def legacy_metrics(spark, sf):
    a, f = F.col("actual"), F.col("forecast")
    return scored_rows(spark, sf).groupBy("model_id").agg(F.round(METRICS["rmspe"](a, f), 6).alias("rmspe"), F.round(METRICS["mape"](a, f) * 100, 5).alias("mape_percent"))


@query(f"""{EVAL}, d AS (SELECT fold, series_id, avg(abs(quantity - before)) AS scale FROM (
    SELECT f.fold, t.series_id, t.quantity, lag(t.quantity, 52) OVER (PARTITION BY f.fold, t.series_id ORDER BY t.week) AS before FROM filled t JOIN folds f ON t.week <= f.train_end) GROUP BY 1, 2)
SELECT model_id, s.fold::INT AS fold, s.series_id, round(mae / nullif(scale, 0), 6) AS mase FROM scores s JOIN d ON d.fold = s.fold AND d.series_id = s.series_id""")
def mase(spark, sf):
    p = dense(spark, sf)
    train, _ = backtest.split(p, backtest.folds(p))
    out = backtest.mase(scores(spark, sf), backtest.naive_mae(train, 52, ("fold", "series_id")), ("fold", "series_id"))
    return rounded(out, "mase").select("model_id", "fold", "series_id", "mase")


LEAD = "SELECT model_id, round(avg(wmape), 6) AS wmape, round(avg(normalized_bias), 6) AS normalized_bias, count(DISTINCT series_id) AS n_series, rank() OVER (ORDER BY avg(wmape))::INT AS rank FROM scores GROUP BY 1"


@query(f"{EVAL} {LEAD}")
def seasonal_naive_backtest_leaderboard(spark, sf):
    return rounded(backtest.leaderboard(scores(spark, sf)), "wmape", "normalized_bias")


@query(f"{EVAL} SELECT model_id, week AS target_week, round(avg(abs(actual - forecast)), 6) AS mae FROM scored GROUP BY 1, 2")
def accuracy_over_time(spark, sf):
    rows = scored_rows(spark, sf).withColumn("mae", F.abs(F.col("actual") - F.col("forecast")))
    return rounded(backtest.accuracy_over_time(rows, metric="mae", time="week"), "mae").withColumnRenamed("week", "target_week")


@query(f"{EVAL} SELECT series_id, round(avg(wmape), 6) AS mean, round(stddev_samp(wmape), 6) AS std, 1::BIGINT AS n_series FROM scores GROUP BY 1")
def accuracy_by_grain(spark, sf):
    s = scores(spark, sf)
    return rounded(backtest.accuracy_by(s.withColumn("grain", F.col("series_id")), "grain"), "mean", "std").withColumnRenamed("grain", "series_id")


@query(f"{EVAL} SELECT model_id, fold::INT AS fold, round(avg(wmape), 6) AS wmape FROM scores GROUP BY 1, 2")
def model_by_fold(spark, sf):
    return rounded(backtest.model_by_fold(scores(spark, sf)), "wmape")


@query(f"{EVAL} SELECT series_id, round(avg(normalized_bias), 6) AS mean_bias, round(stddev_samp(normalized_bias), 6) AS std_bias, round(avg(wmape), 6) AS mean_wmape FROM scores GROUP BY 1")
def bias_distribution(spark, sf):
    return rounded(backtest.bias_distribution(scores(spark, sf)), "mean_bias", "std_bias", "mean_wmape")


@query(f"{EVAL} SELECT series_id, model_id, round(avg(wmape), 6) AS wmape FROM scores WHERE series_id IN ('Brand#11', 'Brand#12') GROUP BY 1, 2")
def transition_impact(spark, sf):
    return rounded(backtest.transition_impact(scores(spark, sf), "Brand#11", "Brand#12"), "wmape")


@query(f"""{EVAL} SELECT model_id, round(avg(wmape) FILTER (WHERE fold < 2), 6) AS backtest, round(avg(wmape) FILTER (WHERE fold = 2), 6) AS live,
  round(avg(wmape) FILTER (WHERE fold = 2) - avg(wmape) FILTER (WHERE fold < 2), 6) AS gap FROM scores GROUP BY 1""")
def backtest_vs_live(spark, sf):
    s = scores(spark, sf)
    return rounded(backtest.backtest_vs_live(s.where("fold < 2"), s.where("fold = 2")), "backtest", "live", "gap")


CHAMP = """SELECT {g}model_id, round(w, 6) AS wmape, round(b, 6) AS normalized_bias FROM (SELECT *, row_number() OVER ({p}ORDER BY w, abs(b), model_id) AS r FROM (
  SELECT {g}model_id, avg(wmape) AS w, avg(normalized_bias) AS b FROM {t} GROUP BY ALL)) WHERE r = 1"""


@query(f"{EVAL} {CHAMP.format(g='series_id, ', p='PARTITION BY series_id ', t='scores')}")
def champion_by_series(spark, sf):
    return rounded(backtest.champions(scores(spark, sf), ["series_id"]), "wmape", "normalized_bias")


@query(f"{EVAL} {CHAMP.format(g='', p='', t='scores')}")
def champion_global(spark, sf):
    return rounded(backtest.champions(scores(spark, sf)), "wmape", "normalized_bias")


BUCKETS = {"short": (1, 4), "long": (5, 13)}
HORIZON = f"""{EVAL}, b AS (SELECT model_id, CASE WHEN forecast_step <= 4 THEN 'short' ELSE 'long' END AS bucket,
  sum(abs(actual - forecast)) / sum(abs(actual)) AS wmape, sum(forecast - actual) / sum(abs(actual)) AS normalized_bias FROM scored GROUP BY 1, 2)"""


@query(f"{HORIZON} {CHAMP.format(g='bucket, ', p='PARTITION BY bucket ', t='b')}")
def champion_by_horizon(spark, sf):
    return rounded(backtest.champions_by_horizon(scored_rows(spark, sf), BUCKETS), "wmape", "normalized_bias")


@query(f"""{HORIZON}, c AS ({CHAMP.format(g='bucket, ', p='PARTITION BY bucket ', t='b')})
SELECT s.series_id, s.fold::INT AS fold, s.week, s.forecast_step, s.model_id, c.bucket, round(s.forecast, 6) AS forecast FROM scored s JOIN c ON c.model_id = s.model_id AND c.bucket = CASE WHEN s.forecast_step <= 4 THEN 'short' ELSE 'long' END""")
def multi_horizon_stitch(spark, sf):
    rows = scored_rows(spark, sf)
    out = backtest.stitch_horizons(rows, backtest.champions_by_horizon(rows, BUCKETS), BUCKETS)
    return rounded(out, "forecast").select("series_id", "fold", "week", "forecast_step", "model_id", "bucket", "forecast")


@query(f"""{EVAL}, m AS (SELECT model_id, 1 / avg(wmape) AS raw FROM scores GROUP BY 1) SELECT model_id, round(raw / sum(raw) OVER (), 6) AS weight FROM m""")
def ensemble_weights(spark, sf):
    return rounded(backtest.ensemble_weights(scores(spark, sf)), "weight")


@query(f"""{EVAL} SELECT series_id, week, round(sum(forecast * CASE model_id WHEN 'naive_seasonal' THEN 0.5 WHEN 'moving_average' THEN 0.3 ELSE 0.2 END), 6) AS forecast FROM scored WHERE fold = 2 GROUP BY 1, 2""")
def ensemble_forecast(spark, sf):
    p = dense(spark, sf)
    train = backtest.split(p, backtest.folds(p).where("fold = 2"))[0].drop("fold")
    made = {m: models.forecast(m, train, 13) for m in THREE}
    return rounded(models.weighted_ensemble(made, {"naive_seasonal": 5, "moving_average": 3, "last_value": 2}), "forecast")


NAIVE = f"""WITH {DENSE}, m AS (SELECT max(week) AS last FROM filled), fc AS (
  SELECT series_id, (week + 364)::DATE AS week, ((week + 364 - last) / 7)::INT AS step, quantity AS forecast FROM filled, m WHERE week > last - 364 AND week <= last - 364 + 91)"""


@query(f"{NAIVE} SELECT * FROM fc")
def naive_forecast(spark, sf):
    return models.naive_seasonal(dense(spark, sf), 13)


@query(f"""{NAIVE}, r AS (
  SELECT series_id, week, row_number() OVER (PARTITION BY series_id ORDER BY week) AS i, quantity - lag(quantity, 52) OVER (PARTITION BY series_id ORDER BY week) AS d FROM filled
), n AS (SELECT max(i) AS n FROM r)
SELECT fc.series_id, fc.week, fc.step, round(any_value(forecast) + quantile_cont(d, 0.1), 6) AS forecast_p10, any_value(forecast) AS forecast_p50, round(any_value(forecast) + quantile_cont(d, 0.9), 6) AS forecast_p90
FROM fc JOIN r ON r.series_id = fc.series_id, n WHERE d IS NOT NULL AND (r.i - 1 - (n - 52 + fc.step - 1)) % 52 = 0 GROUP BY 1, 2, 3""")
def naive_quantiles(spark, sf):
    return rounded(models.naive_quantiles(dense(spark, sf), 13, [0.1, 0.5, 0.9]), "forecast_p10", "forecast_p90")


CROSTON = f"""WITH RECURSIVE {SPARSE}, nz AS (
  SELECT series_id, quantity AS v, i, row_number() OVER (PARTITION BY series_id ORDER BY i) AS k FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week) AS i FROM filled) WHERE quantity > 0
), st AS (
  SELECT series_id, k, i, v AS z, 1.0::DOUBLE AS x FROM nz WHERE k = 1
  UNION ALL SELECT n.series_id, n.k, n.i, 0.1 * n.v + 0.9 * s.z, 0.1 * (n.i - s.i) + 0.9 * s.x FROM st s JOIN nz n ON n.series_id = s.series_id AND n.k = s.k + 1
), fin AS (SELECT series_id, arg_max(z, k) AS z, arg_max(x, k) AS x FROM st GROUP BY 1), m AS (SELECT max(week) AS last FROM filled)"""
STEPS = "(SELECT unnest(generate_series(1, 4))::INT AS step)"


@query(f"{CROSTON} SELECT series_id, (last + 7 * step)::DATE AS week, step, round(z / x, 6) AS forecast FROM fin, m, {STEPS}")
def croston_forecast(spark, sf):
    return rounded(models.croston(panel.fill_gaps(parts_weekly(spark, sf)), 4), "forecast")


@query(f"{CROSTON} SELECT series_id, (last + 7 * step)::DATE AS week, step, round(0.95 * z / x, 6) AS forecast FROM fin, m, {STEPS}")
def croston_sba_forecast(spark, sf):
    return rounded(models.croston_sba(panel.fill_gaps(parts_weekly(spark, sf)), 4), "forecast")


@query(f"""{CROSTON}, q AS (SELECT f.series_id, x, list(v ORDER BY v) AS nz FROM fin f JOIN nz USING (series_id) GROUP BY 1, 2)
SELECT series_id, (last + 7)::DATE AS week, 1 AS step, CASE WHEN 0.5 <= 1 - 1 / x THEN 0.0 ELSE round(list_aggregate(nz, 'quantile_cont', 0.5) * 0 + (
  nz[(floor((0.5 - (1 - 1 / x)) * x * (len(nz) - 1)) + 1)::INT] + (nz[(ceil((0.5 - (1 - 1 / x)) * x * (len(nz) - 1)) + 1)::INT] - nz[(floor((0.5 - (1 - 1 / x)) * x * (len(nz) - 1)) + 1)::INT])
  * ((0.5 - (1 - 1 / x)) * x * (len(nz) - 1) - floor((0.5 - (1 - 1 / x)) * x * (len(nz) - 1)))), 4) END AS forecast_p50 FROM q, m""")
def croston_quantiles(spark, sf):
    return rounded(models.croston_quantiles(panel.fill_gaps(parts_weekly(spark, sf)), 1, [0.5]), "forecast_p50", places=4)


@query(f"""WITH RECURSIVE {SPARSE}, s AS (SELECT series_id, list(quantity ORDER BY week) AS y FROM filled GROUP BY 1), a AS (
  SELECT series_id, y, list_filter(y, lambda v: v > 0) AS nz FROM s
), st AS (
  SELECT series_id, 2 AS i, len(nz)::DOUBLE / len(y) AS p, coalesce(nz[1], 0.0)::DOUBLE AS z FROM a
  UNION ALL SELECT st.series_id, i + 1, CASE WHEN y[i] > 0 THEN 0.1 + 0.9 * p ELSE 0.9 * p END, CASE WHEN y[i] > 0 THEN 0.1 * y[i] + 0.9 * z ELSE z END FROM st JOIN a ON a.series_id = st.series_id WHERE i <= len(y)
), m AS (SELECT max(week) AS last FROM filled)
SELECT series_id, (last + 7)::DATE AS week, 1 AS step, round(arg_max(p * z, i), 6) AS forecast FROM st, m GROUP BY series_id, last""")
def tsb_forecast(spark, sf):
    return rounded(models.tsb(panel.fill_gaps(parts_weekly(spark, sf)), 1), "forecast")


@query(f"""{NAIVE}, c AS (SELECT *, greatest(50, least(400, forecast)) AS f FROM fc), t AS (SELECT *, sum(f) OVER (PARTITION BY week) AS s FROM c)
SELECT series_id, week, step, round(greatest(50, CASE WHEN s > 2000 THEN f * 2000 / s ELSE f END), 6) AS forecast FROM t""")
def constrained_forecast(spark, sf):
    return rounded(models.constrain(models.naive_seasonal(dense(spark, sf), 13), floor=50.0, cap=400.0, total_cap=2000.0), "forecast")


def grouped(name):
    def run(spark, sf):
        return rounded(models.forecast(name, dense(spark, sf), 13), "forecast")

    run.__name__ = f"{name}_forecast"
    return run


for _name in ("holt_winters", "theta_ses", "decomposition_drift", "autoregression"):
    query()(grouped(_name))


@query()
def gbt_direct_forecast(spark, sf):
    return models.gbt_direct(dense(spark, sf), 13, trees=5, depth=3)


@query()
def backtest_records(spark, sf):
    return backtest.run_backtest(dense(spark, sf), ["naive_seasonal", "moving_average"])


# ------------------------------------------------------------------ series quality
@query(f"""WITH {SPARSE}, s AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE quantity > 0) AS nz, avg(quantity) FILTER (WHERE quantity > 0) AS m, stddev_pop(quantity) FILTER (WHERE quantity > 0) AS sd FROM filled GROUP BY 1),
c AS (SELECT series_id, CASE WHEN n >= 10 AND nz >= 2 THEN n::DOUBLE / nz END AS adi, CASE WHEN n >= 10 AND nz >= 2 THEN (sd / m) ** 2 END AS cv2 FROM s)
SELECT series_id, round(adi + 1e-9, 5) AS adi, round(cv2 + 1e-9, 5) AS cv2, CASE WHEN adi IS NULL THEN 'insufficient_data' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'intermittent' WHEN adi < 1.32 THEN 'erratic' ELSE 'lumpy' END AS demand_class,
  coalesce(adi >= 1.32, false) AS is_sparse FROM c""")
def sbc_classes(spark, sf):
    out = demand.classify_demand(panel.fill_gaps(parts_weekly(spark, sf)))
    # ratios of small integers lie on .5 boundaries: a hair more rounds alike in both engines
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("adi", "cv2")}), "adi", "cv2", places=5)


FENCES = f"""WITH {DENSE}, q AS (SELECT series_id, quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM filled GROUP BY 1),
f AS (SELECT filled.*, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM filled JOIN q USING (series_id))"""


@query(f"{FENCES} SELECT series_id, week, quantity, low, high, quantity < low OR quantity > high AS is_outlier FROM f")
def outliers_iqr(spark, sf):
    return cleansing.outliers_iqr(dense(spark, sf))


@query(f"""WITH {DENSE}, z AS (SELECT *, abs(quantity - avg(quantity) OVER w) / stddev_samp(quantity) OVER w AS z FROM filled WINDOW w AS (PARTITION BY series_id))
SELECT series_id, week, quantity, round(z, 6) AS zscore, z > 2 AS is_outlier FROM z""")
def outliers_zscore(spark, sf):
    return rounded(cleansing.outliers_zscore(dense(spark, sf), 2.0), "zscore")


@query(f"{FENCES} SELECT series_id, week, greatest(low, least(high, quantity)) AS quantity, quantity < low OR quantity > high AS is_outlier FROM f")
def clip_outliers(spark, sf):
    return cleansing.clip_outliers(cleansing.outliers_iqr(dense(spark, sf)))


INTERP = """, r AS (SELECT *, row_number() OVER w AS r FROM g WINDOW w AS (PARTITION BY series_id ORDER BY week)),
n AS (SELECT *, CASE WHEN NOT flag THEN quantity END AS v, CASE WHEN NOT flag THEN r END AS a FROM r),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS v0, last_value(a IGNORE NULLS) OVER w AS r0, first_value(v IGNORE NULLS) OVER x AS v1, first_value(a IGNORE NULLS) OVER x AS r1 FROM n
  WINDOW w AS (PARTITION BY series_id ORDER BY week), x AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, week, flag AS {name}, round(CASE WHEN v IS NOT NULL THEN v ELSE coalesce(v0 + (v1 - v0) * (r - r0) / nullif(r1 - r0, 0), v0, v1) END, 6) AS quantity FROM b"""


@query(f"{FENCES}, g AS (SELECT series_id, week, quantity, quantity < low OR quantity > high AS flag FROM f){INTERP.format(name='is_outlier')}")
def interpolate_flagged(spark, sf):
    out = cleansing.outliers_iqr(dense(spark, sf)).drop("low", "high")
    return rounded(cleansing.interpolate_flagged(out, "is_outlier"), "quantity")


STOCK = f"""WITH {SPARSE}, c AS (SELECT *, CASE WHEN (quantity = 0) IS DISTINCT FROM (lag(quantity) OVER w = 0) THEN 1 ELSE 0 END AS c FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY week)),
g AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY week) AS run FROM c),
s AS (SELECT series_id, week, quantity, quantity = 0 AND count(*) OVER p >= 8 AND max(week) OVER p < max(week) OVER (PARTITION BY series_id) AS is_stockout FROM g WINDOW p AS (PARTITION BY series_id, run))"""


@query(f"{STOCK} SELECT * FROM s")
def stockouts(spark, sf):
    return cleansing.detect_stockouts(panel.fill_gaps(parts_weekly(spark, sf)), 8)


@query(f"""{STOCK} SELECT s.series_id, s.week, s.is_stockout, CASE WHEN NOT s.is_stockout THEN s.quantity WHEN y.quantity > 0 THEN y.quantity
  ELSE coalesce(CASE WHEN a.quantity IS NOT NULL AND b.quantity IS NOT NULL THEN (a.quantity + b.quantity) / 2 ELSE coalesce(a.quantity, b.quantity) END, s.quantity) END AS quantity
FROM s LEFT JOIN filled y ON y.series_id = s.series_id AND y.week = s.week - 364 LEFT JOIN filled a ON a.series_id = s.series_id AND a.week = s.week - 364 + 7 LEFT JOIN filled b ON b.series_id = s.series_id AND b.week = s.week - 364 - 7""")
def seasonal_impute(spark, sf):
    return cleansing.seasonal_impute(cleansing.detect_stockouts(panel.fill_gaps(parts_weekly(spark, sf)), 8))


@query(f"WITH {DENSE}, g AS (SELECT *, week BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AS flag FROM filled){INTERP.format(name='is_excluded')}")
def period_exclusion(spark, sf):
    return rounded(cleansing.exclude_periods(dense(spark, sf), [("1997-03-01", "1997-05-31")], "interpolate"), "quantity")


@query()
def cleanse_all(spark, sf):
    return cleansing.cleanse(dense(spark, sf), periods=[("1997-03-01", "1997-05-31")])


@query()
def cleansing_report(spark, sf):
    p = dense(spark, sf)
    return cleansing.cleansing_report(p, cleansing.cleanse(p))


@query(f"""WITH {PARTS}, g AS (SELECT series_id, (week - lag(week) OVER (PARTITION BY series_id ORDER BY week))::INT AS d FROM parts)
SELECT series_id, count(*) AS n_gaps, max(d) AS max_gap_days FROM g WHERE d <> 7 GROUP BY 1""")
def validate_frequency(spark, sf):
    return validation.frequency_faults(parts_weekly(spark, sf))


@query("""SELECT rule, severity, n, n = 0 AS ok FROM (SELECT unnest(['negative', 'null', 'below_min', 'above_max']) AS rule, unnest(['ERROR', 'WARNING', 'ERROR', 'WARNING']) AS severity,
  unnest([count(*) FILTER (WHERE c_acctbal < 0), count(*) FILTER (WHERE c_acctbal IS NULL), count(*) FILTER (WHERE c_acctbal < -500), count(*) FILTER (WHERE c_acctbal > 9000)]) AS n FROM customer)""")
def validate_range(spark, sf):
    return validation.value_range(table(spark, sf, "customer"), "c_acctbal", -500, 9000)


@query(f"""WITH {PARTS}, s AS (SELECT series_id, count(*) AS n, ((max(week) - min(week)) / 7 + 1)::BIGINT AS expected FROM parts GROUP BY 1)
SELECT series_id, n, expected, round(greatest(0, 100.0 * (1 - n / expected)), 6) AS missing_pct FROM s""")
def validate_completeness(spark, sf):
    return rounded(validation.missing_share(parts_weekly(spark, sf)), "missing_pct")


@query()
def validate_input(spark, sf):
    return validation.validate_input(parts_weekly(spark, sf))


@query("SELECT count(*) FILTER (WHERE l_orderkey IS NULL OR l_partkey IS NULL) AS null_keys, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS duplicate_rows FROM lineitem")
def pk_check(spark, sf):
    return validation.primary_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return validation.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query(f"""WITH {PANEL}, s AS (SELECT series_id, count(*) AS n, min(week) AS a, max(week) AS b, count(*) FILTER (WHERE quantity = 0) AS z, sum(abs(quantity)) AS t FROM panel GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_series, min(a) AS first, max(b) AS last, round(100.0 * (1 - sum(n) / sum((b - a) / 7 + 1)), 4) AS missing_pct, count(*) FILTER (WHERE n < (b - a) / 7 + 1) AS n_gappy,
  count(*) FILTER (WHERE n < 52) AS n_short, count(*) FILTER (WHERE t = 0) AS n_zero, count(*) FILTER (WHERE z > 0.5 * n) AS n_zero_inflated FROM s""")
def dq_report(spark, sf):
    return profiling.dq_report(brands(spark, sf))


@query(f"""WITH {PARTS} SELECT series_id, count(*) AS n_weeks, round(avg(quantity), 6) AS mean, round(stddev_samp(quantity), 6) AS std, 100.0 * count(*) FILTER (WHERE quantity = 0) / count(*) AS zero_pct,
  round(100.0 * (1 - count(*) / ((max(week) - min(week)) / 7 + 1)), 6) AS missing_pct, round(stddev_samp(quantity) / abs(avg(quantity)), 6) AS cv FROM parts GROUP BY 1""")
def dq_series(spark, sf):
    return rounded(profiling.dq_series(parts_weekly(spark, sf)), "mean", "std", "missing_pct", "cv")


@query(f"""WITH {DENSE}, w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS i, coalesce(sum(quantity) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  count(*) OVER (PARTITION BY series_id) AS n, sum(quantity) OVER (PARTITION BY series_id) AS t FROM filled),
g AS (SELECT *, abs(s / i - (t - s) / (n - i)) AS gap FROM w WHERE i >= 13 AND n - i >= 13)
SELECT series_id, week AS split_date, i AS split_index, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(gap, 6) DESC, week) AS r FROM g) WHERE r = 1""")
def cusum_best_split(spark, sf):
    return rounded(demand.best_split(dense(spark, sf)), "gap")


@query()
def cusum_breaks(spark, sf):
    return demand.detect_breaks(dense(spark, sf), penalty=0.3)


@query()
def truncate_breaks(spark, sf):
    p = dense(spark, sf)
    return demand.truncate_to_last_break(p, demand.detect_breaks(p, penalty=0.3))


# ------------------------------------------------------------------ transitions
def product_rows(spark, sf, countries: bool = True) -> DataFrame:
    """Products with a line of a known supplier; without countries the lines are aggregated once, and not dealt by supplier."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    spans = [F.min("l_shipdate").cast("date").alias("launch_date"), F.max("l_shipdate").cast("date").alias("eol_date")]
    if countries:
        items = lines.groupBy("p_partkey").agg(*spans)
        nations = lines.select("p_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct().join(table(spark, sf, "supplier"), "s_suppkey")
        items = items.join(nations.groupBy("p_partkey").agg(F.collect_set(F.col("s_nationkey").cast("string")).alias("country")), "p_partkey")
    else:
        known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("known"))
        items = lines.join(known, "l_suppkey", "left").groupBy("p_partkey").agg(*spans, F.max("known").alias("known")).where("known")
    out = table(spark, sf, "part").join(items, "p_partkey")
    return out.select(
        F.col("p_partkey").cast("string").alias("sku_id"), F.col("p_name").alias("sku_description"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("product_family"), F.col("p_type").alias("product_category"), F.lit("Standard").alias("form_factor"),
        F.when(F.col("p_retailprice") > 1400, "Premium").otherwise("Value").alias("price_tier"), *["country"] * countries, F.col("p_brand").alias("segment"), "launch_date", "eol_date",
        F.when(F.col("eol_date") < F.lit("2001-06-01").cast("date"), "Discontinued").otherwise("Active").alias("status"),
    )


PRODUCTS = """products AS (
  SELECT p_partkey::VARCHAR AS sku_id, p_name AS sku_description, p_type || ' ' || p_size AS product_family, p_type AS product_category, 'Standard' AS form_factor, CASE WHEN p_retailprice > 1400 THEN 'Premium' ELSE 'Value' END AS price_tier,
    country, p_brand AS segment, launch_date, eol_date, CASE WHEN eol_date < DATE '2001-06-01' THEN 'Discontinued' ELSE 'Active' END AS status
  FROM part JOIN (SELECT l_partkey, min(l_shipdate)::DATE AS launch_date, max(l_shipdate)::DATE AS eol_date FROM lineitem GROUP BY 1) i ON i.l_partkey = p_partkey
  JOIN (SELECT l_partkey, list(DISTINCT s_nationkey::VARCHAR) AS country FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) n ON n.l_partkey = p_partkey
)"""
MAPS = "maps AS (SELECT sku_id AS old_sku, (sku_id::BIGINT + 1)::VARCHAR AS new_sku, 1.0::DOUBLE AS proportion FROM products WHERE sku_id::BIGINT % 50 = 0)"


def maps(spark, sf) -> DataFrame:
    p = product_rows(spark, sf).where(F.col("sku_id").cast("long") % 50 == 0)
    return p.select(F.col("sku_id").alias("old_sku"), (F.col("sku_id").cast("long") + 1).cast("string").alias("new_sku"), F.lit(1.0).alias("proportion"))


ORIGIN = "1995-04-03"
PLANS = f"""{PRODUCTS}, {MAPS}, plan AS (
  SELECT old_sku, new_sku, proportion, CASE WHEN launch_date IS NULL OR launch_date <= DATE '{ORIGIN}' THEN 'A' WHEN launch_date <= DATE '{ORIGIN}' + 273 THEN 'B' ELSE 'C' END AS scenario, launch_date
  FROM maps LEFT JOIN products ON sku_id = new_sku
), plans AS (
  SELECT old_sku, new_sku, scenario, proportion, CASE WHEN scenario = 'B' THEN (launch_date - 42)::DATE END AS ramp_start, CASE WHEN scenario = 'B' THEN (launch_date + 42)::DATE END AS ramp_end, 'linear' AS ramp_shape FROM plan
)"""


def plans(spark, sf) -> DataFrame:
    return transition.transition_plans(maps(spark, sf), product_rows(spark, sf), ORIGIN)


@query(f"WITH {PLANS} SELECT * FROM plans")
def transition_plans(spark, sf):
    return plans(spark, sf)


@query(f"""WITH {PLANS}, {PARTS}, first AS (SELECT series_id AS new_sku, min(week) AS first FROM parts GROUP BY 1),
old AS (SELECT p.*, plans.*, first.first, greatest(0, least(1, (week - ramp_start)::DOUBLE / nullif((ramp_end - ramp_start), 0))) AS w FROM parts p JOIN plans ON old_sku = p.series_id LEFT JOIN first ON first.new_sku = plans.new_sku),
every AS (
  SELECT series_id, week, quantity FROM parts WHERE series_id NOT IN (SELECT old_sku FROM plans WHERE scenario <> 'C')
  UNION ALL SELECT new_sku, week, quantity FROM old WHERE scenario = 'A' AND (first IS NULL OR week < first)
  UNION ALL SELECT new_sku, week, quantity * w FROM old WHERE scenario = 'B'
  UNION ALL SELECT series_id, week, quantity * (1 - w) FROM old WHERE scenario = 'B'
) SELECT series_id, week, round(sum(quantity), 6) AS quantity FROM every GROUP BY 1, 2""")
def stitch_series(spark, sf):
    return rounded(transition.stitch_series(parts_weekly(spark, sf), plans(spark, sf)), "quantity")


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS t FROM orders WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'), p AS (SELECT t, greatest(0, least(1, (t - DATE '1997-04-01') / 91.0)) AS p FROM d)
SELECT t, round(p, 6) AS linear, round(3 * p * p - 2 * p * p * p, 6) AS scurve, (p >= 0.5)::INT::DOUBLE AS step, round(1 - p, 6) AS down FROM p""")
def ramp_weights(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("t")).where(F.col("t").between("1997-01-01", "1997-12-31")).distinct()
    a, b = F.lit("1997-04-01").cast("date"), F.lit("1997-07-01").cast("date")
    w = lambda s, down=False: transition.ramp_weight(F.col("t"), a, b, F.lit(s), down)
    return rounded(d.select("t", w("linear").alias("linear"), w("scurve").alias("scurve"), w("step").alias("step"), w("linear", True).alias("down")), "linear", "scurve", "down")


# ------------------------------------------------------------------ calibration, value added, drift, exceptions
def with_quantiles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("forecast_p10", F.col("forecast") * 0.75).withColumn("forecast_p90", F.col("forecast") * 1.25)


BAND = f"{EVAL}, band AS (SELECT model_id, series_id, actual, forecast * 0.75 AS low, forecast * 1.25 AS high FROM scored)"


@query(f"{BAND} SELECT round(avg((actual BETWEEN low AND high)::INT), 6) AS coverage, count(*) AS n FROM band")
def interval_coverage(spark, sf):
    return rounded(evaluation.interval_coverage(with_quantiles(scored_rows(spark, sf)), "forecast_p10", "forecast_p90"), "coverage")


@query(f"""{BAND} SELECT model_id, '80' AS label, 0.8::DOUBLE AS nominal, series_id, round(avg((actual BETWEEN low AND high)::INT), 4) AS empirical, round(avg((actual BETWEEN low AND high)::INT) - 0.8, 4) AS miscalibration, round(avg(high - low), 2) AS sharpness, count(*) AS n
FROM band GROUP BY GROUPING SETS ((model_id), (model_id, series_id))""")
def calibration_report(spark, sf):
    return evaluation.calibration_report(with_quantiles(scored_rows(spark, sf)), [0.1, 0.5, 0.9])


@query(f"{BAND} SELECT model_id, series_id, actual, '80' AS label, 0.8::DOUBLE AS nominal, round(low, 6) AS low, round(high, 6) AS high, round(greatest(low - actual, actual - high), 6) AS score FROM band")
def conformal_scores(spark, sf):
    return rounded(evaluation.conformal_scores(with_quantiles(scored_rows(spark, sf)), [0.1, 0.9]), "low", "high", "score")


@query(f"""{BAND}, s AS (SELECT model_id, greatest(low - actual, actual - high) AS score FROM band), r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score) AS r, count(*) OVER (PARTITION BY model_id) AS n FROM s)
SELECT model_id, '80' AS label, round(score, 6) AS correction FROM r WHERE r = greatest(1, least(n, ceil((n + 1) * 0.8)))""")
def conformal_correction(spark, sf):
    return rounded(evaluation.conformal_correction(evaluation.conformal_scores(with_quantiles(scored_rows(spark, sf)), [0.1, 0.9])), "correction")


@query(f"""{BAND}, s AS (SELECT model_id, greatest(low - actual, actual - high) AS score FROM band WHERE model_id = 'naive_seasonal'), r AS (SELECT *, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s),
c AS (SELECT score FROM r WHERE r = greatest(1, least(n, ceil((n + 1) * 0.8))))
SELECT series_id, fold::INT AS fold, week, round(forecast * 0.75 - score, 6) AS forecast_p10, round(forecast * 1.25 + score, 6) AS forecast_p90 FROM scored, c WHERE model_id = 'naive_seasonal'""")
def conformal_interval(spark, sf):
    rows = with_quantiles(scored_rows(spark, sf))
    c = evaluation.conformal_correction(evaluation.conformal_scores(rows, [0.1, 0.9]))
    out = evaluation.apply_conformal(rows.where("model_id = 'naive_seasonal'"), c, [0.1, 0.9], "naive_seasonal")
    return rounded(out, "forecast_p10", "forecast_p90").select("series_id", "fold", "week", "forecast_p10", "forecast_p90")


CASCADE = f"""{EVAL}, l AS (SELECT CASE model_id WHEN 'moving_average' THEN 'statistical' ELSE 'naive' END AS layer, CASE model_id WHEN 'moving_average' THEN 2 ELSE 1 END AS o, * FROM scored WHERE model_id <> 'last_value'),
m AS (SELECT layer, o, sum(abs(actual - forecast)) / sum(abs(actual)) AS wmape, sum(forecast - actual) / sum(abs(actual)) AS bias, avg(abs(actual - forecast)) AS mae FROM l GROUP BY 1, 2),
c AS (SELECT *, lag(layer) OVER (ORDER BY o) AS parent, lag(wmape) OVER (ORDER BY o) - wmape AS f, lag(abs(bias)) OVER (ORDER BY o) - abs(bias) AS fb FROM m)"""
FVA_CLASS = "CASE WHEN {p} IS NULL THEN 'BASELINE' WHEN {f} > 0.02 THEN 'ADDS_VALUE' WHEN {f} < -0.02 THEN 'DESTROYS_VALUE' ELSE 'NEUTRAL' END"


def layered(spark, sf) -> DataFrame:
    return scored_rows(spark, sf).where("model_id <> 'last_value'").withColumn("layer", evaluation.model_layer(F.col("model_id")))


@query(f"{CASCADE} SELECT layer, round(wmape, 6) AS wmape, round(bias, 6) AS normalized_bias, round(mae, 6) AS mae, parent, round(f, 6) AS fva_wmape, round(fb, 6) AS fva_bias, {FVA_CLASS.format(p='parent', f='f')} AS fva_class FROM c")
def fva_cascade(spark, sf):
    return rounded(evaluation.fva_cascade(layered(spark, sf)), "wmape", "normalized_bias", "mae", "fva_wmape", "fva_bias")


@query(f"{CASCADE} SELECT round(arg_min(wmape, o) - arg_max(wmape, o), 6) AS total_fva FROM m")
def total_fva(spark, sf):
    return rounded(evaluation.total_fva(layered(spark, sf)), "total_fva")


DETAIL = f"""{EVAL}, x AS (SELECT *, CASE model_id WHEN 'moving_average' THEN 'statistical' ELSE 'naive' END AS layer, CASE model_id WHEN 'moving_average' THEN 2 ELSE 1 END AS o FROM scores),
best AS (SELECT series_id, fold, layer, o, min(wmape) AS wmape, min(volume) AS volume, (list(model_id ORDER BY wmape, model_id))[1] AS model_id FROM x GROUP BY 1, 2, 3, 4),
detail AS (SELECT *, lag(layer) OVER w AS parent_layer, lag(wmape) OVER w AS parent_wmape, coalesce(lag(wmape) OVER w - wmape, 0) AS fva_wmape FROM best WINDOW w AS (PARTITION BY series_id, fold ORDER BY o)),
named AS (SELECT *, {FVA_CLASS.format(p='parent_layer', f='fva_wmape')} AS fva_class FROM detail)"""


@query(f"{DETAIL} SELECT series_id, fold::INT AS fold, layer, round(wmape, 6) AS wmape, model_id, volume, parent_layer, round(parent_wmape, 6) AS parent_wmape, round(fva_wmape, 6) AS fva_wmape, fva_class FROM named")
def fva_detail(spark, sf):
    return rounded(evaluation.fva_detail(scores(spark, sf)), "wmape", "parent_wmape", "fva_wmape")


@query(f"""{DETAIL} SELECT layer, count(*) AS n, count(*) FILTER (WHERE fva_class = 'ADDS_VALUE') AS n_adds, count(*) FILTER (WHERE fva_class = 'NEUTRAL') AS n_neutral, count(*) FILTER (WHERE fva_class = 'DESTROYS_VALUE') AS n_destroys,
  round(100.0 * count(*) FILTER (WHERE fva_class = 'ADDS_VALUE') / count(*), 1) AS pct_adds, round(avg(fva_wmape), 6) AS mean_fva, round(avg(wmape), 6) AS mean_wmape, sum(volume) AS volume FROM named WHERE parent_layer IS NOT NULL GROUP BY 1""")
def fva_summary(spark, sf):
    return rounded(evaluation.fva_summary(evaluation.fva_detail(scores(spark, sf))), "mean_fva", "mean_wmape")


@query(f"""{DETAIL}, b AS (SELECT layer, avg(fva_wmape) AS mean_fva, round(100.0 * count(*) FILTER (WHERE fva_wmape > 0) / count(*), 1) AS robustness_pct FROM named WHERE parent_layer IS NOT NULL GROUP BY 1)
SELECT layer, round(mean_fva, 6) AS mean_fva, robustness_pct, CASE WHEN robustness_pct >= 60 THEN 'Keep' WHEN robustness_pct >= 30 THEN 'Review' ELSE 'Remove' END AS recommendation, row_number() OVER (ORDER BY mean_fva DESC, layer)::INT AS rank FROM b""")
def layer_leaderboard(spark, sf):
    return rounded(evaluation.layer_leaderboard(evaluation.fva_detail(scores(spark, sf))), "mean_fva")


DRIFT = f"""{EVAL}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week DESC) AS r FROM naive), s AS (
  SELECT series_id, count(*) FILTER (WHERE r > 8) AS nb, sum(abs(actual - forecast)) FILTER (WHERE r <= 8) / nullif(sum(abs(actual)) FILTER (WHERE r <= 8), 0) AS wr, sum(abs(actual - forecast)) FILTER (WHERE r > 8) / nullif(sum(abs(actual)) FILTER (WHERE r > 8), 0) AS wb,
    abs(sum(forecast - actual) FILTER (WHERE r <= 8) / nullif(sum(abs(actual)) FILTER (WHERE r <= 8), 0)) AS bias, avg(actual) FILTER (WHERE r <= 8) AS mr, avg(actual) FILTER (WHERE r > 8) AS mb, stddev_samp(actual) FILTER (WHERE r > 8) AS sb
  FROM o WHERE r <= 34 GROUP BY 1), v AS (
  SELECT series_id, 'accuracy' AS signal, CASE WHEN nb >= 4 AND wb > 0 THEN wr / wb END AS value, 1.5 AS hi, 1.25 AS lo FROM s UNION ALL SELECT series_id, 'bias', bias, 0.25, 0.1 FROM s
  UNION ALL SELECT series_id, 'volume', CASE WHEN nb >= 4 AND sb > 0 THEN abs(mr - mb) / sb END, 3, 2 FROM s)"""


@query(f"{DRIFT} SELECT series_id, signal, CASE WHEN value > hi THEN 'critical' ELSE 'warning' END AS severity, round(value, 6) AS value, CASE WHEN value > hi THEN 0 ELSE 1 END AS severity_order FROM v WHERE value > lo")
def drift_alerts(spark, sf):
    rows = scored_rows(spark, sf).where("model_id = 'naive_seasonal'")
    return rounded(evaluation.drift_alerts(rows, time="week"), "value")


@query(f"""{EVAL}, r AS (SELECT model_id, week, avg(abs(actual - forecast)) AS m FROM scored WHERE fold = 2 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY week DESC) AS k FROM r),
l AS (SELECT model_id, avg(m) AS live, count(*) AS weeks FROM n WHERE k <= 8 GROUP BY 1), b AS (SELECT model_id, avg(abs(actual - forecast)) AS backtest FROM scored WHERE fold < 2 GROUP BY 1)
SELECT model_id, round(backtest, 6) AS backtest, round(live, 6) AS live, weeks, round(live / backtest, 6) AS ratio, CASE WHEN weeks < 4 THEN 'insufficient' WHEN live / backtest <= 1.25 THEN 'ok' WHEN live / backtest <= 1.5 THEN 'warning' ELSE 'alert' END AS status FROM b JOIN l USING (model_id)""")
def model_drift(spark, sf):
    rows = scored_rows(spark, sf).withColumn("err", F.abs(F.col("actual") - F.col("forecast")))
    return rounded(evaluation.model_drift(rows.where("fold < 2"), rows.where("fold = 2"), "err", time="week"), "backtest", "live", "ratio")


@query(f"{EVAL} SELECT model_id, round(avg(wmape), 6) AS mean_wmape, round(avg(normalized_bias), 6) AS mean_bias, count(DISTINCT series_id) AS n_series, sum(n_obs)::BIGINT AS n_obs FROM scores GROUP BY 1")
def model_cards(spark, sf):
    return rounded(evaluation.model_cards(scores(spark, sf)), "mean_wmape", "mean_bias")


def comparison(spark, sf) -> DataFrame:
    f = models.naive_seasonal(dense(spark, sf), 13).drop("step")
    f = with_quantiles(f.withColumn("forecast", F.col("forecast").cast("double")))
    field = f.select("series_id", "week", (F.col("forecast") * 1.3).alias("forecast"))
    prior = f.where("series_id < 'Brand#4'").select("series_id", "week", (F.col("forecast") * 0.7).alias("forecast"))
    return evaluation.compare_forecasts(f, {"field": field}, prior)


COMPARE = f"""{NAIVE}, cmp AS (SELECT series_id, week, forecast AS model_forecast, forecast * 0.75 AS forecast_p10, forecast * 1.25 AS forecast_p90, CASE WHEN forecast > 0 THEN (forecast * 1.25 - forecast * 0.75) / forecast END AS uncertainty_ratio,
  forecast * 1.3 AS field_forecast, forecast - forecast * 1.3 AS field_gap, (forecast - forecast * 1.3) / nullif(abs(forecast * 1.3), 0) * 100 AS field_gap_pct,
  CASE WHEN series_id < 'Brand#4' THEN forecast * 0.7 END AS prior_model_forecast, CASE WHEN series_id < 'Brand#4' THEN forecast - forecast * 0.7 END AS cycle_change,
  CASE WHEN series_id < 'Brand#4' THEN (forecast - forecast * 0.7) / nullif(abs(forecast * 0.7), 0) * 100 END AS cycle_change_pct FROM fc)"""
CMP_COLS = ["forecast_p10", "forecast_p90", "uncertainty_ratio", "field_forecast", "field_gap", "field_gap_pct", "prior_model_forecast", "cycle_change", "cycle_change_pct"]
CMP_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in CMP_COLS)


@query(f"{COMPARE} SELECT series_id, week, model_forecast, {CMP_ROUND} FROM cmp")
def compare_forecasts(spark, sf):
    return rounded(comparison(spark, sf), *CMP_COLS)


FLAGGED = f"""{COMPARE}, fl AS (SELECT series_id, week, coalesce(abs(cycle_change_pct) > 20, false) AS exc_large_cycle_change, coalesce(uncertainty_ratio > 0.4, false) AS exc_high_uncertainty, coalesce(abs(field_gap_pct) > 22, false) AS exc_field_disagree,
  coalesce(field_gap_pct > 30, false) AS exc_overforecast, coalesce(field_gap_pct < -20, false) AS exc_underforecast, prior_model_forecast IS NULL AS exc_no_prior FROM cmp),
fx AS (SELECT *, exc_large_cycle_change OR exc_high_uncertainty OR exc_field_disagree OR exc_overforecast OR exc_underforecast OR exc_no_prior AS has_exception FROM fl)"""
FLAGS = ["exc_large_cycle_change", "exc_high_uncertainty", "exc_field_disagree", "exc_overforecast", "exc_underforecast", "exc_no_prior", "has_exception"]


def flagged(spark, sf) -> DataFrame:
    return evaluation.exception_flags(comparison(spark, sf), uncertainty=0.4, disagree=22.0, under=-20.0)


@query(f"{FLAGGED} SELECT * FROM fx")
def exception_flags(spark, sf):
    return flagged(spark, sf).select("series_id", "week", *FLAGS)


@query(f"{FLAGGED} SELECT series_id, {', '.join(f'sum({c}::INT)::BIGINT AS {c}' for c in FLAGS)} FROM fx GROUP BY 1")
def exception_summary(spark, sf):
    return evaluation.exception_summary(flagged(spark, sf))


@query(f"{COMPARE} SELECT series_id, round(avg(uncertainty_ratio), 6) AS uncertainty_ratio, round(avg(field_gap), 6) AS field_gap, round(avg(field_gap_pct), 6) AS field_gap_pct, round(avg(cycle_change), 6) AS cycle_change, round(avg(cycle_change_pct), 6) AS cycle_change_pct FROM cmp GROUP BY 1")
def comparison_summary(spark, sf):
    return rounded(evaluation.comparison_summary(comparison(spark, sf)), "uncertainty_ratio", "field_gap", "field_gap_pct", "cycle_change", "cycle_change_pct")


@query(f"""WITH {DENSE}, t AS (SELECT *, CASE WHEN count(*) OVER w = 53 THEN avg(quantity) OVER w END AS trend, (row_number() OVER (PARTITION BY series_id ORDER BY week) - 1) % 52 AS p FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)),
s AS (SELECT *, coalesce(avg(quantity - trend) OVER (PARTITION BY series_id, p), 0) AS seasonal FROM t)
SELECT series_id, week, quantity, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(quantity - trend - seasonal, 6) AS residual FROM s""")
def decompose(spark, sf):
    return rounded(evaluation.decompose(dense(spark, sf)).drop("_p"), "trend", "seasonal", "residual")


@query()
def decompose_forecast(spark, sf):
    p = dense(spark, sf)
    return evaluation.decompose_forecast(p, models.naive_seasonal(p, 13))


@query()
def narrative(spark, sf):
    return evaluation.narrative(comparison(spark, sf), dense(spark, sf))


@query(f"WITH {DENSE} SELECT series_id, round(stddev_samp(quantity) / abs(avg(quantity)), 6) AS cv FROM filled GROUP BY 1")
def variation(spark, sf):
    return rounded(demand.variation(dense(spark, sf)), "cv")


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week)::DOUBLE AS r FROM filled) SELECT series_id, round(regr_r2(quantity, r), 6) AS trend_strength FROM r GROUP BY 1")
def trend_strength(spark, sf):
    return rounded(demand.trend_strength(dense(spark, sf)), "trend_strength")


@query(f"""WITH {DENSE}, r AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY week) - 1) % 52 AS p FROM filled), d AS (SELECT *, quantity - avg(quantity) OVER (PARTITION BY series_id, p) AS d FROM r)
SELECT series_id, round(greatest(0, 1 - var_pop(d) / var_pop(quantity)), 6) AS seasonal_strength FROM d GROUP BY 1""")
def seasonal_strength(spark, sf):
    return rounded(demand.seasonal_strength(dense(spark, sf)), "seasonal_strength")


@query(f"""WITH {DENSE}, t AS (SELECT *, CASE WHEN count(*) OVER w = 53 THEN avg(quantity) OVER w END AS s FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING))
SELECT series_id, round(least(100, var_pop(s) / var_pop(CASE WHEN s IS NOT NULL THEN quantity - s END)), 6) AS snr FROM t GROUP BY 1""")
def signal_to_noise(spark, sf):
    return rounded(demand.signal_to_noise(dense(spark, sf)), "snr")


@query()
def forecastability(spark, sf):
    return demand.forecastability(dense(spark, sf))


# ------------------------------------------------------------------ hierarchies
LEVELS = ["region", "nation", "customer"]


def geography(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return hierarchy.paths(c.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_custkey").cast("string").alias("customer")), LEVELS)


def monthly_orders(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("customer"), F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").cast("double").alias("n"))


GEO = """geo AS (SELECT r_name AS region, n_name AS nation, c_custkey::VARCHAR AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ord AS (SELECT o_custkey::VARCHAR AS customer, date_trunc('month', o_orderdate)::DATE AS month, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)"""


@query(f"WITH {GEO} SELECT * FROM geo")
def hierarchy_paths(spark, sf):
    return geography(spark, sf)


@query("SELECT DISTINCT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def hierarchy_parent_child(spark, sf):
    return hierarchy.parent_child(geography(spark, sf), "region", "nation")


@query(f"WITH {GEO} SELECT 'region' AS node_level, region AS node_key, customer AS leaf_key FROM geo UNION ALL SELECT 'nation', nation, customer FROM geo UNION ALL SELECT 'customer', customer, customer FROM geo")
def summing_matrix(spark, sf):
    return hierarchy.summing_matrix(geography(spark, sf), LEVELS)


@query(f"WITH {GEO} SELECT nation, month, sum(n) AS n FROM ord JOIN geo USING (customer) GROUP BY 1, 2")
def rollup_nation(spark, sf):
    return hierarchy.roll_up(monthly_orders(spark, sf), geography(spark, sf), LEVELS, "nation", ["n"], "month")


@query(f"""WITH {GEO}, j AS (SELECT * FROM ord JOIN geo USING (customer))
SELECT 'region' AS node_level, region AS node_key, month, sum(n) AS n FROM j GROUP BY region, month UNION ALL SELECT 'nation', nation, month, sum(n) FROM j GROUP BY nation, month UNION ALL SELECT 'customer', customer, month, sum(n) FROM j GROUP BY customer, month""")
def rollup_all_levels(spark, sf):
    return hierarchy.roll_up_all(monthly_orders(spark, sf), geography(spark, sf), LEVELS, "n", "month")


@query(f"""WITH {GEO}, r AS (SELECT region, month, sum(n) AS n FROM ord JOIN geo USING (customer) GROUP BY 1, 2), k AS (SELECT DISTINCT region, nation FROM geo), c AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY region) AS p FROM k)
SELECT nation, month, round(n * p, 6) AS n FROM r JOIN c USING (region)""")
def disaggregate_equal(spark, sf):
    path = geography(spark, sf)
    top = hierarchy.roll_up(monthly_orders(spark, sf), path, LEVELS, "region", ["n"], "month")
    return rounded(hierarchy.disaggregate(top, path, "region", "nation", ["n"]), "n")


@query(f"WITH {GEO}, s AS (SELECT region, nation, sum(n) AS s FROM ord JOIN geo USING (customer) GROUP BY 1, 2) SELECT region, nation, round(s / sum(s) OVER (PARTITION BY region), 6) AS proportion FROM s")
def historical_proportions(spark, sf):
    return rounded(hierarchy.proportions(monthly_orders(spark, sf), geography(spark, sf), "region", "nation", "n", "month", "customer"), "proportion")


@query(f"""WITH {GEO}, m AS (SELECT max(month) AS m FROM ord), s AS (SELECT nation, customer, sum(n) AS s FROM ord JOIN geo USING (customer) GROUP BY 1, 2), p AS (SELECT *, s / sum(s) OVER (PARTITION BY nation) AS p FROM s),
f AS (SELECT nation, sum(n) AS forecast FROM ord JOIN geo USING (customer), m WHERE month = m GROUP BY 1)
SELECT customer, m AS month, round(forecast * p, 6) AS forecast FROM f JOIN p USING (nation), m""")
def reconcile_middle_out(spark, sf):
    path, o = geography(spark, sf), monthly_orders(spark, sf)
    last = hierarchy.roll_up(o, path, LEVELS, "nation", ["n"], "month").withColumnRenamed("n", "forecast")
    last = last.join(F.broadcast(o.agg(F.max("month").alias("month"))), "month")
    return rounded(hierarchy.middle_out(last, o, path, LEVELS, "nation", "n", "month"), "forecast")


@query(f"""WITH {GEO}, w AS (SELECT 'World' AS world, geo.* FROM geo), m AS (SELECT max(month) AS m FROM ord), s AS (SELECT world, nation, sum(n) AS s FROM ord JOIN w USING (customer) GROUP BY 1, 2), p AS (SELECT *, s / sum(s) OVER (PARTITION BY world) AS p FROM s),
f AS (SELECT world, sum(n) AS forecast FROM ord JOIN w USING (customer), m WHERE month = m GROUP BY 1)
SELECT nation, m AS month, round(forecast * p, 6) AS forecast FROM f JOIN p USING (world), m""")
def reconcile_top_down(spark, sf):
    path = geography(spark, sf).withColumn("world", F.lit("World"))
    o = monthly_orders(spark, sf).join(path, "customer").groupBy("nation", "month").agg(F.sum("n").alias("n"))
    nations = path.select("world", "nation").distinct()
    root = o.groupBy("month").agg(F.sum("n").alias("forecast")).withColumn("world", F.lit("World")).join(F.broadcast(o.agg(F.max("month").alias("month"))), "month")
    return rounded(hierarchy.top_down(root, o, nations, ["world", "nation"], "n", "month"), "forecast")


def reconciled(method):
    def run(spark, sf):
        path = geography(spark, sf).select("region", "nation").distinct()
        o = monthly_orders(spark, sf).join(geography(spark, sf), "customer").groupBy("nation", "month").agg(F.sum("n").alias("n"))
        every = hierarchy.roll_up_all(o, path, ["region", "nation"], "n", "month").withColumn("forecast", F.col("n") * F.when(F.col("node_level") == "region", 1.1).otherwise(1.0))
        res = every.select("node_level", "node_key", "month", (F.col("forecast") - F.col("n") + (F.xxhash64("node_key", "month") % 7)).alias("residual"))
        return hierarchy.reconcile(every.select("node_level", "node_key", "month", "forecast"), path, ["region", "nation"], "month", method, res)

    run.__name__ = f"reconcile_{method}"
    return run


for _name in ("ols", "wls", "wls_var", "mint"):
    query()(reconciled(_name))


@query("SELECT * FROM (VALUES ('n', 'r', true), ('r', 'n', false)) t(child, parent, holds)")
def hierarchy_detection(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("n"), F.col("n_regionkey").alias("r"))
    return hierarchy.functional_levels(n, ["n", "r"])


# ------------------------------------------------------------------ checks, profiles, statistics
@query("""SELECT col AS "column", n_null, n_blank, n_zero, n_unique, n_null / n AS null_rate, 'COMPLETE' AS status, n_unique <= 1 AS is_constant FROM (
  SELECT count(*)::DOUBLE AS n, unnest(['c_name', 'c_nationkey', 'c_acctbal']) AS col, unnest([0, 0, 0])::BIGINT AS n_blank, unnest([0::BIGINT, count(*) FILTER (WHERE c_nationkey = 0), count(*) FILTER (WHERE c_acctbal = 0)]) AS n_zero,
    unnest([count(*) FILTER (WHERE c_name IS NULL), count(*) FILTER (WHERE c_nationkey IS NULL), count(*) FILTER (WHERE c_acctbal IS NULL)]) AS n_null, unnest([count(DISTINCT c_name), count(DISTINCT c_nationkey), count(DISTINCT c_acctbal)]) AS n_unique FROM customer)""")
def completeness(spark, sf):
    return validation.completeness(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_acctbal"])


@query("SELECT unnest(['event_id', 'user_id']) AS \"column\", unnest([0.0, 0.0])::DOUBLE AS null_rate, 'PASS' AS status")
def null_concentration(spark, sf):
    return validation.null_concentration(table(spark, sf, "events").select("event_id", "user_id"))


@query("""SELECT *, CASE WHEN orphan_rate > 0.05 THEN 'BLOCKER' WHEN n_orphans > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM (SELECT count(*) AS n_keys, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_orphans, count(*) FILTER (WHERE l.doc_id IS NULL) / count(*) AS orphan_rate
  FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)""")
def orphans(spark, sf):
    return validation.orphans(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query("""WITH d AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem), g AS (SELECT lag(d) OVER (ORDER BY d) AS before, d AS after FROM d) SELECT before, after, (after - before)::INT AS gap_days FROM g WHERE after - before > 1""")
def date_gaps(spark, sf):
    return validation.date_gaps(table(spark, sf, "lineitem"), "l_shipdate", 1)


@query("SELECT rule, 'WARNING' AS severity, n, n = 0 AS ok FROM (SELECT unnest(['null_date', 'before_start', 'after_end']) AS rule, unnest([0, count(*) FILTER (WHERE o_orderdate::DATE < DATE '1996-01-01'), count(*) FILTER (WHERE o_orderdate::DATE > DATE '2001-01-01')]) AS n FROM orders)")
def date_range(spark, sf):
    return validation.date_range(table(spark, sf, "orders"), "o_orderdate", "1996-01-01", "2001-01-01")


@query("SELECT 'future_date' AS rule, 'BLOCKER' AS severity, count(*) FILTER (WHERE o_orderdate::DATE > DATE '2001-01-31') AS n, count(*) FILTER (WHERE o_orderdate::DATE > DATE '2001-01-31') = 0 AS ok FROM orders")
def no_future_dates(spark, sf):
    return validation.no_future_dates(table(spark, sf, "orders"), "o_orderdate", "2001-01-01", 30)


@query("SELECT count(*) AS n, count(*) BETWEEN 1 AND 1000000000 AS ok FROM lineitem")
def row_count(spark, sf):
    return validation.row_count(table(spark, sf, "lineitem"), 1, 1_000_000_000)


@query(f"""WITH {DENSE}, w AS (SELECT *, avg(quantity) OVER x AS m, stddev_samp(quantity) OVER x AS s, row_number() OVER (PARTITION BY series_id ORDER BY week) AS r FROM filled WINDOW x AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT series_id, week, quantity, round((quantity - m) / nullif(s, 0), 6) AS z FROM w WHERE r > 12 AND abs((quantity - m) / nullif(s, 0)) > 2.5""")
def trailing_anomalies(spark, sf):
    return rounded(validation.trailing_anomalies(dense(spark, sf), z=2.5), "z")


@query(f"WITH {DENSE}, s AS (SELECT *, quantity - lag(quantity) OVER (PARTITION BY series_id ORDER BY week) AS step FROM filled) SELECT * FROM s WHERE step < 0")
def not_monotonic(spark, sf):
    return validation.not_monotonic(dense(spark, sf), "quantity", "week", group="series_id")


@query(f"""WITH {PANEL}, s AS (SELECT *, lag(quantity) OVER (PARTITION BY series_id ORDER BY week) AS before FROM panel) SELECT series_id, week, quantity, before, round((quantity - before) / nullif(abs(before), 0), 6) AS change FROM s WHERE abs((quantity - before) / nullif(abs(before), 0)) > 2""")
def spikes(spark, sf):
    return rounded(validation.spikes(brands(spark, sf), 2.0), "change")


@query(f"""{EVAL}, b AS (SELECT series_id, sign(forecast - lag(forecast) OVER w) AS df, sign(actual - lag(actual) OVER w) AS da FROM naive WINDOW w AS (PARTITION BY series_id ORDER BY week))
SELECT series_id, count(*) AS n, count(*) FILTER (WHERE df <> da) AS n_mismatch FROM b WHERE df IS NOT NULL GROUP BY 1""")
def direction_mismatch(spark, sf):
    rows = scored_rows(spark, sf).where("model_id = 'naive_seasonal'")
    return validation.direction_mismatch(rows.select("series_id", "week", F.col("forecast").alias("quantity")), rows.select("series_id", "week", F.col("actual").alias("quantity")))


@query("""WITH c AS (SELECT l_orderkey AS k, sum(l_quantity) AS child_sum FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS k, sum(o_totalprice) AS parent_sum FROM orders GROUP BY 1)
SELECT k, child_sum::DOUBLE AS child_sum, round(parent_sum, 4) AS parent_sum, round(abs(coalesce(child_sum, 0) - coalesce(parent_sum, 0)), 4) AS gap FROM c FULL JOIN p USING (k) WHERE abs(coalesce(child_sum, 0) - coalesce(parent_sum, 0)) > 0.01 * greatest(abs(coalesce(parent_sum, 0)), 1)""")
def aggregation_gaps(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return rounded(validation.aggregation_gaps(a, b, "k", "v"), "parent_sum", "gap", places=4)


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100 + l_tax * 100, 6) AS total FROM lineitem WHERE abs(round(l_discount * 100 + l_tax * 100, 6) - 10) > 5")
def percentages_sum(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100, 6).alias("a"))
    return validation.percentages(items, ["a"], 10.0, 5.0).drop("a")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 6) AS ratio FROM lineitem WHERE NOT (l_extendedprice / nullif(l_quantity, 0) BETWEEN 950 AND 1500)")
def ratio_bounds(spark, sf):
    return rounded(validation.ratio_bounds(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 950, 1500), "ratio").select("l_orderkey", "l_linenumber", "ratio")


@query("SELECT min(n) AS smallest, max(n) AS largest, count(*) FILTER (WHERE n < 10) AS n_small, round(max(n) / min(n), 6) AS ratio, count(*) FILTER (WHERE n < 10) = 0 AND max(n) / min(n) <= 10 AS ok FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def group_balance(spark, sf):
    return rounded(validation.group_balance(table(spark, sf, "orders"), "o_orderpriority", 10), "ratio")


@query("SELECT rule, 'WARNING' AS severity, n, n = 0 AS ok FROM (SELECT unnest(['l_discount_range', 'l_quantity_range']) AS rule, unnest([count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05), count(*) FILTER (WHERE l_quantity < 5)]) AS n FROM lineitem)")
def range_rules(spark, sf):
    return validation.ranges(table(spark, sf, "lineitem"), {"l_discount": (0.0, 0.05), "l_quantity": (5.0, None)})


@query("SELECT rule, 'WARNING' AS severity, n, n = 0 AS ok FROM (SELECT unnest(['l_quantity < l_extendedprice', 'l_tax <= l_discount']) AS rule, unnest([count(*) FILTER (WHERE NOT l_quantity < l_extendedprice), count(*) FILTER (WHERE NOT l_tax <= l_discount)]) AS n FROM lineitem)")
def column_relations(spark, sf):
    return validation.relations(table(spark, sf, "lineitem"), [("l_quantity", "<", "l_extendedprice"), ("l_tax", "<=", "l_discount")])


@query("SELECT s AS segment, coalesce(n, 0) AS n, coalesce(n, 0) >= 1 AS ok FROM (SELECT unnest(['O', 'F', 'X']) AS s) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON o_orderstatus = s")
def segment_coverage(spark, sf):
    return validation.segment_coverage(table(spark, sf, "orders"), "o_orderstatus", ["O", "F", "X"])


@query("SELECT 'c_acctbal_negative' AS rule, 'WARNING' AS severity, count(*) FILTER (WHERE c_acctbal < 0) AS n, count(*) FILTER (WHERE c_acctbal < 0) = 0 AS ok FROM customer")
def no_negatives(spark, sf):
    return validation.no_negatives(table(spark, sf, "customer"), ["c_acctbal"])


@query("SELECT count(DISTINCT p_brand) AS n, count(DISTINCT p_brand) BETWEEN 1 AND 50 AS ok FROM part")
def cardinality(spark, sf):
    return validation.cardinality(table(spark, sf, "part"), "p_brand", 1, 50)


@query("""WITH r AS (SELECT l_returnflag AS seg, year(l_shipdate) AS y, l_discount AS v, l_quantity AS w FROM lineitem WHERE year(l_shipdate) IN (1996, 1999)),
o AS (SELECT sum(v * w) FILTER (WHERE y = 1996) / sum(w) FILTER (WHERE y = 1996) AS a, sum(v * w) FILTER (WHERE y = 1999) / sum(w) FILTER (WHERE y = 1999) AS b FROM r),
s AS (SELECT seg, sum(v * w) FILTER (WHERE y = 1996) / sum(w) FILTER (WHERE y = 1996) AS a, sum(v * w) FILTER (WHERE y = 1999) / sum(w) FILTER (WHERE y = 1999) AS b FROM r GROUP BY 1),
d AS (SELECT CASE WHEN abs((b - a) / a) <= 0.001 THEN 0 ELSE sign(b - a) END::INT AS overall, a, b FROM o), e AS (SELECT CASE WHEN abs((b - a) / a) <= 0.001 THEN 0 ELSE sign(b - a) END::INT AS d FROM s)
SELECT overall, round(a, 6) AS mean_a, round(b, 6) AS mean_b, (SELECT count(*) FROM e) AS n_segments, (SELECT count(*) FROM e WHERE d <> 0 AND d = -overall) AS n_reversed, (SELECT count(*) FROM e WHERE d <> 0 AND d = -overall) > (SELECT count(*) FROM e) / 2 AS is_paradox FROM d""")
def simpsons_paradox(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate"))
    return rounded(validation.simpson(items, "l_returnflag", "l_discount", "y", 1996, 1999, "l_quantity"), "mean_a", "mean_b")


@query("SELECT l_returnflag, round(avg(l_discount), 6) AS unweighted, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(sum(l_discount * l_quantity) / sum(l_quantity) - avg(l_discount), 6) AS gap FROM lineitem GROUP BY 1")
def weighted_means(spark, sf):
    return rounded(validation.weighted_means(table(spark, sf, "lineitem"), "l_discount", "l_quantity", "l_returnflag"), "unweighted", "weighted", "gap")


@query("SELECT 30.0 * 0.01 * 70 + 0.25 * 90 + 0.25 * 100 + 0.2 * 100 - 30.0 * 0.01 * 70 + 0.3 * 70 - (0.3 * 70 + 0.25 * 90 + 0.25 * 100 + 0.2 * 100 - 69.0) AS score, 'D' AS grade")
def confidence_score(spark, sf):
    found = spark.createDataFrame([("structural", "BLOCKER"), ("logical", "WARNING")], "layer string, severity string")
    return validation.confidence(found)


@query()
def profile_numeric(spark, sf):
    return profiling.distributions(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""SELECT col AS "column", n, round(mean, 4) AS mean, round(std, 4) AS std, p25, p50, p75 FROM (
  SELECT 'l_quantity' AS col, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, quantile_cont(l_quantity::DOUBLE, 0.25) AS p25, quantile_cont(l_quantity::DOUBLE, 0.5) AS p50, quantile_cont(l_quantity::DOUBLE, 0.75) AS p75 FROM lineitem
  UNION ALL SELECT 'l_discount', count(*), avg(l_discount), stddev_samp(l_discount), quantile_cont(l_discount::DOUBLE, 0.25), quantile_cont(l_discount::DOUBLE, 0.5), quantile_cont(l_discount::DOUBLE, 0.75) FROM lineitem)""")
def profile_quartiles(spark, sf):
    return rounded(profiling.distributions(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), "mean", "std", places=4).select("column", "n", "mean", "std", "p25", "p50", "p75")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM lineitem")
def profile_correlations(spark, sf):
    return rounded(profiling.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 0.0), "r")


@query("SELECT isodow(ts)::INT AS weekday, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def weekday_pattern(spark, sf):
    return rounded(profiling.weekday_pattern(table(spark, sf, "events"), "ts", "value"), "mean")


@query()
def temporal_profile(spark, sf):
    return profiling.temporal_profile(table(spark, sf, "events"), "ts", "value")


@query("""SELECT measure, source, target, gap, CASE WHEN gap = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT measure, source, target, abs(source - target) AS gap FROM (SELECT unnest(['rows', 'o_orderkey.nulls', 'o_orderkey.distinct', 'o_orderkey.sum']) AS measure,
  unnest([count(*), 0, count(DISTINCT o_orderkey), sum(o_orderkey)])::DOUBLE AS source, unnest([count(*) FILTER (WHERE o_orderkey % 2 = 0), 0, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 2 = 0), sum(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0)])::DOUBLE AS target FROM orders))""")
def tieout_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return profiling.tie_out(o, o.where("o_orderkey % 2 = 0"))


@query("SELECT 0::BIGINT AS n_fail, 0::BIGINT AS n_warn, 4::BIGINT AS n, 'PASS' AS decision")
def tieout_gate(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return profiling.gate(profiling.tie_out(o, o))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem), r AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a)) AS n_outliers FROM lineitem, q)
SELECT n, n_outliers, round(n_outliers / n, 6) AS rate, CASE WHEN n_outliers / n > 0.05 THEN 'FAIL' WHEN n_outliers > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM r""")
def outlier_rate(spark, sf):
    return rounded(profiling.outlier_rate(table(spark, sf, "lineitem"), "l_extendedprice", k=0.5), "rate")


@query("""WITH s AS (SELECT sum((l_returnflag = 'R')::INT) FILTER (WHERE l_discount > 0.05) AS xa, count(*) FILTER (WHERE l_discount > 0.05) AS na, sum((l_returnflag = 'R')::INT) FILTER (WHERE l_discount <= 0.05) AS xb, count(*) FILTER (WHERE l_discount <= 0.05) AS nb FROM lineitem)
SELECT round(xa / na, 6) AS p_a, round(xb / nb, 6) AS p_b, round(xa / na - xb / nb, 6) AS diff, round((xa / na - xb / nb) / sqrt((xa + xb) / (na + nb) * (1 - (xa + xb) / (na + nb)) * (1 / na + 1 / nb)), 6) AS z FROM s""")
def proportion_test(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("g", F.when(F.col("l_discount") > 0.05, "a").otherwise("b"))
    return rounded(statistics.proportion_test(items, "g", "a", "b", F.col("l_returnflag") == "R"), "p_a", "p_b", "diff", "z").drop("p_value")


@query("""WITH s AS (SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS ma, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS va, count(*) FILTER (WHERE o_orderstatus = 'O') AS na,
  avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS mb, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS vb, count(*) FILTER (WHERE o_orderstatus = 'F') AS nb FROM orders)
SELECT round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 3) AS df, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohen_d FROM s""")
def mean_test(spark, sf):
    out = statistics.mean_test(table(spark, sf, "orders"), "o_orderstatus", "O", "F", "o_totalprice")
    return rounded(rounded(rounded(out, "mean_a", "mean_b", places=4), "df", places=3), "t", "cohen_d")


@query("""WITH c AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS na, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM c),
s AS (SELECT sum(rank * na) AS ra, sum(na)::DOUBLE AS na, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n * n - n) AS ties FROM r)
SELECT round(ra - na * (na + 1) / 2, 3) AS u, round((ra - na * (na + 1) / 2 - na * (n - na) / 2) / sqrt(na * (n - na) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s""")
def mann_whitney(spark, sf):
    out = statistics.mann_whitney(table(spark, sf, "lineitem"), "l_returnflag", "R", "A", "l_quantity")
    return rounded(rounded(out, "u", places=3), "z").drop("p_value")


@query("""WITH o AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), t AS (SELECT sum(o) AS n FROM o), e AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb FROM o),
s AS (SELECT sum(o * o * n / (ra * rb)) - max(n) AS chi2, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, max(n) AS n FROM e, t)
SELECT round(chi2, 6) AS chi2, (ka - 1) * (kb - 1) AS dof, n::BIGINT AS n, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) AS cramers_v FROM s""")
def chi_squared(spark, sf):
    return rounded(statistics.chi_squared(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"), "chi2", "cramers_v")


@query("""WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 97 + 1) / 1000.0 AS p FROM orders WHERE o_orderkey < 60), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p)
SELECT k, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS p_adjusted FROM r""")
def bh_adjust(spark, sf):
    p = table(spark, sf, "orders").where("o_orderkey < 60").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 97 + 1) / 1000.0).cast("double").alias("p"))
    return rounded(statistics.adjust_p(p), "p", "p_adjusted")


@query("""WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 97 + 1) / 1000.0 AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p)
SELECT k, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS p_adjusted FROM r""")
def bh_adjust_all(spark, sf):
    """bh_adjust over every order."""
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 97 + 1) / 1000.0).cast("double").alias("p"))
    return rounded(statistics.adjust_p(p), "p", "p_adjusted")


@query("""WITH g AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS g, o_totalprice AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM orders), a AS (SELECT dimension, g, count(*) AS n, avg(v) AS m FROM g GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT dimension, avg(v) AS gm, sum((v - (SELECT avg(o_totalprice) FROM orders)) ** 2) AS sst, count(*) AS n FROM g GROUP BY 1), b AS (SELECT a.dimension, sum(a.n * (m - gm) ** 2) AS ssb, count(*) AS k FROM a JOIN t USING (dimension) GROUP BY 1)
SELECT dimension, round(ssb / sst, 6) AS eta2, round((ssb / (k - 1)) / ((sst - ssb) / (n - k)), 4) AS f, k AS n_groups FROM b JOIN t USING (dimension)""")
def anova_dimensions(spark, sf):
    return rounded(rounded(statistics.rank_dimensions(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"]), "eta2"), "f", places=4)


@query(f"""{EVAL}, e AS (SELECT abs(a.actual - a.forecast) - abs(b.actual - b.forecast) AS d FROM naive a JOIN moving b ON a.fold = b.fold AND a.series_id = b.series_id AND a.week = b.week)
SELECT round(avg(d), 6) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) AS n FROM e""")
def accuracy_test(spark, sf):
    rows = scored_rows(spark, sf).withColumn("e", F.col("actual") - F.col("forecast"))
    wide = rows.groupBy("fold", "series_id", "week").agg(*[F.max(F.when(F.col("model_id") == m, F.col("e"))).alias(m) for m in THREE])
    return rounded(statistics.paired_test(wide, "naive_seasonal", "moving_average"), "mean_difference", "t")


@query()
def bootstrap_mean(spark, sf):
    return statistics.bootstrap(table(spark, sf, "orders"), "o_totalprice", rounds=200)


# ------------------------------------------------------------------ causal
def priced(spark, sf) -> DataFrame:
    s = sold(spark, sf).withColumn("week", F.date_trunc("week", "l_shipdate").cast("date"))
    return s.groupBy(F.col("p_brand").alias("series_id"), "week").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), (F.avg("l_discount") >= 0.05).cast("double").alias("promo_flag"))


PRICED = """priced AS (SELECT p_brand AS series_id, date_trunc('week', l_shipdate)::DATE AS week, sum(l_quantity)::DOUBLE AS quantity, avg(l_extendedprice / l_quantity) AS unit_price, (round(avg(l_discount), 12) >= 0.05)::INT AS promo FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query(f"""WITH {PRICED}, x AS (SELECT series_id, ln(quantity) AS y, ln(unit_price) AS p, row_number() OVER (PARTITION BY series_id ORDER BY week)::DOUBLE AS t FROM priced WHERE quantity > 0 AND unit_price > 0),
s AS (SELECT series_id, count(*) AS n, covar_samp(p, y) AS py, covar_samp(t, y) AS ty, covar_samp(p, t) AS pt, var_samp(p) AS pp, var_samp(t) AS tt, var_samp(y) AS yy FROM x GROUP BY 1 HAVING count(*) >= 20),
e AS (SELECT *, (py * tt - ty * pt) / (pp * tt - pt * pt) AS b, (ty * pp - py * pt) / (pp * tt - pt * pt) AS c FROM s)
SELECT series_id, n, round(b, 5) AS elasticity, round((b * py + c * ty) / yy, 5) AS r2, CASE WHEN b > 0 THEN 'positive' WHEN abs(b) >= 1 THEN 'elastic' ELSE 'inelastic' END AS label FROM e""")
def elasticity(spark, sf):
    return rounded(causal.price_elasticity(priced(spark, sf)).drop("se", "p_value"), "elasticity", "r2", places=5)


@query(f"""WITH {PRICED}, s AS (SELECT series_id, count(*) FILTER (WHERE promo > 0) AS n_promo, count(*) FILTER (WHERE promo <= 0) AS n_base, avg(quantity) FILTER (WHERE promo > 0) AS mean_promo, avg(quantity) FILTER (WHERE promo <= 0) AS mean_base,
  var_samp(quantity) FILTER (WHERE promo > 0) AS vp, var_samp(quantity) FILTER (WHERE promo <= 0) AS vb FROM priced GROUP BY 1 HAVING count(*) FILTER (WHERE promo > 0) > 0 AND count(*) FILTER (WHERE promo <= 0) > 0)
SELECT series_id, n_promo, n_base, round(mean_promo, 6) AS mean_promo, round(mean_base, 6) AS mean_base, round((mean_promo - mean_base) / mean_base, 6) AS lift, round((mean_promo - mean_base) / sqrt(vp / n_promo + vb / n_base), 6) AS t FROM s""")
def promo_lift(spark, sf):
    p = priced(spark, sf).drop("promo_flag")
    d = sold(spark, sf).withColumn("week", F.date_trunc("week", "l_shipdate").cast("date")).groupBy(F.col("p_brand").alias("series_id"), "week").agg((F.round(F.avg("l_discount"), 12) >= 0.05).cast("int").alias("promo_flag"))
    return rounded(causal.promo_lift(p.join(d, ["series_id", "week"])).drop("p_value"), "mean_promo", "mean_base", "lift", "t")


@query()
def cannibalisation(spark, sf):
    return causal.cannibalisation(dense(spark, sf).withColumn("grp", F.lit("all")), "grp", -0.1)


# ------------------------------------------------------------------ mapping
ATTR = f"""{PRODUCTS}, pairs AS (SELECT o.*, n.sku_id AS sku_id_new, n.price_tier AS price_tier_new, n.form_factor AS form_factor_new, n.product_category AS product_category_new, n.country AS country_new, n.sku_description AS sku_description_new, (n.launch_date - o.launch_date) AS gap
  FROM products o JOIN products n ON n.product_family = o.product_family AND n.segment = o.segment WHERE o.status = 'Discontinued' AND n.launch_date > o.launch_date AND n.launch_date - o.launch_date <= 365),
attr AS (SELECT sku_id AS old_sku, sku_id_new AS new_sku, round(0.3 + 0.2 * (price_tier = price_tier_new)::INT + 0.2 * (form_factor = form_factor_new)::INT + 0.1 * (product_category = product_category_new)::INT + 0.1 * (gap < 90)::INT, 6)::DOUBLE AS score FROM pairs WHERE list_has_any(country, country_new))"""


@query(f"WITH {ATTR} SELECT old_sku, new_sku, 'attribute' AS method, score FROM attr")
def attr_candidates(spark, sf):
    return rounded(mapping.attribute_candidates(product_rows(spark, sf)), "score")


@query(r"""SELECT name, nullif(trim(regexp_extract(lower(name), '(\s+mk\s*(?:ii|iii|iv|v|vi|\d+)$|\s+gen\s*\d+$|\s+v\s*\d+$|\s+plus$|\s+pro$|\s+(?:lite|sport)$|\s+(?:ii|iii|iv|v|vi)$|\s+\d+$|-20\d{2}$|-mk(?:ii|iii|iv|v|vi|\d+)$|-gen\d+$|-v\d+$)', 1)), '') AS marker,
  trim(regexp_replace(lower(name), '(\s+mk\s*(?:ii|iii|iv|v|vi|\d+)$|\s+gen\s*\d+$|\s+v\s*\d+$|\s+plus$|\s+pro$|\s+(?:lite|sport)$|\s+(?:ii|iii|iv|v|vi)$|\s+\d+$|-20\d{2}$|-mk(?:ii|iii|iv|v|vi|\d+)$|-gen\d+$|-v\d+$)', '')) AS base
FROM (SELECT DISTINCT unnest([p_name || ' Pro', p_name || ' Mk II', p_name || '-2024', p_name || ' ' || p_size]) AS name FROM part)""")
def name_markers(spark, sf):
    p = table(spark, sf, "part")
    n = p.select(F.explode(F.array(F.concat("p_name", F.lit(" Pro")), F.concat("p_name", F.lit(" Mk II")), F.concat("p_name", F.lit("-2024")), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))).alias("name")).distinct()
    return n.select("name", mapping.name_marker(F.col("name")).alias("marker"), mapping.name_base(F.col("name")).alias("base"))


FUSED = f"{ATTR}, k AS (SELECT *, count(*) OVER (PARTITION BY old_sku) AS o, count(*) OVER (PARTITION BY new_sku) AS n FROM attr WHERE score >= 0.3)"


@query(f"""WITH {FUSED} SELECT old_sku, new_sku, score AS confidence_score, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level, CASE WHEN o = 1 AND n = 1 THEN '1-to-1' WHEN n = 1 THEN '1-to-Many' WHEN o = 1 THEN 'Many-to-1' ELSE 'Many-to-Many' END AS mapping_type,
  round(CASE WHEN o > 1 THEN 1.0 / o WHEN n > 1 THEN 1.0 / n ELSE 1.0 END, 6)::DOUBLE AS proportion FROM k""")
def fusion(spark, sf):
    return rounded(mapping.fuse(mapping.attribute_candidates(product_rows(spark, sf))), "proportion").drop("methods_matched")


@query(f"""WITH {FUSED}, g AS (SELECT *, CASE WHEN o = 1 AND n > 1 THEN 'n' || new_sku ELSE 'o' || old_sku END AS g FROM k), p AS (SELECT *, round((1.0 / count(*) OVER (PARTITION BY g) + score) / (1.0 + sum(score) OVER (PARTITION BY g)), 4) AS p FROM g),
r AS (SELECT *, round(1 - sum(p) OVER (PARTITION BY g), 4) AS rest, row_number() OVER (PARTITION BY g ORDER BY p DESC, old_sku, new_sku) AS r FROM p)
SELECT old_sku, new_sku, CASE WHEN o = 1 AND n = 1 THEN 1.0 ELSE round(p + CASE WHEN r = 1 THEN rest ELSE 0 END, 4) END AS proportion FROM r""")
def mapping_proportions(spark, sf):
    return mapping.bayesian_proportions(mapping.fuse(mapping.attribute_candidates(product_rows(spark, sf)))).select("old_sku", "new_sku", "proportion")


@query()
def naming_candidates(spark, sf):
    return mapping.naming_candidates(product_rows(spark, sf, countries=False).withColumn("product_family", F.concat_ws(" ", "product_family", "segment")))


@query()
def map_products(spark, sf):
    sales = parts_weekly(spark, sf).withColumnRenamed("series_id", "sku_id")
    p = product_rows(spark, sf).withColumn("product_family", F.concat_ws(" ", "product_family", "segment"))
    return mapping.map_products(p, sales)


# ------------------------------------------------------------------ regressors, files, stores, streams
@query("""WITH h AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE day(o_orderdate) = 1 AND year(o_orderdate) = 1996), g AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-30', INTERVAL 7 DAY))::DATE AS week)
SELECT g.week, count(h.d) AS holiday_count, (count(h.d) > 0)::INT AS is_holiday FROM g LEFT JOIN h ON date_trunc('week', h.d) = g.week GROUP BY 1""")
def holiday_calendar(spark, sf):
    h = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).where("day(date) = 1 AND year(date) = 1996").distinct()
    return regressors.holiday_calendar(h, "1996-01-01", "1996-12-30")


@query("SELECT unnest(['l_quantity', 'l_tax']) AS \"column\", unnest([round(var_samp(l_quantity), 6), round(var_samp(l_tax), 6)]) AS variance, unnest([var_samp(l_quantity) >= 0.001, var_samp(l_tax) >= 0.001]) AS keep FROM lineitem")
def screen_variance(spark, sf):
    return rounded(regressors.screen_variance(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 0.001), "variance")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def screen_correlation(spark, sf):
    return rounded(regressors.screen_correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 0.0), "r")


@query("""WITH b AS (SELECT min(l_quantity) AS qa, max(l_quantity) AS qb, min(l_extendedprice) AS ea, max(l_extendedprice) AS eb FROM lineitem), x AS (SELECT least(9, floor((l_quantity - qa) * 10 / (qb - qa))) AS x, least(9, floor((l_extendedprice - ea) * 10 / (eb - ea))) AS y FROM lineitem, b),
c AS (SELECT x, y, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM w""")
def mutual_information(spark, sf):
    return rounded(regressors.mutual_information(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "mi")


@query(f"""WITH {PRICED}, l AS (SELECT series_id, max(week) AS m, arg_max(unit_price, week) AS unit_price FROM priced GROUP BY 1) SELECT series_id, step::INT AS step, (m + 7 * step)::DATE AS week, round(unit_price, 6) AS unit_price FROM l, (SELECT unnest(generate_series(1, 4))::INT AS step)""")
def future_features(spark, sf):
    return rounded(regressors.future_features(priced(spark, sf), ["unit_price"], 4), "unit_price")


@query()
def validate_regressors(spark, sf):
    f = priced(spark, sf)
    return regressors.validate_regressors(f.where("series_id < 'Brand#5'"), f, ["unit_price", "promo_flag"])


@query("SELECT count(*) AS n_left, count(l.doc_id) AS n_found, round(100.0 * count(l.doc_id) / count(*), 6) AS overlap_pct, count(l.doc_id) * 2 >= count(*) AS ok FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def key_overlap(spark, sf):
    return rounded(files.key_overlap(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]), "overlap_pct")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def merge_files(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return files.merge_files(table(spark, sf, "customer"), {"nation": (n, ["c_nationkey"], "dimension")})


@query("SELECT 1.0::DOUBLE AS median_gap, 'D' AS frequency")
def detect_frequency(spark, sf):
    return files.detect_frequency(table(spark, sf, "events"), "ts", ["event_type"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return stores.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query(f"{EVAL} SELECT series_id, round(avg(normalized_bias), 6) AS avg_bias, round(avg(wmape), 6) AS avg_wmape, sum(actual) AS total_actual FROM scored JOIN scores USING (model_id, fold, series_id) GROUP BY 1")
def bias_report(spark, sf):
    return rounded(stores.bias_report(backtest.metric_rows(scored_rows(spark, sf), ("wmape", "normalized_bias"))), "avg_bias", "avg_wmape")


@query(f"{NAIVE} SELECT fc.series_id, fc.week, step, forecast, a.quantity AS quantity_actual FROM fc JOIN (SELECT series_id, (week + 364)::DATE AS week, quantity FROM filled) a ON a.series_id = fc.series_id AND a.week = fc.week")
def forecast_vs_actual(spark, sf):
    p = dense(spark, sf)
    later = p.select("series_id", F.date_add("week", 364).alias("week"), "quantity")
    return stores.forecast_vs_actual(models.naive_seasonal(p, 13), later)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    out = rounded(live.tumbling(table(spark, sf, "events")), "total", places=4)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def events_sliding(spark, sf):
    return live.sliding(table(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def events_sessions(spark, sf):
    out = live.sessions(table(spark, sf, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedup(spark, sf):
    return live.deduplicated(table(spark, sf, "events"), ["user_id", "event_type"]).select("user_id", "event_type")
