import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from panelforge.functions import distributions as D
from panelforge.functions.metrics import metric_set, normal_cdf
from panelforge.operators import causal, evaluation, hierarchy, mapping, profiling, statistics, validation
from panelforge.plans import backtest, catalog, models
from panelforge.plans.pipeline import Config, run_backtest, run_forecast
from panelforge.sources import readers, stores


def weeks(n):
    return [dt.date(2022, 1, 3) + dt.timedelta(7 * i) for i in range(n)]


def panel_of(spark, made):
    return spark.createDataFrame([(n, w, float(v)) for n, vs in made.items() for w, v in zip(weeks(len(vs)), vs, strict=True)], "series_id string, week date, quantity double")


def test_metrics_and_undefined(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0)], "actual double, forecast double")
    r = df.agg(*metric_set(["wmape", "normalized_bias", "mape", "mae", "rmse"])).first()
    assert (round(r.wmape, 6), round(r.normalized_bias, 6), r.mape, r.mae) == (0.1, round(-10 / 300, 6), 0.1, 15.0)
    zero = spark.createDataFrame([(0.0, 5.0)], "actual double, forecast double").agg(*metric_set(["wmape", "normalized_bias", "mape"])).first()
    assert tuple(zero) == (None, 0.0, None)
    with pytest.raises(KeyError):
        metric_set(["nope"])


def test_normal_and_t(spark):
    assert abs(spark.range(1).select(normal_cdf(F.lit(1.96))).first()[0] - 0.9750021) < 1e-6
    assert abs(D.t_two_sided(2.228, 10) - 0.05) < 1e-3 and abs(D.chi2_sf(3.841, 1) - 0.05) < 1e-3 and abs(D.normal_ppf(0.975) - 1.959964) < 1e-5
    assert abs(D.f_sf(4.1028, 2, 10) - 0.05) < 1e-3


def test_seasonal_naive_wraps_short_series(spark):
    df = panel_of(spark, {"a": [1, 2, 3]})
    got = [r.forecast for r in models.naive_seasonal(df, 5, season=2).orderBy("step").collect()]
    assert got == [2, 3, 2, 3, 2]
    assert [r.forecast for r in models.naive_seasonal(df, 4, season=52).orderBy("step").collect()] == [1, 2, 3, 1]


def test_intermittent(spark):
    df = panel_of(spark, {"a": [0, 2, 0, 0, 4], "z": [0, 0, 0]})
    got = {r.series_id: r.forecast for r in models.croston(df, 1).collect()}
    z, x = 0.1 * 4 + 0.9 * 2, 0.1 * 3 + 0.9 * 1
    assert abs(got["a"] - z / x) < 1e-12 and got["z"] == 0
    p, zz = 0.4, 2.0
    for v in [2, 0, 0, 4]:
        p, zz = (0.1 + 0.9 * p, 0.1 * v + 0.9 * zz) if v else (0.9 * p, zz)
    assert abs({r.series_id: r.forecast for r in models.tsb(df, 1).collect()}["a"] - p * zz) < 1e-12


def test_kernels_learn_a_season(spark):
    y = [50 + 10 * (i % 4) for i in range(40)]
    df = panel_of(spark, {"a": y})
    for name in ("holt_winters", "theta_ses", "decomposition_drift", "autoregression"):
        got = [r.forecast for r in models.forecast(name, df, 4, season=4, order=8, ridge=0.1).orderBy("step").collect()]
        assert all(abs(g - w) < 6 for g, w in zip(got, [50, 60, 70, 80], strict=True)), (name, got)


def test_failures_stay_with_their_series(spark):
    def kernel(y, h):
        if y[0] == 0:
            raise ValueError("bad series")
        return y[:h]

    rows = models.per_series(panel_of(spark, {"a": [0, 1], "b": [5, 6]}), 1, "W", kernel).collect()
    assert {r.series_id: (r.forecast, r.error) for r in rows} == {"a": (None, "bad series"), "b": (5.0, None)}


def test_ensemble_and_constraints(spark):
    df = panel_of(spark, {"a": [1, 3], "b": [10, 30]})
    last, mean = models.last_value(df, 1), models.moving_average(df, 1, window=2)
    got = {r.series_id: r.forecast for r in models.weighted_ensemble({"x": last, "y": mean}, {"x": 0, "y": 0}).collect()}
    assert got == {"a": 2.5, "b": 25.0}
    capped = {r.series_id: r.forecast for r in models.constrain(last, cap=20.0, total_cap=11.5).collect()}
    assert capped == {"a": 1.5, "b": 10.0}
    q = models.monotone_quantiles(spark.createDataFrame([(3.0, 1.0, 2.0)], "a double, b double, c double"), ["a", "b", "c"]).first()
    assert tuple(q) == (1.0, 2.0, 3.0)


def test_folds_count_back(spark):
    f = backtest.folds(panel_of(spark, {"a": range(100)}), 3, 13).collect()
    assert [r.fold for r in f] == [0, 1, 2] and f[2].val_end == weeks(100)[-1] and f[0].train_end == weeks(100)[60]
    assert [r.fold for r in backtest.folds(panel_of(spark, {"a": range(80)}), 3, 13).collect()] == [1, 2]


def test_undefined_metric_never_wins(spark):
    s = spark.createDataFrame([("m1", "a", None, 0.0), ("m2", "a", 0.5, 0.1)], "model_id string, series_id string, wmape double, normalized_bias double")
    assert backtest.champions(s, ["series_id"]).first().model_id == "m2"
    assert backtest.champions(s).first().model_id == "m2"


def test_conformal_literals(spark):
    rows = spark.createDataFrame([("m", "a", 100.0, 90.0, 110.0), ("m", "a", 150.0, 90.0, 110.0), ("m", "a", 100.0, 80.0, 120.0)], "model_id string, series_id string, actual double, forecast_p10 double, forecast_p90 double")
    s = evaluation.conformal_scores(rows, [0.1, 0.9])
    assert sorted(r.score for r in s.collect()) == [-20.0, -10.0, 40.0]
    assert evaluation.conformal_correction(s).first().correction == 40.0


def test_fva_class_by_layer(spark):
    rows = [("naive_seasonal", 100.0, 150.0), ("naive_seasonal", 200.0, 250.0), ("naive_seasonal", 150.0, 200.0), ("holt_winters", 100.0, 105.0), ("holt_winters", 200.0, 195.0), ("holt_winters", 150.0, 155.0)]
    df = spark.createDataFrame(rows, "model_id string, actual double, forecast double").withColumn("layer", evaluation.model_layer(F.col("model_id")))
    got = {r.layer: r.fva_class for r in evaluation.fva_cascade(df).collect()}
    assert got == {"naive": "BASELINE", "statistical": "ADDS_VALUE"}


def geography(spark):
    rows = [("W", "NA", "USA", 100.0), ("W", "NA", "CAN", 50.0), ("W", "EU", "GBR", 80.0), ("W", "EU", "DEU", 60.0)]
    df = spark.createDataFrame([(*r, w) for r in rows for w in weeks(2)], "world string, region string, country string, quantity double, week date")
    return df, hierarchy.paths(df, ["world", "region", "country"])


def test_roll_up_and_proportions(spark):
    df, path = geography(spark)
    every = {(r.node_level, r.node_key): r.quantity for r in hierarchy.roll_up_all(df.select("country", "week", "quantity"), path, ["world", "region", "country"], "quantity", "week").where(F.col("week") == weeks(1)[0]).collect()}
    assert every["region", "NA"] == 150 and every["world", "W"] == 290 and len(every) == 7
    p = {r.country: r.proportion for r in hierarchy.proportions(df.select("country", "week", "quantity"), path, "region", "country", "quantity", "week", "country").collect()}
    assert abs(p["USA"] - 100 / 150) < 1e-12


def test_reconciled_is_coherent_and_keeps_coherent_input(spark):
    df, path = geography(spark)
    levels = ["world", "region", "country"]
    base = hierarchy.roll_up_all(df.select("country", "week", "quantity"), path, levels, "quantity", "week").withColumnRenamed("quantity", "forecast")
    for method in ("ols", "wls"):
        got = {r.leaf_key: r.forecast for r in hierarchy.reconcile(base, path, levels, "week", method).where(F.col("week") == weeks(1)[0]).collect()}
        assert all(abs(got[k] - v) < 1e-3 for k, v in {"USA": 100, "CAN": 50, "GBR": 80, "DEU": 60}.items())


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", -1.0), (None, "b", None)], "k int, s string, v double")
    assert tuple(validation.primary_key(df, ["k"]).first()) == (1, 1)
    assert {r.rule: r.n for r in validation.value_range(df, "v").collect()} == {"negative": 1, "null": 1}
    assert validation.check_schema(df, ["k", "z"], {"s": "numeric"}) == [("z", "BLOCKER", "missing"), ("s", "WARNING", "string is not numeric")]
    c = {r.column: r.status for r in validation.completeness(df).collect()}
    assert c == {"k": "CRITICAL", "s": "COMPLETE", "v": "CRITICAL"}
    assert profiling.gate(profiling.tie_out(df, df)).first().decision == "PASS"
    assert validation.confidence(spark.createDataFrame([], "layer string, severity string")).first().score == 100


def test_simpson(spark):
    rows = [("x", 1, 10.0)] * 90 + [("y", 1, 1.0)] * 10 + [("x", 2, 11.0)] * 10 + [("y", 2, 2.0)] * 90
    r = validation.simpson(spark.createDataFrame(rows, "seg string, p int, v double"), "seg", "v", "p", 1, 2).first()
    assert r.is_paradox and r.n_reversed == 2


def test_statistics_on_known_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    r = statistics.mean_test_p(df, "g", "a", "b", "v")
    assert abs(r["t"] + 3.674235) < 1e-5 and abs(r["p_value"] - 0.02131) < 1e-4
    assert statistics.mann_whitney(df, "g", "a", "b", "v").first().u == 0
    ci = statistics.mean_interval(df.where("g = 'a'"), "v")
    assert abs(ci["low"] + 0.484) < 1e-2
    assert statistics.sample_size_mean(1.0, 0.5) == 63
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert [round(x.p_adjusted, 4) for x in statistics.adjust_p(p, method="holm").orderBy("p").collect()] == [0.03, 0.06, 0.06]
    b = statistics.bootstrap(df, "v", rounds=200).first()
    assert b.low <= 3.5 <= b.high


def test_bootstrap_runs_the_rounds_asked_for(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counted(v):
        with open(log, "a") as f:
            f.write("x")
        return float(v.mean())

    df = spark.createDataFrame([(float(i),) for i in range(40)], "v double")
    r = statistics.bootstrap(df, "v", statistic=counted, rounds=50).first()
    assert r.low < r.estimate < r.high
    assert os.path.getsize(log) == 50 + 1  # one block: its rounds and the estimate itself


def adjusted(values, method):
    """The plain step-up and step-down procedures over a list."""
    order, n, out = sorted(range(len(values)), key=values.__getitem__), len(values), {}
    if method == "bh":
        least = 1.0
        for r in range(n, 0, -1):
            least = min(least, values[order[r - 1]] * n / r)
            out[order[r - 1]] = least
    else:
        most = 0.0
        for r in range(1, n + 1):
            most = max(most, values[order[r - 1]] * (n - r + 1)) if method == "holm" else values[order[r - 1]] * n
            out[order[r - 1]] = min(1.0, most)
    return [out[i] for i in range(n)]


@pytest.mark.parametrize("method", ["bonferroni", "holm", "bh"])
def test_adjusted_p_with_ties_nulls_and_many_values(spark, method):
    values = [((i * 7919) % 1000 + 1) ** 2 / 1e7 if i % 3 else 0.002 for i in range(3000)]
    rows = [(i, v) for i, v in enumerate(values)] + [(-1, None), (-2, None)]
    out = statistics.adjust_p(spark.createDataFrame(rows, "i int, p double"), method=method)
    got = {r.i: r.p_adjusted for r in out.collect()}
    assert len(got) == len(rows) and got[-1] is None and got[-2] is None
    assert all(abs(got[i] - v) < 1e-12 for i, v in enumerate(adjusted(values, method)))
    assert statistics.adjust_p(spark.createDataFrame([], "i int, p double"), method=method).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_order_is_adjusted(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    keys = [r.o_orderkey for r in orders.select("o_orderkey").collect()]
    want = dict(zip(keys, adjusted([(k % 97 + 1) / 1000.0 for k in keys], "bh")))
    got = {r.k: r.p_adjusted for r in catalog.QUERIES["bh_adjust_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in keys)


def test_elasticity_recovers_the_slope(spark):
    import math

    rows = [("a", w, math.exp(5 - 1.5 * math.log(1 + i % 7) + 0.01 * i), float(1 + i % 7)) for i, w in enumerate(weeks(60))]
    r = causal.price_elasticity(spark.createDataFrame(rows, "series_id string, week date, quantity double, unit_price double")).first()
    assert abs(r.elasticity + 1.5) < 1e-6 and r.label == "elastic"


def test_mapping(spark):
    products = readers.mock_products(spark)
    got = {(r.old_sku, r.new_sku) for r in mapping.map_products(products).collect()}
    assert ("SKU00-v1", "SKU00-v2") in got and all(o[:5] == n[:5] for o, n in got)
    names = spark.createDataFrame([("SoundMax 2",), ("Alpha Mk II",), ("Plain",), ("X-2024",)], "n string")
    assert [tuple(r) for r in names.select(mapping.name_base(F.col("n")), mapping.name_marker(F.col("n"))).collect()] == [("soundmax", "2"), ("alpha", "mk ii"), ("plain", None), ("x", "-2024")]
    r = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("a", "b")], "a string, b string").select(mapping.indel_ratio("a", "b")).collect()
    assert [x[0] for x in r] == [0.75, 1.0, 0.0]


def test_names_are_paired_without_rows_of_pairs(spark, monkeypatch):
    import random

    rng, day = random.Random(7), dt.date(2020, 1, 1)
    names = ["Sound Max", "Sound Max 2", "SoundMax Pro", "Alpha Mk II", "Alpha mk III", "alpha", "", None, "é\U0001f600-2024", "long " * 14, "long " * 13 + "gen 2", "x"]
    made = [(rng.choice(["f", "g", "h", None]), f"S{rng.randrange(40)}-v{rng.randrange(3)}", rng.choice(names), rng.choice([None] + [day + dt.timedelta(rng.randrange(700)) for _ in range(9)])) for _ in range(150)]
    products = spark.createDataFrame(made + made[:5], "product_family string, sku_id string, sku_description string, launch_date date").withColumn("status", F.lit("Active"))

    def common(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            above, row = row, [0]
            for j, b in enumerate(y):
                row.append(above[j] + 1 if a == b else max(row[j], above[j + 1]))
        return row[-1]

    parsed = products.select("product_family", "launch_date", "sku_id", *[f(F.col(c)) for c in ("sku_description", "sku_id") for f in (mapping.name_base, mapping.name_marker)]).collect()
    want = []
    for a in parsed:
        for b in parsed:
            if not a[0] or a[0] != b[0] or not a[1] or not b[1] or not 0 < (b[1] - a[1]).days <= 365:
                continue
            best = []
            for k in (3, 5):
                if a[k] is None or b[k] is None:
                    continue
                ratio = 2.0 * common(a[k], b[k]) / (len(a[k]) + len(b[k])) if a[k] or b[k] else 1.0
                if ratio >= 0.7:
                    best.append(min(1.0, 0.5 * ratio + (0.3 if b[k + 1] is not None and a[k + 1] != b[k + 1] else 0.0) + 0.2))
            if best:
                want.append((a[2], b[2], "naming", max(best)))
    assert len(want) > 300
    for olds, batch in ((1024, 10000), (4, 7)):
        monkeypatch.setattr(mapping, "OLDS", olds)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = mapping.naming_candidates(products)
            assert "Join" not in got._jdf.queryExecution().toString()
            assert sorted(map(tuple, got.collect())) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_common_subsequences_of_all_pairs(monkeypatch):
    import random

    rng = random.Random(5)
    for alphabet, longest in (("01234", 8), ("ab ", 30), ("aé\U0001f600\0", 64), ("abc", 90)):
        xs, ys = ([""] + ["".join(rng.choices(alphabet, k=rng.randint(0, n))) for _ in range(30)] for n in (longest, longest + 20))
        for table in (mapping.TABLE, 8):
            monkeypatch.setattr(mapping, "TABLE", table)
            got = mapping.subsequences(xs, ys)
            assert [list(map(int, r)) for r in got] == [[mapping.subsequence(x, y) for x in xs] for y in ys]


def test_products_of_known_suppliers(spark, tmp_path):
    rows = {
        "part": ([(k, "n", "b", "t", 1, 900.0) for k in range(5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, 3), (1, 4), (2, None)], "s_suppkey long, s_nationkey int"),
        "lineitem": ([(0, 1, 5), (0, 9, 2), (1, 9, 1), (2, 2, 7), (3, None, 1), (None, 1, 1)], "l_partkey long, l_suppkey long, d int"),
    }
    for name, (made, schema) in rows.items():
        df = spark.createDataFrame(made, schema)
        (df.select("l_partkey", "l_suppkey", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("l_shipdate")) if name == "lineitem" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    whole = catalog.product_rows(spark, str(tmp_path)).drop("country")
    got = catalog.product_rows(spark, str(tmp_path), countries=False)
    assert got.columns == whole.columns and sorted(got.collect()) == sorted(whole.collect())
    assert [(r.sku_id, r.launch_date) for r in got.orderBy("sku_id").collect()] == [("0", dt.date(2020, 1, 3)), ("2", dt.date(2020, 1, 8))]


def test_stores(spark, tmp_path):
    store = stores.OverrideStore(spark, str(tmp_path / "o"))
    assert store.get().count() == 0
    oid = store.add("a", "b", 0.9, approval_threshold=0.5)
    assert store.get("a").first().status == "pending_approval"
    assert store.delete(oid) and not store.delete(oid) and store.get().count() == 0
    log = stores.AuditLog(spark, str(tmp_path / "a"))
    log.log([{"user_id": "u", "action": "x"}, {"user_id": "u", "action": "y"}])
    assert log.query(action="x").count() == 1 and log.counts().count() == 2
    df = panel_of(spark, {"a": [1, 2]}).withColumnRenamed("quantity", "forecast")
    path = str(tmp_path / "f")
    stores.write_forecasts(df, path, "lob", "2024-01-01")
    stores.write_forecasts(df.withColumn("forecast", F.lit(9.0)).limit(1), path, "lob", "2024-01-01", "upsert")
    assert sorted(r.forecast for r in spark.read.parquet(path).collect())[-1] == 9.0 and spark.read.parquet(path).count() == 2
    made = stores.manifest("r", {"a": 1}, panel_of(spark, {"a": [1, 2]}), "m", df)
    assert stores.read_manifest(spark, stores.write_manifest(spark, made, path))["model"] == "m"


def test_drivers_run_end_to_end(spark, tmp_path):
    made = {"a": [100 + 10 * (i % 13) for i in range(110)], "b": [50 + 5 * (i % 13) for i in range(110)], "s": [0 if i % 3 else 5 for i in range(110)]}
    df, config = panel_of(spark, made), Config(n_folds=2)
    result = run_backtest(df, config)
    assert {r.model_id for r in result.leaderboard.collect()} == {"naive_seasonal", "moving_average", "croston_sba", "tsb"}
    store = stores.MetricStore(spark, str(tmp_path / "m"))
    store.write(result.records, "backtest", "lob")
    assert store.read("backtest", "lob").count() == result.records.count() and store.read("live").count() == 0
    out = run_forecast(df, "naive_seasonal", config)
    assert out.count() == 39 and out.where("forecast_p10 > forecast_p90").count() == 0


@pytest.mark.parametrize("files", [None, 1])
def test_stream_writes_closed_windows(spark, tmp_path, files):
    from panelforge.streaming import live

    rows = [(dt.datetime(2024, 1, 1 + i // 24, i % 24), "x", 1.0) for i in range(72)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double", files)
    # files come in any order: one at a time they need a delay that covers it
    query = live.append_panel(stream, str(tmp_path / "out"), str(tmp_path / "cp"), delay="1 hour" if files is None else "4 days")
    query.awaitTermination()
    got = [(str(r.week), r.quantity) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ([("2024-01-01", 24.0), ("2024-01-02", 24.0)] if files is None else [])
    assert live.late_rows(query) == 0


def test_late_rows_are_counted(spark, tmp_path):
    from panelforge.streaming import live

    schema = "ts timestamp, event_type string, value double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day in (5, 1):  # the second run's rows are older than the first run's watermark
        spark.createDataFrame([(dt.datetime(2024, 1, day, 12), "x", 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
        query = live.append_panel(live.event_stream(spark, source, schema), out, str(tmp_path / "cp"))
        query.awaitTermination()
    assert live.late_rows(query) == 1
