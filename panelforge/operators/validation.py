"""Checks of inputs and results.  Each check is one row: (rule, severity, n, ok), or the rows at fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.panel import ID, TIME, VALUE, period_gaps

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def report(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass over df for all rules: (rule, severity, n) with the number at fault."""
    row = df.agg(*[F.coalesce(n.cast("long"), F.lit(0)).alias(f"c{i}") for i, (_, _, n) in enumerate(rules)])
    items = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("n")) for i, (r, s, _) in enumerate(rules)])
    return row.select(F.explode(items).alias("x")).select("x.*").withColumn("ok", F.col("n") == 0)


def check_schema(df: DataFrame, required: list[str], kinds: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """Missing columns block, other types warn; the schema alone is looked at."""
    have = dict(df.dtypes)
    out = [(c, "BLOCKER", "missing") for c in required if c not in have]
    for c, kind in (kinds or {}).items():
        if c in have and not (have[c].split("(")[0] in NUMERIC if kind == "numeric" else have[c].startswith(kind)):
            out.append((c, "WARNING", f"{have[c]} is not {kind}"))
    return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(null_keys, duplicate_rows): both must be 0."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return grouped.agg(F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def frequency_faults(df: DataFrame, freq: str = "W", id_col=ID, time=TIME) -> DataFrame:
    """Series with irregular steps and how many."""
    return period_gaps(df, freq, id_col, time).groupBy(id_col).agg(F.count("*").alias("n_gaps"), F.max("gap_days").alias("max_gap_days"))


def value_range(df: DataFrame, value=VALUE, low: float | None = None, high: float | None = None) -> DataFrame:
    v = F.col(value)
    rules = [("negative", "ERROR", F.count_if(v < 0)), ("null", "WARNING", F.count_if(v.isNull()))]
    if low is not None:
        rules.append(("below_min", "ERROR", F.count_if(v < low)))
    if high is not None:
        rules.append(("above_max", "WARNING", F.count_if(v > high)))
    return report(df, rules)


def missing_share(df: DataFrame, days: int = 7, id_col=ID, time=TIME) -> DataFrame:
    """Each series' share of periods between its first and last date that it lacks."""
    out = df.groupBy(id_col).agg(F.count("*").alias("n"), (F.datediff(F.max(time), F.min(time)) / days + 1).cast("long").alias("expected"))
    return out.withColumn("missing_pct", F.greatest(F.lit(0.0), 100.0 * (1 - F.col("n") / F.nullif("expected", F.lit(0)))))


def validate_input(df: DataFrame, freq="W", min_series=1, max_missing=50.0, strict=False, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """All input rules; strict turns warnings into errors."""
    rules = value_range(df, value).unionByName(
        duplicates(df, [id_col, time]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("rule"), F.lit("ERROR").alias("severity"), "n", (F.col("n") == 0).alias("ok"))
    )
    rules = rules.unionByName(
        frequency_faults(df, freq, id_col, time).agg(F.count("*").alias("n")).select(F.lit("irregular_series").alias("rule"), F.lit("WARNING").alias("severity"), "n", (F.col("n") == 0).alias("ok"))
    )
    gone = missing_share(df, id_col=id_col, time=time).agg(F.count_if(F.col("missing_pct") > max_missing).alias("n"), F.count("*").alias("s"))
    rules = rules.unionByName(gone.select(F.lit("incomplete_series").alias("rule"), F.lit("WARNING").alias("severity"), "n", (F.col("n") == 0).alias("ok")))
    few = gone.select(F.lit("too_few_series").alias("rule"), F.lit("ERROR").alias("severity"), F.greatest(F.lit(0), min_series - F.col("s")).cast("long").alias("n"))
    rules = rules.unionByName(few.withColumn("ok", F.col("n") == 0))
    return rules.withColumn("severity", F.lit("ERROR")) if strict else rules


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null, null_rate, n_blank, n_zero, n_unique, status) of each column, in one pass."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    aggs = []
    for c in columns:
        v = F.col(c)
        blank = F.count_if(F.trim(v) == "") if kinds[c] == "string" else F.lit(0)
        zero = F.count_if(v == 0) if kinds[c].split("(")[0] in NUMERIC else F.lit(0)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(v.isNull()).alias("n_null"), blank.cast("long").alias("n_blank"), zero.cast("long").alias("n_zero"), F.countDistinct(v).alias("n_unique")).alias(c))
    row = df.agg(F.count("*").alias("_n"), *aggs)
    out = row.select("_n", F.explode(F.array(*columns)).alias("x")).select("x.*", "_n")
    rate = F.coalesce(F.try_divide("n_null", F.nullif("_n", F.lit(0))), F.lit(0.0))
    out = out.withColumn("null_rate", rate)
    status = F.when(F.col("null_rate") == 0, "COMPLETE").when(F.col("null_rate") <= 0.05, "GOOD").when(F.col("null_rate") <= 0.20, "WARNING").otherwise("CRITICAL")
    return out.withColumn("status", status).withColumn("is_constant", F.col("n_unique") <= 1).drop("_n")


def null_concentration(df: DataFrame, warn: float = 0.5, fail: float = 0.95) -> DataFrame:
    out = completeness(df).select("column", "null_rate")
    return out.withColumn("status", F.when(F.col("null_rate") >= fail, "FAIL").when(F.col("null_rate") >= warn, "WARN").otherwise("PASS"))


def date_gaps(df: DataFrame, date_col: str, max_gap_days: int) -> DataFrame:
    """Gaps between distinct dates that are longer than allowed: dates are few, one task orders them."""
    dates = df.select(F.col(date_col).cast("date").alias("d")).where("d IS NOT NULL").distinct()
    out = dates.withColumn("before", F.lag("d").over(W.orderBy("d"))).withColumn("gap_days", F.datediff("d", "before"))
    return out.where(F.col("gap_days") > max_gap_days).select("before", F.col("d").alias("after"), "gap_days")


def date_range(df: DataFrame, date_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    d = F.col(date_col).cast("date")
    rules = [("null_date", "WARNING", F.count_if(d.isNull()))]
    if start:
        rules.append(("before_start", "WARNING", F.count_if(d < F.lit(start).cast("date"))))
    if end:
        rules.append(("after_end", "WARNING", F.count_if(d > F.lit(end).cast("date"))))
    return report(df, rules)


def no_future_dates(df: DataFrame, date_col: str, reference: str, allowed_days: int = 0) -> DataFrame:
    return report(df, [("future_date", "BLOCKER", F.count_if(F.col(date_col).cast("date") > F.date_add(F.lit(reference).cast("date"), allowed_days)))])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(n_keys, n_orphans, orphan_rate, status) of distinct child keys without a parent."""
    keys = child.select(F.col(child_key).alias("k")).where("k IS NOT NULL").distinct()
    known = parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("known")).where("k IS NOT NULL").distinct()
    out = keys.join(known, "k", "left").agg(F.count("*").alias("n_keys"), F.count_if(F.col("known").isNull()).alias("n_orphans"))
    out = out.withColumn("orphan_rate", F.coalesce(F.try_divide("n_orphans", F.nullif("n_keys", F.lit(0))), F.lit(0.0)))
    return out.withColumn("status", F.when(F.col("orphan_rate") > 0.05, "BLOCKER").when(F.col("n_orphans") > 0, "WARNING").otherwise("OK"))


def row_count(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    out = df.agg(F.count("*").alias("n"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("n") >= low)
    if high is not None:
        ok = ok & (F.col("n") <= high)
    return out.withColumn("ok", ok)


def trailing_anomalies(df: DataFrame, window: int = 12, z: float = 3.0, group: str | None = ID, time=TIME, value=VALUE) -> DataFrame:
    """Rows whose value lies over z deviations from the mean of the last `window` rows, themselves included."""
    part = W.partitionBy(group) if group else W.partitionBy(F.lit(0))
    w = part.orderBy(time)
    span = w.rowsBetween(-(window - 1), 0)
    out = df.withColumns({"_m": F.avg(value).over(span), "_s": F.stddev_samp(value).over(span), "_r": F.row_number().over(w)})
    out = out.withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.nullif("_s", F.lit(0.0))))
    return out.where((F.col("_r") > window) & (F.abs("z") > z)).drop("_m", "_s", "_r")


def not_monotonic(df: DataFrame, column: str, order: str, direction: str = "increasing", group: str | None = None) -> DataFrame:
    """Rows that go against the direction, in the order of a column."""
    w = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy(order)
    step = F.col(column) - F.lag(column).over(w)
    return df.withColumn("step", step).where((F.col("step") < 0) if direction == "increasing" else (F.col("step") > 0))


def spikes(df: DataFrame, limit: float = 5.0, group: str | None = ID, time=TIME, value=VALUE) -> DataFrame:
    """Rows that differ from their predecessor by more than `limit` times it; a base of 0 has none."""
    w = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy(time)
    before = F.lag(value).over(w)
    return df.withColumn("before", before).withColumn("change", F.try_divide(F.col(value) - F.col("before"), F.nullif(F.abs("before"), F.lit(0.0)))).where(F.abs("change") > limit)


def direction_mismatch(forecasts: DataFrame, actuals: DataFrame, id_col=ID, time=TIME, value=VALUE) -> DataFrame:
    """Per series: steps, and those on which forecast and actual move against each other."""
    both = forecasts.select(id_col, time, F.col(value).alias("f")).join(actuals.select(id_col, time, F.col(value).alias("a")), [id_col, time])
    w = W.partitionBy(id_col).orderBy(time)
    out = both.withColumn("df", F.signum(F.col("f") - F.lag("f").over(w))).withColumn("da", F.signum(F.col("a") - F.lag("a").over(w)))
    return out.where("df IS NOT NULL AND da IS NOT NULL").groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(F.col("df") != F.col("da")).alias("n_mismatch"))


def aggregation_gaps(child: DataFrame, parent: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Groups whose parts do not add up to the parent's figure."""
    c = child.groupBy(key).agg(F.sum(value).alias("child_sum"))
    p = parent.groupBy(key).agg(F.sum(value).alias("parent_sum"))
    out = c.join(p, key, "full")
    gap = F.abs(F.coalesce("child_sum", F.lit(0.0)) - F.coalesce("parent_sum", F.lit(0.0)))
    return out.withColumn("gap", gap).where(F.col("gap") > tolerance * F.greatest(F.abs(F.coalesce("parent_sum", F.lit(0.0))), F.lit(1.0)))


def percentages(df: DataFrame, columns: list[str], total: float = 100.0, tolerance: float = 1.0) -> DataFrame:
    s = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return df.withColumn("total", s).where(F.abs(F.col("total") - total) > tolerance)


def ratio_bounds(df: DataFrame, top: str, bottom: str, low: float, high: float) -> DataFrame:
    """Rows whose ratio lies outside; a denominator of 0 passes."""
    return df.withColumn("ratio", F.try_divide(F.col(top).cast("double"), F.nullif(F.col(bottom).cast("double"), F.lit(0.0)))).where(~F.col("ratio").between(low, high))


def group_balance(df: DataFrame, group: str, min_count: int = 1, max_ratio: float = 10.0) -> DataFrame:
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    out = n.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count_if(F.col("n") < min_count).alias("n_small"))
    out = out.withColumn("ratio", F.try_divide("largest", F.nullif("smallest", F.lit(0))))
    return out.withColumn("ok", (F.col("n_small") == 0) & (F.col("ratio") <= max_ratio))


#: The default bounds of result columns.
RANGES = {"wmape": (0.0, 2.0), "mape": (0.0, 10.0), "normalized_bias": (-1.0, 1.0), "quantity": (0.0, None), "forecast": (0.0, None), "unit_price": (0.0, None)}


def ranges(df: DataFrame, rules: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    made = []
    for c, (low, high) in (rules or RANGES).items():
        if c in df.columns:
            bad = F.lit(False)
            if low is not None:
                bad = bad | (F.col(c) < low)
            if high is not None:
                bad = bad | (F.col(c) > high)
            made.append((f"{c}_range", "WARNING", F.count_if(bad)))
    return report(df, made)


def relations(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(left, operator, right) that must hold on every row."""
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}
    return report(df, [(f"{a} {o} {b}", "WARNING", F.count_if(~test[o](F.col(a), F.col(b)))) for a, o, b in rules])


def segment_coverage(df: DataFrame, segment: str, expected: list[str], min_rows: int = 1) -> DataFrame:
    """Expected segments with their rows; missing or thin ones are not ok."""
    want = df.sparkSession.createDataFrame([(e,) for e in expected], "segment string")
    n = df.groupBy(F.col(segment).cast("string").alias("segment")).agg(F.count("*").alias("n"))
    out = want.join(n, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("ok", F.col("n") >= min_rows)


def no_negatives(df: DataFrame, columns: list[str]) -> DataFrame:
    return report(df, [(f"{c}_negative", "WARNING", F.count_if(F.col(c) < 0)) for c in columns])


def cardinality(df: DataFrame, column: str, low: int = 0, high: int | None = None) -> DataFrame:
    out = df.agg(F.countDistinct(column).alias("n"))
    ok = F.col("n") >= low
    return out.withColumn("ok", ok & (F.col("n") <= high) if high is not None else ok)


# ------------------------------------------------------------------ Simpson's paradox
def simpson(df: DataFrame, segment: str, value: str, period: str, a, b, weight: str | None = None, flat: float = 0.001) -> DataFrame:
    """One row: the overall change between two periods, and the segments that go the other way.

    Means are weighted where a weight is given.  Overall and segments come from one pass with
    grouping sets; a change within 0.1 % is flat; more than half of the segments reversing is a paradox.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(period).isin(a, b)).select(F.col(segment).cast("string").alias("seg"), F.when(F.col(period) == a, "a").otherwise("b").alias("p"), F.col(value).cast("double").alias("v"), w.alias("w"))
    sums = rows.groupingSets([["p"], ["p", "seg"]], "p", "seg").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w"), F.grouping("seg").alias("total"))
    m = sums.withColumn("m", F.try_divide("s", F.nullif("w", F.lit(0.0))))
    both = m.groupBy("total", "seg").agg(F.max(F.when(F.col("p") == "a", F.col("m"))).alias("ma"), F.max(F.when(F.col("p") == "b", F.col("m"))).alias("mb"))
    change = F.try_divide(F.col("mb") - F.col("ma"), F.nullif(F.abs("ma"), F.lit(0.0)))
    both = both.where("ma IS NOT NULL AND mb IS NOT NULL").withColumn("d", F.when(F.abs(change) <= flat, 0).otherwise(F.signum(change)).cast("int"))
    overall = both.where("total = 1").select(F.col("d").alias("overall"), F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"))
    out = both.where("total = 0").join(F.broadcast(overall))
    out = out.groupBy("overall", "mean_a", "mean_b").agg(F.count("*").alias("n_segments"), F.count_if((F.col("d") != 0) & (F.col("d") == -F.col("overall"))).alias("n_reversed"))
    return out.withColumn("is_paradox", F.col("n_reversed") > F.col("n_segments") / 2)


def weighted_means(df: DataFrame, value: str, weight: str, segment: str | None = None) -> DataFrame:
    keys = [segment] if segment else []
    out = df.groupBy(*keys).agg(F.avg(value).alias("unweighted"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(F.sum(weight).cast("double"), F.lit(0.0))).alias("weighted"))
    return out.withColumn("gap", F.col("weighted") - F.col("unweighted"))


def suggest_segments(df: DataFrame, value: str, most: int = 5) -> list[str]:
    """String columns, and integers of at most 50 values, by ascending cardinality."""
    kinds = {c: k for c, k in df.dtypes if c != value and k in ("string", "int", "bigint", "smallint")}
    if not kinds:
        return []
    n = df.agg(*[F.countDistinct(c).alias(c) for c in kinds]).first().asDict()
    fit = [c for c in kinds if n[c] > 1 and (kinds[c] == "string" or n[c] <= 50)]
    return sorted(fit, key=lambda c: (n[c], c))[:most]


# ------------------------------------------------------------------ confidence
#: Layer weights and caps of the confidence score.
LAYERS = {"structural": 0.30, "logical": 0.25, "business": 0.25, "paradox": 0.20}


def confidence(findings: DataFrame) -> DataFrame:
    """(score, grade) of findings (layer, severity): 100 less 30 a blocker and 10 a warning in each layer.

    A blocker caps the score at 69, a finding of the paradox layer at 79.
    """
    blockers = lambda layer: F.count_if((F.col("layer") == layer) & (F.col("severity") == "BLOCKER"))
    warnings = lambda layer: F.count_if((F.col("layer") == layer) & (F.col("severity") == "WARNING"))
    parts = [w * F.greatest(F.lit(0), 100 - 30 * blockers(n) - 10 * warnings(n)) for n, w in LAYERS.items()]
    out = findings.agg(reduce(lambda a, b: a + b, parts).alias("raw"), F.count_if(F.col("severity") == "BLOCKER").alias("b"), F.count_if((F.col("layer") == "paradox")).alias("p"))
    score = F.when(F.col("b") > 0, F.least(F.col("raw"), F.lit(69.0))).when(F.col("p") > 0, F.least(F.col("raw"), F.lit(79.0))).otherwise(F.col("raw"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return out.select(score.alias("score")).withColumn("grade", grade)
