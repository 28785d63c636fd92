"""Roles of files and columns, join keys, merging, configuration advice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.validation import NUMERIC

TIME_NAMES = ("date", "week", "month", "time", "period", "day", "ts", "timestamp")
TARGET_NAMES = ("quantity", "sales", "demand", "units", "volume", "target", "value", "qty")
ID_NAMES = ("id", "sku", "store", "product", "item", "series", "key", "code")


@dataclass
class Roles:
    time: str | None = None
    target: str | None = None
    ids: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)


def _named(column: str, names) -> bool:
    parts = column.lower().replace("-", "_").split("_")
    return any(n in parts or column.lower().endswith(n) for n in names)


def detect_roles(df: DataFrame) -> Roles:
    """Time by type, then name; target by name, then the first free number; ids by name among keys."""
    kinds = dict(df.dtypes)
    r = Roles()
    dates = [c for c, k in kinds.items() if k.startswith(("date", "timestamp"))]
    named = [c for c in df.columns if _named(c, TIME_NAMES)]
    r.time = next(iter(dates or named), None)
    numbers = [c for c, k in kinds.items() if k.split("(")[0] in NUMERIC and c != r.time]
    r.ids = [c for c in df.columns if c != r.time and _named(c, ID_NAMES) and kinds[c].split("(")[0] not in ("float", "double", "decimal")]
    free = [c for c in numbers if c not in r.ids]
    r.target = next((c for c in free if _named(c, TARGET_NAMES)), next(iter(free), None))
    r.numeric = [c for c in free if c != r.target]
    r.dimensions = [c for c, k in kinds.items() if k == "string" and c not in r.ids and c != r.time]
    return r


def detect_frequency(df: DataFrame, time: str, ids: list[str]) -> DataFrame:
    """(median_gap, frequency) from the gaps of all series."""
    w = W.partitionBy(*ids).orderBy("d") if ids else W.orderBy("d")
    d = df.select(*ids, F.col(time).cast("date").alias("d")).distinct()
    g = d.withColumn("g", F.datediff("d", F.lag("d").over(w))).agg(F.percentile("g", 0.5).alias("median_gap"))
    m = F.col("median_gap")
    return g.withColumn("frequency", F.when(m <= 2, "D").when(m <= 10, "W").when(m <= 35, "M").otherwise("Q"))


def file_scores(df: DataFrame, name: str = "") -> dict[str, float]:
    """Scores of the roles time_series, dimension and regressor, from the schema and one aggregation."""
    r = detect_roles(df)
    row = df.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"d_{i}") for i, c in enumerate(r.ids)], *([F.countDistinct(r.time).alias("t")] if r.time else [])).first().asDict()
    n = row["n"] or 1
    most = max([row[f"d_{i}"] for i in range(len(r.ids))], default=0)
    repeated = bool(r.ids) and most < 0.5 * n
    low = name.lower()
    ts = (0.30 if r.time else 0.0) + (0.20 if r.target and _named(r.target, TARGET_NAMES) else 0.05 if r.target else 0.0) + (0.20 if repeated else 0.10 if r.ids else 0.0) + (0.15 if n >= 100 else 0.05) + (0.15 if any(x in low for x in ("sales", "actual", "train", "demand")) else 0.0)
    dim = (0.30 if not r.time else 0.0) + (0.30 if r.ids and most >= 0.95 * n else 0.0) + (0.20 if r.dimensions else 0.0) + (0.15 if any(x in low for x in ("dim", "store", "product", "master")) else 0.0)
    reg = (0.30 if r.time else 0.0) + (0.20 if len(r.numeric) >= 1 else 0.0) + (0.20 if r.time and row.get("t", 0) >= 0.9 * n else 0.0) + (0.15 if any(x in low for x in ("weather", "holiday", "feature", "regressor", "promo")) else 0.0)
    return {"time_series": ts, "dimension": dim, "regressor": reg}


#: The least score for each role.
LEAST = {"time_series": 0.40, "dimension": 0.30, "regressor": 0.30}


def classify_files(frames: dict[str, DataFrame]) -> dict[str, str]:
    """The role of each file; the best time series is the primary one."""
    scores = {n: file_scores(d, n) for n, d in frames.items()}
    primary = max(scores, key=lambda n: scores[n]["time_series"], default=None)
    out = {}
    for n, s in scores.items():
        if n == primary and s["time_series"] >= LEAST["time_series"]:
            out[n] = "time_series"
            continue
        role = max(("dimension", "regressor"), key=s.get)
        out[n] = role if s[role] >= LEAST[role] else "unknown"
    return out


def join_keys(left: DataFrame, right: DataFrame) -> list[str]:
    kinds = dict(right.dtypes)
    return [c for c, k in left.dtypes if c in kinds and (k == kinds[c]) and (_named(c, ID_NAMES) or _named(c, TIME_NAMES) or k in ("string", "date"))]


def key_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(n_left, n_found, overlap_pct, ok) of distinct keys; under half is a warning."""
    a = left.select(*keys).dropna().distinct()
    b = right.select(*keys).dropna().distinct().withColumn("_f", F.lit(True))
    out = a.join(b, keys, "left").agg(F.count("*").alias("n_left"), F.count("_f").alias("n_found"))
    out = out.withColumn("overlap_pct", F.coalesce(100.0 * F.try_divide("n_found", F.nullif("n_left", F.lit(0))), F.lit(0.0)))
    return out.withColumn("ok", F.col("overlap_pct") >= 50)


def merge_files(primary: DataFrame, others: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """Left joins in order, name -> (frame, keys, role); clashing columns get the file's name; regressors' gaps 0."""
    out = primary
    for name, (frame, keys, role) in others.items():
        rename = {c: f"{c}_{name}" for c in frame.columns if c not in keys and c in out.columns}
        frame = frame.withColumnsRenamed(rename)
        new = [c for c in frame.columns if c not in keys]
        out = out.join(frame, keys, "left")
        if role == "regressor":
            numbers = {c for c, k in frame.dtypes if k.split("(")[0] in NUMERIC}
            out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in new if c in numbers})
    return out


def recommend_config(n_series: int, n_periods: int, frequency: str, seasonal: float, sparse_share: float) -> dict:
    """A configuration from a few facts, by rules."""
    season = {"D": 7, "W": 52, "M": 12, "Q": 4}[frequency]
    models = ["naive_seasonal", "moving_average"]
    if n_periods >= 2 * season:
        models += ["holt_winters", "theta_ses"]
    if sparse_share > 0.2:
        models += ["croston_sba", "tsb"]
    if n_series >= 20 and n_periods >= season:
        models.append("gbt_direct")
    horizon = {"D": 28, "W": 13, "M": 6, "Q": 4}[frequency]
    return {"frequency": frequency, "horizon": horizon, "n_folds": 3 if n_periods >= 2 * season + 3 * horizon else 1, "forecasters": models, "season_length": season if seasonal >= 0.3 else 1}


def hypotheses(n_series: int, n_periods: int, seasonal: float, trend: float, sparse_share: float) -> list[str]:
    out = []
    if seasonal >= 0.3:
        out.append("Demand repeats with the season; seasonal models should beat flat ones.")
    if trend >= 0.3:
        out.append("A trend explains much of the variance; models without one will be biased.")
    if sparse_share > 0.2:
        out.append("Many series are intermittent; rate models suit them.")
    if n_series >= 100 and n_periods < 104:
        out.append("Many short series: a global model can share what each alone lacks.")
    return out or ["No strong signal; simple models are the benchmark to beat."]
