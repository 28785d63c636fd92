"""Writers and stores: metrics, forecasts, overrides, audit, lineage, manifests.

Stores are partitioned Parquet folders; readers filter on partition columns, so Spark prunes.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.plans.backtest import METRIC_SCHEMA


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", "true").schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys; with `update` only those columns change."""
    if update is None:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    fresh = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in update], F.lit(True).alias("_hit"))
    kept = old.join(fresh, keys, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in update})
    kept = kept.select(*old.columns)
    return kept.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def clustered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Laid out by ranges of the columns, so that statistics of files and row groups skip."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


class MetricStore:
    """Metric records under run_type= and lob= folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, records: DataFrame, run_type: str, lob: str) -> None:
        cols = []
        for f in METRIC_SCHEMA.split(", "):
            name, kind = f.split()
            cols.append((F.col(name) if name in records.columns else F.lit(None)).cast(kind).alias(name))
        append(records.select(*cols).withColumn("run_type", F.lit(run_type)).withColumn("lob", F.lit(lob)), self.path, ["run_type", "lob"])

    def read(self, run_type=None, lob=None, model_id=None, grain_level=None, run_id=None) -> DataFrame:
        df = read_or_empty(self.spark, self.path, METRIC_SCHEMA)
        for name, v in (("run_type", run_type), ("lob", lob), ("model_id", model_id), ("grain_level", grain_level), ("run_id", run_id)):
            if v is not None:
                df = df.where(F.col(name) == v)
        return df


OVERRIDES = "override_id string, old_sku string, new_sku string, proportion double, scenario string, ramp_shape string, effective_date date, status string, created_by string, created_at timestamp, approved_by string, approved_at timestamp, notes string"


class OverrideStore:
    """Planner overrides; deletions are records too, and the latest record of an id counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, old_sku, new_sku, proportion=1.0, scenario="MANUAL", ramp_shape="linear", effective_date=None, created_by="", notes="", approval_threshold=0.0) -> str:
        """A share over a positive threshold waits for approval."""
        pending = approval_threshold > 0 and proportion > approval_threshold
        oid = uuid.uuid4().hex
        row = (oid, old_sku, new_sku, float(proportion), scenario, ramp_shape, effective_date, "pending_approval" if pending else "approved", created_by, dt.datetime.now(), None, None, notes)
        append(self.spark.createDataFrame([row], OVERRIDES), self.path)
        return oid

    def get(self, old_sku=None, new_sku=None) -> DataFrame:
        df = read_or_empty(self.spark, self.path, OVERRIDES)
        df = df.withColumn("_r", F.row_number().over(W.partitionBy("override_id").orderBy(F.desc("created_at")))).where("_r = 1 AND status <> 'deleted'").drop("_r")
        for name, v in (("old_sku", old_sku), ("new_sku", new_sku)):
            if v is not None:
                df = df.where(F.col(name) == v)
        return df

    def delete(self, override_id: str) -> bool:
        """True if there was such an override."""
        row = self.get().where(F.col("override_id") == override_id)
        if not row.limit(1).count():
            return False
        append(row.withColumn("status", F.lit("deleted")).withColumn("created_at", F.current_timestamp()), self.path)
        return True


AUDIT = "event_id string, user_id string, action string, resource_type string, resource_id string, status string, detail string, at timestamp, date date"


class AuditLog:
    """Events by day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, events: list[dict]) -> None:
        now = dt.datetime.now()
        rows = [(uuid.uuid4().hex, e.get("user_id"), e.get("action"), e.get("resource_type"), e.get("resource_id"), e.get("status", "ok"), e.get("detail"), e.get("at", now), e.get("at", now).date()) for e in events]
        append(self.spark.createDataFrame(rows, AUDIT), self.path, ["date"])

    def query(self, user_id=None, action=None, resource_type=None, status=None, start=None, end=None, limit: int = 1000) -> DataFrame:
        df = read_or_empty(self.spark, self.path, AUDIT)
        for name, v in (("user_id", user_id), ("action", action), ("resource_type", resource_type), ("status", status)):
            if v is not None:
                df = df.where(F.col(name) == v)
        if start:
            df = df.where(F.col("date") >= F.lit(start).cast("date"))
        if end:
            df = df.where(F.col("date") <= F.lit(end).cast("date"))
        return df.orderBy(F.desc("at")).limit(limit)

    def counts(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, AUDIT).groupBy("action", "status").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


LINEAGE = "run_id string, lob string, model_id string, n_series long, horizon int, selection_strategy string, notes string, run_date date, user_id string"


class Lineage:
    """One row a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, **row) -> None:
        names = [f.split()[0] for f in LINEAGE.split(", ")]
        row = {"run_id": uuid.uuid4().hex, "run_date": dt.date.today()} | row
        append(self.spark.createDataFrame([tuple(row.get(n) for n in names)], LINEAGE), self.path)

    def history(self, lob=None, model_id=None) -> DataFrame:
        df = read_or_empty(self.spark, self.path, LINEAGE)
        for name, v in (("lob", lob), ("model_id", model_id)):
            if v is not None:
                df = df.where(F.col(name) == v)
        return df.orderBy(F.desc("run_date"))

    def latest(self, lob: str) -> DataFrame:
        return self.history(lob).limit(1)


def latest_cards(cards: DataFrame) -> DataFrame:
    """The newest card of each model, of records (model_id, recorded_at, ...)."""
    return cards.withColumn("_r", F.row_number().over(W.partitionBy("model_id").orderBy(F.desc("recorded_at")))).where("_r = 1").drop("_r")


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): the same for the same rows in any order."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.hex(F.xxhash64(F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")))).alias("hash"))


def manifest(run_id: str, config: dict, actuals: DataFrame, model: str, forecast: DataFrame, id_col="series_id", time="week") -> dict:
    """What went in and came out of a run."""
    a = actuals.agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("s"), F.min(time).alias("a"), F.max(time).alias("b")).first()
    return {
        "run_id": run_id, "model": model, "actual_rows": a.n, "series": a.s, "first": str(a.a), "last": str(a.b),
        "content_hash": content_hash(actuals).first().hash, "config_hash": hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8],
        "forecast_rows": forecast.count(),
    }


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file, through Hadoop's file system: any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_manifest(spark: SparkSession, made: dict, forecast_path: str) -> str:
    path = f"{forecast_path.rstrip('/')}_manifest.json"
    write_text(spark, json.dumps(made, indent=1, default=str), path)
    return path


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_forecasts(df: DataFrame, path: str, lob: str, origin: str, mode: str = "overwrite") -> None:
    """Forecasts by line of business and origin: replaced, appended, or merged by (series, week)."""
    df = df.withColumn("lob", F.lit(lob)).withColumn("forecast_origin", F.lit(origin).cast("date"))
    by = ["lob", "forecast_origin"]
    if mode == "append":
        append(df, path, by)
        return
    if mode == "upsert":
        from pyspark.errors import AnalysisException

        spark = df.sparkSession
        try:
            old = spark.read.parquet(path).where((F.col("lob") == lob) & (F.col("forecast_origin") == F.lit(origin).cast("date")))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        if old is not None:
            df = upsert(old.select(*df.columns), df, ["series_id", "week", *by])
            staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
            df.write.parquet(staged)  # a folder isn't overwritten while it is read
            df = spark.read.parquet(staged)
    elif mode != "overwrite":
        raise ValueError(f"unknown mode {mode!r}")
    overwrite_partitions(df, path, by)


def write_mapping_csv(df: DataFrame, path: str) -> None:
    flat = df.withColumns({c: F.array_join(c, ",") for c, k in df.dtypes if k.startswith("array")})
    flat.write.mode("overwrite").option("header", True).csv(path)


def forecast_vs_actual(forecasts: DataFrame, actuals: DataFrame, id_col="series_id", time="week") -> DataFrame:
    renamed = actuals.withColumnsRenamed({c: f"{c}_actual" for c in actuals.columns if c not in (id_col, time)})
    return forecasts.join(renamed, [id_col, time])


def bias_report(records: DataFrame) -> DataFrame:
    return records.groupBy("series_id").agg(F.avg("normalized_bias").alias("avg_bias"), F.avg("wmape").alias("avg_wmape"), F.sum("actual").alias("total_actual"))
