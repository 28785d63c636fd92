"""Readers: files by format, retail tables, product masters, filtered tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc"}


def read_file(spark: SparkSession, path: str, format: str | None = None, schema=None, **options) -> DataFrame:
    """Any file by its suffix or a named format; xlsx goes through pandas where that can read it."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".xlsx" and format is None:
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, **options))
    kind = format or FORMATS.get(suffix)
    if kind is None:
        raise ValueError(f"unsupported file type {suffix!r}; expected one of {sorted(FORMATS)}")
    reader = spark.read.format(kind).options(**({"header": True, "inferSchema": schema is None} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_csv_with_dates(spark: SparkSession, path: str, dates: dict[str, str], schema=None, **options) -> DataFrame:
    """A CSV whose named columns are dates in given formats; without a schema all else is inferred."""
    df = read_file(spark, path, "csv", schema, **options)
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(f)).cast("date") for c, f in dates.items()})


def read_retail(spark: SparkSession, folder: str, date_format: str = "yyyy-MM-dd") -> dict[str, DataFrame]:
    """The tables train, test and store of a retail folder."""
    out = {n: read_csv_with_dates(spark, f"{folder}/{n}.csv", {"Date": date_format}) for n in ("train", "test")}
    return out | {"store": read_file(spark, f"{folder}/store.csv")}


def join_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A left join; Spark broadcasts the dimension when its size allows."""
    return df.join(dimension, key, "left")


def product_master(df: DataFrame) -> DataFrame:
    """A product table in normal form: ISO dates, countries as an array; a missing column is an error."""
    need = ["sku_id", "sku_description", "product_family", "country", "segment", "launch_date", "status"]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"product master lacks columns: {missing}")
    kinds = dict(df.dtypes)
    if kinds["country"] == "string":
        df = df.withColumn("country", F.filter(F.transform(F.split("country", ","), F.trim), lambda c: c != ""))
    return df.withColumns({c: F.col(c).cast("date") for c in ("launch_date", "eol_date") if c in df.columns})


def read_table(spark: SparkSession, path: str, format: str = "parquet", date_col: str | None = None, start: str | None = None, end: str | None = None, where: Column | None = None, version: int | None = None, timestamp: str | None = None) -> DataFrame:
    """A table with a half-open range of dates and a condition, both pushed to the scan; time travel where the format has it."""
    options = {k: str(v) for k, v in (("versionAsOf", version), ("timestampAsOf", timestamp)) if v is not None}
    if options and format != "delta":
        raise ValueError("versions need the delta format")
    df = spark.read.format(format).options(**options).load(path)
    if date_col and start:
        df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
    if date_col and end:
        df = df.where(F.col(date_col) < F.lit(end).cast("date"))
    return df.where(where) if where is not None else df


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def mock_products(spark: SparkSession, families: int = 4, generations: int = 3) -> DataFrame:
    """A small deterministic product master with generations that replace each other."""
    made = spark.range(families * generations).select((F.col("id") / generations).cast("int").alias("f"), (F.col("id") % generations).cast("int").alias("g"))
    return made.select(
        F.format_string("SKU%02d-v%d", "f", F.col("g") + 1).alias("sku_id"),
        F.format_string("Product %02d v%d", "f", F.col("g") + 1).alias("sku_description"),
        F.format_string("Family%02d", "f").alias("product_family"),
        F.lit("Category").alias("product_category"),
        F.lit("Standard").alias("form_factor"),
        F.when(F.col("f") % 2 == 0, "Premium").otherwise("Value").alias("price_tier"),
        F.array(F.lit("US"), F.lit("DE")).alias("country"),
        F.lit("Consumer").alias("segment"),
        F.date_add(F.lit("2020-01-06").cast("date"), (F.col("g") * 300).cast("int")).alias("launch_date"),
        F.when(F.col("g") < generations - 1, F.date_add(F.lit("2021-01-04").cast("date"), (F.col("g") * 300).cast("int"))).alias("eol_date"),
        F.when(F.col("g") < generations - 1, "Discontinued").otherwise("Active").alias("status"),
    )


def get_session(app: str = "panelforge", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """The running session, or one with adaptive execution."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
