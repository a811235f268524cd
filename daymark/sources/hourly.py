"""Reading hourly series: tables, CSV files and nested API payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.functions.exprs import nan_to_null
from daymark.operators.ordered import attach

HOURLY_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("exog_1", T.DoubleType()),
    T.StructField("exog_2", T.DoubleType()),
])

PAYLOAD_SCHEMA = "unix_seconds ARRAY<BIGINT>, price ARRAY<DOUBLE>"
FORECAST_PAYLOAD_SCHEMA = (
    "production_type STRING, unix_seconds ARRAY<BIGINT>, forecast_values ARRAY<DOUBLE>"
)

HOURS_PER_YEAR = 24 * 364  # a benchmark year is 52 whole weeks


def standard_names(columns: list[str]) -> dict[str, str]:
    """``Price`` -> ``price``, ``Exogenous k`` -> ``exog_k``; other names stay."""
    renames = {}
    for name in columns:
        lowered = name.strip().lower()
        if lowered == "price":
            renames[name] = "price"
        elif lowered.startswith("exogenous"):
            renames[name] = f"exog_{lowered.split()[-1]}"
    return renames


def standardize(df: DataFrame, time_column: str, series: F.Column | str = "series") -> DataFrame:
    """Bring any wide hourly table to (series_id, ts, price, exog_*), NaN becoming NULL."""
    series = F.lit(series) if isinstance(series, str) else series
    out = df.withColumnsRenamed(standard_names(df.columns))
    values = [c for c in out.columns if c == "price" or c.startswith("exog_")]
    return out.select(
        series.alias("series_id"),
        F.col(time_column).cast("timestamp_ntz").alias("ts"),
        *[nan_to_null(F.col(c).cast("double")).alias(c) for c in values],
    )


def load_hourly(spark: SparkSession, path: str, time_column: str, fmt: str = "parquet",
                series: F.Column | str = "series", schema: T.StructType | str | None = None,
                ) -> DataFrame:
    """S1. Read a benchmark table. CSV needs an explicit schema; nothing is inferred."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("load_hourly: a CSV source needs an explicit schema")
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return standardize(reader.load(path), time_column, series)


def split_train_test(df: DataFrame, years_test: float) -> DataFrame:
    """S2. Adds ``split``: the trailing ``24*364*years_test`` hours of a series are test."""
    hours = round(HOURS_PER_YEAR * years_test)
    last = df.groupBy("series_id").agg(F.max("ts").alias("_last"))
    cutoff = F.expr(f"_last - make_dt_interval(0, {hours})")
    return attach(df, last, ["series_id"], "ts").withColumn(
        "split", F.when(F.col("ts") > cutoff, "test").otherwise("train")
    ).drop("_last")


def flatten_payload(df: DataFrame, json_column: str, value_field: str = "price",
                    schema: str = PAYLOAD_SCHEMA) -> DataFrame:
    """S3. Parallel arrays inside a JSON payload -> one row per point, epoch seconds -> time.

    A NULL payload has no points; a malformed one fails the job instead of vanishing.
    """
    parsed = df.withColumn("_p", F.from_json(json_column, schema, {"mode": "FAILFAST"}))
    keep = [c for c in df.columns if c != json_column]
    extra = ["_p.production_type"] if "production_type" in schema else []
    points = parsed.select(
        *keep, *extra,
        F.inline(F.arrays_zip(
            F.col("_p.unix_seconds").alias("seconds"), F.col(f"_p.{value_field}").alias("value"))),
    )
    return points.select(
        *keep, *[e.split(".")[1] for e in extra],
        F.expr("cast(date'1970-01-01' as timestamp_ntz)"
               " + make_dt_interval(0, 0, 0, cast(seconds as decimal(18,6)))").alias("ts"),
        nan_to_null("value").alias("value"),
    )
