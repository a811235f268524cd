"""Long forecast frames: reading, idempotent writing, resume and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import materialize

FORECAST_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("origin", T.DateType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("y_true", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
    T.StructField("model", T.StringType()),
])
DAILY_SCHEMA = T.StructType([f for f in FORECAST_SCHEMA.fields if f.name != "hour"])
ORIGIN_KEYS = ["series_id", "model", "origin"]


def load_long(spark: SparkSession, path: str, fmt: str = "parquet",
              schema: T.StructType = FORECAST_SCHEMA) -> DataFrame:
    """S4. Typed read of a long forecast frame."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def write_forecasts(df: DataFrame, path: str) -> None:
    """S5. Store forecasts by (model, origin), replacing the (series, model, origin) in ``df``.

    A partition holds all series of an origin. Series of a touched partition that ``df`` does not
    bring are read first and written back with it, so storing one series leaves the others. Each
    partition is written by one task.
    """
    columns = df.columns
    try:
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    out = df
    if stored is not None:
        parts = df.select("model", "origin").distinct()
        others = (stored.join(parts, ["model", "origin"], "left_semi")
                  .join(df.select(*ORIGIN_KEYS).distinct(), ORIGIN_KEYS, "left_anti"))
        out = df.unionByName(materialize(others.select(*columns), "kept-series"))
    (
        out.repartition("model", "origin").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "origin")
        .parquet(path)
    )


def remaining_origins(planned: DataFrame, done: DataFrame, rows_per_origin: int = 24) -> DataFrame:
    """S6. Planned origins still to run; an origin is done only with exactly 24 rows."""
    finished = (
        done.groupBy(*ORIGIN_KEYS).count()
        .filter(F.col("count") == rows_per_origin).drop("count")
    )
    return planned.join(finished, ORIGIN_KEYS, "left_anti")


def origin_completeness(df: DataFrame, rows_per_origin: int = 24) -> DataFrame:
    """Per origin: row count and whether it is complete."""
    return df.groupBy(*ORIGIN_KEYS).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "complete", F.col("n_rows") == rows_per_origin)


def repair_partial(df: DataFrame, rows_per_origin: int = 24) -> DataFrame:
    """S7. Drop every row of an origin that does not have exactly 24 rows."""
    complete = origin_completeness(df, rows_per_origin).filter("complete")
    return df.join(complete.select(*ORIGIN_KEYS), ORIGIN_KEYS, "left_semi")


def repair_report(df: DataFrame, rows_per_origin: int = 24) -> DataFrame:
    """S7. (series_id, model, rows_removed, origins_removed), models without loss included."""
    torn = ~F.col("complete")
    return origin_completeness(df, rows_per_origin).groupBy("series_id", "model").agg(
        F.sum(F.when(torn, F.col("n_rows")).otherwise(0)).alias("rows_removed"),
        F.count_if(torn).alias("origins_removed"),
    )


def merge_dedup(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S8. Union of two loads; a key present in both keeps the new row.

    The choice is a ``max_by`` aggregate, combined before the shuffle, so a key re-issued many
    times costs one row per task.
    """
    values = [c for c in new.columns if c not in keys]
    both = new.withColumn("_rank", F.lit(1)).unionByName(old.withColumn("_rank", F.lit(0)))
    # Repeats inside one load are settled by the row values, so re-runs give the same table.
    picked = both.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct("_rank", *values)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def merge_conflicts(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """S8. Keys delivered more than once with different values."""
    both = new.select(*keys, value).unionByName(old.select(*keys, value))
    stats = both.groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"),
        F.count(F.lit(1)).alias("copies"),
        (F.count(value) < F.count(F.lit(1))).alias("_some_null"),
        (F.count(value) > 0).alias("_some_value"),
    )
    return stats.filter(
        "low <> high or (_some_null and _some_value)").drop("_some_null", "_some_value")


def wide_to_long(df: DataFrame, truth: str, ts: str = "ts") -> DataFrame:
    """S12. A table with one column per external model -> long forecast rows."""
    models = [c for c in df.columns if c not in ("series_id", ts, truth)]
    return df.unpivot(["series_id", ts, truth], models, "model", "y_pred").select(
        "series_id", F.to_date(ts).alias("origin"), F.hour(ts).alias("hour"),
        F.col(truth).alias("y_true"), "y_pred", "model",
    )
