"""Hourly series derived from the star-schema tables (the data model's ``D-1`` shape).

Every builder is one aggregation with map-side combine keyed by (series, slot), so a series
that owns a third of the raw rows costs one partial row per task and slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import hour_stamp, quarter_floor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_days(daily: DataFrame, values: list[str]) -> DataFrame:
    """Contiguous calendar per series; days without a row become rows of NULLs.

    Each day reaches to the next one, so the input is read once and no calendar is joined. The
    window holds one row per day and series.
    """
    ahead = F.lead("day").over(Window.partitionBy("series_id").orderBy("day"))
    reach = F.coalesce(F.datediff(ahead, F.col("day")), F.lit(1))
    rows = daily.withColumn("_reach", reach).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_reach") - 1)))
    return rows.select("series_id", F.date_add("day", F.col("_i")).alias("day"),
                       *[F.when(F.col("_i") == 0, F.col(v)).alias(v) for v in values])


def fill_hours(hours: DataFrame, values: list[str], whole_days: bool = False) -> DataFrame:
    """Every hour between a series' first and last hour: (series_id, ts, day, hour, values, present).

    ``hours`` has one row per (series, day, hour), so a day packs at most 24 entries. Missing
    days and hours are added, and the day rows are spread over all tasks by (series, day)
    before they are unpacked. The result keeps day and hour: a following aggregation by day
    needs no further shuffle.
    """
    cells = F.struct("hour", *values, F.lit(True).alias("present"))
    packed = hours.groupBy("series_id", "day").agg(
        F.collect_list(cells).alias("_cells"), F.min("hour").alias("_lo"), F.max("hour").alias("_hi"))
    series = Window.partitionBy("series_id")
    edge = lambda pick, hour: pick(hour_stamp("day", hour)).over(series)
    if not whole_days:
        packed = packed.withColumns({"_first": edge(F.min, "_lo"), "_last": edge(F.max, "_hi")})
    bounds = [] if whole_days else ["_first", "_last"]
    days = fill_days(packed, ["_cells", *bounds]).repartition("series_id", "day")
    kinds = dict(hours.dtypes)
    blank = "struct(cast(h as int) as hour, " + "".join(
        f"cast(null as {kinds[v]}) as {v}, " for v in values) + "false as present)"
    entry = "struct<hour:int," + "".join(f"{v}:{kinds[v]}," for v in values) + "present:boolean>"
    absent = f"transform(array_except(sequence(0, 23), coalesce(_cells.hour, array())), h -> {blank})"
    rows = days.select("series_id", "day", *bounds, F.expr(
        f"inline(concat(coalesce(_cells, cast(array() as array<{entry}>)), {absent}))"))
    out = rows.withColumn("ts", hour_stamp("day", "hour"))
    if not whole_days:
        # The bounds are only known on days that had data; other days lie strictly between them.
        out = out.filter("_first is null or ts between _first and _last")
    return out.select("series_id", "ts", "day", "hour", *values, "present")


#: Columns of the standard schema, by the fact of an hour that each one takes.
FACTS = {"price": "total", "exog_1": "n", "exog_2": "users"}


def _event_hours(events: DataFrame, series: F.Column, facts: Sequence[str]) -> DataFrame:
    """One row per (series, day, hour) with the named facts.

    Only ``users`` needs a first shuffle by user; without it every fact is combined before rows move.
    """
    known = {
        "total": F.sum("value"), "mean": F.avg("value"), "n": F.count(F.lit(1)).cast("double"),
        "users": F.count_distinct("user_id").cast("double")}
    return (
        events.select(series.alias("series_id"), F.to_date("ts").alias("day"),
                      F.hour("ts").alias("hour"), "value", "user_id")
        .groupBy("series_id", "day", "hour").agg(*[known[f].alias(f) for f in facts]))


def _zero_filled(agg: DataFrame, columns: Sequence[str] = tuple(FACTS)) -> DataFrame:
    """An hour without events is a true zero total, so the series is complete."""
    return fill_hours(agg, [FACTS[c] for c in columns], whole_days=True).select(
        "series_id", "ts", *[F.coalesce(FACTS[c], F.lit(0.0)).alias(c) for c in columns],
        "day", "hour")


def _event_series(spark: SparkSession, sf_dir: str, series: F.Column, columns: Sequence[str]
                  ) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _zero_filled(_event_hours(events, series, [FACTS[c] for c in columns]), columns)


def hourly_total(spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(FACTS)
                 ) -> DataFrame:
    return _event_series(spark, sf_dir, F.lit("total"), columns)


def hourly_by_type(spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(FACTS)
                   ) -> DataFrame:
    """One series per event type. The cells of a day travel packed, which hides them from column
    pruning, so a caller names the ``columns`` it needs."""
    return _event_series(spark, sf_dir, F.col("event_type"), columns)


def hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per event type and hour; hours without events are absent, never filled."""
    agg = _event_hours(table(spark, sf_dir, "events"), F.col("event_type"), ("mean", "n", "users"))
    return agg.select(
        "series_id", hour_stamp("day", "hour").alias("ts"), F.col("mean").alias("price"),
        F.col("n").alias("exog_1"), F.col("users").alias("exog_2"),
    )


def quarter_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-hourly feed: mean value per 15-minute slot, with real gaps."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("series_id"), quarter_floor("ts").alias("ts"), "value")
        .groupBy("series_id", "ts").agg(F.avg("value").alias("price"))
    )


def delivery_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long hourly history (about 2,500 days) from ``lineitem``.

    Each order line is booked to one of 24 delivery slots of its ship date. Price is the
    turnover of the slot in thousands; the exogenous columns are quantity and line count.
    """
    agg = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.lit("slots").alias("series_id"),
            F.to_date("l_shipdate").alias("day"),
            F.pmod("l_partkey", F.lit(24)).cast("int").alias("hour"),
            "l_extendedprice", "l_quantity",
        )
        .groupBy("series_id", "day", "hour")
        .agg(
            (F.sum("l_extendedprice") / 1000).alias("total"),
            F.sum("l_quantity").alias("n"),
            F.count(F.lit(1)).cast("double").alias("users"),
        )
    )
    return _zero_filled(agg)


def daily_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series per return flag from ``lineitem``: (series_id, day, price, exog_1, exog_2)."""
    agg = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("day"))
        .agg(
            (F.sum("l_extendedprice") / 1000).alias("price"),
            F.sum("l_quantity").alias("exog_1"),
            F.count(F.lit(1)).cast("double").alias("exog_2"),
        )
    )
    return fill_days(agg, ["price", "exog_1", "exog_2"]).select(
        "series_id", "day",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("price", "exog_1", "exog_2")],
    )
