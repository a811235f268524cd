"""Live feeds as streams.

Rows later than the watermark are dropped here and picked up by the batch merge
(``sources.forecasts.merge_dedup``) on its next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from daymark.functions.exprs import unix_micros_ntz
from daymark.operators.ensemble import CALM, STRESSED
from daymark.operators.ordered import attach
from daymark.operators.quality import points_of_step
from daymark.session import shared_path


def event_time(ts: str) -> Column:
    """Watermarks need an instant; the zone-free time is read as UTC whatever the session zone."""
    return F.timestamp_micros(unix_micros_ntz(ts))


def closed_hours(points: DataFrame, delay: str = "2 hours", value: str = "value") -> DataFrame:
    """Every hour that the watermark has passed: (series_id, ts, price, n_points, marks).

    ``marks`` are the distinct instants of the hour in microseconds, in order. The state holds open
    hours only.
    """
    start = F.expr("cast(date'1970-01-01' as timestamp_ntz) + make_dt_interval("
                   "0, 0, 0, cast(unix_micros(window.start) / 1000000 as decimal(18,6)))")
    return (
        points.withColumn("_event", event_time("ts")).withWatermark("_event", delay)
        .groupBy("series_id", F.window("_event", "1 hour"))
        .agg(F.avg(value).alias("price"), F.count(value).alias("n_points"),
             F.sort_array(F.collect_set(F.unix_micros("_event"))).alias("marks"))
        .select("series_id", start.alias("ts"), "price", "n_points", "marks"))


def stream_hourly(points: DataFrame, expected: int | DataFrame, delay: str = "2 hours",
                  value: str = "value") -> DataFrame:
    """T1. Hourly mean, emitted once the watermark has passed the hour and it is complete.

    ``expected`` is the number of points of a complete hour, or a static (series_id, expected)
    table. ``stream_feed`` learns it from the stream.
    """
    hours = closed_hours(points, delay, value).drop("marks")
    if isinstance(expected, DataFrame):
        hours = hours.join(expected.select("series_id", "expected"), "series_id")
    else:
        hours = hours.withColumn("expected", F.lit(expected))
    return hours.filter("n_points >= expected").drop("expected")


def learned_steps(hours: DataFrame) -> DataFrame:
    """T1. The modal step of a series, emitted whenever it changes: (series_id, as_of, step).

    ``hours`` is a stream of closed hours. A row carries the hour's first and last instant and its
    steps as counts, so the state of a series is one count per distinct step and its last instant,
    however long it runs. Hours of one micro-batch come in any order and are sorted; later batches
    hold later hours, because the watermark closes them. ``step`` is 0 while none is known.
    """
    steps = F.expr("transform(slice(marks, 2, size(marks)), (x, i) -> x - marks[i])")
    rows = hours.filter("size(marks) > 0").select(
        "series_id", "ts", F.element_at("marks", 1).alias("lo"), F.element_at("marks", -1).alias("hi"),
        steps.alias("steps"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        counts, last, modal = {}, None, None
        if state.exists:
            names, numbers, last, modal = state.get
            counts = dict(zip(names, numbers))
        hours = pd.concat(list(batches)).sort_values("lo")
        for lo, hi, inner in zip(hours["lo"], hours["hi"], hours["steps"]):
            across = [] if last is None else [lo - last]
            for step in [*across, *inner]:
                counts[int(step)] = counts.get(int(step), 0) + 1
            last = int(hi)
        best = min(counts, key=lambda step: (-counts[step], step), default=0)
        state.update((list(counts), list(counts.values()), last, best))
        if best != modal:
            yield pd.DataFrame({"series_id": [key[0]], "as_of": [hours["ts"].max()], "step": [best]})

    return rows.groupBy("series_id").applyInPandasWithState(
        update, "series_id string, as_of timestamp_ntz, step bigint",
        "steps array<bigint>, counts array<bigint>, last bigint, modal bigint", "append", "NoTimeout")


def stream_feed(points: DataFrame, path: str, checkpoint: str, delay: str = "2 hours",
                value: str = "value") -> None:
    """T1 without a given count: closed hours under ``path/hours``, learned steps under ``path/steps``.

    Two streams with a checkpoint each, the second reads what the first has stored; a restart goes
    on where either stopped. ``current_hours`` applies the newest step to all hours, so a changed
    step also changes the verdict on earlier ones, as the batch rule does.
    """

    def store(stream: DataFrame, name: str) -> None:
        (stream.writeStream.format("parquet").option("path", f"{path}/{name}").outputMode("append")
         .option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
         .awaitTermination())

    hours = closed_hours(points, delay, value)
    store(hours, "hours")
    stored = points.sparkSession.readStream.schema(hours.schema).parquet(f"{path}/hours")
    store(learned_steps(stored), "steps")


HOURS = "series_id string, ts timestamp_ntz, price double, n_points bigint"


def current_hours(spark: SparkSession, path: str) -> DataFrame:
    """Complete closed hours by each series' newest step: (series_id, ts, price, n_points)."""
    steps = spark.read.schema("series_id string, as_of timestamp_ntz, step bigint").parquet(
        f"{path}/steps")
    newest = steps.groupBy("series_id").agg(F.max_by("step", "as_of").alias("step")).select(
        "series_id", points_of_step(F.expr("nullif(step, 0)")).alias("expected"))
    hours = spark.read.schema(HOURS).parquet(f"{path}/hours")
    return attach(hours, newest, ["series_id"], "ts").filter("n_points >= expected").select(
        "series_id", "ts", "price", "n_points")


def stream_dedup(points: DataFrame, keys: tuple[str, ...] = ("series_id", "ts"),
                 delay: str = "2 hours") -> DataFrame:
    """T2. Overlapping chunks deliver a point twice; only the first copy passes."""
    marked = points.withColumn("_event", event_time("ts")).withWatermark("_event", delay)
    return marked.dropDuplicatesWithinWatermark(list(keys)).drop("_event")


LABEL = "series_id string, day date, regime string"


def regime_updates(hourly: DataFrame, threshold: float, horizon: str = "35 days") -> DataFrame:
    """T3. The label of every day that a micro-batch touches, as (series_id, day, regime).

    An hour tells its own day that it exists and the next day what may be its previous peak. The
    state of a (series, day) is that peak and whether the day was seen, so a batch costs what its
    own days cost, however many went before. State is given up ``horizon`` after its day; hours
    later than that change nothing.
    """
    day = F.to_date("ts")
    told = F.array(
        F.struct(day.alias("day"), F.lit(True).alias("own"), F.lit(None).cast("double").alias("peak")),
        F.struct(F.date_add(day, 1).alias("day"), F.lit(False).alias("own"),
                 F.col("y_true").cast("double").alias("peak")))
    rows = hourly.withColumn("_event", event_time("ts")).withWatermark("_event", horizon).select(
        "series_id", "_event", F.inline(told))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        series, on = key
        if state.hasTimedOut:
            state.remove()
            return
        peak, seen = state.get if state.exists else (None, False)
        for pdf in batches:
            seen = seen or bool(pdf["own"].any())
            top = pdf["peak"].max()
            if pd.notna(top):
                peak = float(top) if peak is None else max(peak, float(top))
        state.update((peak, seen))
        end = pd.Timestamp(on, tz="UTC") + pd.Timedelta(days=2)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000),
                                      state.getCurrentWatermarkMs() + 1))
        if seen:
            stressed = peak is not None and peak > threshold
            yield pd.DataFrame({"series_id": [series], "day": [on],
                                "regime": [STRESSED if stressed else CALM]})

    return rows.groupBy("series_id", "day").applyInPandasWithState(
        update, LABEL, "peak double, seen boolean", "update", "EventTimeTimeout")


def stream_regime_alert(hourly: DataFrame, threshold: float, path: str, checkpoint: str,
                        horizon: str = "35 days") -> StreamingQuery:
    """T3. Keep each day's regime label up to date as hours arrive.

    Every micro-batch writes its labels under its batch id, so a batch that is run again replaces
    its own folder and a restart cannot count anything twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/labels/batch={batch_id}")

    return (
        regime_updates(hourly, threshold, horizon).writeStream.outputMode("update")
        .foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def current_labels(spark: SparkSession, path: str) -> DataFrame:
    """Newest label per day."""
    rows = spark.read.option("basePath", f"{path}/labels").parquet(f"{path}/labels")
    return rows.groupBy("series_id", F.col("day").alias("origin")).agg(
        F.max_by("regime", "batch").alias("regime"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into a shared table and return that table."""
    spark = stream.sparkSession
    out, marks = shared_path(spark, name), shared_path(spark, f"{name}-marks")
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", marks).outputMode("append")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
