"""Registered queries T1-T3: the event table read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.session import shared_path
from daymark.sources import series
from daymark.streaming import jobs as J


def _events(spark, d):
    schema = series.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        d).withColumnRenamed("event_type", "series_id")


@query("t1_stream_hourly", "series_id, ts:d, price:6, n_points:i", """
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price, count(value) AS n_points
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
GROUP BY 1, 2 HAVING count(value) >= 2""")
def _(spark, d):
    return J.drain(J.stream_hourly(_events(spark, d), 2), "t1")


@query("t1_stream_feed", "series_id, ts:d, price:6, n_points:i", with_ctes("quarter_mean", """
SELECT h.series_id, h.ts, h.price, h.n_points FROM (
  SELECT series_id, date_trunc('hour', ts) AS ts, avg(price) AS price, count(price) AS n_points
  FROM closed GROUP BY 1, 2) h JOIN expected e USING (series_id) WHERE h.n_points >= e.expected""", """
closed AS (SELECT * FROM quarter_mean
           WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM quarter_mean) - INTERVAL 2 HOUR),
steps AS (SELECT series_id, step, count(*) AS n FROM (
    SELECT series_id, date_diff('second', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS step FROM closed)
  WHERE step > 0 GROUP BY 1, 2),
expected AS (
  SELECT series_id, CASE WHEN step > 3600 THEN 1 ELSE greatest(1, CAST(round_even(3600 / step, 0) AS INTEGER)) END AS expected
  FROM steps QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, step) = 1)"""))
def _(spark, d):
    # The sub-hourly feed lands as files; how many points an hour holds is learned on the way.
    feed, out, marks = (shared_path(spark, n) for n in ("t1-points", "t1-feed", "t1-feed-marks"))
    points = series.quarter_mean(spark, d)
    points.write.parquet(feed)
    J.stream_feed(spark.readStream.schema(points.schema).parquet(feed), out, marks, value="price")
    return J.current_hours(spark, out)


@query("t2_stream_dedup", "series_id, n:i, total:4", """
SELECT event_type AS series_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1""")
def _(spark, d):
    # Two overlapping deliveries of the same points.
    twice = _events(spark, d).union(_events(spark, d))
    once = J.drain(J.stream_dedup(twice, ("series_id", "event_id")), "t2")
    return once.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum("value").alias("total"))


@query("t3_stream_regime_alert", "series_id, origin:d, regime", with_ctes("by_type", """
SELECT d.series_id, d.day AS origin, CASE WHEN p.peak > 550.0 THEN 'stressed' ELSE 'calm' END AS regime
FROM (SELECT DISTINCT series_id, day FROM by_type) d LEFT JOIN
     (SELECT series_id, day, max(price) AS peak FROM by_type GROUP BY 1, 2) p
  ON p.series_id = d.series_id AND p.day = d.day - 1"""))
def _(spark, d):
    # The hourly feed lands in several files; each is one micro-batch.
    feed, out, marks = (shared_path(spark, n) for n in ("t3-feed", "t3", "t3-marks"))
    hourly = P.prices(spark, d).select("series_id", "ts", F.col("price").alias("y_true"))
    hourly.repartition(4, "ts").write.parquet(feed)
    stream = spark.readStream.schema(hourly.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    J.stream_regime_alert(stream, P.STRESS, out, marks).awaitTermination()
    return J.current_labels(spark, out)
