"""Registered queries Q1-Q17."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.operators import quality
from daymark.sources import series

# A feed whose tail is not published yet: the price of the last two days is NULL, and one
# interior hour is NULL too.
_RAGGED = """
ragged AS (SELECT series_id, ts, CASE WHEN day >= DATE '2024-01-29' OR (day = DATE '2024-01-10' AND hour = 3)
                                 THEN NULL ELSE price END AS price, exog_1, exog_2 FROM by_type)"""


def _ragged(spark, d):
    day, hour = F.to_date("ts"), F.hour("ts")
    unknown = (day >= F.lit(dt.date(2024, 1, 29))) | (
        (day == F.lit(dt.date(2024, 1, 10))) & (hour == 3))
    return P.by_type(spark, d).withColumn("price", F.when(~unknown, F.col("price")))


@query("q1_trim_trailing_nulls", "series_id, ts:d, price:6", with_ctes("by_type", """
SELECT r.series_id, r.ts, r.price FROM ragged r
JOIN (SELECT series_id, max(ts) AS last_ts FROM ragged WHERE price IS NOT NULL GROUP BY 1) m
USING (series_id) WHERE r.ts <= m.last_ts""", _RAGGED))
def _(spark, d):
    return quality.trim_trailing_nulls(_ragged(spark, d))


_EXPECTED = """
steps AS (
  SELECT series_id, step, count(*) AS n FROM (
    SELECT series_id, date_diff('second', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS step
    FROM quarter_mean) WHERE step > 0 GROUP BY 1, 2),
expected AS (
  SELECT series_id, CASE WHEN step > 3600 THEN 1 ELSE greatest(1, CAST(round_even(3600 / step, 0) AS INTEGER)) END AS expected
  FROM steps QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, step) = 1)"""


@query("q2_observations_per_hour", "series_id, expected:i",
       with_ctes("quarter_mean", "SELECT * FROM expected", _EXPECTED))
def _(spark, d):
    return quality.observations_per_hour(series.quarter_mean(spark, d))


@query("q3_resample_hourly", "series_id, ts:d, price:6", with_ctes("quarter_mean", """
SELECT s.series_id, s.ts, CASE WHEN h.n >= e.expected THEN h.price END AS price
FROM (SELECT series_id, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS ts
      FROM quarter_mean GROUP BY 1) s
LEFT JOIN (SELECT series_id, date_trunc('hour', ts) AS ts, avg(price) AS price, count(price) AS n
           FROM quarter_mean GROUP BY 1, 2) h USING (series_id, ts)
JOIN expected e USING (series_id)""", _EXPECTED))
def _(spark, d):
    return quality.resample_hourly(series.quarter_mean(spark, d))


@query("q4_sum_components", "series_id, ts:d, value:6", """
SELECT 'total' AS series_id, ts, CASE WHEN count(v) = 5 THEN sum(v) END AS value FROM (
  SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2)
GROUP BY 2""")
def _(spark, d):
    parts = (
        series.table(spark, d, "events")
        .select(F.col("event_type").alias("component"), P.hour_floor("ts").alias("ts"), "value")
        .groupBy("component", "ts").agg(F.sum("value").alias("value"))
        .withColumn("series_id", F.lit("total")))
    return quality.sum_components(parts, 5)


# Price of one hour, load = clicks plus views, renewables = sign-ups: each source has its own holes.
_ALIGN = """
price AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price FROM events GROUP BY 1, 2),
load AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events WHERE value > 20 GROUP BY 1, 2),
ren AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events WHERE value < 60 GROUP BY 1, 2),
aligned AS (SELECT series_id, ts, price, l.value AS exog_1, r.value AS exog_2
            FROM price JOIN load l USING (series_id, ts) JOIN ren r USING (series_id, ts))"""


def _aligned(spark, d):
    e = series.table(spark, d, "events").select(
        F.col("event_type").alias("series_id"), P.hour_floor("ts").alias("ts"), "value")
    hour = lambda f, agg: f.groupBy("series_id", "ts").agg(agg)
    price = hour(e, F.avg("value").alias("price"))
    load = hour(e.filter("value > 20"), F.sum("value").alias("value"))
    ren = hour(e.filter("value < 60"), F.sum("value").alias("value"))
    return price, quality.align_sources(price, load, ren)


@query("q5_align_sources", "series_id, ts:d, price:6, exog_1:6, exog_2:6",
       f"WITH {_ALIGN} SELECT * FROM aligned")
def _(spark, d):
    return _aligned(spark, d)[1]


@query("q5_alignment_loss", "series_id, price_hours:i, kept_hours:i, lost_hours:i", f"""
WITH {_ALIGN} SELECT series_id, p.n AS price_hours, a.n AS kept_hours, p.n - a.n AS lost_hours
FROM (SELECT series_id, count(*) AS n FROM price GROUP BY 1) p
JOIN (SELECT series_id, count(*) AS n FROM aligned GROUP BY 1) a USING (series_id)""")
def _(spark, d):
    return quality.alignment_loss(*_aligned(spark, d))


@query("q6_quality_report", """series_id, n_rows:i, first_ts:d, last_ts:d, missing_hours:i,
       null_price:i, null_exog_1:i, null_exog_2:i, mean_price:6, std_price:5, min_price:6,
       max_price:6, negative_hours:i, negative_pct:6""", with_ctes("hourly_mean", """
SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
  date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS missing_hours,
  count(*) - count(price) AS null_price, count(*) - count(exog_1) AS null_exog_1,
  count(*) - count(exog_2) AS null_exog_2, avg(price) AS mean_price, stddev_samp(price) AS std_price,
  min(price) AS min_price, max(price) AS max_price, count(*) FILTER (price < 0) AS negative_hours,
  100.0 * count(*) FILTER (price < 0) / count(*) AS negative_pct
FROM (SELECT series_id, ts, CASE WHEN exog_1 = 7 THEN NULL ELSE price - 20 END AS price, exog_1, exog_2
      FROM hourly_mean) GROUP BY 1"""))
def _(spark, d):
    df = series.hourly_mean(spark, d).withColumn(
        "price", F.when(F.col("exog_1") != 7, F.col("price") - 20))
    return quality.quality_report(df)


_MISSING = """
spine AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly_mean GROUP BY 1),
missing AS (SELECT * FROM spine ANTI JOIN hourly_mean USING (series_id, ts))"""


@query("q7_missing_hours", "series_id, ts:d",
       with_ctes("hourly_mean", "SELECT * FROM missing", _MISSING))
def _(spark, d):
    return quality.missing_hours(series.hourly_mean(spark, d))


@query("q7_missing_by_day", "series_id, day:d, missing_hours:i", with_ctes("hourly_mean", """
SELECT series_id, CAST(ts AS DATE) AS day, count(*) AS missing_hours FROM missing GROUP BY 1, 2""",
                                                                       _MISSING))
def _(spark, d):
    return quality.missing_hours_by_day(series.hourly_mean(spark, d))


@query("q8_duplicate_hours", "series_id, day:d, hour:i, copies:i", with_ctes("quarter_mean", """
SELECT series_id, CAST(ts AS DATE) AS day, extract(hour FROM ts) AS hour, count(*) AS copies
FROM quarter_mean GROUP BY 1, 2, 3 HAVING count(*) > 1"""))
def _(spark, d):
    return quality.duplicate_hours(series.quarter_mean(spark, d))


@query("q9_densify_days", "series_id, day:d, price:4, n:i", """
WITH d AS (SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS day,
                  sum(l_extendedprice) AS price, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2)
SELECT s.series_id, s.day, d.price, d.n FROM
 (SELECT series_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM d GROUP BY 1) s LEFT JOIN d USING (series_id, day)""")
def _(spark, d):
    daily = (
        series.table(spark, d, "lineitem").filter("l_quantity < 10")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("series_id"),
                 F.to_date("l_shipdate").alias("day"))
        .agg(F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n")))
    return quality.densify_days(daily)


# Member frames with planted defects: one model lacks a day, one repeats an hour, one is torn.
_BROKEN = """
broken AS (
  SELECT * FROM members WHERE NOT (model = 'lag7' AND origin = DATE '2024-01-12')
    AND NOT (model = 'mean3' AND origin = DATE '2024-01-15' AND hour = 4)
  UNION ALL SELECT * FROM members WHERE model = 'lag1' AND origin = DATE '2024-01-16' AND hour = 6),
cells AS (SELECT series_id, model, origin, hour, count(*) AS n FROM broken GROUP BY 1, 2, 3, 4),
o AS (SELECT series_id, model, origin, sum(n) AS r, count(*) FILTER (n > 1) AS dupes FROM cells GROUP BY 1, 2, 3)"""


def _broken(spark, d):
    m = P.members(spark, d)
    on = lambda day: F.col("origin") == F.lit(day)
    kept = m.filter(
        ~((F.col("model") == "lag7") & on(dt.date(2024, 1, 12)))
        & ~((F.col("model") == "mean3") & on(dt.date(2024, 1, 15)) & (F.col("hour") == 4)))
    return kept.unionAll(m.filter(
        (F.col("model") == "lag1") & on(dt.date(2024, 1, 16)) & (F.col("hour") == 6)))


@query("q10_check_members", "series_id, model, rule, n:i", with_ctes("members", """
SELECT series_id, model, 'origin without 24 rows' AS rule, count(*) AS n FROM o WHERE r <> 24 GROUP BY 1, 2
UNION ALL SELECT series_id, model, 'duplicate hour', sum(dupes) FROM o WHERE dupes > 0 GROUP BY 1, 2
UNION ALL SELECT series_id, model, 'origin missing', count(*) FROM (
  SELECT a.series_id, m.model, a.origin FROM (SELECT DISTINCT series_id, origin FROM o) a
  JOIN (SELECT DISTINCT series_id, model FROM o) m USING (series_id)
  ANTI JOIN o ON o.series_id = a.series_id AND o.model = m.model AND o.origin = a.origin)
GROUP BY 1, 2""", _BROKEN))
def _(spark, d):
    return quality.member_coverage(_broken(spark, d))


@query("q10_origin_difference", "series_id, only_left:i, only_right:i, in_both:i",
       with_ctes("members", """
SELECT series_id, count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right,
       count(*) FILTER (l AND r) AS in_both
FROM (SELECT series_id, origin, bool_or(model = 'lag7') AS l, bool_or(model = 'lag1') AS r
      FROM broken WHERE model IN ('lag7', 'lag1') GROUP BY 1, 2) GROUP BY 1""", _BROKEN))
def _(spark, d):
    return quality.origin_set_difference(_broken(spark, d), "lag7", "lag1")


_STALE = """
stale AS (SELECT series_id, model, origin, hour,
  CASE WHEN model = 'lag7' AND hour = 9 THEN y_true + 0.001
       WHEN model = 'mean3' AND hour = 10 AND origin > DATE '2024-01-25' THEN NULL
       WHEN hour = 11 THEN NULL ELSE y_true END AS y_true, y_pred FROM broken)"""


@query("q11_truth_agreement", "series_id, origin:d, hour:i, members:i, spread:6, null_truths:i",
       with_ctes("members", """
SELECT series_id, origin, hour, count(DISTINCT model) AS members, max(y_true) - min(y_true) AS spread,
       count(*) - count(y_true) AS null_truths
FROM stale GROUP BY 1, 2, 3
HAVING count(DISTINCT model) < 4 OR max(y_true) - min(y_true) > 1e-6
    OR (count(y_true) < count(*) AND count(y_true) > 0)""", _BROKEN + "," + _STALE))
def _(spark, d):
    b = _broken(spark, d)
    y = (
        F.when((F.col("model") == "lag7") & (F.col("hour") == 9), F.col("y_true") + 0.001)
        .when((F.col("model") == "mean3") & (F.col("hour") == 10)
              & (F.col("origin") > F.lit(dt.date(2024, 1, 25))), F.lit(None))
        .when(F.col("hour") == 11, F.lit(None)).otherwise(F.col("y_true")))
    return quality.truth_disagreements(b.withColumn("y_true", y))


@query("q12_verify_alignment",
       "series_id, rows_ours:i, rows_published:i, first_mismatch:d, max_diff:6, aligned:b",
       with_ctes("by_type", """
SELECT series_id, count(a.price) AS rows_ours, count(b.price) AS rows_published,
  min(CASE WHEN a.price IS NULL OR b.price IS NULL THEN ts END) AS first_mismatch,
  max(abs(a.price - b.price)) AS max_diff,
  count(a.price) = count(b.price) AND count(*) FILTER (a.price IS NULL OR b.price IS NULL) = 0
    AND max(abs(a.price - b.price)) <= 1e-6 AS aligned
FROM (SELECT * FROM by_type WHERE NOT (series_id = 'view' AND hour = 2)) a
FULL JOIN (SELECT series_id, ts, price + CASE WHEN series_id = 'click' AND hour = 1 THEN 0.5 ELSE 0 END AS price
           FROM by_type) b USING (series_id, ts) GROUP BY 1"""))
def _(spark, d):
    base = P.prices(spark, d).select("series_id", "ts", F.col("price").alias("y_true"))
    ours = base.filter(~((F.col("series_id") == "view") & (F.hour("ts") == 2)))
    bump = F.when((F.col("series_id") == "click") & (F.hour("ts") == 1), 0.5).otherwise(0.0)
    return quality.verify_alignment(ours, base.withColumn("y_true", F.col("y_true") + bump))


@query("q13_null_screen", "series_id, model, null_pred:i, null_true:i", with_ctes("members", """
SELECT series_id, model, count(*) FILTER (y_pred > 250) AS null_pred, count(*) FILTER (y_true < 5) AS null_true
FROM members GROUP BY 1, 2"""))
def _(spark, d):
    df = P.members(spark, d).withColumns({
        "y_pred": F.when(F.col("y_pred") <= 250, F.col("y_pred")),
        "y_true": F.when(F.col("y_true") >= 5, F.col("y_true"))})
    return quality.null_screen(df)


@query("q14_completeness_filter",
       "series_id, model, covered_hours:i, truth_hours:i, missing_hours:i, complete:b",
       with_ctes("members", """
SELECT m.series_id, m.model, coalesce(c.n, 0) AS covered_hours, t.n AS truth_hours,
       t.n - coalesce(c.n, 0) AS missing_hours, t.n = coalesce(c.n, 0) AS complete
FROM (SELECT DISTINCT series_id, model FROM broken) m
JOIN (SELECT series_id, count(*) AS n FROM by_type WHERE day >= DATE '2024-01-08' GROUP BY 1) t USING (series_id)
LEFT JOIN (SELECT series_id, model, count(*) AS n FROM (SELECT DISTINCT series_id, model, origin, hour FROM broken
           WHERE y_pred IS NOT NULL) GROUP BY 1, 2) c USING (series_id, model)""", _BROKEN))
def _(spark, d):
    truth = quality.with_day_hour(P.prices(spark, d)).select(
        "series_id", F.col("day").alias("origin"), "hour").filter(
        F.col("origin") >= F.lit(dt.date(2024, 1, 8)))
    return quality.model_completeness(_broken(spark, d), truth)


_GAPPY = """
gappy AS (SELECT series_id, ts, day, hour, exog_1, CASE WHEN exog_2 = 0 AND hour = 4 THEN NULL ELSE exog_2 END AS exog_2
          FROM by_type WHERE NOT (day = DATE '2024-01-13' AND hour = 5)),
usable AS (SELECT series_id, day FROM gappy GROUP BY 1, 2
           HAVING count(*) = 24 AND count(exog_1) = 24 AND count(exog_2) = 24),
ready AS (SELECT u.series_id, u.day FROM usable u JOIN usable p
          ON p.series_id = u.series_id AND p.day BETWEEN u.day - 7 AND u.day - 1
          GROUP BY 1, 2 HAVING count(*) = 7)"""


def _gappy(spark, d):
    day, hour = F.to_date("ts"), F.hour("ts")
    return P.by_type(spark, d).filter(
        ~((day == F.lit(dt.date(2024, 1, 13))) & (hour == 5))).withColumn(
        "exog_2", F.when(~((F.col("exog_2") == 0) & (hour == 4)), F.col("exog_2")))


@query("q15_forecastable_days", "series_id, day:d",
       with_ctes("by_type", "SELECT * FROM ready", _GAPPY))
def _(spark, d):
    return quality.forecastable_days(_gappy(spark, d))


@query("q16_history_window", "series_id, day:d, start_day:d, end_day:d",
       with_ctes("by_type", "SELECT series_id, day, day - 11 AS start_day, day AS end_day FROM ready",
                 _GAPPY))
def _(spark, d):
    return quality.history_window(quality.forecastable_days(_gappy(spark, d)))


@query("q17_origin_span", "series_id, model, n_origins:i, first_origin:d, last_origin:d",
       with_ctes("members", """
SELECT series_id, model, count(DISTINCT origin) AS n_origins, min(origin) AS first_origin,
       max(origin) AS last_origin FROM members GROUP BY 1, 2"""))
def _(spark, d):
    return quality.origin_span(P.members(spark, d))
