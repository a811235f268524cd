"""Registered queries S1-S12."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.functions.exprs import hour_stamp
from daymark.operators import scoring
from daymark.session import shared_path
from daymark.sources import export, forecasts, hourly, series


@query("s1_load_hourly", "series_id, ts:d, price:4, exog_1:4, exog_2:4",
       "SELECT 'orders' AS series_id, o_orderdate AS ts, o_totalprice AS price, "
       "CAST(o_custkey AS DOUBLE) AS exog_1, CAST(o_orderkey AS DOUBLE) AS exog_2 FROM orders")
def _(spark, d):
    raw = series.table(spark, d, "orders").select(
        F.col("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Price"),
        F.col("o_custkey").alias("Exogenous 1"), F.col("o_orderkey").alias("Exogenous 2"))
    return hourly.standardize(raw, "Date", "orders")


@query("s2_split_train_test", "series_id, split, n:i, first_ts:d, last_ts:d", with_ctes("slots", """
SELECT series_id, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT *, CASE WHEN ts > max(ts) OVER (PARTITION BY series_id) - INTERVAL 17472 HOUR
            THEN 'test' ELSE 'train' END AS split FROM slots)
GROUP BY 1, 2"""))
def _(spark, d):
    return hourly.split_train_test(series.delivery_slots(spark, d), 2).groupBy(
        "series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                                  F.max("ts").alias("last_ts"))


@query("s3_flatten_payload", "series_id, ts:d, value:6", """
SELECT event_type AS series_id, date_trunc('second', ts) AS ts, value FROM events""")
def _(spark, d):
    # The feed delivers payloads of up to 500 points: parallel arrays of epoch seconds and
    # values, cut by event number so that no payload can grow with the data.
    events = series.table(spark, d, "events")
    seconds = F.expr("datediff(to_date(ts), date'1970-01-01') * 86400L + hour(ts) * 3600L"
                     " + minute(ts) * 60L + second(ts)")
    payloads = (
        events.select(F.col("event_type").alias("series_id"), seconds.alias("s"), "value",
                      F.floor(F.col("event_id") / 500).alias("part"))
        .groupBy("series_id", "part")
        .agg(F.collect_list(F.struct("s", "value")).alias("points"))
        .select("series_id", F.to_json(F.struct(
            F.col("points.s").alias("unix_seconds"), F.col("points.value").alias("price"))
        ).alias("body"))
    )
    return hourly.flatten_payload(payloads, "body")


_LOAD_COUNTS = """
SELECT series_id, model, count(*) AS n, count(DISTINCT origin) AS origins, sum(y_pred) AS total
FROM members GROUP BY 1, 2"""


def _load_counts(df):
    return df.groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("origin").alias("origins"),
        F.sum("y_pred").alias("total"))


@query("s4_load_long", "series_id, model, n:i, origins:i, total:4",
       with_ctes("members", _LOAD_COUNTS))
def _(spark, d):
    path = shared_path(spark, "s4")
    P.members(spark, d).write.parquet(path)
    return _load_counts(forecasts.load_long(spark, path))


@query("s5_append_forecasts", "series_id, model, n:i, origins:i, total:4",
       with_ctes("members", _LOAD_COUNTS))
def _(spark, d):
    # Written twice, the second time for the test days only: nothing is duplicated.
    path = shared_path(spark, "s5")
    frame = P.members(spark, d)
    forecasts.write_forecasts(frame, path)
    forecasts.write_forecasts(frame.filter(F.col("origin") >= F.lit(P.TEST_START)), path)
    return _load_counts(forecasts.load_long(spark, path))


# A partly finished run: hour 23 of every fifth day is not written yet.
_DONE = """
done AS (SELECT * FROM members WHERE NOT (hour = 23 AND extract(day FROM origin) % 5 = 0))"""


def _done(frame):
    return frame.filter(~((F.col("hour") == 23) & (F.dayofmonth("origin") % 5 == 0)))


@query("s6_remaining_origins", "series_id, model, origin:d", with_ctes("members", """
SELECT p.* FROM (SELECT DISTINCT series_id, model, origin FROM members) p
ANTI JOIN (SELECT series_id, model, origin FROM done GROUP BY 1, 2, 3 HAVING count(*) = 24) f
USING (series_id, model, origin)""", _DONE))
def _(spark, d):
    frame = P.members(spark, d)
    planned = frame.select("series_id", "model", "origin").distinct()
    return forecasts.remaining_origins(planned, _done(frame))


@query("s7_repair_partial", "series_id, model, rows_removed:i, origins_removed:i",
       with_ctes("members", """
SELECT series_id, model, sum(CASE WHEN n <> 24 THEN n ELSE 0 END) AS rows_removed,
       count(*) FILTER (n <> 24) AS origins_removed
FROM (SELECT series_id, model, origin, count(*) AS n FROM done GROUP BY 1, 2, 3)
GROUP BY 1, 2""", _DONE))
def _(spark, d):
    return forecasts.repair_report(_done(P.members(spark, d)))


@query("s7_repaired_rows", "series_id, model, n:i, total:4", with_ctes("members", """
SELECT series_id, model, count(*) AS n, sum(y_pred) AS total FROM done
SEMI JOIN (SELECT series_id, model, origin FROM done GROUP BY 1, 2, 3 HAVING count(*) = 24) f
USING (series_id, model, origin) GROUP BY 1, 2""", _DONE))
def _(spark, d):
    return forecasts.repair_partial(_done(P.members(spark, d))).groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_pred").alias("total"))


# Two overlapping loads of one feed; the later one re-issues some hours with a new value.
_LOADS = """
old AS (SELECT series_id, ts, price FROM hourly_mean WHERE day <= DATE '2024-01-20'),
new AS (SELECT series_id, ts, price + CASE WHEN hour = 12 THEN 1.0 ELSE 0.0 END AS price
        FROM hourly_mean WHERE day >= DATE '2024-01-15')"""


def _loads(spark, d):
    base = series.hourly_mean(spark, d).select("series_id", "ts", "price")
    day = F.to_date("ts")
    old = base.filter(day <= F.lit("2024-01-20").cast("date"))
    new = base.filter(day >= F.lit("2024-01-15").cast("date")).withColumn(
        "price", F.col("price") + F.when(F.hour("ts") == 12, 1.0).otherwise(0.0))
    return new, old


@query("s8_merge_dedup", "series_id, ts:d, price:6", with_ctes("hourly_mean", """
SELECT series_id, ts, price FROM new UNION ALL
SELECT series_id, ts, price FROM old ANTI JOIN new USING (series_id, ts)""", _LOADS))
def _(spark, d):
    new, old = _loads(spark, d)
    return forecasts.merge_dedup(new, old, ["series_id", "ts"])


@query("s8_merge_conflicts", "series_id, ts:d, low:6, high:6, copies:i",
       with_ctes("hourly_mean", """
SELECT series_id, ts, min(price) AS low, max(price) AS high, count(*) AS copies
FROM (SELECT * FROM new UNION ALL SELECT * FROM old) GROUP BY 1, 2
HAVING min(price) <> max(price)""", _LOADS))
def _(spark, d):
    new, old = _loads(spark, d)
    return forecasts.merge_conflicts(new, old, ["series_id", "ts"], "price")


# An uploaded text table with defects planted by rule: text in a number, a repeated hour, gaps.
_UPLOAD = """
upload AS (
  SELECT series_id, CAST(ts AS VARCHAR) AS timestamp, ts,
         CASE WHEN hour = 5 AND day = DATE '2024-01-03' THEN 'n/a' ELSE CAST(exog_1 AS VARCHAR) END AS exog_1
  FROM hourly_mean
  UNION ALL SELECT series_id, CAST(ts AS VARCHAR), ts, CAST(exog_1 AS VARCHAR) FROM hourly_mean
  WHERE hour = 7 AND day = DATE '2024-01-04'),
steps AS (
  SELECT series_id, step, count(*) AS n FROM (
    SELECT series_id, date_diff('second', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS step
    FROM (SELECT DISTINCT series_id, ts FROM upload)) WHERE step > 0 GROUP BY 1, 2)"""


@query("s9_validate_upload", "series_id, rule, detail, n:i", with_ctes("hourly_mean", """
SELECT series_id, 'duplicate timestamp' AS rule, CAST(min(ts) AS VARCHAR) AS detail, count(*) AS n
FROM (SELECT series_id, ts FROM upload GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
UNION ALL
SELECT series_id, 'not numeric: exog_1', arg_min(exog_1, ts), count(*) FROM upload
WHERE TRY_CAST(exog_1 AS DOUBLE) IS NULL AND exog_1 IS NOT NULL GROUP BY 1
UNION ALL
SELECT s.series_id, 'not hourly', CAST(CAST(m.step AS BIGINT) AS VARCHAR) || ' s', s.n FROM
 (SELECT series_id, sum(n) AS n FROM steps WHERE step <> 3600 GROUP BY 1) s JOIN
 (SELECT series_id, step FROM steps QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, step) = 1) m
 USING (series_id)""", _UPLOAD))
def _(spark, d):
    from daymark.operators.quality import validate_upload
    base = series.hourly_mean(spark, d).withColumn("exog_text", F.format_string("%.1f", "exog_1"))
    day = F.to_date("ts")
    broken = (F.hour("ts") == 5) & (day == F.lit("2024-01-03").cast("date"))
    text = base.select(
        "series_id", F.col("ts").cast("string").alias("timestamp"),
        F.when(broken, "n/a").otherwise(F.col("exog_text")).alias("exog_1"))
    again = base.filter((F.hour("ts") == 7) & (day == F.lit("2024-01-04").cast("date"))).select(
        "series_id", F.col("ts").cast("string").alias("timestamp"),
        F.col("exog_text").alias("exog_1"))
    return validate_upload(text.unionAll(again), ("exog_1",))


_SUMMARY = """
SELECT model, 'hourly' AS target, avg(abs(y_true - y_pred)) AS mae,
       sqrt(avg(power(y_true - y_pred, 2))) AS rmse
FROM members GROUP BY 1
UNION ALL
SELECT model, 'daily', avg(abs(y_true - y_pred)), sqrt(avg(power(y_true - y_pred, 2)))
FROM daily_members GROUP BY 1"""


def _summary(spark, d):
    frame = P.members(spark, d)
    h = scoring.error_metrics(frame, ["model"]).select(
        "model", F.lit("hourly").alias("target"), "mae", "rmse")
    day = scoring.error_metrics(scoring.daily_baseload(frame), ["model"]).select(
        "model", F.lit("daily").alias("target"), "mae", "rmse")
    return h.unionAll(day)


@query("s10_display_table", "model, target, mae, rmse", with_ctes("daily_members", f"""
SELECT model, target, printf('%.3f', mae) AS mae,
       CASE WHEN rmse < 0.001 THEN '<0.001' ELSE printf('%.3f', rmse) END AS rmse
FROM ({_SUMMARY})"""))
def _(spark, d):
    return export.display_table(_summary(spark, d))


@query("s10_display_pvalues", "event_id:i, p, v", """
SELECT event_id, CASE WHEN x IS NULL THEN '--' WHEN x >= 0 AND x < 0.001 THEN '<0.001'
         WHEN x > 0.999 AND x <= 1 THEN '>0.999' ELSE printf('%.3f', x) END AS p,
       CASE WHEN abs(y) < 0.0005 THEN '0.000' ELSE printf('%.3f', y) END AS v
FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE 1.0 / (1.0 + value * value) END AS x,
             (value - 48.01) / 1717.0 AS y FROM events)""")
def _(spark, d):
    x = F.when(F.col("event_id") % 97 != 0, 1.0 / (1.0 + F.col("value") * F.col("value")))
    return export.display_table(series.table(spark, d, "events").select(
        "event_id", x.alias("p"), ((F.col("value") - 48.01) / 1717.0).alias("v")), ["p"])


@query("s11_mark_best", "model, target, best_mae:b, best_rmse:b", with_ctes("daily_members", f"""
SELECT model, target,
  model <> 'naive' AND mae = min(CASE WHEN model <> 'naive' THEN mae END) OVER (PARTITION BY target) AS best_mae,
  model <> 'naive' AND rmse = min(CASE WHEN model <> 'naive' THEN rmse END) OVER (PARTITION BY target) AS best_rmse
FROM ({_SUMMARY})"""))
def _(spark, d):
    return export.mark_best(_summary(spark, d), ["mae", "rmse"], ["target"])


@query("s12_wide_to_long", "series_id, origin:d, hour:i, y_true:6, y_pred:6, model",
       with_ctes("members", "SELECT * FROM members"))
def _(spark, d):
    wide = P.members(spark, d).groupBy(
        "series_id", hour_stamp("origin", "hour").alias("ts"), "y_true").pivot("model", list(P.MODELS)).agg(
        F.first("y_pred"))
    return forecasts.wide_to_long(wide, "y_true")
