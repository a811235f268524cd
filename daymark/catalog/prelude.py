"""Shared inputs of the registered queries: Spark builders and the SQL for the same frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions.exprs import hour_floor  # noqa: F401  (re-exported for the catalog)
from daymark.operators.naive import (
    lookup_forecasts, same_hour, same_hour_mean, similar_day)
from daymark.sources import series

EVENT_FIRST = dt.date(2024, 1, 1)
#: Members are split here: earlier origins fit weights, later ones are scored.
TEST_START = dt.date(2024, 1, 20)
#: Windows of the long history: training before, weights fitted inside, scores from the end on.
SLOT_FIRST = dt.date(1995, 2, 1)
SLOT_VALIDATION = dt.date(1999, 1, 1)
SLOT_TEST = dt.date(2000, 1, 1)
#: Previous-day maximum above which a day counts as stressed, on ``hourly_by_type``.
STRESS = 550.0

_SPINE = """
{name}_span AS (
  SELECT series_id, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi
  FROM {name}_agg GROUP BY series_id),
{name}_spine AS (
  SELECT series_id, unnest(generate_series(CAST(lo AS TIMESTAMP),
         CAST(hi AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts
  FROM {name}_span),
{name} AS (
  SELECT s.series_id, s.ts, coalesce(a.total, 0.0) AS price,
         CAST(coalesce(a.n, 0) AS DOUBLE) AS exog_1, CAST(coalesce(a.users, 0) AS DOUBLE) AS exog_2,
         CAST(s.ts AS DATE) AS day, CAST(extract(hour FROM s.ts) AS INTEGER) AS hour
  FROM {name}_spine s LEFT JOIN {name}_agg a USING (series_id, ts))"""

_EVENT_AGG = """
{name}_agg AS (
  SELECT {key} AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS total,
         count(*) AS n, count(DISTINCT user_id) AS users
  FROM events GROUP BY 1, 2),"""

PRELUDE: dict[str, tuple[tuple[str, ...], str]] = {
    "hourly_total": ((), _EVENT_AGG.format(name="hourly_total", key="'total'")
                     + _SPINE.format(name="hourly_total")),
    "by_type": ((), _EVENT_AGG.format(name="by_type", key="event_type")
                + _SPINE.format(name="by_type")),
    "slots": ((), """
slots_agg AS (
  SELECT 'slots' AS series_id,
         CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS ts,
         sum(l_extendedprice) / 1000 AS total, sum(l_quantity) AS n, count(*) AS users
  FROM lineitem GROUP BY 1, 2),""" + _SPINE.format(name="slots")),
    "hourly_mean": ((), """
hourly_mean AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price,
         CAST(count(*) AS DOUBLE) AS exog_1, CAST(count(DISTINCT user_id) AS DOUBLE) AS exog_2,
         CAST(date_trunc('hour', ts) AS DATE) AS day,
         CAST(extract(hour FROM date_trunc('hour', ts)) AS INTEGER) AS hour
  FROM events GROUP BY 1, 2, 6, 7)"""),
    "quarter_mean": ((), """
quarter_mean AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS price
  FROM events GROUP BY 1, 2)"""),
    "turnover": ((), """
turnover_agg AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS day,
         sum(l_extendedprice) / 1000 AS price, sum(l_quantity) AS exog_1,
         CAST(count(*) AS DOUBLE) AS exog_2
  FROM lineitem GROUP BY 1, 2),
turnover AS (
  SELECT s.series_id, s.day, coalesce(a.price, 0.0) AS price, coalesce(a.exog_1, 0.0) AS exog_1,
         coalesce(a.exog_2, 0.0) AS exog_2
  FROM (SELECT series_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP),
               CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
        FROM turnover_agg GROUP BY series_id) s
  LEFT JOIN turnover_agg a USING (series_id, day))"""),
    "members": (("by_type",), """
members AS (
  SELECT a.series_id, a.day AS origin, a.hour, a.price AS y_true, b.price AS y_pred, m.model
  FROM by_type a
  JOIN (VALUES ('lag1'), ('lag7'), ('naive')) AS m(model) ON TRUE
  JOIN by_type b ON b.series_id = a.series_id AND b.hour = a.hour
   AND b.day = a.day - CASE m.model WHEN 'lag1' THEN 1 WHEN 'lag7' THEN 7 ELSE
         CASE WHEN isodow(a.day) = 1 THEN 3 WHEN isodow(a.day) >= 6 THEN 7 ELSE 1 END END
  WHERE a.day >= DATE '2024-01-08'
  UNION ALL
  SELECT a.series_id, a.day, a.hour, a.price, avg(b.price), 'mean3'
  FROM by_type a JOIN by_type b ON b.series_id = a.series_id AND b.hour = a.hour
   AND b.day BETWEEN a.day - 3 AND a.day - 1
  WHERE a.day >= DATE '2024-01-08'
  GROUP BY a.series_id, a.day, a.hour, a.price HAVING count(*) = 3)"""),
    "slot_members": (("slots",), """
slot_members AS (
  SELECT a.series_id, a.day AS origin, a.hour, a.price AS y_true, b.price AS y_pred, m.model
  FROM slots a
  JOIN (VALUES ('lag1'), ('lag7'), ('naive')) AS m(model) ON TRUE
  JOIN slots b ON b.series_id = a.series_id AND b.hour = a.hour
   AND b.day = a.day - CASE m.model WHEN 'lag1' THEN 1 WHEN 'lag7' THEN 7 ELSE
         CASE WHEN isodow(a.day) = 1 THEN 3 WHEN isodow(a.day) >= 6 THEN 7 ELSE 1 END END
  WHERE a.day >= DATE '1995-02-01'
  UNION ALL
  SELECT a.series_id, a.day, a.hour, a.price, avg(b.price), 'mean3'
  FROM slots a JOIN slots b ON b.series_id = a.series_id AND b.hour = a.hour
   AND b.day BETWEEN a.day - 3 AND a.day - 1
  WHERE a.day >= DATE '1995-02-01'
  GROUP BY a.series_id, a.day, a.hour, a.price HAVING count(*) = 3)"""),
    "daily_members": (("members",), """
daily_members AS (
  SELECT series_id, model, origin, avg(y_true) AS y_true, avg(y_pred) AS y_pred
  FROM members GROUP BY 1, 2, 3
  HAVING count(*) = 24 AND count(DISTINCT hour) = 24)"""),
    "regimes": (("members",), """
regimes AS (
  SELECT d.series_id, d.origin, CASE WHEN p.top > 550.0 THEN 'stressed' ELSE 'calm' END AS regime
  FROM (SELECT DISTINCT series_id, origin FROM members) d
  LEFT JOIN (SELECT series_id, origin, max(y_true) AS top FROM members GROUP BY 1, 2) p
    ON p.series_id = d.series_id AND p.origin = d.origin - 1)"""),
    "losses": (("members",), """
losses AS (
  SELECT series_id, model, origin, avg(abs(y_true - y_pred)) AS loss
  FROM members GROUP BY 1, 2, 3)"""),
}


def with_ctes(names: str, body: str, extra: str = "") -> str:
    """``WITH <inputs> <extra CTEs> <body>``; inputs are resolved in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        deps, _ = PRELUDE[name]
        for d in deps:
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = ",".join(PRELUDE[n][1] for n in ordered)
    return f"WITH {ctes}{',' + extra if extra else ''}\n{body}"


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hourly_by_type(spark, sf_dir)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``by_type`` with the price alone."""
    return series.hourly_by_type(spark, sf_dir, ("price",))


def members_of(hourly: DataFrame, start: dt.date) -> DataFrame:
    """Four look-up forecasts of the same hours, from ``start`` on so that all cover every origin."""
    rules = {
        "lag1": same_hour(1), "lag7": same_hour(7), "naive": similar_day,
        "mean3": same_hour_mean((1, 2, 3)),
    }
    return lookup_forecasts(hourly, rules, (1, 2, 3, 7)).filter(F.col("origin") >= F.lit(start))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members_of(prices(spark, sf_dir), EVENT_FIRST + dt.timedelta(days=7))


def slot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same four models over the long hourly history of ``lineitem``."""
    return members_of(series.delivery_slots(spark, sf_dir), SLOT_FIRST)


MODELS = ("lag1", "lag7", "mean3", "naive")
