"""Registered queries V1-V10, on the daily calendar of ``lineitem``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.operators import splits as S
from daymark.sources import series

WINDOW = 1092
FIRST = dt.date(1999, 6, 1)
LAST = dt.date(2001, 6, 30)
BOUNDARY = dt.date(2000, 1, 1)

_POS = """
pos AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS pos,
               count(*) OVER (PARTITION BY series_id) AS n FROM turnover)"""


def _days(spark, d):
    return series.daily_turnover(spark, d).select("series_id", "day")


_WALK = """
SELECT o.series_id, o.day AS origin, a.day AS train_start, b.day AS train_end, 1092 AS n_train
FROM pos o JOIN pos a ON a.series_id = o.series_id AND a.pos = o.pos - 1092
JOIN pos b ON b.series_id = o.series_id AND b.pos = o.pos - 1"""


@query("v1_walk_forward", "series_id, origin:d, train_start:d, train_end:d, n_train:i",
       with_ctes("turnover", _WALK, _POS))
def _(spark, d):
    return S.walk_forward(_days(spark, d), WINDOW)


@query("v1_split_membership", "series_id, origin:d, role, n:i, first_day:d, last_day:d",
       with_ctes("turnover", """
SELECT o.series_id, o.day AS origin, CASE WHEN t.pos = o.pos THEN 'test' ELSE 'train' END AS role,
       count(*) AS n, min(t.day) AS first_day, max(t.day) AS last_day
FROM pos o JOIN pos t ON t.series_id = o.series_id AND t.pos BETWEEN o.pos - 1092 AND o.pos
WHERE o.pos >= 1092 AND (o.pos - 1092) % 28 = 0 GROUP BY 1, 2, 3""", _POS))
def _(spark, d):
    return S.split_membership(_days(spark, d), WINDOW, 28).groupBy(
        "series_id", "origin", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"))


@query("v2_origin_restriction", "series_id, origin:d, train_start:d, train_end:d, n_train:i",
       with_ctes("turnover", _WALK + """
JOIN (SELECT series_id, greatest(min(pos), 1092) AS start FROM pos WHERE day >= DATE '1999-06-01' GROUP BY 1) s
  ON s.series_id = o.series_id
WHERE o.pos >= s.start AND (o.pos - s.start) % 7 = 0 AND o.day <= DATE '2001-06-30'""", _POS))
def _(spark, d):
    return S.walk_forward(_days(spark, d), WINDOW, 7, FIRST, LAST)


@query("v3_assert_before", "series_id, validation_end:d, test_start:d, ordered:b",
       with_ctes("turnover", """
SELECT *, coalesce(validation_end < test_start, FALSE) AS ordered FROM (
  SELECT series_id, max(day) FILTER (day < DATE '2000-01-01') AS validation_end,
         min(day) FILTER (day >= DATE '2000-01-01') AS test_start
  FROM turnover GROUP BY 1)"""))
def _(spark, d):
    days = _days(spark, d)
    return S.order_report(days.filter(F.col("day") < F.lit(BOUNDARY)),
                          days.filter(F.col("day") >= F.lit(BOUNDARY)))


@query("v4_carve_validation", "series_id, day:d, role", with_ctes("turnover", """
SELECT series_id, day, CASE WHEN n - pos <= 364 THEN 'validation' ELSE 'fit' END AS role FROM pos""",
                                                                 _POS))
def _(spark, d):
    return S.carve_validation(_days(spark, d), 364)


@query("v5_interpretation_window", "series_id, day:d, n_days:i", with_ctes("turnover", """
SELECT series_id, day, count(*) OVER (PARTITION BY series_id) AS n_days FROM (
  SELECT series_id, day FROM turnover WHERE day < DATE '2000-01-01'
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY day DESC) <= 1092)"""))
def _(spark, d):
    return S.interpretation_window(_days(spark, d), BOUNDARY, WINDOW)


@query("v6_assert_disjoint",
       "series_id, shared_days:i, train_end:d, first_explained:d, disjoint:b",
       with_ctes("turnover", """
SELECT *, shared_days = 0 AND train_end < first_explained AS disjoint FROM (
  SELECT series_id, count(*) FILTER (day BETWEEN DATE '1999-12-20' AND DATE '1999-12-31') AS shared_days,
    max(day) FILTER (day < DATE '2000-01-01') AS train_end,
    min(day) FILTER (day >= DATE '1999-12-20') AS first_explained
  FROM turnover GROUP BY 1)"""))
def _(spark, d):
    days = _days(spark, d)
    return S.overlap_report(days.filter(F.col("day") < F.lit(BOUNDARY)),
                            days.filter(F.col("day") >= F.lit(dt.date(1999, 12, 20))))


@query("v7_refit_blocks", "series_id, origin:d, block:i, refit:b", with_ctes("turnover", f"""
SELECT series_id, origin, (train_end - first_end) // 7 AS block, (train_end - first_end) % 7 = 0 AS refit
FROM (SELECT *, min(train_end) OVER (PARTITION BY series_id) AS first_end FROM ({_WALK}))""", _POS))
def _(spark, d):
    return S.refit_blocks(S.walk_forward(_days(spark, d), WINDOW), 7)


@query("v8_tuning_window", "series_id, day:d, role", with_ctes("turnover", """
SELECT series_id, day, CASE WHEN n - pos <= 364 THEN 'validation' WHEN n - pos <= 364 + 1092 THEN 'fit'
                            ELSE 'unused' END AS role FROM pos""", _POS))
def _(spark, d):
    return S.tuning_window(_days(spark, d), 364, WINDOW)


@query("v9_assert_ood", "series_id, live_start:d, frozen_on:d, out_of_sample:b",
       with_ctes("by_type", """
SELECT *, live_start > frozen_on AS out_of_sample FROM (
  SELECT series_id, min(day) FILTER (day >= DATE '2024-01-20') AS live_start,
         max(day) FILTER (day < DATE '2024-01-20') AS frozen_on
  FROM by_type GROUP BY 1)"""))
def _(spark, d):
    hourly = series.hourly_by_type(spark, d)
    cut = F.lit(dt.date(2024, 1, 20))
    frozen = hourly.filter(F.to_date("ts") < cut).groupBy("series_id").agg(
        F.max(F.to_date("ts")).alias("frozen_on"))
    return S.ood_report(hourly.filter(F.to_date("ts") >= cut), frozen)


@query("v10_validate_range", "series_id, n:i, first_origin:d, last_origin:d",
       with_ctes("turnover", """
SELECT series_id, count(*) AS n, min(day) AS first_origin, max(day) AS last_origin FROM pos
WHERE pos >= 1092 AND day BETWEEN DATE '1999-06-01' AND DATE '2001-06-30' GROUP BY 1""", _POS))
def _(spark, d):
    S.validate_range(FIRST, LAST)
    return S.origins(_days(spark, d), WINDOW, 1, FIRST, LAST).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("origin").alias("first_origin"),
        F.max("origin").alias("last_origin"))
