"""Registered queries A1-A7."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.operators import scoring as S

BY = ["series_id", "model"]


def _metric(name, column, expr, source="members"):
    return with_ctes(source, f"SELECT series_id, model, {expr} AS {column} FROM {source} GROUP BY 1, 2")


@query("a1_mae", "series_id, model, mae:6", _metric("a1", "mae", "avg(abs(y_true - y_pred))"))
def _(spark, d):
    return P.members(spark, d).groupBy(*BY).agg(S.mae().alias("mae"))


@query("a2_rmse", "series_id, model, rmse:6",
       _metric("a2", "rmse", "sqrt(avg(power(y_true - y_pred, 2)))"))
def _(spark, d):
    return P.members(spark, d).groupBy(*BY).agg(S.rmse().alias("rmse"))


_TERM = "200 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred))"


@query("a3_smape", "series_id, model, target, smape:6", with_ctes("daily_members", f"""
SELECT series_id, model, 'daily' AS target, avg({_TERM}) AS smape FROM daily_members GROUP BY 1, 2
UNION ALL
SELECT series_id, model, 'hourly', CASE WHEN count(*) FILTER (y_true = 0 AND y_pred = 0) = 0
       THEN avg(CASE WHEN abs(y_true) + abs(y_pred) > 0 THEN {_TERM} END) END FROM members GROUP BY 1, 2"""))
def _(spark, d):
    m = P.members(spark, d)
    daily = S.daily_baseload(m).groupBy(*BY, F.lit("daily").alias("target")).agg(
        S.smape().alias("smape"))
    return daily.unionByName(m.groupBy(*BY, F.lit("hourly").alias("target")).agg(
        S.smape().alias("smape")))


@query("a4_smape_zero_safe", "series_id, model, smape:6", _metric(
    "a4", "smape", f"avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE {_TERM} END)"))
def _(spark, d):
    return P.members(spark, d).groupBy(*BY).agg(S.smape_zero_safe().alias("smape"))


def _rmae(source, hour, keys="series_id, model"):
    on = "AND w.hour = a.hour" if hour else ""
    return with_ctes(source, f"""
SELECT {keys}, mae, naive_mae, mae / naive_mae AS rmae FROM (
  SELECT a.series_id, a.model, avg(abs(a.y_true - a.y_pred)) AS mae, avg(abs(a.y_true - w.y_true)) AS naive_mae
  FROM {source} a LEFT JOIN {source} w ON w.series_id = a.series_id AND w.model = a.model {on}
   AND w.origin = a.origin - 7 GROUP BY 1, 2)""")


@query("a5_rmae_hourly", "series_id, model, mae:6, naive_mae:6, rmae:6", _rmae("members", True))
def _(spark, d):
    return S.rmae_hourly(P.members(spark, d), BY)


@query("a5_rmae_long_history", "series_id, model, mae:6, naive_mae:6, rmae:6",
       _rmae("slot_members", True))
def _(spark, d):
    return S.rmae_hourly(P.slot_members(spark, d), BY)


@query("a6_rmae_daily", "series_id, model, mae:6, naive_mae:6, rmae:6",
       _rmae("daily_members", False))
def _(spark, d):
    return S.rmae_daily(S.daily_baseload(P.members(spark, d)), BY)


@query("a7_daily_baseload", "series_id, origin:d, y_true:6, y_pred:6, model",
       with_ctes("daily_members", "SELECT * FROM daily_members"))
def _(spark, d):
    return S.daily_baseload(P.members(spark, d))


@query("a7_baseload_violations", "series_id, model, origin:d, n_rows:i, n_hours:i",
       with_ctes("members", """
SELECT series_id, model, origin, count(*) AS n_rows, count(DISTINCT hour) AS n_hours FROM (
  SELECT series_id, model, origin, CASE WHEN hour = 23 AND extract(day FROM origin) % 7 = 0 THEN 22 ELSE hour END AS hour
  FROM members WHERE NOT (hour = 3 AND extract(day FROM origin) = 10)) GROUP BY 1, 2, 3
HAVING count(*) <> 24 OR count(DISTINCT hour) <> 24"""))
def _(spark, d):
    # One day repeats hour 22 in place of 23 (24 rows, 23 hours); another lacks an hour.
    m = P.members(spark, d).filter(~((F.col("hour") == 3) & (F.dayofmonth("origin") == 10)))
    swap = (F.col("hour") == 23) & (F.dayofmonth("origin") % 7 == 0)
    return S.baseload_violations(m.withColumn("hour", F.when(swap, 22).otherwise(F.col("hour"))))
