"""Registered queries M1-M13."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.operators import arma as R
from daymark.operators import boosting as B
from daymark.operators import features as X
from daymark.operators import models as M
from daymark.operators import naive as N
from daymark.operators import splits as V
from daymark.operators.trees import TreeParams
from daymark.session import materialize, shared_path
from daymark.sources import series

FORECAST = "series_id, origin:d, hour:i, y_true:6, y_pred:6, model"
DAILY = "series_id, origin:d, y_true:6, y_pred:6, model"
_LAG = "CASE WHEN isodow(a.day) = 1 THEN 3 WHEN isodow(a.day) >= 6 THEN 7 ELSE 1 END"
WINDOW, YEAR, WEEK = 1092, 364, 7
TREES = TreeParams(trees=200, depth=3, rate=0.1)
#: 24 hours x 200 weeks of fits: coarser cuts.
HOURLY_TREES = TreeParams(trees=200, depth=3, rate=0.1, bins=8)


@query("m1_naive_dow", FORECAST, with_ctes("by_type", f"""
SELECT a.series_id, a.day AS origin, a.hour, a.price AS y_true, b.price AS y_pred, 'naive' AS model
FROM by_type a JOIN by_type b ON b.series_id = a.series_id AND b.hour = a.hour AND b.day = a.day - {_LAG}"""))
def _(spark, d):
    return N.naive_dow(P.prices(spark, d))


@query("m1_naive_dow_long_history", FORECAST, with_ctes("slots", f"""
SELECT a.series_id, a.day AS origin, a.hour, a.price AS y_true, b.price AS y_pred, 'naive' AS model
FROM slots a JOIN slots b ON b.series_id = a.series_id AND b.hour = a.hour AND b.day = a.day - {_LAG}"""))
def _(spark, d):
    return N.naive_dow(series.delivery_slots(spark, d))


@query("m2_naive_dow_daily", DAILY, with_ctes("by_type", f"""
SELECT a.series_id, a.day AS origin, a.y AS y_true, b.y AS y_pred, 'naive' AS model
FROM (SELECT series_id, day, avg(price) AS y FROM by_type GROUP BY 1, 2) a
JOIN (SELECT series_id, day, avg(price) AS y FROM by_type GROUP BY 1, 2) b
  ON b.series_id = a.series_id AND b.day = a.day - {_LAG}"""))
def _(spark, d):
    return N.naive_dow_daily(P.prices(spark, d))


def _slot_features(spark, d):
    """Full feature matrix of the long history, stored once: models read it several times."""
    return materialize(X.build_features(series.delivery_slots(spark, d)), "features")


#: One series, spread over about eight tasks.
RUN_DAYS = 182


@query("m3_lasso_hourly", FORECAST)
def _(spark, d):
    return M.fit_lasso_aic(_slot_features(spark, d), 1092, 182, run_days=RUN_DAYS)


@query("m4_lasso_daily", DAILY)
def _(spark, d):
    return M.fit_lasso_aic_daily(_slot_features(spark, d), 1092, 7, run_days=RUN_DAYS)


@query("m5_seasonal_arx", FORECAST)
def _(spark, d):
    return M.fit_seasonal_arx(series.delivery_slots(spark, d), 1092, 7)


@query("m6_seasonal_arx_daily", DAILY)
def _(spark, d):
    return M.fit_seasonal_arx_daily(series.delivery_slots(spark, d), 1092, 7)


@query("m5_seasonal_arma", FORECAST)
def _(spark, d):
    return R.fit_seasonal_arma(series.delivery_slots(spark, d), WINDOW, WEEK)


@query("m6_seasonal_arma_daily", DAILY)
def _(spark, d):
    return R.fit_seasonal_arma(series.delivery_slots(spark, d), WINDOW, WEEK, daily=True)


#: Blocks start every seven days from the first; a window needs 16 known days before its own.
_ARMA_SQL = f"""
SELECT 'slots' AS series_id, CAST(day AS DATE) AS block_start, {WINDOW} AS n_days, 0.0 AS normal_gap
FROM (SELECT DISTINCT day, date_diff('day', (SELECT min(day) FROM slots), day) AS n FROM slots)
WHERE n % {WEEK} = 0 AND n >= {WINDOW + R.REACH}"""


@query("m5_arma_normal_equations", "series_id, block_start:d, n_days:i, normal_gap:6",
       with_ctes("slots", _ARMA_SQL))
def _(spark, d):
    return R.arma_certificate(series.delivery_slots(spark, d), WINDOW, WEEK)


@query("m6_arma_normal_equations", "series_id, block_start:d, n_days:i, normal_gap:6",
       with_ctes("slots", _ARMA_SQL))
def _(spark, d):
    return R.arma_certificate(series.delivery_slots(spark, d), WINDOW, WEEK, daily=True)


def _last_year(spark, d):
    """(features, the training window before the last year, the last year)."""
    feats = _slot_features(spark, d)
    roles = V.tuning_window(feats, YEAR, WINDOW)
    part = lambda role: feats.join(roles.filter(F.col("role") == role), ["series_id", "day"],
                                   "left_semi")
    return feats, part("fit"), part("validation")


#: The days of ``_last_year`` and the models' labels; hour 24 is the baseload.
_WINDOW_SQL = f"""
ranked AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS r FROM (
  SELECT DISTINCT day FROM slots WHERE day >= (SELECT min(day) + 7 FROM slots))),
fit AS MATERIALIZED (SELECT day FROM ranked WHERE r > {YEAR} AND r <= {YEAR + WINDOW}),
label AS MATERIALIZED (
  SELECT day, hour, price AS y FROM slots SEMI JOIN fit USING (day)
  UNION ALL SELECT day, 24, avg(price) FROM slots SEMI JOIN fit USING (day) GROUP BY day),
arms AS (SELECT DISTINCT 'slots' AS series_id, CASE WHEN hour < 24 THEN 'hourly' ELSE 'daily' END AS target,
                CASE WHEN hour < 24 THEN hour END AS hour, hour AS place FROM label)"""


@query("m7_gbt_hourly", FORECAST)
def _(spark, d):
    _, train, live = _last_year(spark, d)
    return B.arm_forecasts(B.score_gbt(materialize(B.fit_gbt(train, TREES, ("hourly",)), "trees"), live))


@query("m7_gbt_walk_forward", FORECAST)
def _(spark, d):
    return B.gbt_walk_forward(_slot_features(spark, d), WINDOW, WEEK, HOURLY_TREES,
                              run_days=RUN_DAYS)


@query("m7_gbt_certificate", """series_id, target, hour:i, n_days:i, n_trees:i, loss_rises:i,
       wrong_leaves:i, lost_rows:i, base_gap:6""", with_ctes("slots", f"""
SELECT series_id, target, hour, (SELECT count(*) FROM fit) AS n_days, {TREES.trees} AS n_trees,
       0 AS loss_rises, 0 AS wrong_leaves, 0 AS lost_rows, 0.0 AS base_gap FROM arms""", _WINDOW_SQL))
def _(spark, d):
    _, train, _ = _last_year(spark, d)
    return B.fit_certificate(materialize(B.fit_gbt(train, TREES), "trees"), train)


@query("m7_first_splits", "series_id, target, hour:i, gain:2", with_ctes("slots", """
SELECT series_id, target, arms.hour, max(s_left * s_left / n_left
       + (s - s_left) * (s - s_left) / (n - n_left)) - any_value(s * s / n) AS gain
FROM (SELECT hour AS place, feature, edge, count(*) AS n_left, sum(g) AS s_left
      FROM (SELECT e.feature, e.edge, x.day FROM edges e JOIN x ON x.feature = e.feature AND x.v <= e.edge)
      JOIN signs USING (day) GROUP BY 1, 2, 3)
JOIN (SELECT hour AS place, count(*) AS n, sum(g) AS s FROM signs GROUP BY 1) USING (place)
JOIN arms USING (place)
WHERE n_left >= 20 AND n - n_left >= 20 GROUP BY 1, 2, 3""", _WINDOW_SQL + """,
signs AS MATERIALIZED (
  SELECT day, hour, sign(y - m) AS g FROM label JOIN (
    SELECT hour, quantile_cont(y, 0.5) AS m FROM label GROUP BY 1) USING (hour)),
x AS MATERIALIZED (
  SELECT fit.day, 'p' || k || '_' || s.hour AS feature, s.price AS v
  FROM fit CROSS JOIN (VALUES (1), (2), (3), (7)) AS l(k) JOIN slots s ON s.day = fit.day - k
  UNION ALL SELECT fit.day, 'a' || k || '_' || s.hour, s.exog_1
  FROM fit CROSS JOIN (VALUES (0), (1), (7)) AS l(k) JOIN slots s ON s.day = fit.day - k
  UNION ALL SELECT fit.day, 'b' || k || '_' || s.hour, s.exog_2
  FROM fit CROSS JOIN (VALUES (0), (1), (7)) AS l(k) JOIN slots s ON s.day = fit.day - k
  UNION ALL SELECT day, 'd' || w, CAST(isodow(day) = w AS DOUBLE) FROM fit, range(1, 8) AS g(w)),
edges AS MATERIALIZED (
  SELECT DISTINCT feature, v AS edge FROM (
    SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r FROM x)
  JOIN (SELECT feature, count(*) AS n, count(DISTINCT v) AS kinds, max(v) AS top FROM x GROUP BY 1)
    USING (feature)
  WHERE v < top AND (kinds <= 16 OR list_contains(
    list_transform(range(1, 16), lambda i: CAST(floor(i * (n - 1) / 16) AS BIGINT)), r)))"""))
def _(spark, d):
    _, train, _ = _last_year(spark, d)
    one = TreeParams(trees=1, depth=1)
    return B.first_splits(materialize(B.fit_gbt(train, one), "trees"), train)


@query("m8_gbt_daily", DAILY)
def _(spark, d):
    _, train, live = _last_year(spark, d)
    models = materialize(B.fit_gbt(train, TREES, ("daily",)), "trees")
    return B.arm_forecasts(B.score_gbt(models, live), daily=True)


@query("m8_gbt_daily_walk_forward", DAILY)
def _(spark, d):
    return B.gbt_walk_forward(_slot_features(spark, d), WINDOW, WEEK, TREES, daily=True,
                              run_days=RUN_DAYS)


@query("m9_walk_forward", FORECAST, with_ctes("slots", """
SELECT t.series_id, t.day AS origin, t.hour, t.price AS y_true, w.m AS y_pred, 'window-mean' AS model
FROM (SELECT *, (p - 1092) // 28 AS block FROM pos WHERE p >= 1092) t
JOIN (SELECT b.series_id, b.block, q.hour, avg(q.price) AS m
      FROM (SELECT DISTINCT series_id, (p - 1092) // 28 AS block FROM pos WHERE p >= 1092) b
      JOIN pos q ON q.series_id = b.series_id AND q.p >= 28 * b.block AND q.p < 28 * b.block + 1092
      GROUP BY 1, 2, 3) w ON w.series_id = t.series_id AND w.block = t.block AND w.hour = t.hour""", """
firsts AS (SELECT series_id, min(day) AS lo FROM slots GROUP BY 1),
pos AS (SELECT s.series_id, s.day, s.hour, s.price, s.day - f.lo - 7 AS p
        FROM slots s JOIN firsts f USING (series_id) WHERE s.day >= f.lo + 7)"""))
def _(spark, d):
    feats = materialize(X.build_features(series.delivery_slots(spark, d)), "features")
    return M.run_walk_forward(feats, M.window_mean, "window-mean", 1092, 28)


@query("m10_freeze", """series_id, frozen_on:d, train_start:d, n_train_days:i, window_days:i,
       price_mean:6, price_std:5""", with_ctes("slots", f"""
SELECT 'slots' AS series_id, max(day) AS frozen_on, min(day) AS train_start, count(*) AS n_train_days,
       {WINDOW} AS window_days, any_value(p.m) AS price_mean, any_value(p.s) AS price_std
FROM fit CROSS JOIN (SELECT avg(price) AS m, stddev_samp(price) AS s FROM slots
                     WHERE day <= (SELECT max(day) FROM fit)) p""", _WINDOW_SQL))
def _(spark, d):
    _, train, _ = _last_year(spark, d)
    path = shared_path(spark, "frozen")
    B.freeze(train, series.delivery_slots(spark, d), WINDOW, path, TREES)
    return spark.read.parquet(f"{path}/metadata")


@query("m11_score_frozen", FORECAST)
def _(spark, d):
    _, train, live = _last_year(spark, d)
    path = shared_path(spark, "frozen")
    B.freeze(train, series.delivery_slots(spark, d), WINDOW, path, TREES)
    return B.score_frozen(path, live)


@query("m12_forecast_day", FORECAST, with_ctes("by_type", """
SELECT a.series_id, a.day AS origin, a.hour, CAST(NULL AS DOUBLE) AS y_true, b.price AS y_pred, 'naive' AS model
FROM by_type a JOIN by_type b ON b.series_id = a.series_id AND b.hour = a.hour AND b.day = DATE '2024-01-29'
WHERE a.day = DATE '2024-01-30'"""))
def _(spark, d):
    # The last day's prices are not published yet.
    day = dt.date(2024, 1, 30)
    live = P.by_type(spark, d).withColumn(
        "price", F.when(F.to_date("ts") < F.lit(day), F.col("price")))
    return N.forecast_day(live, day)


@query("m13_search", "series_id, trial:i, alpha:6, l1:6, mae:6, n_trials:i")
def _(spark, d):
    feats = _slot_features(spark, d)
    roles = V.tuning_window(feats, 364, 1092)
    return M.best_trial(M.search(roles, feats, M.random_trials(50)))


@query("m12_forecast_day_fitted", FORECAST)
def _(spark, d):
    # Frozen a year before; the last day's prices are not published yet.
    hourly = series.delivery_slots(spark, d)
    _, train, live = _last_year(spark, d)
    day = live.agg(F.max("day")).first()[0]
    unknown = hourly.withColumn("price", F.when(F.to_date("ts") < F.lit(day), F.col("price")))
    models = materialize(B.fit_gbt(train, TREES, ("hourly",)), "trees")
    return B.forecast_day_fitted(models, unknown, day)


@query("m13_tree_search", "series_id, trial:i, trees:i, depth:i, rate:6, bins:i, min_leaf:i, mae:6, n_trials:i")
def _(spark, d):
    feats = _slot_features(spark, d)
    roles = V.tuning_window(feats, YEAR, WINDOW)
    return B.best_trees(B.search_trees(roles, feats, B.tree_trials(50)))
