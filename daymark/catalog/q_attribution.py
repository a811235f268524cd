"""Registered queries I1-I11.

The explained model is a linear one whose coefficients SQL can fit too: each of a cell's
features gets an equal share of its single-regressor slope.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.q_models import _WINDOW_SQL, TREES, YEAR, _last_year, _slot_features
from daymark.catalog.registry import query
from daymark.functions.exprs import HOURS
from daymark.operators import attribution as A
from daymark.operators import boosting as B
from daymark.operators import features as X
from daymark.operators import models as M
from daymark.operators import splits as V
from daymark.session import materialize

KINDS = {"price_D-1": ("price", 1), "price_D-7": ("price", 7), "exog_1_D0": ("exog_1", 0),
         "exog_2_D-1": ("exog_2", 1)}
N = len(KINDS)
_FROM = dt.date(2024, 1, 8)

_ATTR = f"""
x AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT a.series_id, a.day, a.hour, '{k}_h' || printf('%02d', a.hour) AS feature, b.{c} AS value "
    f"FROM by_type a JOIN by_type b ON b.series_id = a.series_id AND b.hour = a.hour AND b.day = a.day - {lag} "
    f"WHERE a.day >= DATE '2024-01-08'" for k, (c, lag) in KINDS.items())}),
y AS (SELECT series_id, day, hour, price FROM by_type WHERE day >= DATE '2024-01-08'),
yd AS (SELECT series_id, day, avg(price) AS price FROM y GROUP BY 1, 2),
coefs AS (
  SELECT x.series_id, 'hourly' AS target, x.hour, feature, coalesce(regr_slope(price, value), 0) / {N} AS coef,
         avg(value) AS mean, avg(price) AS expected
  FROM x JOIN y USING (series_id, day, hour) GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT x.series_id, 'daily', NULL, feature, coalesce(regr_slope(price, value), 0) / {24 * N},
         avg(value), avg(price)
  FROM x JOIN yd USING (series_id, day) GROUP BY 1, 2, 3, 4),
attr AS MATERIALIZED (
  SELECT c.series_id, c.target, c.hour, x.day, x.feature, coef * (x.value - mean) AS value,
         x.value AS feature_value, expected
  FROM x JOIN coefs c ON c.series_id = x.series_id AND c.feature = x.feature),
imp AS (SELECT series_id, target, hour, feature, regexp_replace(feature, '_h[0-9]+$', '') AS family,
               avg(abs(value)) AS importance FROM attr GROUP BY 1, 2, 3, 4, 5),
labels AS (SELECT d.series_id, d.day, CASE WHEN p.peak > 550.0 THEN 'stressed' ELSE 'calm' END AS regime
  FROM (SELECT DISTINCT series_id, day FROM by_type) d LEFT JOIN
       (SELECT series_id, day, max(price) AS peak FROM by_type GROUP BY 1, 2) p
    ON p.series_id = d.series_id AND p.day = d.day - 1),
pred AS (SELECT series_id, target, hour, day, sum(value) + any_value(expected) AS prediction FROM attr GROUP BY 1, 2, 3, 4),
dayset AS (SELECT p.series_id, p.day, p.prediction AS y_pred, yd.price AS y_true, regime
  FROM pred p JOIN yd USING (series_id, day) JOIN labels USING (series_id, day) WHERE p.target = 'daily')"""


def _sql(body):
    return with_ctes("by_type", body, _ATTR)


def _data(spark, d):
    """(long features, targets, coefficients): one pass over the day vectors."""
    vectors = X.day_vectors(P.by_type(spark, d))
    lagged = X.calendar_lags(vectors, {k: (c, lag) for k, (c, lag) in KINDS.items() if lag})
    lagged = lagged.withColumn("exog_1_D0", F.col("exog_1")).filter(
        F.col("day") >= F.lit(_FROM)).withColumn("y_daily", X.vector_mean("price"))
    hours = lagged.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    at = lambda name: F.get(F.col(f"`{name}`"), F.col("hour"))
    cells = F.array(*[F.struct(F.concat(F.lit(f"{k}_h"), F.format_string("%02d", "hour")).alias(
        "feature"), at(k).alias("value")) for k in KINDS])
    rows = hours.select("series_id", "day", "hour", at("price").alias("y"), "y_daily",
                        F.inline(cells))
    rows = materialize(rows, "cells")
    slope = lambda y: F.coalesce(F.regr_slope(F.col(y), F.col("value")), F.lit(0.0))
    hourly = rows.groupBy("series_id", "hour", "feature").agg(
        (slope("y") / N).alias("coef"), F.avg("value").alias("mean"), F.avg("y").alias("expected"))
    daily = rows.groupBy("series_id", "feature").agg(
        (slope("y_daily") / (24 * N)).alias("coef"), F.avg("value").alias("mean"),
        F.avg("y_daily").alias("expected"))
    cols = ["series_id", "target", "hour", "feature", "coef", "mean", "expected"]
    coefs = hourly.withColumn("target", F.lit("hourly")).select(*cols).unionAll(
        daily.withColumn("target", F.lit("daily")).withColumn(
            "hour", F.lit(None).cast("int")).select(*cols))
    return rows, coefs


def _attr(spark, d):
    rows, coefs = _data(spark, d)
    return A.attribute_linear(rows.select("series_id", "day", "feature", "value"), coefs)


def _labels(spark, d):
    from daymark.operators.ensemble import regime_labels
    hourly = P.by_type(spark, d).select(
        "series_id", F.to_date("ts").alias("origin"), F.col("price").alias("y_true"))
    return regime_labels(hourly, P.STRESS).withColumnRenamed("origin", "day")


def _predictions(rows, coefs):
    """Model output computed the direct way: intercept plus sum of coef * x."""
    long = rows.select("series_id", "day", "feature", "value")
    return long.join(coefs, ["series_id", "feature"]).groupBy(*A.MODEL, "day").agg(
        (F.sum(F.col("coef") * F.col("value")) - F.sum(F.col("coef") * F.col("mean"))
         + F.first("expected")).alias("prediction"))


def _dayset(spark, d):
    rows, coefs = _data(spark, d)
    pred = _predictions(rows, coefs.filter("target = 'daily'"))
    truth = rows.groupBy("series_id", "day").agg(F.first("y_daily").alias("y_true"))
    return pred.select("series_id", "day", F.col("prediction").alias("y_pred")).join(
        truth, ["series_id", "day"]).join(_labels(spark, d), ["series_id", "day"])


@query("i1_attribute_linear",
       "series_id, target, hour:i, day:d, feature, value:6, feature_value:6, expected:6",
       _sql("SELECT * FROM attr"))
def _(spark, d):
    return _attr(spark, d)


@query("i2_attribute_trees",
       "series_id, target, hour:i, day:d, feature, value:6, feature_value:6, expected:6")
def _(spark, d):
    _, train, live = _last_year(spark, d)
    models = materialize(B.fit_gbt(train, TREES), "trees")
    return B.attribute_trees(models, live, X.feature_names())


@query("i2_additivity", "series_id, target, hour:i, n_features:i, n_days:i, max_gap:6", with_ctes("slots", f"""
SELECT series_id, target, hour, {len(X.feature_names())} AS n_features,
       (SELECT count(*) FROM ranked WHERE r <= {YEAR}) AS n_days, 0.0 AS max_gap FROM arms""", _WINDOW_SQL))
def _(spark, d):
    _, train, live = _last_year(spark, d)
    models = materialize(B.fit_gbt(train, TREES), "trees")
    attr = materialize(B.attribute_trees(models, live, X.feature_names()), "attributions")
    pred = B.score_gbt(models, live).select(
        *A.MODEL, F.col("origin").alias("day"), F.col("y_pred").alias("prediction"))
    gaps, wide = A.additivity(attr, pred), attr.groupBy(*A.MODEL).agg(
        F.count_distinct("feature").alias("n_features"))
    same = ((gaps["series_id"] == wide["series_id"]) & (gaps["target"] == wide["target"])
            & gaps["hour"].eqNullSafe(wide["hour"]))
    return gaps.join(wide, same).select(*[gaps[c] for c in gaps.columns], "n_features")


@query("i3_mean_abs", "series_id, target, hour:i, feature, importance:6",
       _sql("SELECT * FROM imp"))
def _(spark, d):
    return A.mean_abs(_attr(spark, d))


@query("i4_group_importance", "series_id, target, hour:i, family, importance:6, position:i", _sql(f"""
SELECT series_id, target, hour, family, sum(importance) AS importance,
       any_value(list_position([{", ".join(f"'{g}'" for g in X.GROUP_ORDER)}], family)) AS position
FROM imp GROUP BY 1, 2, 3, 4"""))
def _(spark, d):
    return A.group_importance(_attr(spark, d))


@query("i4_lasso_group_importance", "series_id, target, hour:i, family, importance:6, position:i")
def _(spark, d):
    # Models of the window that ends a year before the last day explain that year.
    names = X.feature_names()
    feats = _slot_features(spark, d)
    year = V.tuning_window(feats, 364, 1092)
    past = feats.join(year.filter("role <> 'validation'"), ["series_id", "day"], "left_semi")
    live = feats.join(year.filter("role = 'validation'"), ["series_id", "day"], "left_semi")
    coefs = materialize(M.lasso_coefficients(past, names, 1092, targets_per_task=4), "coefs")
    attr = A.attribute_linear(M.lasso_inputs(live, names, coefs), coefs)
    return A.group_importance(attr)


@query("i5_family_by_hour", "series_id, family, " + ", ".join(f"{h}:6" for h in HOURS), _sql(
    "SELECT series_id, family, " + ", ".join(
        f'sum(CASE WHEN hour = {h} THEN importance END) AS "{h}"' for h in HOURS)
    + " FROM imp WHERE target = 'hourly' GROUP BY 1, 2"))
def _(spark, d):
    return A.family_by_hour(_attr(spark, d))


@query("i6_importance_splits", "series_id, family, " + ", ".join(
    f"{t}_{c}:6" for t in ("hourly", "daily") for c in ("all", "calm", "stressed")), _sql("""
SELECT series_id, family, """ + ", ".join(
    f"avg(CASE WHEN target = '{t}' THEN v_{c} END) AS {t}_{c}"
    for t in ("hourly", "daily") for c in ("all", "calm", "stressed")) + """
FROM (SELECT series_id, target, hour, family, sum(v_all) AS v_all, sum(v_calm) AS v_calm, sum(v_stressed) AS v_stressed
  FROM (SELECT series_id, target, hour, feature, regexp_replace(feature, '_h[0-9]+$', '') AS family,
          avg(abs(value)) AS v_all, avg(abs(value)) FILTER (regime = 'calm') AS v_calm,
          avg(abs(value)) FILTER (regime = 'stressed') AS v_stressed
        FROM attr JOIN labels USING (series_id, day) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""))
def _(spark, d):
    return A.importance_splits(_attr(spark, d), _labels(spark, d))


@query("i7_top_features", "series_id, hour:i, day:d, feature, rank:i, value:6, feature_value:6", _sql("""
SELECT a.series_id, a.hour, a.day, a.feature, r.rank, a.value, a.feature_value FROM attr a
JOIN (SELECT series_id, feature, row_number() OVER (PARTITION BY series_id ORDER BY round(importance, 9) DESC, feature) AS rank
      FROM imp WHERE target = 'hourly' AND hour = 19) r USING (series_id, feature)
WHERE a.target = 'hourly' AND a.hour = 19 AND r.rank <= 3"""))
def _(spark, d):
    return A.top_features(_attr(spark, d), 19, 3)


@query("i8_case_study", "series_id, day:d, feature, value:6, feature_value:6", _sql("""
SELECT series_id, day, feature, value, feature_value FROM attr SEMI JOIN (
  SELECT series_id, day FROM dayset QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY y_pred DESC, day) = 1)
USING (series_id, day) WHERE target = 'daily'"""))
def _(spark, d):
    from daymark.operators.tables import case_day
    days = _dayset(spark, d).withColumnRenamed("day", "origin").withColumn("model", F.lit("linear"))
    case = case_day(days).withColumnRenamed("origin", "day")
    return A.case_study(_attr(spark, d), case)


@query("i9_check_additivity", "series_id, target, hour:i, n_days:i, max_gap:6", _sql("""
SELECT series_id, target, hour, count(*) AS n_days, 0.0 AS max_gap FROM pred GROUP BY 1, 2, 3"""))
def _(spark, d):
    rows, coefs = _data(spark, d)
    attr = A.attribute_linear(rows.select("series_id", "day", "feature", "value"), coefs)
    return A.additivity(attr, _predictions(rows, coefs))


@query("i10_check_conservation", "series_id, target, hour:i, ungrouped:6, grouped:6", _sql("""
SELECT series_id, target, hour, sum(importance) AS ungrouped, sum(importance) AS grouped
FROM imp GROUP BY 1, 2, 3"""))
def _(spark, d):
    return A.conservation(_attr(spark, d))


@query("i11_run_facts", """series_id, n_test_days:i, test_start:d, test_end:d, n_calm:i, n_stressed:i,
       threshold:2, train_start:d, train_end:d, n_train_days:i, case_day:d, case_baseload:6,
       case_prediction:6, case_regime, top_decile_bias:6, n_top_decile:i""", _sql("""
SELECT d.*, 550.0 AS threshold, t.train_start, t.train_end, t.n_train_days, c.day AS case_day,
       c.y_true AS case_baseload, c.y_pred AS case_prediction, c.regime AS case_regime,
       b.bias AS top_decile_bias, b.n AS n_top_decile
FROM (SELECT series_id, count(*) AS n_test_days, min(day) AS test_start, max(day) AS test_end,
        count(*) FILTER (regime = 'calm') AS n_calm, count(*) FILTER (regime = 'stressed') AS n_stressed
      FROM dayset GROUP BY 1) d
JOIN (SELECT series_id, min(day) AS train_start, max(day) AS train_end, count(DISTINCT day) AS n_train_days
      FROM by_type WHERE day < DATE '2024-01-08' GROUP BY 1) t USING (series_id)
JOIN (SELECT * FROM dayset QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY y_pred DESC, day) = 1) c USING (series_id)
JOIN (SELECT series_id, avg(y_pred - y_true) AS bias, count(*) AS n FROM dayset
      JOIN (SELECT series_id, quantile_cont(y_true, 0.9) AS cut FROM dayset GROUP BY 1) USING (series_id)
      WHERE y_true >= cut GROUP BY 1) b USING (series_id)"""))
def _(spark, d):
    train = P.prices(spark, d).select("series_id", F.to_date("ts").alias("day")).filter(
        F.col("day") < F.lit(_FROM)).distinct()
    return A.run_facts(_dayset(spark, d), train, P.STRESS)
