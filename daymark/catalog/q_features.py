"""Registered queries F1-F15."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.q_quality import _GAPPY, _gappy
from daymark.catalog.registry import query
from daymark.functions.exprs import HOUR_TAGS, HOURS
from daymark.operators import features as X
from daymark.sources import series

TRAIN_END = dt.date(2024, 1, 20)
BASE = ("price", "exog_1", "exog_2")


@query("f1_daily_wide",
       "series_id, day:d, " + ", ".join(f"{c}_{t}:6" for c in BASE for t in HOUR_TAGS),
       with_ctes("hourly_mean", "SELECT series_id, day, " + ", ".join(
           f"max(CASE WHEN hour = {h} THEN {c} END) AS {c}_{t}"
           for c in BASE for h, t in zip(HOURS, HOUR_TAGS)) + " FROM hourly_mean GROUP BY 1, 2"))
def _(spark, d):
    return X.daily_wide(series.hourly_mean(spark, d))


def _lag_sql(columns, lags):
    shown, joins = [], []
    for k in lags:
        joins.append(f"LEFT JOIN hourly_mean l{k} ON l{k}.series_id = a.series_id "
                     f"AND l{k}.hour = a.hour AND l{k}.day = a.day - {k}")
        shown += [f"l{k}.{c} AS {c}_lag{k}" for c in columns]
    return with_ctes("hourly_mean", f"""
SELECT a.series_id, a.day, a.hour, {', '.join(shown)}
FROM (SELECT s.series_id, s.day, h.hour FROM (SELECT DISTINCT series_id, day FROM hourly_mean) s
      JOIN (SELECT unnest(range(24)) AS hour) h ON TRUE) a {' '.join(joins)}""")


def _hour_rows(df, names):
    picked = [F.get(F.col(f"`{name}`"), F.col("hour")).alias(alias) for name, alias in names]
    return df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        "series_id", "day", "hour", *picked)


@query("f2_price_lags",
       "series_id, day:d, hour:i, price_lag1:6, price_lag2:6, price_lag3:6, price_lag7:6",
       _lag_sql(["price"], X.PRICE_LAGS))
def _(spark, d):
    v = X.price_lags(X.day_vectors(series.hourly_mean(spark, d)))
    return _hour_rows(v, [(X.lag_name("price", k), f"price_lag{k}") for k in X.PRICE_LAGS])


@query("f3_exog_lags",
       "series_id, day:d, hour:i, exog_1_lag1:6, exog_2_lag1:6, exog_1_lag7:6, exog_2_lag7:6",
       _lag_sql(["exog_1", "exog_2"], X.EXOG_LAGS))
def _(spark, d):
    v = X.exog_lags(X.day_vectors(series.hourly_mean(spark, d)))
    return _hour_rows(v, [(X.lag_name(c, k), f"{c}_lag{k}") for k in X.EXOG_LAGS for c in X.EXOG])


@query("f4_exog_current", "series_id, day:d, hour:i, exog_1_now:6, exog_2_now:6",
       _lag_sql(["exog_1", "exog_2"], (0,)).replace("_lag0", "_now"))
def _(spark, d):
    v = X.exog_current(X.day_vectors(series.hourly_mean(spark, d)))
    return _hour_rows(v, [(X.lag_name(c, 0), f"{c}_now") for c in X.EXOG])


@query("f5_weekday_onehot", "series_id, day:d, " + ", ".join(f"{w}:1" for w in X.WEEKDAYS),
       with_ctes("turnover", "SELECT series_id, day, " + ", ".join(
           f"CASE WHEN isodow(day) = {i + 1} THEN 1.0 ELSE 0.0 END AS {w}"
           for i, w in enumerate(X.WEEKDAYS)) + " FROM turnover"))
def _(spark, d):
    return X.weekday_flags(series.daily_turnover(spark, d))


@query("f6_targets", "series_id, day:d, " + ", ".join(f"{t}:6" for t in X.TARGETS),
       with_ctes("by_type", "SELECT series_id, day, " + ", ".join(
           f"max(CASE WHEN hour = {h} THEN price END) AS {t}" for h, t in zip(HOURS, X.TARGETS))
                 + " FROM by_type WHERE day >= DATE '2024-01-08' GROUP BY 1, 2"))
def _(spark, d):
    return X.targets(X.build_features(P.by_type(spark, d)))


# Long features by plain joins on the hour grid; a day survives with all 240 slots and 24 labels.
_FEATURES = """
grid AS (SELECT g.series_id, g.day, g.hour, p.price, g.exog_1, g.exog_2 FROM gappy g
         JOIN by_type p USING (series_id, ts)),
cells AS (
  SELECT t.series_id, t.day, 'price_D-' || k || '_h' || printf('%02d', g.hour) AS feature, g.price AS value
  FROM (SELECT DISTINCT series_id, day FROM grid) t JOIN (VALUES (1), (2), (3), (7)) v(k) ON TRUE
  JOIN grid g ON g.series_id = t.series_id AND g.day = t.day - k
  UNION ALL
  SELECT t.series_id, t.day, e.name || CASE WHEN k = 0 THEN '_D0' ELSE '_D-' || k END || '_h' || printf('%02d', g.hour),
         CASE e.name WHEN 'exog_1' THEN g.exog_1 ELSE g.exog_2 END
  FROM (SELECT DISTINCT series_id, day FROM grid) t JOIN (VALUES (0), (1), (7)) v(k) ON TRUE
  JOIN (VALUES ('exog_1'), ('exog_2')) e(name) ON TRUE
  JOIN grid g ON g.series_id = t.series_id AND g.day = t.day - k),
kept AS (
  SELECT c.series_id, c.day FROM cells c GROUP BY 1, 2 HAVING count(value) = 240
  INTERSECT
  SELECT series_id, day FROM grid GROUP BY 1, 2 HAVING count(price) = 24),
feats AS (
  SELECT c.* FROM cells c JOIN kept USING (series_id, day)
  UNION ALL
  SELECT k.series_id, k.day, 'dow_' || i, CASE WHEN isodow(k.day) - 1 = i THEN 1.0 ELSE 0.0 END
  FROM kept k JOIN (SELECT unnest(range(7)) AS i) ON TRUE)"""
_FEATURE_CTES = _GAPPY + "," + _FEATURES


def _features(spark, d):
    return X.build_features(_gappy(spark, d))


def _long(spark, d):
    return X.long_features(_features(spark, d), X.feature_names())


@query("f7_complete_cases", "series_id, day:d",
       with_ctes("by_type", "SELECT * FROM kept", _FEATURE_CTES))
def _(spark, d):
    return _features(spark, d)


@query("f8_daily_target", "series_id, day:d, y_daily:6", with_ctes("by_type", """
SELECT series_id, day, avg(price) AS y_daily FROM grid SEMI JOIN kept USING (series_id, day)
GROUP BY 1, 2""", _FEATURE_CTES))
def _(spark, d):
    return X.daily_target(_features(spark, d), strict=False)


@query("f9_build_features", "series_id, day:d, feature, value:6",
       with_ctes("by_type", "SELECT * FROM feats", _FEATURE_CTES))
def _(spark, d):
    return _long(spark, d)


@query("f10_feature_group", "feature, family, n:i", with_ctes("by_type", """
SELECT feature, CASE WHEN feature LIKE 'dow%' THEN 'dow' ELSE regexp_replace(feature, '_h[0-9]+$', '') END AS family,
       count(*) AS n FROM feats GROUP BY 1, 2""", _FEATURE_CTES))
def _(spark, d):
    return _long(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "family", X.feature_group("feature"))


@query("f11_daily_exog_mean", "series_id, day:d, exog_1_mean:6, exog_2_mean:6",
       with_ctes("hourly_mean", """
SELECT series_id, day, CASE WHEN count(exog_1) = 24 THEN avg(exog_1) END AS exog_1_mean,
       CASE WHEN count(exog_2) = 24 THEN avg(exog_2) END AS exog_2_mean
FROM hourly_mean GROUP BY 1, 2"""))
def _(spark, d):
    return X.daily_exog_mean(X.day_vectors(series.hourly_mean(spark, d)))


@query("f12_sequence_pack", "series_id, day:d, step:i, hour:i, value:6, n_static:i, static_sum:6",
       with_ctes("by_type", """
SELECT k.series_id, k.day, s.step, g.hour, g.price AS value, z.n_static, z.static_sum FROM kept k
JOIN (VALUES (0, 7), (1, 3), (2, 2), (3, 1)) s(step, lag) ON TRUE
JOIN grid g ON g.series_id = k.series_id AND g.day = k.day - s.lag
JOIN (SELECT series_id, day, count(*) AS n_static, sum(value) AS static_sum FROM feats
      WHERE feature NOT LIKE 'price%' GROUP BY 1, 2) z ON z.series_id = k.series_id AND z.day = k.day""",
                 _FEATURE_CTES))
def _(spark, d):
    packed = X.sequence_pack(_features(spark, d), X.feature_names())
    steps = packed.select("series_id", "day", F.size("static").alias("n_static"), F.aggregate(
        "static", F.lit(0.0), lambda a, x: a + x).alias("static_sum"),
        F.posexplode("steps").alias("step", "v"))
    return steps.select("series_id", "day", "step", "n_static", "static_sum",
                        F.posexplode("v").alias("hour", "value"))


@query("f13_standardize", "series_id, day:d, feature, scaled:5, value:5", with_ctes("by_type", """
SELECT f.series_id, f.day, f.feature, f.value,
       (f.value - s.m) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END AS scaled
FROM feats f JOIN (SELECT series_id, feature, avg(value) AS m, stddev_pop(value) AS sd FROM feats
                   WHERE day < DATE '2024-01-20' GROUP BY 1, 2) s USING (series_id, feature)""",
                                                                         _FEATURE_CTES))
def _(spark, d):
    scaled = X.standardize(_long(spark, d), F.col("day") < F.lit(TRAIN_END))
    return X.unstandardize(scaled.drop("value"))


@query("f14_asinh_median", "series_id, day:d, feature, scaled:5, value:6", with_ctes("turnover", """
SELECT l.series_id, l.day, l.feature, l.value,
       asinh((l.value - m.med) / CASE WHEN m.mad > 0 THEN m.mad ELSE 1 END) AS scaled
FROM long l JOIN (
  SELECT series_id, feature, any_value(med) AS med, median(abs(value - med)) / 0.6744897501960817 AS mad
  FROM long JOIN (SELECT series_id, feature, median(value) AS med FROM long
                  WHERE day < DATE '2000-01-01' GROUP BY 1, 2) USING (series_id, feature)
  WHERE day < DATE '2000-01-01' GROUP BY 1, 2) m USING (series_id, feature)""", """
long AS (SELECT series_id, day, 'price' AS feature, price AS value FROM turnover
         UNION ALL SELECT series_id, day, 'exog_1', exog_1 FROM turnover
         UNION ALL SELECT series_id, day, 'exog_2', exog_2 FROM turnover)"""))
def _(spark, d):
    long = series.daily_turnover(spark, d).unpivot(
        ["series_id", "day"], list(BASE), "feature", "value")
    fit = X.asinh_median_fit(long, F.col("day") < F.lit(dt.date(2000, 1, 1)))
    scaled = X.asinh_median_apply(long, fit)
    return X.asinh_median_invert(scaled.drop("value"))


@query("f15_ordered_vector", "series_id, day:d, n:i, total:6", with_ctes("by_type", """
SELECT series_id, day, count(*) AS n, sum(value) AS total FROM feats GROUP BY 1, 2""",
                                                                        _FEATURE_CTES))
def _(spark, d):
    names = X.feature_names()
    flat = X.flat_features(_features(spark, d), names)
    v = X.ordered_vector(flat, names).withColumn("a", vector_to_array("features"))
    return v.select("series_id", "day", F.size("a").alias("n"),
                    F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"))
