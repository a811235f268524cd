"""Registered queries A15-A17 and A19-A24."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.q_comparison import _ENSEMBLES, _ensembles
from daymark.catalog.registry import query
from daymark.operators import ensemble as E
from daymark.operators import naive as N
from daymark.operators import scoring as S
from daymark.operators import tables as T

_TERM = "200 * abs(a.y_true - a.y_pred) / (abs(a.y_true) + abs(a.y_pred))"


def metrics_sql(source: str, keys: str = "a.series_id, a.model", hourly: bool = True) -> str:
    on = "AND w.hour = a.hour" if hourly else ""
    return f"""
SELECT {keys}, avg(abs(a.y_true - a.y_pred)) AS mae, sqrt(avg(power(a.y_true - a.y_pred, 2))) AS rmse,
  CASE WHEN count(*) FILTER (abs(a.y_true) + abs(a.y_pred) = 0) = 0
       THEN avg(CASE WHEN abs(a.y_true) + abs(a.y_pred) > 0 THEN {_TERM} END) END AS smape,
  avg(CASE WHEN abs(a.y_true) + abs(a.y_pred) = 0 THEN 0 ELSE {_TERM} END) AS smape_safe,
  avg(abs(a.y_true - a.y_pred)) / avg(abs(a.y_true - w.y_true)) AS rmae
FROM {source} a LEFT JOIN {source} w ON w.series_id = a.series_id AND w.model = a.model {on}
 AND w.origin = a.origin - 7 GROUP BY ALL"""


_DIRECT = """
base AS (SELECT series_id, day, avg(price) AS y FROM by_type GROUP BY 1, 2),
direct AS (SELECT a.series_id, a.day AS origin, a.y AS y_true, b.y AS y_pred, 'naive' AS model
  FROM base a JOIN base b ON b.series_id = a.series_id AND b.day = a.day -
    CASE WHEN isodow(a.day) = 1 THEN 3 WHEN isodow(a.day) >= 6 THEN 7 ELSE 1 END
  WHERE a.day >= DATE '2024-01-08')"""


def _direct(spark, d):
    daily = N.naive_dow_daily(P.prices(spark, d))
    return daily.filter(F.col("origin") >= F.lit(P.EVENT_FIRST) + F.expr("interval 7 days"))


@query("a15_canonical_table", "series_id, model, target, mae:6, rmse:6, smape:6, rmae:6",
       with_ctes("daily_members", f"""
SELECT s.series_id, s.model, s.target, mae, rmse, smape, rmae
FROM (SELECT x.series_id, m.model, t.target FROM (SELECT DISTINCT series_id FROM members) x
      JOIN (VALUES ('naive'), ('lag1'), ('lag7'), ('mean3')) m(model) ON TRUE
      JOIN (VALUES ('hourly'), ('daily-direct'), ('daily-aggregated')) t(target) ON TRUE) s
LEFT JOIN (SELECT *, 'hourly' AS target FROM ({metrics_sql('members')}) UNION ALL
           SELECT *, 'daily-direct' FROM ({metrics_sql('direct', hourly=False)}) UNION ALL
           SELECT *, 'daily-aggregated' FROM ({metrics_sql('daily_members', hourly=False)})) f
USING (series_id, model, target)""", _DIRECT))
def _(spark, d):
    return T.canonical_table(P.members(spark, d), _direct(spark, d),
                             ("naive", "lag1", "lag7", "mean3"))


@query("a16_ood_summary",
       "model, mae:6, rmse:6, smape:6, rmae:6, mae_era:6, rmae_era:6, mae_ratio:6",
       with_ctes("members", f"""
SELECT l.model, l.mae, l.rmse, l.smape_safe AS smape, l.rmae, e.mae AS mae_era, e.rmae AS rmae_era,
       l.mae / e.mae AS mae_ratio
FROM ({metrics_sql('live', 'a.model')}) l LEFT JOIN ({metrics_sql('era', 'a.model')}) e USING (model)""", """
live AS (SELECT * FROM members WHERE origin >= DATE '2024-01-20'),
era AS (SELECT * FROM members WHERE origin < DATE '2024-01-20')"""))
def _(spark, d):
    m = P.members(spark, d)
    live = F.col("origin") >= F.lit(P.TEST_START)
    return T.ood_summary(S.all_metrics(m.filter(live), ["model"]),
                         S.all_metrics(m.filter(~live), ["model"]))


_PRINT = """
printed AS (SELECT model, round(rmae, 3) AS rmae, round(mae, 3) + CASE WHEN model = 'lag7' THEN 0.25 ELSE 0 END AS mae,
  CAST(NULL AS DOUBLE) AS mape, round(smape, 3) AS smape, round(rmse, 3) AS rmse FROM again)"""


@query("a17_published_comparison",
       "model, source, rmae:6, mae:6, smape:6, rmse:6, mape:6, drift:b",
       with_ctes("slot_members", f"""
SELECT model, 'own' AS source, rmae, mae, smape, rmse, CAST(NULL AS DOUBLE) AS mape, NULL AS drift FROM own
UNION ALL SELECT p.model, 'printed', p.rmae, p.mae, p.smape, p.rmse, p.mape, abs(p.mae - a.mae) > 0.005
  FROM printed p JOIN again a USING (model)
UNION ALL SELECT a.model, 'recomputed', a.rmae, a.mae, a.smape, a.rmse, NULL, abs(p.mae - a.mae) > 0.005
  FROM printed p JOIN again a USING (model)""", f"""
own_frame AS (SELECT * FROM slot_members WHERE model IN ('naive', 'mean3')),
pub_frame AS (SELECT * FROM slot_members WHERE model IN ('lag1', 'lag7')),
own AS ({metrics_sql('own_frame', 'a.model')}), again AS ({metrics_sql('pub_frame', 'a.model')}),""" + _PRINT))
def _(spark, d):
    m = P.slot_members(spark, d)
    ours = m.filter(F.col("model").isin("naive", "mean3"))
    published = m.filter(F.col("model").isin("lag1", "lag7"))
    # Printed values: three decimals of the same scores, one of them misprinted.
    scores = S.all_metrics(published, ["model"])
    wrong = F.when(F.col("model") == "lag7", 0.25).otherwise(0.0)
    printed = scores.select(
        "model", F.round("rmae", 3).alias("rmae"), (F.round("mae", 3) + wrong).alias("mae"),
        F.lit(None).cast("double").alias("mape"), F.round("smape", 3).alias("smape"),
        F.round("rmse", 3).alias("rmse"))
    return T.published_comparison(ours, published, printed)


@query("a19_checkpoint_table", "source, model, mae:6, rmse:6, smape_safe:6, rmae:6",
       with_ctes("members", metrics_sql("kept", "a.source, a.model"), """
kept AS (SELECT *, CASE WHEN model = 'naive' THEN 'own' ELSE 'published' END AS source
         FROM members WHERE model IN ('naive', 'lag1', 'lag7'))"""))
def _(spark, d):
    # The own 3-day mean is still running (its last day is missing), so it is left out.
    m = P.members(spark, d)
    own = m.filter(F.col("model").isin("naive", "mean3")).filter(
        ~((F.col("model") == "mean3") & (F.dayofmonth("origin") == 30)))
    published = m.filter(F.col("model").isin("lag1", "lag7"))
    return T.checkpoint_table(own, published, published.filter(F.col("model") == "lag1"))


@query("a20_mae_by_year", "model, mae_1999:6, mae_2000:6, change:6", with_ctes("slot_members", """
SELECT model, avg(abs(y_true - y_pred)) FILTER (year(origin) = 1999) AS mae_1999,
  avg(abs(y_true - y_pred)) FILTER (year(origin) = 2000) AS mae_2000,
  avg(abs(y_true - y_pred)) FILTER (year(origin) = 2000) - avg(abs(y_true - y_pred)) FILTER (year(origin) = 1999) AS change
FROM slot_members GROUP BY 1"""))
def _(spark, d):
    return T.mae_by_year(P.slot_members(spark, d), (1999, 2000))


@query("a21_top_decile_bias", "series_id, model, bias:6, n_days:i", with_ctes("daily_members", """
SELECT series_id, model, avg(y_pred - y_true) AS bias, count(*) AS n_days
FROM daily_members JOIN (SELECT series_id, model, quantile_cont(y_true, 0.9) AS cut FROM daily_members GROUP BY 1, 2)
USING (series_id, model) WHERE y_true >= cut GROUP BY 1, 2"""))
def _(spark, d):
    return T.top_decile_bias(S.daily_baseload(P.members(spark, d)))


@query("a22_case_day", "series_id, model, origin:d, y_pred:6, y_true:6, regime",
       with_ctes("daily_members regimes", """
SELECT series_id, model, origin, y_pred, y_true, regime FROM (
  SELECT * FROM daily_members QUALIFY row_number() OVER (PARTITION BY series_id, model ORDER BY y_pred DESC, origin) = 1)
JOIN regimes USING (series_id, origin)"""))
def _(spark, d):
    m = P.members(spark, d)
    return T.case_day(S.daily_baseload(m), E.regime_labels(m, P.STRESS))


@query("a23_day_report", """series_id, model, origin:d, forecast_baseload:6, actual_baseload:6,
       mae:6, worst_hour:i, worst_error:6""", with_ctes("members", """
SELECT series_id, model, origin, avg(y_pred) AS forecast_baseload,
  avg(y_true) AS actual_baseload, avg(abs(y_pred - y_true)) AS mae,
  arg_min(hour, struct_pack(e := -round(abs(y_pred - y_true), 9), h := hour)) AS worst_hour, max(abs(y_pred - y_true)) AS worst_error
FROM members GROUP BY 1, 2, 3"""))
def _(spark, d):
    return T.day_report(P.members(spark, d))


@query("a24_ensemble_vs_best", "series_id, model, mae:6, best_single:6, gap:6",
       with_ctes("regimes", """
SELECT series_id, e.model, e.mae, b.best_single, e.mae - b.best_single AS gap
FROM (SELECT series_id, model, avg(abs(y_true - y_pred)) AS mae FROM
        (SELECT * FROM ens_static UNION ALL SELECT * FROM ens_regime) GROUP BY 1, 2) e
JOIN (SELECT series_id, min(mae) AS best_single FROM (
        SELECT series_id, model, avg(abs(y_true - y_pred)) AS mae FROM members WHERE model <> 'naive' GROUP BY 1, 2)
      GROUP BY 1) b USING (series_id)""", _ENSEMBLES))
def _(spark, d):
    frame = P.members(spark, d).unionByName(_ensembles(spark, d))
    return T.ensemble_vs_best(S.error_metrics(frame, ["series_id", "model"]),
                              ("static", "regime"))
