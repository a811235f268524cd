"""Registered queries A8-A14 and A18."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.q_ensemble import _trio, BY_REGIME, REGIME_SQL, STATIC, STATIC_SQL
from daymark.catalog.registry import query
from daymark.operators import comparison as C
from daymark.operators import ensemble as E
from daymark.session import materialize


def upper_tail_sql(z: str) -> str:
    """P(Z > z) by the all-positive series of the normal integral; SQL has no erf."""
    series = (f"list_sum(list_transform(range(0, 420), lambda n: exp((2*n+1)*ln(abs({z})) "
              f"- lgamma(2*n+2) + n*ln(2.0) + lgamma(n+1))))")
    return (f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 0.5 WHEN {z} > 20 THEN 0.0 "
            f"WHEN {z} < -20 THEN 1.0 ELSE 0.5 - sign({z}) * exp(-{z}*{z}/2) / {math.sqrt(2 * math.pi)} * {series} END")


def dm_sql(source: str, keys: str, hac: bool = True) -> str:
    """Statistic per key over ``source(keys, origin, d)``; the last CTE is ``dm``."""
    lags = "CAST(least(greatest(1, floor(4 * power(n / 100.0, 2.0 / 9.0))), n - 1) AS INTEGER)" if hac else "0"
    return f"""
dm_e AS MATERIALIZED (SELECT {keys}, d, d - avg(d) OVER (PARTITION BY {keys}) AS e,
  row_number() OVER (PARTITION BY {keys} ORDER BY origin) AS i FROM {source}),
dm_n AS (SELECT *, {lags} AS lags FROM (
  SELECT {keys}, count(*) AS n, avg(d) AS dbar, avg(e * e) AS iid_var FROM dm_e GROUP BY ALL)),
dm_c AS (SELECT {keys}, k, sum(a.e * b.e) AS c FROM
  (SELECT *, unnest(range(1, 16)) AS k FROM dm_e) a JOIN (SELECT {keys}, i, e FROM dm_e) b USING ({keys})
  WHERE b.i = a.i - a.k GROUP BY ALL),
dm_v AS (SELECT {keys}, n, dbar, lags, iid_var, any_value(iid_var) + coalesce(sum(2 * (1 - k / (lags + 1.0)) * c / n), 0) AS v
  FROM dm_n LEFT JOIN dm_c USING ({keys}) WHERE k IS NULL OR k <= lags OR lags = 0
  GROUP BY {keys}, n, dbar, lags, iid_var),
dm AS (SELECT {keys}, n, dbar, lags, iid_var, CASE WHEN v > 0 THEN v ELSE iid_var END AS variance,
  CASE WHEN n >= 3 THEN dbar / sqrt(CASE WHEN v > 0 THEN v ELSE iid_var END / n) END AS stat FROM dm_v)"""


def _iid_sql(source, keys):
    return f"""
dm AS (SELECT {keys}, count(*) AS n, avg(d) AS dbar, 0 AS lags, var_pop(d) AS iid_var, var_pop(d) AS variance,
       avg(d) / sqrt(var_pop(d) / count(*)) AS stat FROM {source} GROUP BY ALL)"""


_LOSS = """
slot_losses AS (SELECT series_id, model, origin, avg(abs(y_true - y_pred)) AS loss,
                       avg(power(y_true - y_pred, 2)) AS loss2 FROM slot_members GROUP BY 1, 2, 3),
diff AS (SELECT a.series_id, a.origin, a.loss - b.loss AS d, a.loss2 - b.loss2 AS d2
         FROM slot_losses a JOIN slot_losses b USING (series_id, origin)
         WHERE a.model = 'naive' AND b.model = 'mean3')"""
_PAIRS = """
pairs AS (SELECT r.series_id, r.origin, r.model AS model_row, c.model AS model_col, c.loss - r.loss AS d
          FROM slot_losses r JOIN slot_losses c USING (series_id, origin) WHERE r.model <> c.model)"""


@query("a8_loss_differential", "series_id, origin:d, l1:6, l2:4", with_ctes(
    "slot_members", "SELECT series_id, origin, d AS l1, d2 AS l2 FROM diff", _LOSS))
def _(spark, d):
    m = P.slot_members(spark, d)
    one = C.loss_differential(m, "naive", "mean3").withColumnRenamed("d", "l1")
    two = C.loss_differential(m, "naive", "mean3", 2).withColumnRenamed("d", "l2")
    return one.join(two, C.DAY)


_DM = "series_id, n:i, dbar:6, lags:i, variance:5, stat:5, p:6"


@query("a9_dm_uncorrected", _DM, with_ctes(
    "slot_members", f"SELECT *, {upper_tail_sql('stat')} AS p FROM dm",
    _LOSS + "," + _iid_sql("diff", "series_id")))
def _(spark, d):
    diff = C.loss_differential(P.slot_members(spark, d), "naive", "mean3")
    return C.with_p(C.dm_statistics(diff, ["series_id"], "uncorrected"))


@query("a10_dm_hac", _DM, with_ctes(
    "slot_members", f"SELECT *, {upper_tail_sql('stat')} AS p FROM dm",
    _LOSS + "," + dm_sql("diff", "series_id")))
def _(spark, d):
    diff = C.loss_differential(P.slot_members(spark, d), "naive", "mean3")
    return C.with_p(C.dm_statistics(diff, ["series_id"]))


@query("a11_dm_matrix", "series_id, model_row, model_col, n:i, stat:5, p:6", with_ctes(
    "slot_members", f"SELECT *, {upper_tail_sql('stat')} AS p FROM dm",
    _LOSS + "," + _PAIRS + "," + dm_sql("pairs", "series_id, model_row, model_col")))
def _(spark, d):
    return C.dm_matrix(P.slot_members(spark, d), P.MODELS)


@query("a11_dm_matrix_uncorrected", "series_id, model_row, model_col, n:i, stat:5, p:6", with_ctes(
    "slot_members", f"SELECT *, {upper_tail_sql('stat')} AS p FROM dm",
    _LOSS + "," + _PAIRS + "," + _iid_sql("pairs", "series_id, model_row, model_col")))
def _(spark, d):
    return C.dm_matrix(P.slot_members(spark, d), P.MODELS, "uncorrected")


@query("a12_block_bootstrap", "series_id, block:i, n:i, p:6")
def _(spark, d):
    diff = C.loss_differential(P.slot_members(spark, d), "lag1", "lag7")
    return C.block_bootstrap(diff, ["series_id"])


_SUBSETS = f"""
ens_two AS (SELECT * FROM ens_regime UNION ALL SELECT * FROM ens_static),
cells AS (SELECT series_id, origin, hour, any_value(y_true) AS y, max(CASE WHEN model = 'regime' THEN y_pred END) AS p0,
                 max(CASE WHEN model = 'static' THEN y_pred END) AS p1 FROM ens_two GROUP BY 1, 2, 3),
days AS (SELECT series_id, origin, avg(abs(y - p0)) AS l0, avg(abs(y - p1)) AS l1, avg(abs(y - p1)) - avg(abs(y - p0)) AS d,
                avg(abs(p0 - p1)) AS gap, max(abs(p0 - p1)) AS gap_max FROM cells GROUP BY 1, 2),
subsets AS (SELECT *, 'all' AS subset FROM days UNION ALL
            SELECT days.*, regime FROM days JOIN regimes USING (series_id, origin)),
maes AS (SELECT series_id, subset, avg(l0) AS mae_first, avg(l1) AS mae_second, avg(gap) AS mean_gap,
                max(gap_max) AS max_gap, CASE WHEN count(*) > 2 THEN skewness(d) END AS skewness
         FROM subsets GROUP BY 1, 2),
auto AS (SELECT series_id, subset, corr(CASE WHEN p IS NOT NULL THEN d END, p) AS lag1_autocorr FROM (
  SELECT *, lag(d) OVER (PARTITION BY series_id, subset ORDER BY origin) AS p FROM subsets) GROUP BY 1, 2)"""
_ENSEMBLES = STATIC_SQL + "," + REGIME_SQL


def _ensembles(spark, d):
    # Stage boundary: both ensembles and all labels read the stored member forecasts.
    m = materialize(_trio(P.members(spark, d)), "members")
    return E.combine(m, STATIC, "static").unionByName(
        E.combine_by_regime(m, BY_REGIME, P.STRESS, "regime"))


@query("a13_dm_regime_facts", """series_id, subset, n:i, mae_first:6, mae_second:6, delta_pct:5,
       mean_gap:6, max_gap:6, lag1_autocorr:6, skewness:5""", with_ctes("regimes", """
SELECT series_id, subset, n, mae_first, mae_second, 100 * (mae_first - mae_second) / mae_second AS delta_pct,
       mean_gap, max_gap, lag1_autocorr, skewness
FROM (SELECT series_id, subset, count(*) AS n FROM subsets GROUP BY 1, 2)
JOIN maes USING (series_id, subset) JOIN auto USING (series_id, subset)""", _ENSEMBLES + "," + _SUBSETS))
def _(spark, d):
    return C.dm_regime_facts(C._pair_days(_ensembles(spark, d), "regime", "static", P.STRESS))


@query("a13_dm_regime_report", """series_id, subset, n:i, mae_first:6, mae_second:6, bandwidth:i,
       stat_hac:5, p_hac:6, stat_uncorrected:5, p_uncorrected:6, boot_low:6, boot_high:6,
       range_low:6, range_high:6""")
def _(spark, d):
    return C.dm_regime_report(_ensembles(spark, d), "regime", "static", P.STRESS)


@query("a14_dm_regime_split", "series_id, subset, n:i, mae_first:6, mae_second:6, stat:5, p:6",
       with_ctes("regimes", f"""
SELECT dm.*, mae_first, mae_second, {upper_tail_sql('stat')} AS p FROM dm
JOIN maes USING (series_id, subset)""", _ENSEMBLES + "," + _SUBSETS + ","
                 + dm_sql("subsets", "series_id, subset")))
def _(spark, d):
    return C.dm_regime_split(_ensembles(spark, d), "regime", "static", P.STRESS)


@query("a18_dm_vs_published", """series_id, ours, theirs, mae_ours:6, mae_theirs:6, stat:5,
       p_ours_better:6, p_theirs_better:6, verdict""", with_ctes("slot_members", f"""
SELECT series_id, ours, theirs, o.mae AS mae_ours, t.mae AS mae_theirs, stat, p1 AS p_ours_better,
       p2 AS p_theirs_better, CASE WHEN p1 < 0.05 THEN 'ours better (p<0.05)'
         WHEN p2 < 0.05 THEN 'theirs better (p<0.05)' ELSE 'no significant difference' END AS verdict
FROM (SELECT *, {upper_tail_sql('stat')} AS p1, {upper_tail_sql('(-stat)')} AS p2 FROM dm)
JOIN (SELECT series_id, model AS ours, avg(loss) AS mae FROM slot_losses GROUP BY 1, 2) o USING (series_id, ours)
JOIN (SELECT series_id, model AS theirs, avg(loss) AS mae FROM slot_losses GROUP BY 1, 2) t USING (series_id, theirs)""",
    _LOSS + "," + _PAIRS + """,
versus AS (SELECT series_id, origin, model_row AS ours, model_col AS theirs, d FROM pairs
           WHERE model_row IN ('mean3', 'naive') AND model_col IN ('lag1', 'lag7'))""" + ","
    + dm_sql("versus", "series_id, ours, theirs")))
def _(spark, d):
    return C.dm_vs_published(P.slot_members(spark, d), ("mean3", "naive"), ("lag1", "lag7"))
