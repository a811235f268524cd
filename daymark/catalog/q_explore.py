"""Registered queries X1-X17."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.catalog import prelude as P
from daymark.catalog.prelude import with_ctes
from daymark.catalog.registry import query
from daymark.operators import explore as X
from daymark.sources import hourly, series

_SPLIT = """
split_slots AS (SELECT *, CASE WHEN ts > max(ts) OVER (PARTITION BY series_id) - INTERVAL 17472 HOUR
                          THEN 'test' ELSE 'train' END AS split FROM slots)"""


def _split(spark, d):
    return hourly.split_train_test(series.delivery_slots(spark, d), 2)


@query("x1_distribution_stats",
       "series_id, split, mean:6, std:5, skew:5, kurt:5, negative_hours:i, negative_pct:6",
       with_ctes("slots", """
SELECT series_id, split, avg(price) AS mean, stddev_samp(price) AS std, skewness(price) AS skew,
  kurtosis(price) AS kurt, count(*) FILTER (price < 0) AS negative_hours,
  100.0 * count(*) FILTER (price < 0) / count(*) AS negative_pct
FROM (SELECT * REPLACE (price - 40 AS price) FROM split_slots) GROUP BY 1, 2""", _SPLIT))
def _(spark, d):
    return X.distribution_stats(_split(spark, d).withColumn("price", F.col("price") - 40))


@query("x2_histogram", "series_id, split, bin:i, n:i, left_edge:6", with_ctes("slots", """
SELECT series_id, split, bin, count(*) AS n, any_value(lo + bin * ((hi - lo) / 100)) AS left_edge FROM (
  SELECT *, CAST(least(floor((price - lo) * 100 / (hi - lo)), 99) AS INTEGER) AS bin
  FROM split_slots JOIN (SELECT series_id, split, min(price) AS lo, max(price) AS hi FROM split_slots GROUP BY 1, 2)
  USING (series_id, split)) GROUP BY 1, 2, 3""", _SPLIT))
def _(spark, d):
    return X.histogram(_split(spark, d))


@query("x3_box_stats", "series_id, split, q1:6, median:6, q3:6", with_ctes("slots", """
SELECT series_id, split, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
       quantile_cont(price, 0.75) AS q3 FROM split_slots GROUP BY 1, 2""", _SPLIT))
def _(spark, d):
    return X.box_stats(_split(spark, d))


@query("x4_hour_profile", "series_id, hour:i, weekday:6, weekend:6", with_ctes("by_type", """
SELECT series_id, hour, avg(price) FILTER (isodow(day) < 6) AS weekday,
       avg(price) FILTER (isodow(day) >= 6) AS weekend FROM by_type GROUP BY 1, 2"""))
def _(spark, d):
    return X.hour_profile(P.prices(spark, d))


@query("x5_weekday_means", "series_id, weekday:i, mean:6", with_ctes("by_type", """
SELECT series_id, isodow(day) - 1 AS weekday, avg(price) AS mean FROM by_type GROUP BY 1, 2"""))
def _(spark, d):
    return X.weekday_means(P.prices(spark, d))


@query("x6_month_means", "series_id, month:i, mean:6", with_ctes("slots", """
SELECT series_id, month(day) AS month, avg(price) AS mean FROM slots GROUP BY 1, 2"""))
def _(spark, d):
    return X.month_means(series.delivery_slots(spark, d))


def _rolling(expr, width, source):
    over = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return with_ctes(source, f"SELECT series_id, ts, CASE WHEN count(price) {over} = {width} THEN "
                             f"{expr} {over} END AS v FROM {source}")


@query("x7_rolling_std", "series_id, ts:d, rolling_std:5", _rolling(
    "stddev_samp(price)", 168, "by_type").replace("AS v", "AS rolling_std"))
def _(spark, d):
    return X.rolling_std(P.prices(spark, d))


@query("x8_spike_counts", "series_id, split, threshold:6, spikes:i, spike_pct:6",
       with_ctes("slots", """
SELECT series_id, split, any_value(t) AS threshold, count(*) FILTER (price > t) AS spikes,
       100.0 * count(*) FILTER (price > t) / count(*) AS spike_pct
FROM split_slots JOIN (SELECT series_id, avg(price) + 3 * stddev_samp(price) AS t FROM split_slots
                       WHERE split = 'train' GROUP BY 1) USING (series_id) GROUP BY 1, 2""", _SPLIT))
def _(spark, d):
    return X.spike_counts(_split(spark, d))


@query("x9_days_over_threshold", "series_id, year:i, days_over:i, n_days:i", with_ctes("slots", """
SELECT series_id, year(day) AS year, count(*) FILTER (peak > 250) AS days_over, count(*) AS n_days
FROM (SELECT series_id, day, max(price) AS peak FROM slots GROUP BY 1, 2) GROUP BY 1, 2"""))
def _(spark, d):
    return X.days_over_threshold(series.delivery_slots(spark, d), 250.0)


def _acov(source, top):
    return f"""
e AS MATERIALIZED (SELECT series_id, ts, price - avg(price) OVER (PARTITION BY series_id) AS e,
      row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
cov AS MATERIALIZED (SELECT a.series_id, k, a.n, sum(a.e * b.e) / a.n AS acov
  FROM (SELECT *, unnest(range(0, {top + 1})) AS k FROM e) a JOIN e b
    ON b.series_id = a.series_id AND b.i = a.i - a.k GROUP BY 1, 2, 3)"""


@query("x10_acf", "series_id, k:i, n:i, acf:6", with_ctes("by_type", """
SELECT c.series_id, c.k, c.n, c.acov / z.acov AS acf
FROM cov c JOIN cov z ON z.series_id = c.series_id AND z.k = 0""", _acov("by_type", 192)))
def _(spark, d):
    return X.acf(P.prices(spark, d))


@query("x11_pacf", "series_id, k:i, pacf:6")
def _(spark, d):
    return X.pacf(P.prices(spark, d))


@query("x12_adf", "series_id, stat:6, used_lag:i, nobs:i, p:6, stationary:b")
def _(spark, d):
    return X.adf(series.delivery_slots(spark, d), 48)


@query("x13_kpss", "series_id, n:i, lags:i, stat:6, p:6", with_ctes("by_type", """
SELECT series_id, n, lags, stat, CASE WHEN stat < 0.347 THEN 0.10
  WHEN stat < 0.463 THEN 0.10 + (stat - 0.347) * (0.05 - 0.10) / (0.463 - 0.347)
  WHEN stat < 0.574 THEN 0.05 + (stat - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
  WHEN stat < 0.739 THEN 0.025 + (stat - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS p
FROM (SELECT series_id, n, lags, ss / (CAST(n AS DOUBLE) * n) / lrv AS stat FROM
  (SELECT series_id, sum(s * s) AS ss FROM (SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS s FROM e) GROUP BY 1)
  JOIN (SELECT series_id, n, lags, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / (lags + 1.0)) END * acov) AS lrv
        FROM cov JOIN auto USING (series_id) WHERE k <= lags GROUP BY 1, 2, 3) USING (series_id))""",
    _acov("by_type", 400) + """,
auto AS (SELECT series_id, CAST(least(floor(1.1447 * power(power(s1 / s0, 2), 1.0 / 3.0) * power(CAST(n AS DOUBLE), 1.0 / 3.0)), n - 1) AS INTEGER) AS lags
  FROM (SELECT series_id, n, sum(CASE WHEN k = 0 THEN acov ELSE 2 * acov END) AS s0, sum(2 * k * acov) AS s1
        FROM cov WHERE k <= floor(power(CAST(n AS DOUBLE), 2.0 / 9.0)) GROUP BY 1, 2))"""))
def _(spark, d):
    return X.kpss(P.prices(spark, d))


@query("x14_exog_corr", "series_id, corr_exog_1:6, corr_exog_2:6", with_ctes("by_type", """
SELECT series_id, corr(price, exog_1) AS corr_exog_1, corr(price, exog_2) AS corr_exog_2
FROM by_type GROUP BY 1"""))
def _(spark, d):
    return X.exog_corr(P.by_type(spark, d))


@query("x15_rolling_corr", "series_id, ts:d, rolling_corr:5", _rolling(
    "corr(price, exog_1)", 720, "slots").replace("AS v", "AS rolling_corr"))
def _(spark, d):
    return X.rolling_corr(series.delivery_slots(spark, d))


@query("x16_yearly_summary", "series_id, year:i, mean:6, std:5, min:6, max:6", with_ctes("slots", """
SELECT series_id, year(day) AS year, avg(price) AS mean, stddev_samp(price) AS std,
       min(price) AS min, max(price) AS max FROM slots GROUP BY 1, 2"""))
def _(spark, d):
    return X.yearly_summary(series.delivery_slots(spark, d))


@query("x17_daily_series", "series_id, day:d, baseload:6", with_ctes("hourly_mean", """
SELECT s.series_id, s.day, b.baseload FROM
 (SELECT series_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM hourly_mean GROUP BY 1) s
LEFT JOIN (SELECT series_id, day, avg(price) AS baseload FROM hourly_mean GROUP BY 1, 2) b USING (series_id, day)"""))
def _(spark, d):
    return X.daily_series(series.hourly_mean(spark, d))


@query("x17_daily_missing", "series_id, n_days:i, missing_days:i", """
WITH d AS (SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS day
           FROM lineitem WHERE l_quantity < 4 GROUP BY 1, 2)
SELECT series_id, date_diff('day', min(day), max(day)) + 1 AS n_days,
       date_diff('day', min(day), max(day)) + 1 - count(*) AS missing_days FROM d GROUP BY 1""")
def _(spark, d):
    sparse = series.table(spark, d, "lineitem").filter("l_quantity < 4").select(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"),
        F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"))
    return X.daily_missing(X.daily_series(sparse))
