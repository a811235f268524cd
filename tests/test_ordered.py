import datetime as dt

import numpy as np
import pandas as pd
from conftest import DAY0
from pyspark.sql import functions as F

from daymark.operators import explore as X
from daymark.operators import ordered as O


def _frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, DAY0 + dt.timedelta(hours=int(7 * i)), float(v))
            for s in ("hot", "cold") for i, v in enumerate(rng.normal(0, 1, n if s == "hot" else 9))]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, price double")


def test_position_and_running_sum_cross_chunks(spark):
    df = _frame(spark)
    month = F.trunc(F.to_date("ts"), "month")
    out = O.with_position(df, ["series_id"], "ts", month)
    out = O.running_sum(out, ["series_id"], "ts", month, "price", "cum").toPandas()
    for _, g in out.groupby("series_id"):
        g = g.sort_values("ts")
        assert list(g["pos"]) == list(range(len(g)))
        np.testing.assert_allclose(g["cum"], g["price"].cumsum(), atol=1e-9)


def test_rolling_blocks_equal_one_big_window(spark):
    df = O.with_position(_frame(spark), ["series_id"], "ts", F.trunc(F.to_date("ts"), "month"))
    blocks = O.with_halo(df, "pos", 4, size=8)
    from pyspark.sql import Window
    w = Window.partitionBy("series_id", "_block").orderBy("pos").rowsBetween(-4, 0)
    out = blocks.withColumn("m", F.avg("price").over(w)).filter("_own").toPandas()
    assert len(out) == df.count()
    for _, g in out.groupby("series_id"):
        g = g.sort_values("pos")
        np.testing.assert_allclose(g["m"], g["price"].rolling(5, min_periods=1).mean(), atol=1e-9)


def test_rolling_moments_match_pandas(spark):
    df = _frame(spark, 3000).withColumn("exog_1", F.col("price") * 0.5 + F.hour("ts"))
    std = X.rolling_std(df, 168).toPandas()
    corr = X.rolling_corr(df, 50).toPandas()
    for name, pdf in df.toPandas().groupby("series_id"):
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        got = std[std.series_id == name].sort_values("ts")["rolling_std"].to_numpy()
        np.testing.assert_allclose(got.astype(float), pdf["price"].rolling(168).std(), atol=1e-9)
        got = corr[corr.series_id == name].sort_values("ts")["rolling_corr"].to_numpy()
        want = pdf["price"].rolling(50).corr(pdf["exog_1"])
        np.testing.assert_allclose(got.astype(float), want, atol=1e-9)


def test_attach_keeps_every_row_of_a_dominant_key(spark):
    df = _frame(spark)
    small = df.groupBy("series_id").agg(F.max("ts").alias("last"))
    assert O.attach(df, small, ["series_id"], "ts").count() == df.count()


def test_pacf_and_adf_against_direct_linear_algebra(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(2500)
    for t in range(1, len(x)):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([("a", DAY0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)],
                               "series_id string, ts timestamp_ntz, price double")
    e = x - x.mean()
    c = np.array([e[k:] @ e[:len(e) - k] / len(e) for k in range(8)])
    pacf = X.pacf(df, 7).orderBy("k").toPandas()["pacf"].to_numpy()
    for k in range(1, 8):
        toeplitz = c[np.abs(np.subtract.outer(range(k), range(k)))]
        assert abs(pacf[k] - np.linalg.solve(toeplitz, c[1:k + 1])[-1]) < 1e-9
    got = X.adf(df, 6).collect()[0]
    p, dx = got["used_lag"], np.diff(x)
    z = np.column_stack([x[p:-1], np.ones(len(dx) - p)] + [dx[p - j:len(dx) - j] for j in range(1, p + 1)])
    y = dx[p:]
    beta, res = np.linalg.lstsq(z, y, rcond=None)[:2]
    se = np.sqrt(res[0] / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
    assert abs(got["stat"] - beta[0] / se) < 1e-6
    assert got["nobs"] == len(y) and got["stationary"] and got["p"] < 0.01


def test_skewness_and_kurtosis_are_bias_corrected(spark):
    v = pd.Series([1.0, 2.0, 9.0, 4.0, 4.5])
    df = spark.createDataFrame([("a", "train", float(x)) for x in v],
                               "series_id string, split string, price double")
    got = X.distribution_stats(df).collect()[0]
    assert abs(got["skew"] - v.skew()) < 1e-12 and abs(got["kurt"] - v.kurt()) < 1e-12
