import datetime as dt
import math

import numpy as np
import pytest
from conftest import DAY0, members_frame
from pyspark.sql import functions as F

from daymark.operators import comparison as C
from daymark.operators.quality import CheckFailed


def _diff(spark, d):
    return spark.createDataFrame([("a", (DAY0 + dt.timedelta(days=i)).date(), float(v))
                                  for i, v in enumerate(d)], "series_id string, origin date, d double")


def _stat(d, lags):
    e = d - d.mean()
    n = len(d)
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return d.mean() / math.sqrt((var if var > 0 else e @ e / n) / n)


@pytest.mark.parametrize("n", [3, 12, 90, 300])
def test_hac_statistic_and_tail(spark, n):
    d = np.random.default_rng(n).normal(0.2, 1, n).cumsum() / 5
    lags = min(max(1, math.floor(4 * (n / 100) ** (2 / 9))), n - 1)
    got = C.with_p(C.dm_statistics(_diff(spark, d), ["series_id"])).collect()[0]
    assert got["lags"] == lags
    assert got["stat"] == pytest.approx(_stat(d, lags))
    assert got["p"] == pytest.approx(0.5 * math.erfc(_stat(d, lags) / math.sqrt(2)))


def test_bandwidth_zero_is_the_uncorrected_test(spark):
    d = _diff(spark, np.random.default_rng(1).normal(0.3, 1, 50))
    a = C.dm_statistics(d, ["series_id"], bandwidth=0).collect()[0]["stat"]
    b = C.dm_statistics(d, ["series_id"], "uncorrected").collect()[0]["stat"]
    assert a == pytest.approx(b)


def test_degenerate_inputs(spark):
    same = C.with_p(C.dm_statistics(_diff(spark, [0.0] * 10), ["series_id"])).collect()[0]
    assert (same["status"], same["p"]) == ("identical", 0.5)
    for d in ([1.0] * 10, [1.0, 2.0]):
        with pytest.raises(CheckFailed):
            C.require_testable(C.dm_statistics(_diff(spark, d), ["series_id"]))


def test_matrix_is_complementary_and_favours_the_better_model(spark):
    frame, _ = members_frame(spark, {"sharp": (0, 1), "blunt": (0, 5), "mid": (0, 2)}, days=60)
    p = {(r["model_row"], r["model_col"]): r["p"] for r in
         C.dm_matrix(frame, ("sharp", "blunt", "mid")).collect()}
    assert len(p) == 6 and p["sharp", "blunt"] < 0.001
    assert all(p[a, b] + p[b, a] == pytest.approx(1) for a, b in p)


def test_squared_loss_has_no_root(spark):
    frame, truth = members_frame(spark, {"a": (0, 1), "b": (0, 3)}, days=3)
    pdf = frame.toPandas()
    pdf["e"] = (pdf["y_true"] - pdf["y_pred"]) ** 2
    per = pdf.groupby(["model", "origin"])["e"].mean()
    got = {r["origin"]: r["d"] for r in C.loss_differential(frame, "a", "b", 2).collect()}
    assert all(got[o] == pytest.approx(per["a", o] - per["b", o]) for o in got)
    with pytest.raises(ValueError):
        C.daily_losses(frame, 3)


def test_bootstrap_equals_gathering_every_resample(spark):
    d = np.random.default_rng(5).normal(0.1, 1, 40)
    got = {r["block"]: r["p"] for r in C.block_bootstrap(
        _diff(spark, d), ["series_id"], (3, 7, 40), draws=3000).collect()}
    assert set(got) == {3, 7}
    for block, p in got.items():
        rng = np.random.default_rng(42)
        starts = rng.integers(0, 40, size=(3000, -(-40 // block)))
        idx = (starts[:, :, None] + np.arange(block)).reshape(3000, -1)[:, :40] % 40
        hits = int(((d - d.mean())[idx].mean(axis=1) >= d.mean()).sum())
        assert p == pytest.approx((1 + hits) / 3001)


def test_regime_report_falls_back_to_one_test_on_short_subsets(spark):
    frame, _ = members_frame(spark, {"x": (0, 1), "y": (0, 2)}, days=40)
    rows = {r["subset"]: r for r in C.dm_regime_report(frame, "x", "y", 78.0, draws=500).collect()}
    assert rows["all"]["n"] == sum(r["n"] for s, r in rows.items() if s != "all")
    assert rows["all"]["range_low"] <= rows["all"]["range_high"]
    few = frame.filter(F.col("origin") < F.lit(dt.date(2020, 1, 4)))
    short = C.dm_regime_report(few, "x", "y", 1e9, draws=100).filter("subset = 'all'").collect()[0]
    assert short["boot_low"] is None and short["p_hac"] is not None
