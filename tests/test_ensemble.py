import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import DAY0, LONG, members_frame
from pyspark.sql import functions as F

from daymark.catalog import load_all
from daymark.operators import ensemble as E
from daymark.operators import scoring as S
from daymark.operators import tables as T
from daymark.operators.quality import CheckFailed

SPEC = {"good": (0, 1), "low": (-3, 2), "high": (4, 2)}


def test_equal_and_scaled_weights(spark):
    frame, truth = members_frame(spark, SPEC, days=4)
    a = E.combine(frame, dict.fromkeys(SPEC, 1.0)).orderBy("origin", "hour").toPandas()
    b = E.combine(frame, dict.fromkeys(SPEC, 5.0)).orderBy("origin", "hour").toPandas()
    np.testing.assert_allclose(a["y_pred"], b["y_pred"])
    want = frame.groupBy("origin", "hour").agg(F.avg("y_pred").alias("p")).orderBy("origin", "hour").toPandas()
    np.testing.assert_allclose(a["y_pred"], want["p"])
    np.testing.assert_allclose(a["y_true"], truth.ravel())


def test_single_weight_reproduces_the_member(spark):
    frame, _ = members_frame(spark, SPEC, days=3)
    out = E.combine(frame, {"good": 1.0, "low": 0.0, "high": 0.0}).orderBy("origin", "hour").toPandas()
    want = frame.filter("model = 'good'").orderBy("origin", "hour").toPandas()
    np.testing.assert_allclose(out["y_pred"], want["y_pred"])


def test_bad_weights_are_refused(spark):
    frame, _ = members_frame(spark, SPEC, days=2)
    for w in ({"good": -1.0, "low": 1.0, "high": 1.0}, dict.fromkeys(SPEC, 0.0)):
        with pytest.raises(CheckFailed):
            E.combine(frame, w)
    with pytest.raises(Exception, match="no weight"):
        E.combine(frame, {"good": 1.0, "low": 1.0}).collect()
    table = spark.createDataFrame([("a", "good", 1.0), ("a", "low", 1.0)],
                                  "series_id string, model string, weight double")
    with pytest.raises(Exception, match="no weight"):
        E.combine(frame, table).collect()


def test_a_missing_member_gives_null_not_a_partial_mean(spark):
    frame, _ = members_frame(spark, SPEC, days=2)
    cut = frame.filter(~((F.col("model") == "low") & (F.col("hour") == 5)))
    out = E.combine(cut, dict.fromkeys(SPEC, 1.0))
    assert out.filter("y_pred is null").count() == 2


def _flat(spark, peaks):
    rows = [("a", (DAY0 + dt.timedelta(days=d)).date(), h, v, v, "m") for d, v in peaks.items()
            for h in range(24)]
    return spark.createDataFrame(rows, LONG)


def test_regime_reads_only_the_previous_calendar_day(spark):
    frame = _flat(spark, {0: 99.0, 1: 10.0, 2: 10.0, 9: 99.0, 10: 10.0, 12: 10.0})
    got = {(r["origin"] - DAY0.date()).days: r["regime"] for r in E.regime_labels(frame, 50).collect()}
    assert got == {0: "calm", 1: "stressed", 2: "calm", 9: "calm", 10: "stressed", 12: "calm"}
    exact = {(r["origin"] - DAY0.date()).days: r["regime"] for r in E.regime_labels(frame, 99).collect()}
    assert "stressed" not in exact.values()
    moved = frame.withColumn("y_true", F.when(F.col("origin") == F.lit(dt.date(2020, 1, 2)), 500.0)
                             .otherwise(F.col("y_true")))
    again = {(r["origin"] - DAY0.date()).days: r["regime"] for r in E.regime_labels(moved, 50).collect()}
    assert again[1] == got[1] and again[2] == "stressed"


def test_equal_regime_sets_equal_the_static_ensemble(spark):
    frame, _ = members_frame(spark, SPEC, days=6)
    w = {"good": 2.0, "low": 1.0, "high": 1.0}
    a = E.combine(frame, w).orderBy("origin", "hour").toPandas()
    b = E.combine_by_regime(frame, {"calm": w, "stressed": w}, 60).orderBy("origin", "hour").toPandas()
    np.testing.assert_allclose(a["y_pred"], b["y_pred"])
    with pytest.raises(CheckFailed):
        E.combine_by_regime(frame, {"calm": w, "spike": w}, 60)


def test_weights_match_an_exhaustive_search(spark):
    frame, truth = members_frame(spark, SPEC, days=20)
    got = E.fit_weights(frame, tuple(SPEC), strict=True).toPandas()
    pdf = frame.toPandas().pivot_table(index=["origin", "hour"], columns="model", values="y_pred")
    p, y = pdf[list(SPEC)].to_numpy(), truth.ravel()
    grid = [(i, j, 100 - i - j) for i, j in itertools.product(range(101), repeat=2) if i + j <= 100]
    best = min(np.abs(y - p @ np.array(g) / 100).mean() for g in grid)
    assert got["mae"].iloc[0] == pytest.approx(best, abs=1e-3)
    assert got["weight"].sum() == pytest.approx(1) and (got["weight"] >= 0).all()
    singles = [np.abs(y - p[:, i]).mean() for i in range(3)]
    assert got["mae"].iloc[0] <= min(singles) + 1e-12


def test_weights_close_their_gap_for_any_number_of_members(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 10):
        spec = {f"m{i}": (float(rng.normal(0, 4)), float(rng.uniform(1, 6))) for i in range(n)}
        frame, truth = members_frame(spark, spec, days=25, seed=n)
        got = E.fit_weights(frame, list(spec)).collect()
        mae, bound = got[0]["mae"], got[0]["bound"]
        assert len(got) == n and 0 <= mae - bound <= 1e-4 * mae
        pdf = frame.toPandas().pivot_table(index=["origin", "hour"], columns="model", values="y_pred")
        p, y = pdf[list(spec)].to_numpy(), truth.ravel()
        error = lambda w: np.abs(y - p @ w).mean()
        assert error([r["weight"] for r in sorted(got, key=lambda r: int(r["model"][1:]))]
                     ) == pytest.approx(mae)
        # No weights, drawn at random or at a corner, get below the bound.
        draws = np.vstack([rng.dirichlet(np.full(n, 0.5), 400), np.eye(n)])
        assert min(error(w) for w in draws) >= bound - 1e-9


def test_weights_with_kinks_perfect_members_and_series_of_their_own(spark):
    rows = []
    for s, (a, b) in {"x": (0.0, 9.0), "y": (-2.0, 1.0)}.items():
        for d in range(6):
            for h in range(24):
                y = float((d * 7 + h) % 5)
                rows += [(s, (DAY0 + dt.timedelta(days=d)).date(), h, y, y + a, "a"),
                         (s, (DAY0 + dt.timedelta(days=d)).date(), h, y, y + b, "b")]
    frame = spark.createDataFrame(rows + [("x", DAY0.date(), 30, None, 1.0, "a")], LONG)
    got = {(r["series_id"], r["model"]): r for r in E.fit_weights(frame, ("a", "b")).collect()}
    assert got["x", "a"]["weight"] == pytest.approx(1, abs=1e-3)
    assert got["x", "a"]["n_cells"] == 144 and got["x", "a"]["mae"] < 0.01
    assert got["y", "a"]["weight"] == pytest.approx(1 / 3, abs=1e-3)


def test_weight_fit_closes_on_heavy_tailed_errors_of_close_members(spark, monkeypatch):
    """Members that share most of their error, as lags of one series do: few residuals near zero
    decide the weights."""
    rng = np.random.default_rng(11)
    days, n = 120, 4
    level = rng.gamma(1.2, 900.0, (days + n, 24))
    truth = level[n:]
    rows = [("a", (DAY0 + dt.timedelta(days=d)).date(), h, float(truth[d, h]),
             float(level[n - 1 - i + d, h] if i < 3 else level[d:d + n, h].mean()), f"m{i}")
            for d in range(days) for h in range(24) for i in range(n)]
    monkeypatch.setattr(E, "MAX_PASSES", 40)
    got = E.fit_weights(spark.createDataFrame(rows, LONG), [f"m{i}" for i in range(n)],
                        gap=1e-6).collect()
    assert -1e-9 <= got[0]["mae"] - got[0]["bound"] <= 1e-6 * got[0]["mae"]


def test_search_in_hundredths_keeps_one_row_per_member(spark):
    frame, truth = members_frame(spark, SPEC, days=12)
    got = E.search_weights(frame, tuple(SPEC)).toPandas().set_index("model")
    pdf = frame.toPandas().pivot_table(index=["origin", "hour"], columns="model", values="y_pred")
    p, y = pdf[list(SPEC)].to_numpy(), truth.ravel()
    error = lambda w: np.abs(y - p @ np.array(w) / 100).mean()
    w = [round(100 * got.loc[m, "weight"]) for m in SPEC]
    assert sum(w) == 100 and got["mae"].iloc[0] == pytest.approx(error(w))
    near = [np.add(w, m) for m in E.simplex_moves(len(SPEC), 1) if min(np.add(w, m)) >= 0]
    assert error(w) <= min(map(error, near)) + 1e-8
    for name in ("e4_fit_weights", "e4_fit_weights_by_type", "e5_fit_regime_weights"):
        assert {("model", ""), ("weight", "2"), ("mae", "6")} <= set(load_all()[name].fields()), name


def test_weight_fit_refuses_leaks_nulls_and_thin_regimes(spark):
    frame, _ = members_frame(spark, SPEC, days=10)
    test = frame.select("series_id", F.date_add("origin", 5).alias("day"))
    with pytest.raises(CheckFailed, match="before"):
        E.fit_weights(frame, tuple(SPEC), test_days=test)
    with pytest.raises(CheckFailed, match="missing"):
        E.fit_weights(frame.withColumn("y_pred", F.when(F.col("hour") != 2, F.col("y_pred"))),
                      tuple(SPEC), strict=True)
    with pytest.raises(CheckFailed, match="each regime needs 20"):
        E.fit_regime_weights(frame, tuple(SPEC), 60)


def test_threshold_uses_training_prices_and_largest_admissible_k(spark):
    frame, truth = members_frame(spark, {"m": (0, 1)}, days=60)
    rng = np.random.default_rng(0)
    prices = rng.normal(50, 10, 500)
    train = spark.createDataFrame([("a", DAY0, float(v)) for v in prices],
                                  "series_id string, ts timestamp_ntz, price double")
    got = E.regime_threshold(train, frame, min_days=20).collect()[0]
    mean, std, peaks = prices.mean(), prices.std(ddof=1), truth.max(axis=1)
    for k in (3.0, 2.5, 2.0, 1.5):
        stressed = int((peaks[:-1] > mean + k * std).sum())
        if stressed >= 20 and 60 - stressed >= 20:
            break
    assert got["k"] == k and got["stressed_days"] == stressed
    assert got["threshold"] == pytest.approx(mean + k * std)


@pytest.mark.parametrize("mode", ["exclude", "expanding"])
def test_corrections_match_a_shifted_rolling_mean(spark, mode):
    frame, _ = members_frame(spark, {"m": (2, 1)}, days=15)
    pdf = frame.toPandas()
    signed = (pdf["y_true"] - pdf["y_pred"]).groupby(pdf["origin"]).mean().sort_index()
    want = signed.rolling(4, min_periods=4 if mode == "exclude" else 1).mean().shift(1)
    got = E.rolling_correction(frame, 4, mode).orderBy("origin").toPandas()["correction"].astype(float)
    np.testing.assert_allclose(got, want.to_numpy())
    # Changing a day's truth leaves its own and earlier corrections alone.
    day = pdf["origin"].sort_values().unique()[8]
    moved = frame.withColumn("y_true", F.when(F.col("origin") == F.lit(day), 0.0).otherwise(F.col("y_true")))
    again = E.rolling_correction(moved, 4, mode).orderBy("origin").toPandas()["correction"].astype(float)
    np.testing.assert_allclose(again[:9], got[:9])
    assert again[9] != got[9]
    for bad in ({"window": 0}, {"window": 3, "cold_start": "zero"}):
        with pytest.raises(ValueError):
            E.rolling_correction(frame, **bad)


def test_constant_bias_is_removed_on_the_same_days(spark):
    frame, _ = members_frame(spark, {"naive": (0, 3), "m": (-8, 0)}, days=20)
    out = {r["model"]: r for r in E.recalibration_sweep(frame, (3,)).collect()}
    assert out["m"]["mae_raw"] == pytest.approx(8) and out["m"]["mae_recal"] == pytest.approx(0, abs=1e-9)
    assert out["m"]["n_days"] == 17
    kept = E.recalibrate(frame, 3)
    assert kept.select("origin").distinct().count() == 17


def test_baseload_and_metrics_guards(spark):
    frame, truth = members_frame(spark, SPEC, days=16)
    assert S.daily_baseload(frame, strict=True).count() == 48
    with pytest.raises(CheckFailed):
        S.daily_baseload(frame.filter("hour <> 7"), strict=True)
    got = S.all_metrics(frame, ["model"]).filter("model = 'good'").collect()[0]
    pdf = frame.filter("model = 'good'").toPandas().sort_values(["origin", "hour"])
    y, p = pdf["y_true"].to_numpy(), pdf["y_pred"].to_numpy()
    weekly = np.abs(y[168:] - y[:-168]).mean()
    assert got["rmae"] == pytest.approx(np.abs(y - p).mean() / weekly)
    assert got["smape"] == pytest.approx(200 * np.mean(np.abs(y - p) / (np.abs(y) + np.abs(p))))
    zero = frame.withColumns({"y_true": F.when(F.col("hour") == 0, 0.0).otherwise(F.col("y_true")),
                              "y_pred": F.when(F.col("hour") == 0, 0.0).otherwise(F.col("y_pred"))})
    z = S.error_metrics(zero, ["model"]).collect()
    assert all(r["smape"] is None and r["smape_safe"] is not None for r in z)
    flat = S.daily_baseload(frame).withColumn("y_true", F.lit(5.0))
    with pytest.raises(CheckFailed):
        S.rmae_daily(flat, ["model"], strict=True)


def test_canonical_table_keeps_absent_arms(spark):
    frame, _ = members_frame(spark, SPEC, days=16)
    direct = S.daily_baseload(frame.filter("model = 'good'"))
    out = T.canonical_table(frame, direct, tuple(SPEC), strict=True).toPandas()
    assert list(out["model"][:3]) == ["good"] * 3 and list(out["target"][:3]) == list(T.TARGETS)
    assert out.loc[(out.target == "daily-direct") & (out.model != "good"), "mae"].isna().all()
    same = out[(out.model == "good") & (out.target != "hourly")]["mae"]
    assert same.nunique() == 1


def test_case_day_uses_no_outcome_and_bias_uses_the_exact_quantile(spark):
    frame, _ = members_frame(spark, {"m": (1, 2)}, days=25)
    daily = S.daily_baseload(frame)
    pdf = daily.toPandas()
    case = T.case_day(daily).collect()[0]
    assert case["origin"] == pdf.loc[pdf["y_pred"].idxmax(), "origin"]
    top = pdf[pdf["y_true"] >= pdf["y_true"].quantile(0.9)]
    got = T.top_decile_bias(daily).collect()[0]
    assert got["n_days"] == len(top)
    assert got["bias"] == pytest.approx((top["y_pred"] - top["y_true"]).mean())
    assert isinstance(pdf, pd.DataFrame)
