import datetime as dt
import json

import pytest
from conftest import DAY0, members_frame, wavy
from pyspark.sql import functions as F

from daymark.operators import models as M
from daymark.plans import studies
from daymark.sources import forecasts


def test_walk_forward_resumes_and_replaces_torn_origins(spark, tmp_path):
    df = wavy(spark, 30).unionByName(wavy(spark, 30, seed=5, series="b"))
    path = str(tmp_path / "runs")
    day = lambda d: (DAY0 + dt.timedelta(days=d)).date()
    calls = dict(fit_predict=M.window_mean, model="mean", window=10, refit_every=2,
                 first_origin=day(17))
    first = studies.walk_forward_run(df, path, last_origin=day(22), **calls)
    assert first.count() == 2 * 6 * 24
    # A crash leaves one series' last origin torn; the next run covers a longer range.
    torn = first.filter(~((F.col("series_id") == "b") & (F.col("hour") > 4)
                          & (F.col("origin") == F.lit(day(22)))))
    kept = str(tmp_path / "torn")
    forecasts.write_forecasts(torn, kept)
    out = studies.walk_forward_run(df, kept, last_origin=day(29), **calls)
    full = studies.walk_forward_run(df, str(tmp_path / "full"), last_origin=day(29), **calls)
    assert out.count() == full.count() == 2 * 13 * 24
    assert out.exceptAll(full.select(*out.columns)).count() == 0


def test_ensemble_study_beats_its_members_on_validation(spark):
    spec = {"a": (2, 2), "b": (-2, 2), "naive": (0, 8)}
    frame, truth = members_frame(spark, spec, days=80)
    cut = F.lit((DAY0 + dt.timedelta(days=50)).date())
    train = spark.createDataFrame([("a", DAY0, float(v)) for v in truth[:20].ravel()],
                                  "series_id string, ts timestamp_ntz, price double")
    out = studies.ensemble_study(train, frame.filter(F.col("origin") < cut),
                                 frame.filter(F.col("origin") >= cut), ("a", "b"), 5)
    weights = {r["model"]: r["weight"] for r in out.static_weights.collect()}
    assert weights["a"] == pytest.approx(0.5, abs=0.1)
    assert all(r["gap"] < 0 for r in out.against_best.collect())
    assert {r["subset"] for r in out.regime_split.collect()} >= {"all"}
    with pytest.raises(ValueError):
        studies.ensemble_study(train, frame, frame, ("a", "b"), 5)


def test_landed_payloads_become_a_forecast(spark):
    hours, epoch = 24 * 9, 1577836800
    stamps = [epoch + 3600 * i for i in range(hours)]
    price = [float(i % 24) for i in range(hours - 24)] + [None] * 24
    body = lambda kind, values: json.dumps(
        {"production_type": kind, "unix_seconds": stamps, "forecast_values": values})
    one = lambda b: spark.createDataFrame([("de", x) for x in b], "series_id string, body string")
    prices = one([json.dumps({"unix_seconds": stamps, "price": price})])
    load = one([body("load", [50.0] * hours)])
    parts = one([body(k, [1.0] * hours) for k in ("solar", "on", "off")])
    aligned = studies.live_hours(prices, load, parts, 3)
    assert aligned.count() == hours - 24 and aligned.agg(F.max("exog_2")).collect()[0][0] == 3.0
    report = studies.live_day(aligned, (DAY0 + dt.timedelta(days=7)).date()).collect()[0]
    assert report["mae"] == 0 and report["forecast_baseload"] == pytest.approx(11.5)
