"""Inputs that once lost or invented rows."""

import datetime as dt

import pytest
from conftest import encoded, members_frame, wavy
from pyspark.sql import functions as F

from daymark.catalog import load_all
from daymark.operators import comparison as C
from daymark.operators import ensemble as E
from daymark.operators import features as X
from daymark.operators import models as M
from daymark.operators import naive as N
from daymark.operators import quality as Q
from daymark.sources import forecasts, hourly, series

SF = "/root/testdata/sf0.001"


def test_one_unknown_hour_costs_no_other_forecast(spark):
    df = wavy(spark, 120)
    hole = dt.datetime(2020, 2, 20, 5)
    with_hole = df.withColumn("price", F.when(F.col("ts") != F.lit(hole).cast("timestamp_ntz"),
                                              F.col("price")))
    full = M.fit_seasonal_arx(df, 28, 7).filter("hour = 5").count()
    left = M.fit_seasonal_arx(with_hole, 28, 7).filter("hour = 5").count()
    # The day before, and the days whose lags read the hole, have no regressors.
    assert full - left <= 6


def test_window_need_not_be_whole_blocks(spark):
    assert M.fit_seasonal_arx_daily(wavy(spark, 90), 30, 7).count() > 0


def test_series_written_singly_stay(spark, tmp_path):
    path = str(tmp_path / "stored")
    frame, _ = members_frame(spark, {"a": (0, 1), "b": (1, 1)}, days=4)
    both = frame.unionByName(frame.withColumn("series_id", F.lit("z")))
    for series in ("a", "z", "a"):
        forecasts.write_forecasts(both.filter(F.col("series_id") == series), path)
    assert forecasts.load_long(spark, path).count() == both.count()


def test_repeated_component_counts_once(spark):
    rows = [("s", dt.datetime(2020, 1, 1), c, v) for c, v in (("x", 1.0), ("x", 1.0), ("y", 5.0))]
    parts = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, component string, value double")
    assert Q.sum_components(parts, 3).first()["value"] is None
    assert Q.sum_components(parts, 2).first()["value"] == 6.0


def test_broken_payload_fails(spark):
    frame = spark.createDataFrame([("a", '{"unix_seconds": [1')], "series_id string, body string")
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        hourly.flatten_payload(frame, "body").collect()


def test_series_that_is_not_ready_is_named(spark):
    df = encoded(spark, 12).unionByName(encoded(spark, 12, skip=[(9, 3)], series="b"))
    with pytest.raises(Exception, match="every series"):
        N.forecast_day(df, dt.date(2020, 1, 12))


def test_absent_regime_and_threshold_are_refused(spark):
    frame, _ = members_frame(spark, {"a": (0, 1), "b": (1, 1)}, days=30)
    with pytest.raises(Exception, match="each regime"):
        E.fit_regime_weights(frame, ["a", "b"], 1e9, min_days=2)
    limits = spark.createDataFrame([("other", 1.0)], "series_id string, threshold double")
    with pytest.raises(Exception, match="no regime threshold"):
        E.regime_labels(frame, limits).collect()
    train = encoded(spark, 20)
    with pytest.raises(Exception, match="no k leaves"):
        E.regime_threshold(train, frame, min_days=1000).collect()


def test_days_of_one_model_do_not_count(spark):
    frame, _ = members_frame(spark, {"a": (0, 1), "b": (1, 1)}, days=40)
    cut = frame.filter("NOT (model = 'b' AND day(origin) <= 6)")
    d = C.loss_differential(cut, "a", "b")
    shared = cut.filter("model = 'b'").select("origin").distinct().count()
    assert C.dm_statistics(d, ["series_id"]).first()["n"] == shared == d.count()
    with pytest.raises(Exception, match="share every origin"):
        C.dm_matrix(cut, ("a", "b"))


def test_many_members_get_weights(spark):
    spec = {f"m{i}": (i * 0.5, 1.0 + 0.3 * i) for i in range(6)}
    frame, truth = members_frame(spark, spec, days=20)
    got = {r["model"]: r for r in E.fit_weights(frame, list(spec)).collect()}
    assert abs(sum(r["weight"] for r in got.values()) - 1) < 1e-9
    three = E.fit_weights(frame, list(spec)[:3]).first()["mae"]
    assert got["m0"]["mae"] <= three + 1e-6


def test_lag_beyond_a_block(spark):
    days = spark.range(200).select(F.lit("a").alias("series_id"), F.expr(
        "date_add(date'2020-01-01', cast(id as int))").alias("day"), F.col("id").alias("v"))
    got = X.calendar_lags(days, {"old": ("v", 90)}).filter("v >= 90")
    assert got.filter("old = v - 90").count() == 110


def test_series_of_prices_never_shuffle_by_user(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan(load_all()["a1_mae"].frame(spark, SF))
    whole, bare = series.hourly_by_type(spark, SF), series.hourly_by_type(spark, SF, ("price",))
    assert bare.columns == ["series_id", "ts", "price", "day", "hour"]
    rows = lambda df: sorted(map(tuple, df.select("series_id", "ts", "price").collect()))
    assert [r[:2] for r in rows(bare)] == [r[:2] for r in rows(whole)]
    # Sums go through another shuffle, so their order, and with it the last bits, may differ.
    assert [r[2] for r in rows(bare)] == pytest.approx([r[2] for r in rows(whole)], rel=1e-12)
