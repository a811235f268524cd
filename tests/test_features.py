import datetime as dt

import pytest
from conftest import DAY0, HOURLY, encoded, wavy
from pyspark.sql import functions as F

from daymark.operators import features as X
from daymark.operators import naive as N
from daymark.operators.quality import CheckFailed


def _cells(df):
    names = X.feature_names()
    return {(r["day"], r["feature"]): r["value"] for r in X.long_features(df, names).collect()}


def test_lag_cells_have_their_closed_form(spark):
    feats = X.build_features(encoded(spark))
    cells = _cells(feats)
    assert len(X.feature_names()) == 247
    day = (DAY0 + dt.timedelta(days=10)).date()
    for k in (1, 2, 3, 7):
        assert cells[day, f"price_D-{k}_h05"] == (10 - k) * 100 + 5
    for k in (1, 7):
        assert cells[day, f"exog_1_D-{k}_h23"] == (10 - k) * 10 + 23
        assert cells[day, f"exog_2_D-{k}_h07"] == pytest.approx(10 - k + 0.7)
    assert cells[day, "exog_1_D0_h11"] == 111
    assert cells[day, f"dow_{day.weekday()}"] == 1 and sum(
        cells[day, w] for w in X.WEEKDAYS) == 1
    assert feats.agg(F.min("day")).collect()[0][0] == (DAY0 + dt.timedelta(days=7)).date()


def test_target_day_price_never_reaches_its_features(spark):
    base = encoded(spark)
    day = (DAY0 + dt.timedelta(days=10)).date()
    moved = base.withColumn("price", F.when(F.to_date("ts") == F.lit(day), -999.0).otherwise(F.col("price")))
    a, b = _cells(X.build_features(base)), _cells(X.build_features(moved))
    assert {k: v for k, v in a.items() if k[0] == day} == {k: v for k, v in b.items() if k[0] == day}
    assert a != b


def test_a_missing_day_is_dropped_not_mislabelled(spark):
    gone = [(5, h) for h in range(24)]
    feats = X.build_features(encoded(spark, 20, skip=gone))
    days = {(r["day"] - DAY0.date()).days for r in feats.select("day").collect()}
    assert days == set(range(7, 20)) - {5 + k for k in (1, 2, 3, 7)}
    hole = X.build_features(encoded(spark, 20, skip=[(5, 3)]))
    assert {(r["day"] - DAY0.date()).days for r in hole.select("day").collect()} == days


def test_repeated_hour_is_refused(spark):
    row = [("a", DAY0 + dt.timedelta(hours=2), 1.0, 1.0, 1.0)]
    with pytest.raises(CheckFailed, match="repeated"):
        X.daily_wide(encoded(spark, 2).unionByName(spark.createDataFrame(row, HOURLY)), strict=True)


def test_unknown_feature_name_raises(spark):
    df = spark.createDataFrame([("price_D-1_h24",)], "f string")
    with pytest.raises(Exception, match="no block generates"):
        df.select(X.feature_group("f")).collect()


def test_reordered_columns_are_refused(spark):
    names = X.feature_names()
    flat = X.flat_features(X.build_features(encoded(spark)), names)
    with pytest.raises(ValueError, match="order"):
        X.ordered_vector(flat, names[1:] + names[:1])


def test_direct_daily_naive_equals_mean_of_hourly(spark):
    df = wavy(spark, 30)
    direct = {r["origin"]: r["y_pred"] for r in N.naive_dow_daily(df).collect()}
    hourly = N.naive_dow(df).groupBy("origin").agg(F.avg("y_pred").alias("p")).collect()
    assert direct and all(direct[r["origin"]] == pytest.approx(r["p"]) for r in hourly)


def test_naive_rule_by_weekday(spark):
    got = N.naive_dow(encoded(spark, 21)).filter("hour = 0").collect()
    for r in got:
        lag = {0: 3, 5: 7, 6: 7}.get(r["origin"].weekday(), 1)
        assert r["y_true"] - r["y_pred"] == 100 * lag


def test_live_day_needs_no_price_and_ignores_it(spark):
    df = wavy(spark, 12)
    day = (DAY0 + dt.timedelta(days=11)).date()
    on_day = F.to_date("ts") == F.lit(day)
    blank = df.withColumn("price", F.when(~on_day, F.col("price")))
    odd = df.withColumn("price", F.when(on_day, 9999.0).otherwise(F.col("price")))
    runs = [N.forecast_day(x, day).orderBy("hour").collect() for x in (df, blank, odd)]
    preds = [[r["y_pred"] for r in rows] for rows in runs]
    assert preds[0] == preds[1] == preds[2] and len(preds[0]) == 24
    assert all(r["y_true"] is None for r in runs[1])
    with pytest.raises(CheckFailed):
        N.forecast_day(df.filter(~(on_day & (F.hour("ts") == 3))), day)


def test_standardize_uses_training_rows_only_and_inverts(spark):
    long = spark.createDataFrame(
        [("a", "f", dt.date(2020, 1, d), float(v)) for d, v in ((1, 1), (2, 3), (3, 100))],
        "series_id string, feature string, day date, value double")
    train = F.col("day") < F.lit(dt.date(2020, 1, 3))
    out = X.standardize(long, train)
    assert [r["scaled"] for r in out.orderBy("day").collect()] == [-1.0, 1.0, 98.0]
    back = X.unstandardize(out.drop("value")).orderBy("day").collect()
    assert [r["value"] for r in back] == [1.0, 3.0, 100.0]


def test_sequence_pack_is_oldest_first(spark):
    packed = X.sequence_pack(X.build_features(encoded(spark)), X.feature_names()).orderBy("day").first()
    assert [s[0] for s in packed["steps"]] == [0.0, 400.0, 500.0, 600.0]
    assert len(packed["static"]) == 247 - 96
