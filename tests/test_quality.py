import datetime as dt
import json
import random
from collections import Counter

import pytest
from conftest import DAY0, LONG, encoded, members_frame
from pyspark.sql import functions as F

from daymark.operators import quality as Q
from daymark.sources import export, forecasts, hourly


def _points(spark, values, minutes=15):
    rows = [("a", DAY0 + dt.timedelta(minutes=minutes * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, price double")


def test_payload_to_hours_keeps_a_partial_hour_null(spark):
    body = json.dumps({"unix_seconds": [1577836800 + 900 * i for i in range(8)],
                       "price": [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]})
    flat = hourly.flatten_payload(spark.createDataFrame([("a", body)], "series_id string, body string"), "body")
    pts = flat.withColumnRenamed("value", "price")
    expected = Q.observations_per_hour(pts)
    assert expected.collect()[0]["expected"] == 4
    out = Q.resample_hourly(pts, expected).orderBy("ts").collect()
    assert [r["price"] for r in out] == [None, 6.5]
    assert out[0]["ts"] == dt.datetime(2020, 1, 1)


@pytest.mark.parametrize("minutes,expected", [(15, 4), (30, 2), (60, 1), (120, 1), (20, 3)])
def test_points_per_hour_from_modal_step(spark, minutes, expected):
    pts = _points(spark, [1.0] * 12, minutes)
    odd = pts.filter(F.col("ts") != F.lit(DAY0 + dt.timedelta(minutes=minutes * 5)))
    assert Q.observations_per_hour(odd).collect()[0]["expected"] == expected


def test_interior_nulls_survive_trailing_ones_do_not(spark):
    out = Q.trim_trailing_nulls(_points(spark, [1.0, None, 2.0, None, None])).orderBy("ts").collect()
    assert [r["price"] for r in out] == [1.0, None, 2.0]
    assert Q.trim_trailing_nulls(_points(spark, [None, None])).count() == 0


def test_empty_interior_hours_appear_as_null(spark):
    pts = _points(spark, [1.0] * 4).unionByName(_points(spark, [2.0] * 16).filter(
        F.hour("ts") == 3))
    one = spark.createDataFrame([("a", 4)], "series_id string, expected int")
    assert [r["price"] for r in Q.resample_hourly(pts, one).orderBy("ts").collect()] == [
        1.0, None, None, 2.0]


def test_component_sum_is_null_when_one_is_missing(spark):
    rows = [("a", DAY0, c, v) for c, v in (("solar", 1.0), ("on", None), ("off", 2.0))]
    rows += [("a", DAY0 + dt.timedelta(hours=1), c, 1.0) for c in ("solar", "on", "off")]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, component string, value double")
    assert [r["value"] for r in Q.sum_components(df, 3).orderBy("ts").collect()] == [None, 3.0]


def test_repeated_clock_hour_is_found(spark):
    df = encoded(spark, 2)
    again = df.filter(F.hour("ts") == 2).limit(1)
    with pytest.raises(Q.CheckFailed):
        Q.require_unique_hours(df.unionByName(again))
    assert Q.duplicate_hours(df).count() == 0


def test_forecastable_days_need_seven_good_days_before(spark):
    df = encoded(spark, 20, skip=[(9, 4)]).withColumn("price", F.lit(None).cast("double"))
    got = {(r["day"] - DAY0.date()).days for r in Q.forecastable_days(df).collect()}
    assert got == {7, 8, 17, 18, 19}


def test_member_checks(spark):
    frame, _ = members_frame(spark, {"m": (0, 1), "n": (0, 1)}, days=3)
    assert Q.member_coverage(frame).count() == 0
    day1 = F.col("origin") == F.lit(dt.date(2020, 1, 2))
    lost = frame.filter(~((F.col("model") == "n") & day1))
    assert [r["rule"] for r in Q.member_coverage(lost).collect()] == ["origin missing"]
    # 24 rows, but hour 22 twice and hour 23 absent.
    swapped = frame.withColumn("hour", F.when((F.col("hour") == 23) & day1 & (F.col("model") == "n"), 22)
                               .otherwise(F.col("hour")))
    assert [r["rule"] for r in Q.member_coverage(swapped).collect()] == ["duplicate hour"]
    shifted = frame.withColumn("hour", F.when(F.col("model") == "n", F.col("hour") + 1).otherwise(F.col("hour")))
    with pytest.raises(Q.CheckFailed):
        Q.require_same_truth(shifted)
    stale = frame.withColumn("y_true", F.when((F.col("model") == "n") & (F.col("hour") == 3),
                                              F.col("y_true") + 1).otherwise(F.col("y_true")))
    assert Q.truth_disagreements(stale).count() == 3
    nulls = frame.withColumn("y_true", F.when(F.col("hour") != 3, F.col("y_true")))
    assert Q.truth_disagreements(nulls).count() == 0


def test_upload_rules_name_the_offender(spark):
    rows = [("a", f"2020-01-01 0{h}:00:00", v) for h, v in enumerate(["1", "2", "x", "4"])]
    rows += [("a", "yesterday", "5"), ("a", "2020-01-01 03:00:00", "4"), ("a", "2020-01-01 06:00:00", "1")]
    df = spark.createDataFrame(rows, "series_id string, timestamp string, price string")
    got = {r["rule"]: (r["detail"], r["n"]) for r in Q.validate_upload(df, ["price"]).collect()}
    assert got["not numeric: price"] == ("x", 1)
    assert got["unparseable timestamp"] == ("yesterday", 1)
    assert got["duplicate timestamp"] == ("2020-01-01 03:00:00", 1)
    assert got["not hourly"] == ("3600 s", 1)
    assert "missing columns" in {r["rule"] for r in Q.validate_upload(df, ["price", "exog_1"]).collect()}


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line for line in plan.splitlines())


def test_feed_questions_read_the_feed_once(spark, tmp_path):
    path = str(tmp_path / "feed")
    _points(spark, [1.0] * 300).write.parquet(path)
    feed = spark.read.parquet(path)
    assert _scans(Q.observations_per_hour(feed)) == _scans(Q.step_counts(feed)) == 1
    assert _scans(Q.feed_state(feed)) == 1
    text = feed.select("series_id", F.col("ts").cast("string").alias("timestamp"),
                       F.col("price").cast("string").alias("price"))
    assert _scans(Q.validate_upload(text, ["price"])) == 1


def test_steps_inside_and_across_days(spark):
    rng = random.Random(5)
    minutes = {s: sorted(rng.sample(range(9 * 1440), k)) for s, k in (("a", 400), ("b", 12), ("c", 1))}
    rows = [(s, DAY0 + dt.timedelta(minutes=m), None) for s, ms in minutes.items() for m in ms + ms[:3]]
    feed = spark.createDataFrame(rows + [("a", None, 1.0), ("d", None, 1.0)],
                                 "series_id string, ts timestamp_ntz, price double")
    want = Counter((s, (b - a) * 60_000_000) for s, ms in minutes.items() for a, b in zip(ms, ms[1:]))
    got = {(r["series_id"], r["step"]): r["n"] for r in Q.step_counts(feed).collect()}
    assert got == want
    expected = {r["series_id"]: r["expected"] for r in Q.observations_per_hour(feed).collect()}
    assert set(expected) == {"a", "b", "c", "d"} and expected["c"] == expected["d"] == 1
    assert {r["price"] for r in Q.resample_hourly(feed).collect()} == {None}


def test_hours_with_the_learned_and_with_the_given_count_agree(spark):
    pts = _points(spark, [float(i % 7) for i in range(400)]).filter("minute(ts) <> 30 or hour(ts) <> 5")
    learned = Q.resample_hourly(pts).orderBy("ts").collect()
    assert learned == Q.resample_hourly(pts, Q.observations_per_hour(pts)).orderBy("ts").collect()
    assert len(learned) == 100 and sum(r["price"] is None for r in learned) == 4


def test_rename_and_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([("2020-01-01 00:00:00", 1.5, float("nan"), 3.0)],
                          "Date string, Price double, `Exogenous 1` double, `Exogenous 2` double"
                          ).write.option("header", True).csv(path)
    schema = "Date timestamp_ntz, Price double, `Exogenous 1` double, `Exogenous 2` double"
    df = hourly.load_hourly(spark, path, "Date", "csv", "de", schema)
    assert df.columns == ["series_id", "ts", "price", "exog_1", "exog_2"]
    assert df.collect()[0]["exog_1"] is None
    with pytest.raises(ValueError):
        hourly.load_hourly(spark, path, "Date", "csv")


def test_split_is_whole_weeks(spark):
    out = hourly.split_train_test(encoded(spark, 372), 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"test": 24 * 364, "train": 24 * 8}


def test_rewriting_an_origin_does_not_duplicate_it(spark, tmp_path):
    frame, _ = members_frame(spark, {"m": (0, 1)}, days=4)
    path = str(tmp_path / "f")
    forecasts.write_forecasts(frame, path)
    forecasts.write_forecasts(frame.filter(F.col("origin") > F.lit(dt.date(2020, 1, 2))), path)
    assert forecasts.load_long(spark, path).count() == 96
    torn = frame.filter(~((F.col("hour") > 9) & (F.dayofmonth("origin") == 2)))
    planned = frame.select("series_id", "model", "origin").distinct()
    assert forecasts.remaining_origins(planned, torn).count() == 1
    assert forecasts.repair_partial(torn).count() == 72
    assert forecasts.repair_report(torn).collect()[0]["rows_removed"] == 10


def test_merge_prefers_new_and_reports_conflicts(spark):
    schema = "k string, v double"
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema)
    old = spark.createDataFrame([("b", 3.0), ("c", 4.0), ("c", 4.0)], schema)
    got = {r["k"]: r["v"] for r in forecasts.merge_dedup(new, old, ["k"]).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 4.0}
    assert [r["k"] for r in forecasts.merge_conflicts(new, old, ["k"], "v").collect()] == ["b"]


def test_display_rules(spark):
    df = spark.createDataFrame([(0.0, -0.0001, 3), (0.9999, 1.0, 4), (None, 2.34567, 5)],
                               "p double, m double, n int")
    got = export.display_table(df, ["p"]).collect()
    assert [r["p"] for r in got] == ["<0.001", ">0.999", "--"]
    assert [r["m"] for r in got] == ["0.000", "1.000", "2.346"]
    assert [r["n"] for r in got] == [3, 4, 5]


def test_naive_is_never_marked_best(spark):
    df = spark.createDataFrame([("naive", "h", 1.0), ("a", "h", 2.0), ("b", "h", 3.0), ("naive", "d", 1.0)],
                               "model string, target string, mae double")
    got = {(r["model"], r["target"]): r["best_mae"] for r in export.mark_best(df, ["mae"], ["target"]).collect()}
    assert got == {("naive", "h"): False, ("a", "h"): True, ("b", "h"): False, ("naive", "d"): False}


def test_alignment_names_the_first_mismatch(spark):
    base = encoded(spark, 2).select("series_id", "ts", F.col("price").alias("y_true"))
    assert Q.verify_alignment(base, base).collect()[0]["aligned"]
    less = base.filter(F.hour("ts") != 5)
    got = Q.verify_alignment(less, base).collect()[0]
    assert got["first_mismatch"] == DAY0 + dt.timedelta(hours=5) and not got["aligned"]


def test_long_schema_matches_reader():
    assert forecasts.FORECAST_SCHEMA.simpleString() == (
        "struct<" + ",".join(p.strip().replace(" ", ":") for p in LONG.split(",")) + ">")
