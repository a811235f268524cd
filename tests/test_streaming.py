import datetime as dt

from conftest import DAY0
from pyspark.sql import functions as F

from daymark.operators.ensemble import regime_labels
from daymark.operators.quality import resample_hourly
from daymark.streaming import jobs as J

SCHEMA = "series_id string, ts timestamp_ntz, value double"


def _write(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(hours, minutes=0):
    return DAY0 + dt.timedelta(hours=hours, minutes=minutes)


def _stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "latestFirst", False).parquet(path)


def test_only_complete_closed_hours_are_emitted(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(spark, path, [("a", at(0, 15 * i), float(i)) for i in range(4)]
           + [("a", at(1, 15 * i), 9.0) for i in range(3)])          # hour 1 lacks a point
    _write(spark, path, [("a", at(2, 15 * i), 5.0) for i in range(4)] + [("a", at(9), 1.0)])
    out = J.drain(J.stream_hourly(_stream(spark, path), 4, "1 hour"), "t1").orderBy("ts").collect()
    assert [(r["ts"], r["price"]) for r in out] == [(at(0), 1.5), (at(2), 5.0)]
    need = spark.createDataFrame([("a", 3)], "series_id string, expected int")
    table = J.drain(J.stream_hourly(_stream(spark, path), need, "1 hour"), "t1")
    assert {r["ts"] for r in table.collect()} == {at(0), at(1), at(2)}


def test_step_is_learned_and_agrees_with_the_batch_rule(spark, tmp_path):
    path, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    grid = lambda s, start, end, minutes: [
        (s, at(0, m), float(m % 11)) for m in range(start * 60, end * 60, minutes) if m % 420 != 30]
    files = [grid("a", 0, 6, 60) + grid("b", 0, 6, 20), grid("a", 6, 12, 15) + grid("b", 6, 12, 20),
             grid("a", 12, 30, 15) + grid("b", 12, 30, 20) + [("c", at(4), 1.0)]]
    seen = []
    for k, rows in enumerate(files):  # "a" starts hourly and turns to quarters
        _write(spark, path, rows, SCHEMA)
        J.stream_feed(_stream(spark, path), out, marks, "1 hour")  # each run goes on from the last
        points = spark.createDataFrame([r for f in files[:k + 1] for r in f], SCHEMA)
        last = max(r[1] for f in files[:k + 1] for r in f)
        closed = points.filter(F.col("ts") < F.lit(last.replace(minute=0) - dt.timedelta(hours=1)))
        if k == 2:  # too late for the stream: its hour was closed when it came
            closed = closed.filter("series_id <> 'c'")
        want = {(r["series_id"], r["ts"], r["price"]) for r in resample_hourly(closed, value="value")
                .withColumnRenamed("value", "price").filter("price is not null").collect()}
        got = [(r["series_id"], r["ts"], r["price"]) for r in J.current_hours(spark, out).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        seen.append(sum(s == "a" for s, _, _ in got))
    steps = spark.read.parquet(out + "/steps").filter("series_id = 'a'").orderBy("as_of").collect()
    assert [r["step"] // 60_000_000 for r in steps] == [60, 15]
    # While the step is an hour every hour is whole; the first hours no longer count once it is 15.
    assert seen[0] > 0 and at(1) not in {t for s, t, _ in got if s == "a"}


def test_overlapping_chunks_count_once(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(spark, path, [("a", at(h), float(h)) for h in range(6)])
    _write(spark, path, [("a", at(h), float(h)) for h in range(4, 9)])
    out = J.drain(J.stream_dedup(_stream(spark, path), delay="12 hours"), "t2")
    assert out.count() == 9 and out.columns == ["series_id", "ts", "value"]


def test_labels_follow_late_peaks_and_survive_a_replay(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "series_id string, ts timestamp_ntz, y_true double"
    day = lambda d, v: [("a", at(24 * d + h), v) for h in range(24)]
    _write(spark, path, day(0, 10.0) + day(1, 10.0), schema)
    _write(spark, path, day(2, 10.0), schema)
    _write(spark, path, [("a", at(24 + 5), 99.0)], schema)  # day 1 is re-issued with a spike
    for run in range(2):  # the second run replays every batch into the same table
        J.stream_regime_alert(_stream(spark, path, schema), 50.0, out,
                              str(tmp_path / f"marks{run}")).awaitTermination()
        got = {r["origin"]: r["regime"] for r in J.current_labels(spark, out).collect()}
        rows = spark.read.schema(schema).parquet(path).withColumn("origin", F.to_date("ts"))
        want = {r["origin"]: r["regime"] for r in regime_labels(rows, 50.0).collect()}
        assert got == want and got[at(48).date()] == "stressed"


def test_a_batch_costs_its_own_days_only(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "series_id string, ts timestamp_ntz, y_true double"
    n = 20
    for d in range(n):  # one day a file, every third with a spike
        _write(spark, path, [("a", at(24 * d + h), 80.0 if d % 3 == 0 and h == 7 else 10.0)
                             for h in range(24)], schema)
    query = J.stream_regime_alert(_stream(spark, path, schema), 50.0, out, str(tmp_path / "m"),
                                  "5 days")
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(steps) == n
    # Two keys a batch, its own day and the next; given-up days leave the state.
    assert all(p["stateOperators"][0]["numRowsUpdated"] == 2 for p in steps)
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 12 for p in steps)
    got = {r["origin"]: r["regime"] for r in J.current_labels(spark, out).collect()}
    rows = spark.read.schema(schema).parquet(path).withColumn("origin", F.to_date("ts"))
    assert got == {r["origin"]: r["regime"] for r in regime_labels(rows, 50.0).collect()}
    assert len(got) == n
