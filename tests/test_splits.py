import datetime as dt

import pytest
from conftest import DAY0

from daymark.operators import splits as V
from daymark.operators.quality import CheckFailed


def calendar(spark, offsets, series="a"):
    return spark.createDataFrame(
        [(series, (DAY0 + dt.timedelta(days=d)).date()) for d in offsets], "series_id string, day date")


def day(d):
    return (DAY0 + dt.timedelta(days=d)).date()


@pytest.mark.parametrize("offsets", [range(30), [*range(12), *range(19, 35)]])
@pytest.mark.parametrize("step,first", [(1, None), (3, None), (2, day(15)), (1, day(99))])
def test_walk_forward_against_slices(spark, offsets, step, first):
    days = [day(d) for d in offsets]
    start = 10
    if first is not None:
        later = [i for i, d in enumerate(days) if d >= first]
        start = max(10, later[0]) if later else len(days)
    want = {(days[p], d) for p in range(start, len(days), step) for d in days[p - 10:p]}
    out = V.split_membership(calendar(spark, offsets), 10, step, first).collect()
    assert {(r["origin"], r["day"]) for r in out if r["role"] == "train"} == want
    assert all(r["origin"] == r["day"] for r in out if r["role"] == "test")
    spans = V.walk_forward(calendar(spark, offsets), 10, step, first).collect()
    assert {(r["origin"], r["train_start"]) for r in spans} == {
        (days[p], days[p - 10]) for p in range(start, len(days), step)}
    assert all(r["train_end"] < r["origin"] for r in spans)


def test_refits_follow_the_calendar_across_gaps(spark):
    offsets = [*range(14), *range(17, 20), *range(40, 60)]
    splits = V.walk_forward(calendar(spark, offsets), 5)
    out = {r["origin"]: r for r in V.refit_blocks(splits, 7).collect()}
    last = None
    for p in range(5, len(offsets)):
        end = day(offsets[p - 1])
        refit = last is None or (end - last).days >= 7
        last = end if refit else last
        assert out[day(offsets[p])]["refit"] == refit
    assert len(out) == len(offsets) - 5


def test_validation_is_the_tail_and_bounds_are_checked(spark):
    cal = calendar(spark, range(20))
    roles = {r["day"]: r["role"] for r in V.carve_validation(cal, 5).collect()}
    assert [d for d, r in roles.items() if r == "validation"] and all(
        (roles[day(d)] == "validation") == (d >= 15) for d in range(20))
    with pytest.raises(ValueError):
        V.carve_validation(cal, 0)
    with pytest.raises(Exception, match="fewer"):
        V.carve_validation(cal, 20).collect()


def test_interpretation_window_is_strictly_before_and_whole(spark):
    cal = calendar(spark, range(30))
    out = V.interpretation_window(cal, day(20), 10).collect()
    assert {r["day"] for r in out} == {day(d) for d in range(10, 20)}
    with pytest.raises(Exception, match="fewer days"):
        V.interpretation_window(cal, day(5), 10).collect()
    with pytest.raises(Exception, match="gaps"):
        V.interpretation_window(calendar(spark, [*range(5), *range(9, 30)]), day(15), 10).collect()


def test_order_guards(spark):
    a, b = calendar(spark, range(5)), calendar(spark, range(5, 9))
    V.require_before(a, b)
    V.require_disjoint(a, b)
    with pytest.raises(CheckFailed):
        V.require_before(calendar(spark, range(6)), b)
    with pytest.raises(CheckFailed):
        V.require_before(a.limit(0), b)
    with pytest.raises(CheckFailed):
        V.require_disjoint(calendar(spark, range(6)), b)
    with pytest.raises(ValueError, match="inverted"):
        V.validate_range(day(3), day(2))
