"""Accuracy metrics on forecast frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions.exprs import HOURS, ratio
from daymark.operators.features import calendar_lags
from daymark.operators.quality import refuse_any


def abs_error() -> Column:
    return F.abs(F.col("y_true") - F.col("y_pred"))


def mae() -> Column:
    """A1. Mean absolute error."""
    return F.avg(abs_error())


def rmse() -> Column:
    """A2. Root mean squared error."""
    e = F.col("y_true") - F.col("y_pred")
    return F.sqrt(F.avg(e * e))


def _symmetric() -> tuple[Column, Column]:
    return 2 * abs_error(), F.abs("y_true") + F.abs("y_pred")


def smape() -> Column:
    """A3. Symmetric percentage error; one 0/0 cell makes the whole value undefined."""
    num, den = _symmetric()
    undefined = F.count_if(den == 0) > 0
    return F.when(~undefined, 100 * F.avg(ratio(num, den)))


def smape_zero_safe() -> Column:
    """A4. As A3, with an exactly met zero counting as no error."""
    num, den = _symmetric()
    return 100 * F.avg(F.when(den == 0, 0.0).otherwise(ratio(num, den)))


def error_metrics(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """A1-A4 in one pass."""
    return frame.groupBy(*by).agg(
        mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape"),
        smape_zero_safe().alias("smape_safe"), F.count(F.lit(1)).alias("n"))


def pack_days(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per day: ``y_true`` and ``y_pred`` as 24-slot arrays, NULL where an hour is absent."""
    slots = [
        "array(" + ", ".join(f"max(case when hour = {h} then {c} end)" for h in HOURS) + f") as {c}"
        for c in ("y_true", "y_pred")]
    present = "array(" + ", ".join(f"max(hour = {h})" for h in HOURS) + ") as _present"
    return frame.groupBy(*keys).agg(*[F.expr(x) for x in (*slots, present)])


def unpack_days(days: DataFrame, keep: Sequence[str], more: dict[str, str] | None = None
                ) -> DataFrame:
    """Back to one row per hour; ``more`` maps new columns to further 24-slot arrays."""
    plain = [c for c in ("series_id", "model", "origin") if c in days.columns]
    hours = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).filter(
        F.get("_present", F.col("hour")))
    at = lambda c: F.get(F.col(c), F.col("hour"))
    return hours.select(*plain, *keep, "hour", at("y_true").alias("y_true"),
                        at("y_pred").alias("y_pred"),
                        *[at(v).alias(k) for k, v in (more or {}).items()])


def signed_error() -> Column:
    """Mean (truth - forecast) over the known hours of a packed day."""
    e = F.filter(F.zip_with("y_true", "y_pred", lambda a, b: a - b), lambda x: x.isNotNull())
    return F.when(F.size(e) > 0, F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e))


def with_week_ago(frame: DataFrame, extra: Sequence[str] = (), daily: bool = False) -> DataFrame:
    """Adds ``week_ago``: the truth of the same slot seven calendar days earlier in the frame.

    Hours are packed into day vectors and lagged inside bounded blocks of days: the frame is
    read once, nothing is joined, and no series or model is gathered in one task.
    """
    keys = ["series_id", "model", *extra]
    if daily:
        return calendar_lags(frame.select(*keys, "origin", "y_true", "y_pred"),
                             {"week_ago": ("y_true", 7)}, day="origin", keys=keys)
    lagged = calendar_lags(pack_days(frame, [*keys, "origin"]), {"_week": ("y_true", 7)},
                           day="origin", keys=keys)
    return unpack_days(lagged, list(extra), {"week_ago": "_week"})


def _others(by: Sequence[str]) -> list[str]:
    return [c for c in by if c not in ("series_id", "model", "origin", "hour")]


def _relative(frame: DataFrame, by: Sequence[str], daily: bool) -> DataFrame:
    return with_week_ago(frame, _others(by), daily).groupBy(*by).agg(
        mae().alias("mae"), F.avg(F.abs(F.col("y_true") - F.col("week_ago"))).alias("naive_mae"))


def rmae_hourly(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """A5. MAE over the MAE of the same hour one week earlier (matched hours only)."""
    return _relative(frame, by, daily=False).withColumn(
        "rmae", ratio(F.col("mae"), F.col("naive_mae")))


def rmae_daily(daily: DataFrame, by: Sequence[str], strict: bool = False) -> DataFrame:
    """A6. The same on the baseload; strict mode refuses a zero denominator."""
    out = _relative(daily, by, daily=True)
    if strict:
        refuse_any(out.filter("naive_mae is null or naive_mae <= 0"),
                   "the weekly reference has no error to compare with")
    return out.withColumn("rmae", ratio(F.col("mae"), F.col("naive_mae")))


def all_metrics(frame: DataFrame, by: Sequence[str], daily: bool = False) -> DataFrame:
    """MAE, RMSE, sMAPE (both forms) and rMAE together, in one pass."""
    naive = F.avg(F.abs(F.col("y_true") - F.col("week_ago")))
    return with_week_ago(frame, _others(by), daily).groupBy(*by).agg(
        mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape"),
        smape_zero_safe().alias("smape_safe"), ratio(mae(), naive).alias("rmae"),
        F.count(F.lit(1)).alias("n"))


def baseload_violations(frame: DataFrame) -> DataFrame:
    """A7. (series, model, origin) groups without 24 rows covering 24 distinct hours."""
    return _day_groups(frame).filter("n_rows <> 24 or n_hours <> 24").select(
        "series_id", "model", "origin", "n_rows", "n_hours")


def _day_groups(frame: DataFrame) -> DataFrame:
    # Hours are 0..23: a 24-bit mask counts distinct ones without a second shuffle.
    mask = F.bit_or(F.when(F.col("hour").between(0, 23), F.expr("shiftleft(1, hour)")).otherwise(0))
    return frame.groupBy("series_id", "model", "origin").agg(
        F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"),
        F.count(F.lit(1)).alias("n_rows"), F.bit_count(mask).alias("n_hours"))


def daily_baseload(frame: DataFrame, strict: bool = False) -> DataFrame:
    """A7. Mean of the 24 hours per (series, origin, model).

    Incomplete groups are refused in strict mode and left out otherwise.
    """
    if strict:
        refuse_any(baseload_violations(frame), "a partial day's mean is not a baseload")
    return _day_groups(frame).filter("n_rows = 24 and n_hours = 24").select(
        "series_id", "origin", "y_true", "y_pred", "model")
