"""Null-safe column expressions. Nothing here triggers a job or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = list(range(24))
HOUR_TAGS = [f"h{h:02d}" for h in HOURS]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """pandas marks a missing number NaN; inside the engine it is NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def hour_floor(ts: str) -> Column:
    """Start of the hour, staying zone-free (``date_trunc`` would go through the session zone)."""
    return F.expr(f"cast(to_date({ts}) as timestamp_ntz) + make_dt_interval(0, hour({ts}))")


def quarter_floor(ts: str) -> Column:
    """Start of the 15-minute slot of a zone-free timestamp."""
    return F.expr(
        f"cast(to_date({ts}) as timestamp_ntz)"
        f" + make_dt_interval(0, hour({ts}), 15 * cast(floor(minute({ts}) / 15) as int))"
    )


def hour_stamp(day: str, hour: str) -> Column:
    return F.expr(f"cast({day} as timestamp_ntz) + make_dt_interval(0, cast({hour} as int))")


def unix_micros_ntz(ts: str) -> Column:
    """Microseconds since the epoch of a zone-free timestamp, independent of the session zone."""
    return F.expr(
        f"datediff(to_date({ts}), date'1970-01-01') * 86400000000L"
        f" + hour({ts}) * 3600000000L + minute({ts}) * 60000000L"
        f" + cast(extract(second from {ts}) * 1000000 as bigint)"
    )


def similar_day_lag(day: str | Column) -> Column:
    """Days back to the comparable day: Monday 3, weekend 7, otherwise 1."""
    wd = F.weekday(col(day))
    return F.when(wd == 0, 3).when(wd >= 5, 7).otherwise(1)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of an ANSI error on a zero denominator."""
    return F.when(den != 0, num / den)


def non_negative_root(c: Column) -> Column:
    """Square root of a variance whose last bits may have gone below zero; NULL stays NULL."""
    return F.when(c > 0, F.sqrt(c)).when(c <= 0, 0.0)


def bias_corrected_skewness(c: str | Column) -> Column:
    """Sample skewness G1 (the pandas convention); Spark's own is the population form."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(c: str | Column) -> Column:
    """Sample excess kurtosis G2 (the pandas convention)."""
    c = col(c)
    n = F.count(c).cast("double")
    return F.when(
        n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    )


def newey_west_lags(n: Column) -> Column:
    """max(1, floor(4 (n/100)^(2/9))), never above n - 1."""
    rule = F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")
    return F.least(F.greatest(F.lit(1), rule), (n - 1).cast("int"))
