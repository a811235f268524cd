"""Reference forecasts and other forecasts that are plain look-ups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions.exprs import similar_day_lag
from daymark.operators.features import (
    SERIES_DAY, build_features, calendar_lags, day_vectors, vector_mean)
from daymark.operators.quality import CheckFailed, refuse_any, with_day_hour

FORECAST_COLUMNS = ["series_id", "origin", "hour", "y_true", "y_pred", "model"]


def lookup_forecasts(df: DataFrame, rules: dict[str, Callable[[dict[int, Column]], Column]],
                     lags: Sequence[int]) -> DataFrame:
    """Long frame of forecasts that only look back whole days.

    ``rules`` maps a model name to an expression over the 24-slot price vectors of the given
    lags. Hours are gathered into day vectors once, lagged once, and every model is read off
    the same row: two shuffles whatever the number of models, no self-join.
    """
    vectors = day_vectors(df, ("price",))
    lagged = calendar_lags(vectors, {f"_d{k}": ("price", k) for k in lags})
    past = {k: F.col(f"_d{k}") for k in lags}
    wide = lagged.select(*SERIES_DAY, "price", *[
        make(past).alias(f"_m{i}") for i, make in enumerate(rules.values())])
    hours = wide.select(*SERIES_DAY, F.posexplode("price").alias("hour", "y_true"), *[
        f"_m{i}" for i in range(len(rules))])
    cells = F.array(*[
        F.struct(F.lit(name).alias("model"), F.get(F.col(f"_m{i}"), F.col("hour")).alias("y_pred"))
        for i, name in enumerate(rules)])
    return hours.select("series_id", F.col("day").alias("origin"), "hour", "y_true",
                        F.inline(cells)).select(*FORECAST_COLUMNS).filter(
        "y_true is not null and y_pred is not null")


def same_hour(lag: int) -> Callable[[dict[int, Column]], Column]:
    """Rule: the same hour ``lag`` days earlier."""
    return lambda past: past[lag]


def same_hour_mean(lags: Sequence[int]) -> Callable[[dict[int, Column]], Column]:
    """Rule: mean of the same hour over several earlier days, all of which must be known."""

    def rule(past: dict[int, Column]) -> Column:
        total = past[lags[0]]
        for k in lags[1:]:
            total = F.zip_with(total, past[k], lambda a, b: a + b)
        return F.transform(total, lambda x: x / len(lags))

    return rule


def similar_day(past: dict[int, Column]) -> Column:
    """Rule: Monday repeats the last Friday, a weekend day last week's, other days yesterday."""
    lag = similar_day_lag("day")
    return F.when(lag == 3, past[3]).when(lag == 7, past[7]).otherwise(past[1])


def naive_dow(df: DataFrame, model: str = "naive") -> DataFrame:
    """M1. The similar-day reference forecast."""
    return lookup_forecasts(df, {model: similar_day}, (1, 3, 7))


def naive_dow_daily(df: DataFrame, model: str = "naive") -> DataFrame:
    """M2. The same rule on the baseload, read from the day's price vectors."""
    vectors = day_vectors(df, ("price",))
    lagged = calendar_lags(vectors, {f"_d{k}": ("price", k) for k in (1, 3, 7)})
    source = similar_day({k: F.col(f"_d{k}") for k in (1, 3, 7)})
    return lagged.select(
        "series_id", F.col("day").alias("origin"), vector_mean("price").alias("y_true"),
        vector_mean(source).alias("y_pred"), F.lit(model).alias("model"),
    ).filter("y_true is not null and y_pred is not null")


def day_inputs(df: DataFrame, day: dt.date, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features of ``day`` without its labels, hours of the eight days that can matter)."""
    first = day - dt.timedelta(days=7)
    recent = with_day_hour(df).filter(F.col("day").between(F.lit(first), F.lit(day)))
    features = build_features(recent.select(*df.columns), need_label=False).filter(
        F.col("day") == F.lit(day))
    if strict:
        seen = recent.select("series_id").distinct()
        refuse_any(seen.join(features.select("series_id"), "series_id", "left_anti"),
                   f"{day} cannot be forecast for every series: each needs 24 hours of exogenous "
                   "data and seven complete days before it")
        if features.limit(1).count() == 0:
            raise CheckFailed(f"no series reaches {day}")
    return features, recent


def with_actuals(hours: DataFrame, recent: DataFrame, model: str) -> DataFrame:
    """(series_id, day, hour, y_pred) as a long frame; the actual price is attached afterwards and
    never influences the forecast."""
    actual = recent.select("series_id", "day", "hour", F.col("price").alias("y_true"))
    return hours.join(actual, ["series_id", "day", "hour"], "left").select(
        "series_id", F.col("day").alias("origin"), "hour", "y_true", "y_pred",
        F.lit(model).alias("model"))


def forecast_day(df: DataFrame, day: dt.date, strict: bool = True, model: str = "naive"
                 ) -> DataFrame:
    """M12. Forecast one day from features only; its own price may be unknown.

    Only the eight days that can matter are read.
    """
    features, recent = day_inputs(df, day, strict)
    lag = similar_day_lag("day")
    # Price blocks come first in x, in lag order 1, 2, 3, 7.
    start = F.when(lag == 1, 0).when(lag == 3, 48).otherwise(72)
    hours = features.select(
        *SERIES_DAY, F.posexplode(F.slice("x", start + 1, F.lit(24))).alias("hour", "y_pred"))
    return with_actuals(hours, recent, model)
