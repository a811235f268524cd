"""Rolling-origin splits and ordering guards.

Inputs are (series_id, day) calendars: one row per day, so a series is bounded by its calendar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.operators.quality import CheckFailed, refuse_any

SERIES_DAY = ["series_id", "day"]


def positions(days: DataFrame) -> DataFrame:
    """(series_id, day, pos): 0-based rank of each day.

    One row per calendar day, so a series is at most a few ten thousand rows here.
    """
    w = Window.partitionBy("series_id").orderBy("day")
    return days.select(*SERIES_DAY, (F.row_number().over(w) - 1).alias("pos"))


def origins(days: DataFrame, window: int, step: int = 1,
            first_origin: dt.date | None = None, last_origin: dt.date | None = None) -> DataFrame:
    """V1/V2. (series_id, origin, pos): every day usable as an origin.

    The first origin is the later of position ``window`` and the first day on or after
    ``first_origin``; afterwards one origin every ``step`` rows.
    """
    validate_range(first_origin, last_origin)
    pos = positions(days)
    if first_origin is None:
        start = F.lit(window)
        ranked = pos.withColumn("_start", start)
    else:
        begins = pos.filter(F.col("day") >= F.lit(first_origin)).groupBy("series_id").agg(
            F.greatest(F.min("pos"), F.lit(window)).alias("_start"))
        ranked = pos.join(begins, "series_id")
    keep = (F.col("pos") >= F.col("_start")) & ((F.col("pos") - F.col("_start")) % step == 0)
    if last_origin is not None:
        keep = keep & (F.col("day") <= F.lit(last_origin))
    return ranked.filter(keep).select("series_id", F.col("day").alias("origin"), "pos")


def walk_forward(days: DataFrame, window: int, step: int = 1,
                 first_origin: dt.date | None = None, last_origin: dt.date | None = None
                 ) -> DataFrame:
    """V1. (series_id, origin, train_start, train_end, n_train).

    Training days are exactly the ``window`` rows before the origin; two equi-joins on
    position find their ends, no range join.
    """
    pos = positions(days)
    o = origins(days, window, step, first_origin, last_origin)
    for name, offset in (("train_start", window), ("train_end", 1)):
        edge = pos.select("series_id", F.col("day").alias(name),
                          (F.col("pos") + offset).alias("pos"))
        o = o.join(edge, ["series_id", "pos"])
    return o.select("series_id", "origin", "train_start", "train_end",
                    F.lit(window).alias("n_train"))


def split_membership(days: DataFrame, window: int, step: int = 1,
                     first_origin: dt.date | None = None, last_origin: dt.date | None = None
                     ) -> DataFrame:
    """V1 in long form: (series_id, origin, day, role) with role train or test.

    Each origin lists the positions of its window, so the match is an equi-join.
    """
    pos = positions(days)
    o = origins(days, window, step, first_origin, last_origin)
    wanted = o.select("series_id", "origin", F.col("pos").alias("_origin_pos"), F.explode(
        F.sequence(F.col("pos") - window, F.col("pos"))).alias("pos"))
    role = F.when(F.col("pos") == F.col("_origin_pos"), "test").otherwise("train")
    return wanted.join(pos, ["series_id", "pos"]).select("series_id", "origin", "day",
                                                         role.alias("role"))


def require_before(validation: DataFrame, test: DataFrame) -> None:
    """V3. max(validation) < min(test) for every series; an empty side is an error."""
    refuse_any(order_report(validation, test).filter("not ordered"),
               "the validation window must end strictly before the test window")
    if validation.limit(1).count() == 0 or test.limit(1).count() == 0:
        raise CheckFailed("validation and test days must both be non-empty")


def order_report(validation: DataFrame, test: DataFrame) -> DataFrame:
    """V3. Per series: end of validation, start of test, and whether they are ordered."""
    v = validation.groupBy("series_id").agg(F.max("day").alias("validation_end"))
    t = test.groupBy("series_id").agg(F.min("day").alias("test_start"))
    return v.join(t, "series_id", "full").withColumn(
        "ordered", F.coalesce(F.col("validation_end") < F.col("test_start"), F.lit(False)))


def _from_end(days: DataFrame) -> DataFrame:
    """Adds ``_rank`` (1 = last day) and ``_n`` (days in the series)."""
    pos = positions(days)
    n = pos.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    return pos.join(n, "series_id").withColumn("_rank", F.col("_n") - F.col("pos"))


def carve_validation(days: DataFrame, n: int) -> DataFrame:
    """V4. Adds ``role``: the trailing ``n`` days are validation, the others fit."""
    if n <= 0:
        raise ValueError("validation days must be a positive number")
    ranked = _from_end(days)
    guard = F.when(F.col("_n") <= n, F.raise_error(
        F.lit("validation days must be fewer than the training days")))
    return ranked.select(*SERIES_DAY, F.coalesce(
        guard, F.when(F.col("_rank") <= n, "validation").otherwise("fit")).alias("role"))


def interpretation_window(days: DataFrame, boundary: dt.date, n: int) -> DataFrame:
    """V5. The last ``n`` days strictly before ``boundary``; short or gappy windows raise."""
    picked = _from_end(days.filter(F.col("day") < F.lit(boundary))).filter(F.col("_rank") <= n)
    stats = picked.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("_span"))
    guard = F.when(F.col("_rows") < n, F.raise_error(F.lit("fewer days than the window needs"))
                   ).when(F.col("_span") != n, F.raise_error(F.lit("the window has gaps")))
    return picked.select(*SERIES_DAY).join(stats, "series_id").withColumn(
        "n_days", F.coalesce(guard, F.col("_rows"))).select(*SERIES_DAY, "n_days")


def overlap_report(train: DataFrame, explained: DataFrame) -> DataFrame:
    """V6. Per series: shared days, end of training, first explained day."""
    shared = (
        train.select(*SERIES_DAY, F.lit(1).alias("t"), F.lit(0).alias("e"))
        .unionAll(explained.select(*SERIES_DAY, F.lit(0), F.lit(1)))
        .groupBy(*SERIES_DAY).agg(F.max("t").alias("t"), F.max("e").alias("e"))
    )
    return shared.groupBy("series_id").agg(
        F.count_if((F.col("t") == 1) & (F.col("e") == 1)).alias("shared_days"),
        F.max(F.when(F.col("t") == 1, F.col("day"))).alias("train_end"),
        F.min(F.when(F.col("e") == 1, F.col("day"))).alias("first_explained"),
    ).withColumn("disjoint", (F.col("shared_days") == 0)
                 & (F.col("train_end") < F.col("first_explained")))


def require_disjoint(train: DataFrame, explained: DataFrame) -> None:
    refuse_any(overlap_report(train, explained).filter("not coalesce(disjoint, false)"),
               "explained days must be strictly unseen in training")


def refit_starts(days: DataFrame, every_n: int, day: str = "train_end") -> DataFrame:
    """V7. (series_id, block, block_start, block_end): when a full refit happens.

    A refit is due once ``every_n`` calendar days have passed since the last one, which on a
    calendar with gaps depends on the previous refit; the fold keeps refit days only and runs
    over one series' sorted training-end days (bounded by its calendar).
    """
    sorted_days = days.groupBy("series_id").agg(F.array_sort(F.collect_set(day)).alias("_days"))
    fold = F.aggregate(
        F.col("_days"), F.expr("cast(array() as array<date>)"),
        lambda refits, d: F.when(
            F.coalesce(F.datediff(d, F.try_element_at(refits, F.lit(-1))) >= every_n, F.lit(True)),
            F.concat(refits, F.array(d))).otherwise(refits))
    starts = sorted_days.select("series_id", F.array_max("_days").alias("_last"),
                                F.posexplode(fold).alias("block", "block_start"))
    w = Window.partitionBy("series_id").orderBy("block")
    return starts.select(
        "series_id", "block", "block_start",
        F.coalesce(F.date_sub(F.lead("block_start").over(w), 1), F.col("_last")).alias("block_end"))


def refit_blocks(splits: DataFrame, every_n: int) -> DataFrame:
    """V7. Adds ``block`` and ``refit`` (first origin of a block) to walk-forward splits.

    Every origin still gets a forecast; only the fit is reused inside a block.
    """
    starts = refit_starts(splits, every_n)
    covered = starts.select(
        "series_id", "block", "block_start",
        F.explode(F.expr("sequence(block_start, block_end, interval 1 day)")).alias("train_end"))
    return splits.join(covered, ["series_id", "train_end"]).withColumn(
        "refit", F.col("train_end") == F.col("block_start")).drop("block_start")


def tuning_window(days: DataFrame, validation_days: int, window: int) -> DataFrame:
    """V8. Adds ``role``: validation, the ``window`` fit days before it, or unused."""
    ranked = _from_end(days)
    role = (
        F.when(F.col("_rank") <= validation_days, "validation")
        .when(F.col("_rank") <= validation_days + window, "fit").otherwise("unused"))
    return ranked.select(*SERIES_DAY, role.alias("role"))


def ood_report(live: DataFrame, frozen: DataFrame) -> DataFrame:
    """V9. Per series: first live day against the last training day of the frozen model."""
    first = live.groupBy("series_id").agg(F.min(F.to_date("ts")).alias("live_start"))
    return first.join(frozen.select("series_id", "frozen_on"), "series_id").withColumn(
        "out_of_sample", F.col("live_start") > F.col("frozen_on"))


def require_ood(live: DataFrame, frozen: DataFrame) -> None:
    refuse_any(ood_report(live, frozen).filter("not out_of_sample"),
               "the live window overlaps the training window")


def validate_range(first: dt.date | None, last: dt.date | None) -> None:
    """V10. An inverted range would run zero origins and look like success."""
    if first is not None and last is not None and last < first:
        raise ValueError(f"origin range is inverted: {last} is before {first}")


def role_days(roles: DataFrame, role: str | Column) -> DataFrame:
    return roles.filter(F.col("role") == role).select(*SERIES_DAY)
