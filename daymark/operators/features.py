"""Leakage-free daily features.

A day is one row holding 24-slot vectors, so lags move one array per source column instead of
24 columns. Lags are calendar lags: a gap in the days yields NULL, never an older day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import HOUR_TAGS, HOURS, col, similar_day_lag
from daymark.operators.quality import refuse_any, require_unique_hours, with_day_hour

SERIES_DAY = ["series_id", "day"]
PRICE_LAGS = (1, 2, 3, 7)
EXOG_LAGS = (1, 7)
EXOG = ("exog_1", "exog_2")
WEEKDAYS = [f"dow_{i}" for i in range(7)]
TARGETS = [f"y_{tag}" for tag in HOUR_TAGS]
BLOCK_DAYS = 64


def day_number(day: str | Column) -> Column:
    return F.datediff(col(day), F.lit("1970-01-01").cast("date"))


def day_vectors(df: DataFrame, columns: Sequence[str] = ("price", *EXOG)) -> DataFrame:
    """F1. One row per (series, day): a 24-slot array per column, NULL where an hour is absent.

    Fixed-size conditional aggregates keep the buffer bounded however often an hour repeats;
    ``n_rows`` lets callers see repeats and holes.
    """
    df = with_day_hour(df)
    slots = [
        "array(" + ", ".join(f"max(case when hour = {h} then {c} end)" for h in HOURS) + f") as {c}"
        for c in columns]
    return df.groupBy(*SERIES_DAY).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.expr(x) for x in slots])


def daily_wide(df: DataFrame, columns: Sequence[str] = ("price", *EXOG),
               strict: bool = False) -> DataFrame:
    """F1. Flat form ``{column}_h00 .. {column}_h23``; strict mode refuses repeated hours."""
    if strict:
        require_unique_hours(df)
    return spread(day_vectors(df, columns), {c: c for c in columns})


def spread(df: DataFrame, vectors: dict[str, str], keep: Sequence[str] = SERIES_DAY) -> DataFrame:
    """Expand 24-slot arrays to flat columns named ``{prefix}_hNN``."""
    return df.select(*keep, *[
        F.expr(f"get(`{name}`, {h}) as `{prefix}_{tag}`")
        for name, prefix in vectors.items() for h, tag in zip(HOURS, HOUR_TAGS)
    ])


def calendar_lags(df: DataFrame, wanted: dict[str, tuple[str, int]], day: str = "day",
                  keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Add columns ``name -> (source, days back)`` looked up by calendar day.

    Days are cut into blocks with the last few days of a block repeated in the next, so the
    window holds at most one block of one series; a block is no shorter than the longest lag. One shuffle; no calendar spine needed
    because the frame is a range over day numbers.
    """
    reach = max(lag for _, lag in wanted.values())
    n, size = F.col("_n"), max(BLOCK_DAYS, reach)
    blocks = (
        df.withColumn("_n", day_number(day))
        .withColumn("_home", F.floor(n / size))
        .withColumn("_block", F.explode(
            F.when(F.pmod(n, F.lit(size)) >= size - reach,
                   F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    )
    base = Window.partitionBy(*keys, "_block").orderBy("_n")
    return (
        blocks.withColumns({
            name: F.first(source).over(base.rangeBetween(-lag, -lag))
            for name, (source, lag) in wanted.items()
        })
        .filter("_block = _home").drop("_n", "_home", "_block")
    )


def lag_name(column: str, lag: int) -> str:
    return f"{column}_D-{lag}" if lag else f"{column}_D0"


def price_lags(vectors: DataFrame, lags: Sequence[int] = PRICE_LAGS) -> DataFrame:
    """F2."""
    return calendar_lags(vectors, {lag_name("price", k): ("price", k) for k in lags})


def exog_lags(vectors: DataFrame, exog: Sequence[str] = EXOG,
              lags: Sequence[int] = EXOG_LAGS) -> DataFrame:
    """F3."""
    return calendar_lags(vectors, {lag_name(c, k): (c, k) for c in exog for k in lags})


def exog_current(vectors: DataFrame, exog: Sequence[str] = EXOG) -> DataFrame:
    """F4. The target day's own exogenous vectors: day-ahead forecasts, known at the origin."""
    return vectors.withColumns({lag_name(c, 0): F.col(c) for c in exog})


def weekday_flags(df: DataFrame, day: str = "day") -> DataFrame:
    """F5. ``dow_0`` (Monday) .. ``dow_6``."""
    return df.withColumns({
        name: (F.weekday(day) == i).cast("double") for i, name in enumerate(WEEKDAYS)})


def blocks_of(exog: Sequence[str] = EXOG, price_days: Sequence[int] = PRICE_LAGS,
              exog_days: Sequence[int] = EXOG_LAGS, current: bool = True) -> list[str]:
    """Names of the 24-slot feature blocks, in the fixed model order."""
    names = [lag_name("price", k) for k in price_days]
    for c in exog:
        names += [lag_name(c, k) for k in exog_days]
        if current:
            names.append(lag_name(c, 0))
    return names


def feature_names(blocks: Sequence[str] | None = None) -> list[str]:
    """Flat feature names in the fixed order: lag blocks first, weekday flags last."""
    blocks = blocks_of() if blocks is None else blocks
    return [f"{b}_{tag}" for b in blocks for tag in HOUR_TAGS] + WEEKDAYS


def _all_known(vectors: Sequence[str]) -> Column:
    ok = F.lit(True)
    for v in vectors:
        ok = ok & F.col(f"`{v}`").isNotNull() & ~F.exists(F.col(f"`{v}`"), lambda x: x.isNull())
    return ok


def build_features(df: DataFrame, exog: Sequence[str] = EXOG,
                   price_days: Sequence[int] = PRICE_LAGS, exog_days: Sequence[int] = EXOG_LAGS,
                   current: bool = True, need_label: bool = True) -> DataFrame:
    """F9. (series_id, day, x ARRAY, y ARRAY): every feature known, and every label unless
    ``need_label`` is false (the live case: tomorrow's prices do not exist yet).

    ``x`` follows :func:`feature_names`. No feature reads the target day's own price.
    """
    vectors = day_vectors(df, ("price", *exog))
    wanted = {lag_name("price", k): ("price", k) for k in price_days}
    wanted |= {lag_name(c, k): (c, k) for c in exog for k in exog_days}
    lagged = calendar_lags(vectors, wanted)
    if current:
        lagged = exog_current(lagged, exog)
    blocks = blocks_of(exog, price_days, exog_days, current)
    out = complete_cases(lagged, blocks, "price" if need_label else None)
    flags = F.array(*[(F.weekday("day") == i).cast("double") for i in range(7)])
    return out.select(
        *SERIES_DAY,
        F.concat(*[F.col(f"`{b}`") for b in blocks], flags).alias("x"),
        F.col("price").alias("y"))


def complete_cases(df: DataFrame, blocks: Sequence[str], label: str | None = "price") -> DataFrame:
    """F7. Keep a day only if every feature slot and every label slot is known."""
    return df.filter(_all_known([*blocks, *([label] if label else [])]))


def targets(features: DataFrame) -> DataFrame:
    """F6. ``y_h00 .. y_h23`` as flat columns."""
    return spread(features, {"y": "y"})


def flat_features(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Flat 247-column form of ``x``; only for the model boundary and inspection."""
    return features.select(
        *SERIES_DAY, *[F.expr(f"get(x, {i}) as `{name}`") for i, name in enumerate(names)])


def long_features(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(series_id, day, feature, value)."""
    labels = F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")")
    return features.select(*SERIES_DAY, F.posexplode("x").alias("_i", "value")).select(
        *SERIES_DAY, F.get(labels, F.col("_i")).alias("feature"), "value")


def vector_mean(c: str | Column) -> Column:
    """Mean of a 24-slot array, NULL unless all 24 slots are known."""
    c = col(c)
    known = (F.size(c) == 24) & ~F.exists(c, lambda x: x.isNull())
    return F.when(known, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / 24)


def daily_target(features: DataFrame, strict: bool = True) -> DataFrame:
    """F8. Baseload: unweighted mean of the 24 hours. A partial day is not a baseload."""
    out = features.select(*SERIES_DAY, vector_mean("y").alias("y_daily"))
    if strict:
        refuse_any(out.filter("y_daily is null").select(*SERIES_DAY),
                   "a day without 24 known prices has no baseload")
    return out


def daily_exog_mean(vectors: DataFrame, exog: Sequence[str] = EXOG) -> DataFrame:
    """F11. Daily mean of each target-day exogenous vector."""
    return vectors.select(*SERIES_DAY, *[vector_mean(c).alias(f"{c}_mean") for c in exog])


GROUP_ORDER = (*blocks_of(), "dow")


def feature_group(name: str | Column, blocks: Sequence[str] | None = None) -> Column:
    """F10. Feature name -> the block that generated it, or ``dow``.

    The names are looked up among those the blocks generate; any other fails the job.
    """
    name = col(name)
    blocks = blocks_of() if blocks is None else blocks
    pairs = [(f"{b}_{tag}", b) for b in blocks for tag in HOUR_TAGS]
    pairs += [(day, "dow") for day in WEEKDAYS]
    family = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    stranger = F.raise_error(F.concat(F.lit("no block generates a feature named "), name))
    return F.coalesce(F.try_element_at(family, name), stranger.cast("string"))


def sequence_pack(features: DataFrame, names: Sequence[str],
                  lags: Sequence[int] = (7, 3, 2, 1)) -> DataFrame:
    """F12. ``steps``: one 24-slot price vector per lag, oldest first; ``static``: the rest.

    Slices are found by feature name, never by position.
    """
    names = list(names)
    starts = []
    for k in lags:
        first = f"{lag_name('price', k)}_h00"
        if first not in names:
            raise ValueError(f"sequence_pack: no price block for lag {k}")
        starts.append(names.index(first))
    used = {s + h for s in starts for h in HOURS}
    static, run = [], []
    for i in range(len(names) + 1):
        if i < len(names) and i not in used:
            run.append(i)
        elif run:
            static.append(F.slice("x", run[0] + 1, len(run)))
            run = []
    return features.select(
        *SERIES_DAY,
        F.array(*[F.slice("x", s + 1, 24) for s in starts]).alias("steps"),
        F.concat(*static).alias("static"))


def _per_slot_stats(long: DataFrame, train: Column, keys: Sequence[str]) -> DataFrame:
    rows = long.filter(train)
    return rows.groupBy(*keys).agg(
        F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))


def standardize(long: DataFrame, train: Column, keys: Sequence[str] = ("series_id", "feature")
                ) -> DataFrame:
    """F13. (value - mean) / std with both taken from the training slice only.

    Population std; a constant column is divided by 1. The fitted ``_mean``/``_std`` stay on
    the row so :func:`unstandardize` can invert.
    """
    stats = _per_slot_stats(long, train, keys)
    joined = long.join(stats, list(keys))
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return joined.withColumn("_std", scale).withColumn(
        "scaled", (F.col("value") - F.col("_mean")) / F.col("_std"))


def unstandardize(scaled: DataFrame, column: str = "scaled") -> DataFrame:
    return scaled.withColumn("value", F.col(column) * F.col("_std") + F.col("_mean"))


#: 75% quantile of the standard normal; makes the MAD comparable to a standard deviation.
MAD_NORMAL = 0.6744897501960817


def asinh_median_fit(long: DataFrame, train: Column, keys: Sequence[str] = ("series_id", "feature")
                     ) -> DataFrame:
    """F14 fit: median and scaled MAD per key over the training rows.

    A group is one feature of one series over a training window, so its size is the window and
    plain joins on it stay even.
    """
    rows = long.filter(train)
    med = rows.groupBy(*keys).agg(F.median("value").alias("_med"))
    dev = rows.join(med, list(keys)).withColumn("_dev", F.abs(F.col("value") - F.col("_med")))
    return dev.groupBy(*keys).agg(
        F.first("_med").alias("_med"), (F.median("_dev") / MAD_NORMAL).alias("_mad"))


def asinh_median_apply(long: DataFrame, fit: DataFrame,
                       keys: Sequence[str] = ("series_id", "feature")) -> DataFrame:
    """F14 apply: asinh((x - median) / MAD); a zero MAD leaves the centred value unscaled."""
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(1.0)
    return long.join(fit, list(keys)).withColumn("_mad", scale).withColumn(
        "scaled", F.asinh((F.col("value") - F.col("_med")) / F.col("_mad")))


def asinh_median_invert(scaled: DataFrame, column: str = "scaled") -> DataFrame:
    return scaled.withColumn("value", F.sinh(column) * F.col("_mad") + F.col("_med"))


def ordered_vector(flat: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    """F15. ML vector in the fixed order; other or reordered feature columns are an error."""
    names = list(names)
    present = [c for c in flat.columns if c not in SERIES_DAY and not c.startswith("y_")]
    if present != names:
        raise ValueError("feature columns differ from the fitted order")
    if names[-7:] != WEEKDAYS:
        raise ValueError("the weekday flags must be the last seven features")
    # ML treats dots and dashes in names literally only through positional aliases.
    safe = [f"f{i}" for i in range(len(names))]
    renamed = flat.withColumnsRenamed(dict(zip(names, safe)))
    out = VectorAssembler(inputCols=safe, outputCol=output).transform(renamed)
    return out.drop(*safe)


def naive_source_day(day: str | Column) -> Column:
    day = col(day)
    return F.date_sub(day, similar_day_lag(day))
