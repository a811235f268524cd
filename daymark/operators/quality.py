"""Cleaning, resampling and quality checks.

Checks come in pairs: a report (rows describing every violation) and a ``require_*`` wrapper
that raises on the first violation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import non_negative_root, ratio, unix_micros_ntz
from daymark.operators.ordered import attach
from daymark.session import materialize
from daymark.sources.series import fill_days, fill_hours

HOUR_MICROS = 3_600_000_000
SERIES_DAY = ["series_id", "day"]


class CheckFailed(ValueError):
    """A strict check found violations."""


def refuse_any(violations: DataFrame, message: str) -> None:
    """Raise with up to three examples when a report is not empty."""
    found = violations.limit(3).collect()
    if found:
        raise CheckFailed(f"{message}: e.g. {[r.asDict() for r in found]}")


def with_day_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``day`` and ``hour``; columns already there are kept, and with them the partitioning."""
    if {"day", "hour"} <= set(df.columns):
        return df
    return df.withColumns({"day": F.to_date(ts), "hour": F.hour(ts)})


# ---- ingest -----------------------------------------------------------------------------


def trim_trailing_nulls(df: DataFrame, value: str = "price") -> DataFrame:
    """Q1. Remove only the trailing run of NULLs of a series; interior NULLs stay."""
    last = df.groupBy("series_id").agg(
        F.max(F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_last"))
    return attach(df, last, ["series_id"], "ts").filter("ts <= _last").drop("_last")


def with_steps(points: DataFrame) -> DataFrame:
    """Adds ``step``, the microseconds since the point before it on the same day, and ``edges``.

    ``points`` has one row per (series, ts). Only the first point of a day has no step; it carries
    the day's first and last instant, so that steps across days need no second read.
    """
    day = Window.partitionBy(*SERIES_DAY).orderBy("us")
    whole = day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.col("us") - F.lag("us").over(day)
    edges = F.array("us", F.last("us").over(whole))
    timed = points.withColumns({"day": F.to_date("ts"), "us": unix_micros_ntz("ts")})
    return timed.withColumn("step", step).withColumn(
        "edges", F.when(F.col("step").isNull() & F.col("us").isNotNull(), edges))


def merge_steps(rows: DataFrame, n: Column, facts: dict[str, Column] | None = None) -> DataFrame:
    """(series_id, step, n, facts): all steps of a series, those across days included.

    ``n`` counts steps; ``facts`` are aggregates that merge under their own name. Every series has
    a row without a step, whose n is 0. What meets in one row is two instants a day and series.
    """
    facts = facts or {}
    merged = [c.alias(name) for name, c in facts.items()]
    parts = rows.groupBy("series_id", "step").agg(
        n.alias("n"), F.sort_array(F.flatten(F.collect_list("edges"))).alias("edges"), *merged)
    # Sorted edges read first, last, first, last: a step leads from each last to the next first.
    gaps = """filter(transform(edges, (x, i) -> if(i > 0 and i % 2 = 0, x - edges[i - 1], null)),
              x -> x is not null)"""
    counted = parts.select("series_id", *facts, F.posexplode(F.expr(
        f"concat(array(struct(step, n)), transform({gaps}, x -> struct(x as step, 1L as n)))")))
    return counted.select(
        "series_id", "col.step", "col.n",
        *[F.when(F.col("pos") == 0, F.col(name)).alias(name) for name in facts],
    ).groupBy("series_id", "step").agg(F.sum("n").alias("n"), *merged)


def feed_state(df: DataFrame, value: str = "price") -> DataFrame:
    """What Q2 and Q3 need of a feed, from one read: one row per (series, day, hour, step).

    ``n`` counts the steps, ``total`` and ``known`` are the sum and number of the values. A regular
    feed leaves one or two rows an hour; points of a day are ordered in a window that can spill.
    """
    points = df.groupBy("series_id", "ts").agg(
        F.sum(value).alias("total"), F.count(value).alias("known"))
    return with_steps(points).groupBy(*SERIES_DAY, F.hour("ts").alias("hour"), "step").agg(
        F.count("step").alias("n"), F.first("edges", ignorenulls=True).alias("edges"),
        F.sum("total").alias("total"), F.sum("known").alias("known"))


def step_counts(df: DataFrame) -> DataFrame:
    """(series_id, step in microseconds, n): spacing of consecutive distinct timestamps."""
    points = with_steps(df.select("series_id", "ts").distinct())
    return merge_steps(points, F.count("step")).filter("step is not null")


def modal_step() -> Column:
    """Most frequent step of a group of (step, n) rows, the smallest on a tie."""
    return F.min_by("step", F.when(F.col("step").isNotNull(), F.struct(-F.col("n"), F.col("step"))))


def points_of_step(step: Column) -> Column:
    """Points that an hour holds at this step, one where no step is known."""
    expected = F.when(step > HOUR_MICROS, 1).otherwise(
        F.greatest(F.lit(1), F.rint(HOUR_MICROS / step)))
    return F.coalesce(expected, F.lit(1)).cast("int")


def _expected(state: DataFrame) -> DataFrame:
    steps = merge_steps(state, F.sum("n")).groupBy("series_id").agg(modal_step().alias("step"))
    return steps.select("series_id", points_of_step(F.col("step")).alias("expected"))


def observations_per_hour(df: DataFrame) -> DataFrame:
    """Q2. Points a complete hour holds, from the modal step (smallest on a tie). One read."""
    value = F.lit(None).cast("double")
    return _expected(feed_state(df.select("series_id", "ts", value.alias("_value")), "_value"))


def resample_hourly(df: DataFrame, expected: DataFrame | None = None, value: str = "price"
                    ) -> DataFrame:
    """Q3. Hourly mean, NULL unless the hour holds every expected point.

    Hours between the first and last point that hold nothing appear as NULL. Without ``expected``
    the points of a complete hour are learned as in Q2; the feed is still read once, its state is
    written and both questions are answered from that.
    """
    state = feed_state(df.select("series_id", "ts", value), value)
    if expected is None:
        state = materialize(state, "feed-state")
        expected = _expected(state)
    hours = state.filter("day is not null").groupBy(*SERIES_DAY, "hour").agg(
        F.sum("total").alias("_sum"), F.sum("known").alias("_n"))
    full = fill_hours(hours, ["_sum", "_n"])
    complete = F.col("_n") >= F.col("expected")
    mean = ratio(F.col("_sum"), F.col("_n"))
    return attach(full, expected, ["series_id"], "ts").select(
        "series_id", "ts", F.when(complete, mean).alias(value))


def sum_components(parts: DataFrame, n_components: int, component: str = "component") -> DataFrame:
    """Q4. Sum of component series per timestamp; NULL when any component is missing.

    A component that overlapping loads brought twice counts once, with its known value.
    """
    single = parts.groupBy("series_id", "ts", component).agg(F.max("value").alias("value"))
    return single.groupBy("series_id", "ts").agg(
        F.when(F.count("value") == n_components, F.sum("value")).alias("value"))


def align_sources(price: DataFrame, load: DataFrame, renewables: DataFrame) -> DataFrame:
    """Q5. Hours present in all three sources, in the standard schema."""
    key = ["series_id", "ts"]
    return (
        price.select(*key, "price")
        .join(load.select(*key, F.col("value").alias("exog_1")), key)
        .join(renewables.select(*key, F.col("value").alias("exog_2")), key)
    )


def alignment_loss(price: DataFrame, aligned: DataFrame) -> DataFrame:
    """Q5. Per series: price hours, hours kept, hours lost."""
    return (
        price.select("series_id", "ts", F.lit(0).alias("_kept"))
        .unionAll(aligned.select("series_id", "ts", F.lit(1)))
        .groupBy("series_id")
        .agg(F.count_if(F.col("_kept") == 0).alias("price_hours"),
             F.sum("_kept").alias("kept_hours"))
        .withColumn("lost_hours", F.col("price_hours") - F.col("kept_hours"))
    )


def validate_upload(raw: DataFrame, required: Sequence[str] = ("price", "exog_1", "exog_2"),
                    time_column: str = "timestamp") -> DataFrame:
    """S9. Violations of an uploaded text table: (series_id, rule, detail, n).

    All value columns arrive as strings. The detail names the first offending value, or the
    modal spacing for a non-hourly table.
    """
    missing = [c for c in (time_column, *required) if c not in raw.columns]
    if missing:
        names = F.lit(", ".join(missing))
        return raw.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select(
            "series_id", F.lit("missing columns").alias("rule"), names.alias("detail"), "n")
    return _violations(raw, required, time_column)


def _violations(raw: DataFrame, required: Sequence[str], time_column: str) -> DataFrame:
    """Every rule of S9 from one read: facts per timestamp, then per step, then per series."""
    ts = F.expr(f"try_cast({time_column} as timestamp_ntz)")
    row = F.count(F.lit(1))
    wrong = {f"_{i}": F.col(name).isNotNull() & F.expr(f"try_cast({name} as double) is null")
             for i, name in enumerate(required)}
    text = {f"_{i}": F.col(name) for i, name in enumerate(required)}
    points = raw.select(
        "series_id", ts.alias("ts"), F.col(time_column).alias("_time"),
        *[F.when(bad, text[k]).alias(k) for k, bad in wrong.items()],
    ).groupBy("series_id", "ts").agg(
        row.alias("copies"), F.min("_time").alias("_time"),
        *[F.count(k).alias(f"n{k}") for k in wrong], *[F.min(k).alias(k) for k in wrong])
    timed, repeated = F.col("ts").isNotNull(), F.col("copies") > 1
    facts = with_steps(points).select(
        "series_id", "step", "edges",
        F.when(~timed, F.col("copies")).alias("n_bad"), F.when(~timed, F.col("_time")).alias("bad"),
        F.when(timed & repeated, 1).alias("n_dup"), F.when(timed & repeated, F.col("ts")).alias("dup"),
        *[f"n{k}" for k in wrong],
        *[F.when(F.col(k).isNotNull(), F.struct("ts", k)).alias(k) for k in wrong])
    sums = ["n_bad", "n_dup", *[f"n{k}" for k in wrong]]
    merge = {c: F.sum(c) for c in sums} | {c: F.min(c) for c in ("bad", "dup", *wrong)}
    steps = merge_steps(facts, F.count("step"), merge)
    series = steps.groupBy("series_id").agg(
        modal_step().alias("modal"), F.sum(F.when(F.col("step") != HOUR_MICROS, F.col("n"))).alias("n_odd"),
        *[c.alias(name) for name, c in merge.items()])
    spacing = F.concat((F.col("modal") / 1_000_000).cast("bigint").cast("string"), F.lit(" s"))
    rules = [("unparseable timestamp", F.col("bad"), "n_bad"),
             ("duplicate timestamp", F.col("dup").cast("string"), "n_dup"),
             *[(f"not numeric: {name}", F.col(f"_{i}")[f"_{i}"], f"n_{i}")
               for i, name in enumerate(required)],
             ("not hourly", spacing, "n_odd")]
    found = F.array(*[F.struct(F.lit(rule).alias("rule"), detail.alias("detail"),
                               F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias("n"))
                      for rule, detail, n in rules])
    return series.select("series_id", F.inline(found)).filter("n > 0")


# ---- series checks ----------------------------------------------------------------------


def missing_hours(df: DataFrame) -> DataFrame:
    """Q7. Hours absent between the first and last hour of a series."""
    return fill_hours(with_day_hour(df).select("series_id", "day", "hour").distinct(), []).filter(
        "not present").select("series_id", "ts")


def missing_hours_by_day(df: DataFrame) -> DataFrame:
    return missing_hours(df).groupBy("series_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("missing_hours"))


def quality_report(df: DataFrame, columns: Sequence[str] = ("price", "exog_1", "exog_2")
                   ) -> DataFrame:
    """Q6. One row per series: extent, holes, NULLs and the moments of the price.

    Missing hours are the span in hours minus the distinct hours seen, so one aggregation is
    enough. Distinct hours are counted per (series, hour) first.
    """
    p = F.col("price")
    hourly = df.groupBy("series_id", "ts").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        F.count(p).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss"),
        F.min(p).alias("lo"), F.max(p).alias("hi"), F.count_if(p < 0).alias("neg"),
    )
    agg = hourly.groupBy("series_id").agg(
        F.sum("rows").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("_hours"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in columns],
        F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("ss").alias("_ss"),
        F.min("lo").alias("min_price"), F.max("hi").alias("max_price"),
        F.sum("neg").alias("negative_hours"),
    )
    span = (unix_micros_ntz("last_ts") - unix_micros_ntz("first_ts")) / HOUR_MICROS + 1
    mean = ratio(F.col("_s"), F.col("_n"))
    var = F.when(F.col("_n") > 1, (F.col("_ss") - F.col("_s") * mean) / (F.col("_n") - 1))
    return agg.select(
        "series_id", "n_rows", "first_ts", "last_ts",
        (span - F.col("_hours")).cast("bigint").alias("missing_hours"),
        *[f"null_{c}" for c in columns],
        mean.alias("mean_price"), non_negative_root(var).alias("std_price"),
        "min_price", "max_price", "negative_hours",
        ratio(100.0 * F.col("negative_hours"), F.col("n_rows")).alias("negative_pct"),
    )


def duplicate_hours(df: DataFrame) -> DataFrame:
    """Q8. (series, day, hour) pairs with more than one observation."""
    return with_day_hour(df).groupBy("series_id", "day", "hour").agg(
        F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique_hours(df: DataFrame) -> DataFrame:
    refuse_any(duplicate_hours(df), "a (day, hour) pair is repeated (clock change or duplicate)")
    return df


def densify_days(daily: DataFrame) -> DataFrame:
    """Q9. Contiguous calendar per series; days without data become all-NULL rows."""
    return fill_days(daily, [c for c in daily.columns if c not in SERIES_DAY])


# ---- forecast-frame checks --------------------------------------------------------------


def member_coverage(df: DataFrame) -> DataFrame:
    """Q10. Violations of a member set: (series_id, model, rule, n).

    Rules: an origin without 24 rows; a repeated (origin, hour); an origin another member has
    and this one lacks.
    """
    cells = df.groupBy("series_id", "model", "origin", "hour").agg(F.count(F.lit(1)).alias("n"))
    origins = cells.groupBy("series_id", "model", "origin").agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("dupes"))
    torn = origins.filter("rows <> 24").groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("origin without 24 rows"))
    dupes = origins.filter("dupes > 0").groupBy("series_id", "model").agg(
        F.sum("dupes").alias("n")).withColumn("rule", F.lit("duplicate hour"))
    # A missing origin = origins of the series minus origins of the member; both are counts.
    total = origins.groupBy("series_id", "origin").agg(F.lit(1).alias("_o")).groupBy(
        "series_id").agg(F.count(F.lit(1)).alias("all_origins"))
    mine = origins.groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("my_origins"))
    absent = mine.join(total, "series_id").withColumn(
        "n", F.col("all_origins") - F.col("my_origins")).filter("n > 0").withColumn(
        "rule", F.lit("origin missing"))
    cols = ["series_id", "model", "rule", "n"]
    return torn.select(*cols).unionAll(dupes.select(*cols)).unionAll(absent.select(*cols))


def origin_set_difference(df: DataFrame, left: str, right: str) -> DataFrame:
    """Q10. Per series: origins only in ``left``, only in ``right`` and in both."""
    return (
        df.filter(F.col("model").isin(left, right))
        .groupBy("series_id", "origin")
        .agg(F.bool_or(F.col("model") == left).alias("l"),
             F.bool_or(F.col("model") == right).alias("r"))
        .groupBy("series_id")
        .agg(F.count_if(F.col("l") & ~F.col("r")).alias("only_left"),
             F.count_if(F.col("r") & ~F.col("l")).alias("only_right"),
             F.count_if(F.col("l") & F.col("r")).alias("in_both"))
    )


def truth_disagreements(df: DataFrame, atol: float = 1e-6) -> DataFrame:
    """Q11. (series, origin, hour) cells whose members disagree, or are not all present.

    Reports the number of members present, the spread of ``y_true`` and the number of NULLs;
    all members NULL counts as agreement.
    """
    n_models = df.select("series_id", "model").distinct().groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_all"))
    cells = df.groupBy("series_id", "origin", "hour").agg(
        F.count_distinct("model").alias("members"),
        (F.max("y_true") - F.min("y_true")).alias("spread"),
        F.count_if(F.col("y_true").isNull()).alias("null_truths"),
        F.count(F.lit(1)).alias("_n"),
    )
    mixed = (F.col("null_truths") > 0) & (F.col("null_truths") < F.col("_n"))
    return attach(cells, n_models, ["series_id"], "origin").filter(
        (F.col("members") < F.col("_all")) | (F.col("spread") > atol) | mixed
    ).select("series_id", "origin", "hour", "members", "spread", "null_truths")


def require_same_truth(df: DataFrame, atol: float = 1e-6) -> DataFrame:
    refuse_any(truth_disagreements(df, atol),
               "members do not share identical hours and realized prices")
    return df


def require_members(df: DataFrame) -> DataFrame:
    refuse_any(member_coverage(df), "members are incomplete or cover different origins")
    return df


def verify_alignment(ours: DataFrame, published: DataFrame, atol: float = 1e-6) -> DataFrame:
    """Q12. Per series: row counts, first timestamp in only one side, largest truth difference.

    Both inputs are (series_id, ts, y_true) with one row per timestamp.
    """
    cells = (
        ours.select("series_id", "ts", F.col("y_true").alias("a"), F.lit(None).cast("double").alias("b"),
                    F.lit(1).alias("na"), F.lit(0).alias("nb"))
        .unionAll(published.select("series_id", "ts", F.lit(None).cast("double"), "y_true",
                                   F.lit(0), F.lit(1)))
        .groupBy("series_id", "ts")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"),
             F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    )
    one_sided = (F.col("na") == 0) | (F.col("nb") == 0)
    out = cells.groupBy("series_id").agg(
        F.sum("na").alias("rows_ours"), F.sum("nb").alias("rows_published"),
        F.min(F.when(one_sided, F.col("ts"))).alias("first_mismatch"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"),
    )
    return out.withColumn(
        "aligned",
        (F.col("rows_ours") == F.col("rows_published")) & F.col("first_mismatch").isNull()
        & F.coalesce(F.col("max_diff") <= atol, F.lit(False)))


def require_aligned(ours: DataFrame, published: DataFrame, atol: float = 1e-6) -> None:
    refuse_any(verify_alignment(ours, published, atol).filter("not aligned"),
               "the two tables are not the same data")


def null_screen(df: DataFrame) -> DataFrame:
    """Q13. NULLs per (series, model) and column."""
    return df.groupBy("series_id", "model").agg(
        F.count_if(F.col("y_pred").isNull()).alias("null_pred"),
        F.count_if(F.col("y_true").isNull()).alias("null_true"))


def require_no_nulls(df: DataFrame) -> DataFrame:
    refuse_any(null_screen(df).filter("null_pred > 0 or null_true > 0"),
               "weights cannot be fitted on missing values")
    return df


def model_completeness(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Q14. Per (series, model): truth hours without a forecast.

    ``truth`` is (series_id, origin, hour); counting both sides avoids a join of all models
    with all hours.
    """
    total = truth.groupBy("series_id").agg(F.count(F.lit(1)).alias("truth_hours"))
    matched = (
        preds.filter("y_pred is not null")
        .join(truth.select("series_id", "origin", "hour"), ["series_id", "origin", "hour"],
              "left_semi")
        .groupBy("series_id", "model", "origin", "hour").agg(F.lit(1).alias("_x"))
        .groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("covered_hours"))
    )
    named = preds.select("series_id", "model").distinct()
    return named.join(matched, ["series_id", "model"], "left").join(total, "series_id").select(
        "series_id", "model",
        F.coalesce("covered_hours", F.lit(0)).alias("covered_hours"), "truth_hours",
    ).withColumn("missing_hours", F.col("truth_hours") - F.col("covered_hours")).withColumn(
        "complete", F.col("missing_hours") == 0)


def complete_models(preds: DataFrame, truth: DataFrame, strict: bool = False) -> DataFrame:
    """Q14. Forecasts of complete models only; strict mode raises instead of skipping."""
    report = model_completeness(preds, truth)
    if strict:
        refuse_any(report.filter("not complete"), "these models are not ready")
    keep = report.filter("complete").select("series_id", "model")
    return attach(preds, keep, ["series_id", "model"], "origin")


# ---- live day ---------------------------------------------------------------------------


def forecastable_days(df: DataFrame, exog: Sequence[str] = ("exog_1", "exog_2"),
                      lag_days: int = 7) -> DataFrame:
    """Q15. Days with 24 rows and complete exogenous columns, preceded by 7 such days.

    The day's price is not required. The look-back runs over one row per day.
    """
    known = F.lit(True)
    for c in exog:
        known = known & F.col(c).isNotNull()
    usable = (
        with_day_hour(df).groupBy(*SERIES_DAY)
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_and(known).alias("_ok"))
        .filter("_n = 24 and _ok")
        .withColumn("_k", F.datediff("day", F.lit("1970-01-01").cast("date")))
    )
    w = Window.partitionBy("series_id").orderBy("_k").rangeBetween(-lag_days, -1)
    return usable.withColumn("_prev", F.count(F.lit(1)).over(w)).filter(
        F.col("_prev") == lag_days).select(*SERIES_DAY)


def history_window(days: DataFrame, longest_lag: int = 7, margin_days: int = 3) -> DataFrame:
    """Q16. Range to request so that ``day`` is forecastable; ends on the day itself."""
    return days.select(
        *SERIES_DAY,
        F.date_sub("day", longest_lag + 1 + margin_days).alias("start_day"),
        F.col("day").alias("end_day"))


def origin_span(df: DataFrame, by: Sequence[str] = ("series_id", "model")) -> DataFrame:
    """Q17. Number of origins, first and last."""
    return df.groupBy(*by, "origin").agg(F.lit(1).alias("_x")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_origins"),
        F.min("origin").alias("first_origin"), F.max("origin").alias("last_origin"))
