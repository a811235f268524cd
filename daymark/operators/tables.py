"""Result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.functions.exprs import ratio
from daymark.operators.ordered import attach
from daymark.operators.quality import complete_models, refuse_any
from daymark.operators.quantiles import quantiles
from daymark.operators.scoring import all_metrics, daily_baseload

TARGETS = ("hourly", "daily-direct", "daily-aggregated")
METRICS = ["mae", "rmse", "smape", "rmae"]


def canonical_table(hourly: DataFrame, daily_direct: DataFrame, models: Sequence[str],
                    strict: bool = False) -> DataFrame:
    """A15. model x target x metric, in fixed order; an absent arm stays as NULLs.

    ``hourly`` also yields the aggregated daily arm. Strict mode refuses daily models that do
    not share the same origins.
    """
    if strict:
        per_day = daily_direct.groupBy("series_id", "origin").agg(
            F.count_distinct("model").alias("n"))
        want = daily_direct.select("series_id", "model").distinct().groupBy("series_id").agg(
            F.count(F.lit(1)).alias("want"))
        refuse_any(per_day.join(want, "series_id").filter("n <> want"),
                   "daily models cover different origins")
    by = ["series_id", "model"]
    arms = [
        ("hourly", all_metrics(hourly, by)),
        ("daily-direct", all_metrics(daily_direct, by, daily=True)),
        ("daily-aggregated", all_metrics(daily_baseload(hourly), by, daily=True)),
    ]
    found = None
    for target, frame in arms:
        part = frame.select(*by, F.lit(target).alias("target"), *METRICS)
        found = part if found is None else found.unionByName(part)
    # The fixed model x target layout is a literal list exploded per series, not a join of data.
    layout = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(t).alias("target"),
                 F.lit(i * len(TARGETS) + j).alias("position"))
        for i, m in enumerate(models) for j, t in enumerate(TARGETS)])
    spine = hourly.select("series_id").distinct().select("series_id", F.inline(layout))
    return spine.join(found, [*by, "target"], "left").select(
        *by, "target", *METRICS, "position").orderBy("series_id", "position")


def ood_summary(live: DataFrame, reference: DataFrame, by: Sequence[str] = ("model",)
                ) -> DataFrame:
    """A16. Live metrics next to the in-era ones, with the degradation ratio, by rMAE.

    Both inputs are metric tables (one row per model).
    """
    era = reference.select(*by, F.col("mae").alias("mae_era"), F.col("rmae").alias("rmae_era"))
    out = live.select(*by, "mae", "rmse", F.col("smape_safe").alias("smape"), "rmae").join(
        era, list(by), "left")
    return out.withColumn("mae_ratio", ratio(F.col("mae"), F.col("mae_era"))).orderBy("rmae")


def published_comparison(ours: DataFrame, published: DataFrame, printed: DataFrame,
                         tolerance: float = 0.005) -> DataFrame:
    """A17. Own metrics, printed constants and recomputed published metrics in one table.

    ``ours`` and ``published`` are forecast frames, ``printed`` is (model, rmae, mae, mape,
    smape, rmse). ``drift`` is set when print and recomputation differ in MAE.
    """
    cols = ["model", "source", "rmae", "mae", "smape", "rmse", "mape", "drift"]
    none = F.lit(None).cast("double")
    own = all_metrics(ours, ["model"]).select(
        "model", F.lit("own").alias("source"), "rmae", "mae", "smape", "rmse", none.alias("mape"),
        F.lit(None).cast("boolean").alias("drift"))
    again = all_metrics(published, ["model"])
    drift = again.select("model", F.col("mae").alias("_again")).join(
        printed.select("model", F.col("mae").alias("_print")), "model").select(
        "model", (F.abs(F.col("_again") - F.col("_print")) > tolerance).alias("drift"))
    paper = printed.join(drift, "model").withColumn("source", F.lit("printed"))
    recomputed = again.withColumn("mape", none).join(drift, "model").withColumn(
        "source", F.lit("recomputed"))
    return own.select(*cols).unionByName(paper.select(*cols)).unionByName(
        recomputed.select(*cols)).orderBy("rmae", "model", "source")


def checkpoint_table(own: DataFrame, published: DataFrame, truth: DataFrame,
                     strict: bool = False) -> DataFrame:
    """A19. Published and own models on identical hours, ordered by MAE.

    Own models lacking an hour of ``truth`` are left out, or refused in strict mode.
    """
    kept = complete_models(own, truth, strict).withColumn("source", F.lit("own"))
    both = kept.unionByName(published.withColumn("source", F.lit("published")))
    hours = truth.select("series_id", "origin", "hour")
    same = both.join(hours, ["series_id", "origin", "hour"], "left_semi")
    return all_metrics(same, ["source", "model"]).orderBy("mae")


def mae_by_year(frame: DataFrame, years: Sequence[int]) -> DataFrame:
    """A20. MAE per model for each year, and the change from the first to the last."""
    error = F.abs(F.col("y_true") - F.col("y_pred"))
    out = frame.groupBy("model").agg(*[
        F.avg(F.when(F.year("origin") == y, error)).alias(f"mae_{y}") for y in years])
    return out.withColumn("change", F.col(f"mae_{years[-1]}") - F.col(f"mae_{years[0]}"))


def top_decile_bias(daily: DataFrame, q: float = 0.9) -> DataFrame:
    """A21. Mean (forecast - actual) over the days whose baseload reaches the q-quantile.

    The quantile is exact, by counting passes.
    """
    keys = ["series_id", "model"]
    cut = quantiles(daily, "y_true", {"_cut": q}, keys)
    top = attach(daily, cut, keys, "origin").filter("y_true >= _cut")
    return top.groupBy(*keys).agg(
        F.avg(F.col("y_pred") - F.col("y_true")).alias("bias"),
        F.count(F.lit(1)).alias("n_days"))


def case_day(daily: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A22. The day with the highest prediction; no outcome is used. First day on a tie."""
    keys = ["series_id", "model"]
    out = daily.groupBy(*keys).agg(F.max_by(
        F.struct("origin", "y_pred", "y_true"),
        F.struct(F.col("y_pred"), -F.datediff("origin", F.lit("1970-01-01").cast("date"))),
    ).alias("_d")).select(*keys, F.col("_d.origin").alias("origin"),
                          F.col("_d.y_pred").alias("y_pred"), F.col("_d.y_true").alias("y_true"))
    return out if labels is None else out.join(labels, ["series_id", "origin"], "left")


def day_report(frame: DataFrame) -> DataFrame:
    """A23. Per (series, model, day): both baseloads, the day's MAE, the worst hour, its error.

    Without known prices the actual side is NULL.
    """
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    known = F.count("y_true") == 24
    worst = F.max_by(F.struct(F.col("hour"), error.alias("error")),
                     F.struct(error, -F.col("hour")))
    out = frame.groupBy("series_id", "model", "origin").agg(
        F.avg("y_pred").alias("forecast_baseload"),
        F.when(known, F.avg("y_true")).alias("actual_baseload"),
        F.when(known, F.avg(error)).alias("mae"), F.when(known, worst).alias("_w"))
    return out.select(
        "series_id", "model", "origin", "forecast_baseload", "actual_baseload", "mae",
        F.col("_w.hour").alias("worst_hour"), F.col("_w.error").alias("worst_error"))


def ensemble_vs_best(metrics: DataFrame, ensembles: Sequence[str], reference: str = "naive",
                     by: Sequence[str] = ("series_id",)) -> DataFrame:
    """A24. Each ensemble's MAE against the best single model, the reference row excluded."""
    single = metrics.filter(~F.col("model").isin(*ensembles, reference)).groupBy(*by).agg(
        F.min("mae").alias("best_single"))
    return metrics.filter(F.col("model").isin(*ensembles)).join(single, list(by)).select(
        *by, "model", "mae", "best_single", (F.col("mae") - F.col("best_single")).alias("gap"))
