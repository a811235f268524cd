"""Attribution tables (I1, I3-I11); those of trees come from ``boosting.attribute_trees``.

Attributions are long: (series_id, target, hour, day, feature, value, feature_value,
expected). ``target`` is ``hourly`` or ``daily``; ``hour`` is NULL on the daily arm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import HOURS
from daymark.operators.features import GROUP_ORDER, feature_group
from daymark.operators.ordered import attach
from daymark.operators.quality import refuse_any
from daymark.operators.quantiles import quantiles

MODEL = ["series_id", "target", "hour"]


def attribute_linear(long: DataFrame, coefs: DataFrame) -> DataFrame:
    """I1. Exact additive attribution ``coef * (x - training mean)`` of linear models.

    ``long`` is (series_id, day, feature, value); ``coefs`` is (series_id, target, hour,
    feature, coef, mean, expected). A join key (series, feature) holds one row per day.
    """
    model = coefs.groupBy("series_id", "feature").agg(F.collect_list(
        F.struct("target", "hour", "coef", "mean", "expected")).alias("_m"))
    rows = long.join(model, ["series_id", "feature"])
    return rows.select("series_id", "day", "feature", F.col("value").alias("feature_value"),
                       F.inline("_m")).select(
        *MODEL, "day", "feature",
        (F.col("coef") * (F.col("feature_value") - F.col("mean"))).alias("value"),
        "feature_value", "expected")


# ---- summaries --------------------------------------------------------------------------


def mean_abs(attr: DataFrame) -> DataFrame:
    """I3. Mean absolute attribution per feature of every model."""
    return attr.groupBy(*MODEL, "feature").agg(F.avg(F.abs("value")).alias("importance"))


def group_importance(attr: DataFrame) -> DataFrame:
    """I4. I3 summed by family; known families first in fixed order, none dropped."""
    grouped = mean_abs(attr).withColumn("family", feature_group("feature")).groupBy(
        *MODEL, "family").agg(F.sum("importance").alias("importance"))
    known = F.array(*[F.lit(g) for g in GROUP_ORDER])
    place = F.array_position(known, F.col("family"))
    return grouped.withColumn("position", F.when(place > 0, place).otherwise(len(GROUP_ORDER) + 1))


def family_by_hour(attr: DataFrame) -> DataFrame:
    """I5. Family x hour matrix of the hourly arm."""
    hourly = group_importance(attr.filter("target = 'hourly'"))
    return hourly.groupBy("series_id", "family").pivot("hour", HOURS).agg(F.first("importance"))


def importance_splits(attr: DataFrame, labels: DataFrame) -> DataFrame:
    """I6. Family importance over all, calm and stressed days; hourly (mean over the hours)
    and daily arm side by side. ``labels`` is (series_id, day, regime)."""
    rows = attr.join(labels, ["series_id", "day"])
    size = F.abs("value")
    pick = lambda r: F.avg(F.when(F.col("regime") == r, size))
    per_feature = rows.groupBy(*MODEL, "feature").agg(
        F.avg(size).alias("all"), pick("calm").alias("calm"), pick("stressed").alias("stressed"))
    per_family = per_feature.withColumn("family", feature_group("feature")).groupBy(
        *MODEL, "family").agg(*[F.sum(c).alias(c) for c in ("all", "calm", "stressed")])
    return per_family.groupBy("series_id", "family").agg(*[
        F.avg(F.when(F.col("target") == t, F.col(c))).alias(f"{t}_{c}")
        for t in ("hourly", "daily") for c in ("all", "calm", "stressed")])


def top_features(attr: DataFrame, hour: int, k: int = 20) -> DataFrame:
    """I7. The k most important features at one hour with attribution and value of every day.

    The ranking window holds one row per feature of a model.
    """
    at = attr.filter((F.col("target") == "hourly") & (F.col("hour") == hour))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(
        F.desc(F.round("importance", 9)), "feature"))
    best = mean_abs(at).withColumn("rank", rank).filter(F.col("rank") <= k)
    return at.join(best.select("series_id", "feature", "rank"), ["series_id", "feature"]).select(
        "series_id", "hour", "day", "feature", "rank", "value", "feature_value")


def case_study(attr: DataFrame, days: DataFrame, target: str = "daily") -> DataFrame:
    """I8. Attribution and feature value of one day per series; ``days`` is (series_id, day)."""
    return attr.filter(F.col("target") == target).join(
        days.select("series_id", "day"), ["series_id", "day"], "left_semi").select(
        "series_id", "day", "hour", "feature", "value", "feature_value")


def additivity(attr: DataFrame, predictions: DataFrame) -> DataFrame:
    """I9. Per model: largest gap between sum of attributions + expected value and prediction."""
    total = attr.groupBy(*MODEL, "day").agg(
        (F.sum("value") + F.first("expected")).alias("explained"))
    same = ((total["series_id"] == predictions["series_id"]) & (total["day"] == predictions["day"])
            & (total["target"] == predictions["target"])
            & total["hour"].eqNullSafe(predictions["hour"]))
    return total.join(predictions, same).select(
        total["series_id"], total["target"], total["hour"],
        F.abs(F.col("explained") - F.col("prediction")).alias("_gap")).groupBy(*MODEL).agg(
        F.count(F.lit(1)).alias("n_days"), F.max("_gap").alias("max_gap"))


def require_additive(attr: DataFrame, predictions: DataFrame, atol: float = 1e-6) -> None:
    refuse_any(additivity(attr, predictions).filter(F.col("max_gap") > atol),
               "attributions do not add up to the predictions")


def conservation(attr: DataFrame) -> DataFrame:
    """I10. Grouped and ungrouped importance totals per model; grouping must not change them."""
    flat = mean_abs(attr).groupBy(*MODEL).agg(F.sum("importance").alias("ungrouped"))
    grouped = group_importance(attr).groupBy(*MODEL).agg(F.sum("importance").alias("grouped"))
    same = ((flat["series_id"] == grouped["series_id"]) & (flat["target"] == grouped["target"])
            & flat["hour"].eqNullSafe(grouped["hour"]))
    return flat.join(grouped, same).select(flat["series_id"], flat["target"], flat["hour"],
                                           "ungrouped", "grouped")


def run_facts(days: DataFrame, train_days: DataFrame, threshold: float | Column) -> DataFrame:
    """I11. One summary row per series.

    ``days`` is (series_id, day, regime, y_true, y_pred) of the explained days, ``train_days``
    is (series_id, day). The bias is over the days whose baseload reaches the 0.9 quantile.
    """
    train = train_days.groupBy("series_id").agg(
        F.min("day").alias("train_start"), F.max("day").alias("train_end"),
        F.count(F.lit(1)).alias("n_train_days"))
    cut = quantiles(days, "y_true", {"_cut": 0.9}, ["series_id"])
    top = F.col("y_true") >= F.col("_cut")
    case = F.max_by(F.struct("day", "y_pred", "y_true", "regime"),
                    F.struct("y_pred", -F.datediff("day", F.lit("1970-01-01").cast("date"))))
    out = attach(days, cut, ["series_id"], "day").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_test_days"), F.min("day").alias("test_start"),
        F.max("day").alias("test_end"),
        F.count_if(F.col("regime") == "calm").alias("n_calm"),
        F.count_if(F.col("regime") == "stressed").alias("n_stressed"),
        F.avg(F.when(top, F.col("y_pred") - F.col("y_true"))).alias("top_decile_bias"),
        F.count_if(top).alias("n_top_decile"), case.alias("_c"))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return out.join(train, "series_id").select(
        "series_id", "n_test_days", "test_start", "test_end", "n_calm", "n_stressed",
        limit.alias("threshold"), "train_start", "train_end", "n_train_days",
        F.col("_c.day").alias("case_day"), F.col("_c.y_true").alias("case_baseload"),
        F.col("_c.y_pred").alias("case_prediction"), F.col("_c.regime").alias("case_regime"),
        "top_decile_bias", "n_top_decile")
