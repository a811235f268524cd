"""The three main flows: walk-forward forecasting, ensemble study, live day.

Stage results that several later steps read are written once to the shared folder; everything
between two stages is one lazy plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.operators import comparison, ensemble, models, naive, quality, scoring, splits, tables
from daymark.operators.features import build_features
from daymark.session import materialize
from daymark.sources import forecasts
from daymark.sources.hourly import flatten_payload


def walk_forward_run(hourly: DataFrame, path: str, fit_predict: models.FitPredict, model: str,
                     window: int, refit_every: int = 1, first_origin: dt.date | None = None,
                     last_origin: dt.date | None = None) -> DataFrame:
    """Features -> splits -> resume -> fit and predict -> store; returns the stored forecasts.

    Origins already stored with all 24 hours are not run again; torn ones are run and replaced.
    """
    splits.validate_range(first_origin, last_origin)
    features = materialize(build_features(hourly), "features")
    planned = splits.origins(features, window, 1, first_origin, last_origin).select(
        "series_id", "origin").withColumn("model", F.lit(model))
    spark = hourly.sparkSession
    done = _stored(spark, path)
    todo = planned if done is None else forecasts.remaining_origins(planned, done)
    fresh = models.run_walk_forward(features, fit_predict, model, window, refit_every,
                                    first_origin, last_origin, todo=todo)
    if done is not None:
        # Finish the read of the old partitions before any of them is replaced.
        fresh = materialize(fresh, "fresh")
    # Origins are (model, origin) partitions shared by all series: rewrite a touched partition
    # with the rows other series already have in it.
    if done is not None:
        touched = fresh.select("model", "origin").distinct()
        keys = ["series_id", "model", "origin"]
        kept = done.join(touched, ["model", "origin"], "left_semi").join(
            fresh.select(*keys).distinct(), keys, "left_anti")
        fresh = materialize(fresh.unionByName(kept), "merged")
    forecasts.write_forecasts(fresh, path)
    return forecasts.load_long(spark, path)


def _stored(spark, path: str) -> DataFrame | None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return forecasts.load_long(spark, path) if exists else None


@dataclass(frozen=True)
class EnsembleStudy:
    threshold: DataFrame
    static_weights: DataFrame
    regime_weights: DataFrame
    forecasts: DataFrame
    metrics: DataFrame
    against_best: DataFrame
    regime_split: DataFrame


def ensemble_study(train: DataFrame, validation: DataFrame, test: DataFrame,
                   members: Sequence[str], min_days: int = 20) -> EnsembleStudy:
    """Threshold and both weight sets from earlier windows, applied to and scored on the test.

    ``train`` is hourly prices from before the validation window; the frames are long. The
    members are checked first: complete, same origins, same realized prices.
    """
    own = lambda f: f.filter(F.col("model").isin(*members))
    val, tst = materialize(own(validation), "validation"), materialize(test, "test")
    for frame in (val, own(tst)):
        quality.require_members(frame)
        quality.require_same_truth(frame)
    quality.require_no_nulls(val)
    test_days = tst.select("series_id", F.col("origin").alias("day")).distinct()
    threshold = materialize(ensemble.regime_threshold(train, val, min_days=min_days), "threshold")
    static = materialize(ensemble.fit_weights(val, members, test_days=test_days), "static")
    regime = materialize(ensemble.fit_regime_weights(
        val, members, threshold, min_days, test_days), "regime")
    static_run = ensemble.combine(own(tst), static, "static")
    regime_run = ensemble.combine_by_regime(own(tst), regime, threshold, "regime")
    both = materialize(static_run.unionByName(regime_run), "ensembles")
    metrics = scoring.all_metrics(tst.unionByName(both.select(*tst.columns)), ["series_id", "model"])
    return EnsembleStudy(
        threshold, static, regime, both, metrics,
        tables.ensemble_vs_best(metrics, ("static", "regime")),
        comparison.dm_regime_split(both, "regime", "static", threshold))


def live_hours(price: DataFrame, load: DataFrame, renewables: DataFrame, n_components: int
               ) -> DataFrame:
    """Landed payload files -> aligned hourly series in the standard schema.

    ``price`` and ``load`` are (series_id, body) JSON payloads, ``renewables`` has one payload
    per component. A partial hour stays NULL; only the unpublished tail of the price is cut.
    """
    points = quality.trim_trailing_nulls(flatten_payload(price, "body").withColumnRenamed(
        "value", "price"))
    schema = "production_type STRING, unix_seconds ARRAY<BIGINT>, forecast_values ARRAY<DOUBLE>"
    parts = flatten_payload(renewables, "body", "forecast_values", schema)
    total = quality.sum_components(parts, n_components, "production_type")
    demand = flatten_payload(load, "body", "forecast_values", schema)
    hourly = lambda df, c: quality.resample_hourly(df, value=c)
    return quality.align_sources(
        hourly(points, "price"), hourly(demand, "value"), hourly(total, "value"))


def live_day(hourly: DataFrame, day: dt.date) -> DataFrame:
    """Forecast one day with the reference rule and report it; the actual side may be NULL."""
    return tables.day_report(naive.forecast_day(hourly, day))
