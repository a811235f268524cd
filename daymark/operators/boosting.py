"""Boosted trees for many series (M7, M8, M10-M13, I2): fits, forecasts, storage, certificates.

Every (series, run of refit blocks) or (series, part of the targets) is one task's work, and no
task holds more than a training window and a run of days. Models travel as rows, one per series
and target, and meet the days they score by (series, run): nothing is broadcast or collected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import asdict, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.operators.features import SERIES_DAY, day_number, vector_mean
from daymark.operators.models import DAILY, LONG, _stack, final_window, run_blocks, run_rows
from daymark.operators.naive import day_inputs, with_actuals
from daymark.operators.trees import Boosted, Cuts, Paths, TreeParams, fit_boosted

ARMS = ("hourly", "daily")
MODELS = ("series_id string, target string, hour int, base double, depth int, rate double, "
          "feature array<int>, threshold array<double>, value array<double>, cover array<bigint>")
SCORES = "series_id string, target string, hour int, origin date, y_true double, y_pred double"
ATTRIBUTION = ("series_id string, target string, hour int, day date, feature string, "
               "value double, feature_value double, expected double")
#: Days of a series that are scored in one task.
RUN_DAYS = 364


def with_daily(features: DataFrame) -> DataFrame:
    """The 24 labels and, as a 25th, the baseload."""
    return features.withColumn("y", F.concat("y", F.array(vector_mean("y"))))


def _targets(arms: Sequence[str]) -> list[int]:
    unknown = set(arms) - set(ARMS)
    if unknown or not arms:
        raise ValueError(f"arms are {ARMS}, not {sorted(unknown)}")
    return [*(range(24) if "hourly" in arms else ()), *([24] if "daily" in arms else ())]


def _name(target: int) -> tuple[str, int | None]:
    return ("hourly", target) if target < 24 else ("daily", None)


# ---- walk-forward -----------------------------------------------------------------------


def gbt_walk_forward(features: DataFrame, window: int, refit_every: int,
                     params: TreeParams | DataFrame = TreeParams(), daily: bool = False,
                     first_origin: dt.date | None = None, last_origin: dt.date | None = None,
                     model: str = "gbt", todo: DataFrame | None = None,
                     run_days: int | None = None) -> DataFrame:
    """M7/M8 refitted through the calendar, per series: every ``refit_every`` days on the
    ``window`` days before. All hours of a block are fitted together.

    ``params`` may be a table (series_id and the fields of ``TreeParams``), as a search finds
    them; a series without a row there is left out.
    """
    rows = run_rows(features, window, refit_every, first_origin, last_origin, todo, run_days)
    if daily:
        rows = rows.withColumn("y", F.array(vector_mean("y")))
    names = [f.name for f in fields(TreeParams)]
    if isinstance(params, DataFrame):
        rows = rows.join(params.select("series_id", F.struct(*names).alias("_params")), "series_id")
    else:
        rows = rows.withColumn("_params", F.struct(
            *[F.lit(v).alias(k) for k, v in asdict(params).items()]))

    def one_block(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        own = TreeParams(**{k: train["_params"].iloc[0][k] for k in names})
        fit = fit_boosted(Cuts(_stack(train["x"]), own.bins), _stack(train["y"]), own)
        truth, pred = _stack(test["y"]), fit.predict(_stack(test["x"]))
        width = truth.shape[1]
        out = pd.DataFrame({
            "series_id": np.repeat(test["series_id"].to_numpy(), width),
            "origin": np.repeat(test["day"].to_numpy(), width),
            "hour": np.tile(np.arange(width, dtype=np.int32), len(test)),
            "y_true": truth.ravel(), "y_pred": pred.ravel(), "model": model})
        return out.drop(columns="hour") if daily else out

    out = run_blocks(rows, window, one_block, DAILY if daily else LONG)
    return out if todo is None else out.join(
        todo.select("series_id", "origin"), ["series_id", "origin"], "left_semi")


# ---- models as rows ---------------------------------------------------------------------


def _to_rows(series_id: str, targets: Sequence[int], fit: Boosted, params: TreeParams
             ) -> pd.DataFrame:
    return pd.DataFrame([{
        "series_id": series_id, "target": _name(t)[0], "hour": _name(t)[1],
        "base": float(fit.base[j]), "depth": params.depth, "rate": params.rate,
        "feature": fit.feature[j].ravel().tolist(),
        "threshold": fit.threshold[j].ravel().tolist(), "value": fit.value[j].ravel().tolist(),
        "cover": fit.cover[j].ravel().tolist()} for j, t in enumerate(targets)]).astype(
        {"hour": "Int32"})


def _from_rows(rows: pd.DataFrame) -> Boosted:
    """One ensemble of the rows, which have the same shape."""
    depth = int(rows["depth"].iloc[0])
    inner, m = (1 << depth) - 1, len(rows)
    part = lambda c, width: np.array(rows[c].tolist()).reshape(m, -1, width)
    return Boosted(rows["base"].to_numpy(float), part("feature", inner).astype(int),
                   part("threshold", inner), part("value", inner + 1), part("cover", inner + 1))


def fit_gbt(train: DataFrame, params: TreeParams = TreeParams(), arms: Sequence[str] = ARMS,
            targets_per_task: int = 5) -> DataFrame:
    """M7/M8. One row per series and target: the trees fitted on all days of ``train``.

    ``train`` is a bounded window per series (see ``final_window``). Fewer targets a task
    spread one series over more tasks, each of which gets the window.
    """
    wanted = _targets(arms)
    parts = [wanted[i:i + targets_per_task] for i in range(0, len(wanted), targets_per_task)]
    rows = with_daily(train).select(
        *SERIES_DAY, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("part"))

    def one_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        at = parts[int(pdf["part"].iloc[0])]
        fit = fit_boosted(Cuts(_stack(pdf["x"]), params.bins), _stack(pdf["y"])[:, at], params)
        return _to_rows(pdf["series_id"].iloc[0], at, fit, params)

    return rows.groupBy("series_id", "part").applyInPandas(one_part, MODELS)


def _by_run(models: DataFrame, days: DataFrame, run_days: int):
    """Days and the models of their series, both keyed by (series, run of days)."""
    runs = days.withColumn("run", F.floor(day_number("day") / run_days))
    # Renamed on the way, as the two sides of a cogroup must not share columns.
    seen = runs.groupBy("series_id", F.col("run").alias("of_run")).agg(F.count("*")).select(
        "series_id", "of_run")
    return runs, models.join(seen, "series_id").withColumnRenamed("of_run", "run")


def score_gbt(models: DataFrame, live: DataFrame, run_days: int = RUN_DAYS) -> DataFrame:
    """Forecasts of every day by every model of its series: (series_id, target, hour, origin,
    y_true, y_pred). Labels may be unknown; a series without a model has no forecast."""
    days = live.select(*SERIES_DAY, "x", F.concat("y", F.array(vector_mean("y"))).alias("y"))
    runs, keyed = _by_run(models, days, run_days)

    def one_run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["series_id", "target", "hour", "origin", "y_true", "y_pred"])]
        if len(left) and len(right):
            x = _stack(left["x"])
            truth = np.array([[np.nan] * 25 if y is None else
                              [np.nan if v is None else v for v in y] for y in left["y"]], float)
            for _, rows in right.groupby("depth"):
                pred = _from_rows(rows).predict(x)
                for j, (arm, hour) in enumerate(zip(rows["target"], rows["hour"])):
                    at = 24 if arm == "daily" else int(hour)
                    out.append(pd.DataFrame({
                        "series_id": left["series_id"], "target": arm,
                        "hour": pd.array([None if at == 24 else at] * len(left), "Int32"),
                        "origin": left["day"], "y_true": truth[:, at], "y_pred": pred[:, j]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    scored = runs.groupBy("series_id", "run").cogroup(
        keyed.groupBy("series_id", "run")).applyInPandas(one_run, SCORES)
    return scored.withColumn("y_true", F.when(~F.isnan("y_true"), F.col("y_true")))


def arm_forecasts(scored: DataFrame, daily: bool = False, model: str = "gbt") -> DataFrame:
    """One arm of ``score_gbt`` as a long or a daily forecast frame."""
    keep = ["series_id", "origin", *([] if daily else ["hour"]), "y_true", "y_pred"]
    return scored.filter(F.col("target") == ("daily" if daily else "hourly")).select(
        *keep, F.lit(model).alias("model"))


# ---- freezing ---------------------------------------------------------------------------


def frozen_metadata(features: DataFrame, prices: DataFrame, window: int) -> DataFrame:
    """M10. One row per series: training span and the price level up to its end."""
    span = final_window(features, window).groupBy("series_id").agg(
        F.max("day").alias("frozen_on"), F.min("day").alias("train_start"),
        F.count(F.lit(1)).alias("n_train_days"))
    known = prices.join(span.select("series_id", "frozen_on"), "series_id").filter(
        F.to_date("ts") <= F.col("frozen_on"))
    level = known.groupBy("series_id").agg(
        F.avg("price").alias("price_mean"), F.stddev_samp("price").alias("price_std"))
    return span.join(level, "series_id").withColumn("window_days", F.lit(window))


def freeze(features: DataFrame, prices: DataFrame, window: int, path: str,
           params: TreeParams = TreeParams(), arms: Sequence[str] = ARMS) -> None:
    """M10. Fit on each series' final window and store the models with their metadata."""
    fit_gbt(final_window(features, window), params, arms).write.mode("overwrite").parquet(
        f"{path}/models")
    frozen_metadata(features, prices, window).write.mode("overwrite").parquet(f"{path}/metadata")


def load_frozen(spark, path: str) -> DataFrame:
    return spark.read.schema(MODELS).parquet(f"{path}/models")


def score_frozen(path: str, live: DataFrame, daily: bool = False, model: str = "gbt") -> DataFrame:
    """M11. Score every live day with the stored models; nothing is refitted."""
    return arm_forecasts(score_gbt(load_frozen(live.sparkSession, path), live), daily, model)


def forecast_day_fitted(models: DataFrame, df: DataFrame, day: dt.date, strict: bool = True,
                        model: str = "gbt") -> DataFrame:
    """M12 with a fitted model: one day of every series from its stored trees; the day's own
    price may be unknown and never influences the forecast."""
    features, recent = day_inputs(df, day, strict)
    blank = features.withColumn("y", F.array_repeat(F.lit(None).cast("double"), 24))
    hours = score_gbt(models.filter("target = 'hourly'"), blank).select(
        "series_id", F.col("origin").alias("day"), "hour", "y_pred")
    return with_actuals(hours, recent, model)


# ---- certificates -----------------------------------------------------------------------


def fit_certificate(models: DataFrame, train: DataFrame, atol: float = 1e-9) -> DataFrame:
    """What must hold for fitted trees, recomputed from the days they were fitted on.

    Per model: n_days; n_trees; loss_rises, rounds after which the absolute error is larger than
    before; wrong_leaves, whose value is not the scaled median of their residuals; lost_rows, by
    which the leaves' covers miss the days of all trees; base_gap against the median label.
    """
    rows = with_daily(train).select(*SERIES_DAY, "x", "y")
    keyed = models.join(rows.select("series_id").distinct(), "series_id", "left_semi")
    # One task a model: its window against all its trees, tree by tree.
    left = keyed.withColumn("key", F.coalesce("hour", F.lit(24)))
    right = rows.join(left.select("series_id", F.col("key").alias("_key")), "series_id"
                      ).withColumnRenamed("_key", "key")
    schema = ("series_id string, target string, hour int, tree int, leaf int, value double, "
              "rate double, before double, after double")

    def one_model(m: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        fit = _from_rows(m)
        at = int(m["key"].iloc[0])
        leaf = fit.leaves(_stack(pdf["x"]))[0]
        value = np.take_along_axis(fit.value[0], leaf, axis=1)
        y = _stack(pdf["y"])[:, at]
        told = fit.base[0] + np.cumsum(value, axis=0)
        before = y - np.vstack([np.full((1, len(y)), fit.base[0]), told[:-1]])
        n_trees = len(leaf)
        return pd.DataFrame({
            "series_id": m["series_id"].iloc[0], "target": m["target"].iloc[0],
            "hour": pd.array([None if at == 24 else at] * leaf.size, "Int32"),
            "tree": np.repeat(np.arange(n_trees, dtype=np.int32), len(y)),
            "leaf": leaf.ravel(), "value": value.ravel(), "rate": m["rate"].iloc[0],
            "before": before.ravel(), "after": (y - told).ravel()})

    seen = left.groupBy("series_id", "key").cogroup(right.groupBy("series_id", "key")).applyInPandas(
        one_model, schema)
    key = ["series_id", "target", "hour"]
    by_leaf = seen.groupBy(*key, "tree", "leaf").agg(
        F.count("*").alias("n"), F.percentile("before", F.lit(0.5)).alias("middle"),
        F.first("value").alias("value"), F.first("rate").alias("rate"),
        F.sum(F.abs("before")).alias("before"), F.sum(F.abs("after")).alias("after"))
    by_tree = by_leaf.groupBy(*key, "tree").agg(
        F.sum("n").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"),
        F.count_if(F.abs(F.col("middle") * F.col("rate") - F.col("value")) > atol).alias("wrong"))
    told = by_tree.groupBy(*key).agg(
        F.max("n").alias("n_days"), F.count("*").alias("n_trees"),
        F.count_if(F.col("after") > F.col("before") * (1 + 1e-12)).alias("loss_rises"),
        F.sum("wrong").alias("wrong_leaves"))
    covers = models.select(*key, "base", F.aggregate(
        "cover", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("covered"))
    labels = rows.select("series_id", F.posexplode("y").alias("at", "label")).groupBy(
        "series_id", "at").agg(F.percentile("label", F.lit(0.5)).alias("label"))
    same = ((told["series_id"] == covers["series_id"]) & (told["target"] == covers["target"])
            & told["hour"].eqNullSafe(covers["hour"]))
    out = told.join(covers, same).select(
        *[told[c] for c in told.columns], "base",
        (F.col("covered") - F.col("n_days") * F.col("n_trees")).alias("lost_rows"),
        F.coalesce(told["hour"], F.lit(24)).alias("at"))
    return out.join(labels, ["series_id", "at"]).select(
        *key, "n_days", "n_trees", "loss_rises", "wrong_leaves", "lost_rows",
        F.abs(F.col("base") - F.col("label")).alias("base_gap"))


def first_splits(models: DataFrame, train: DataFrame) -> DataFrame:
    """(series_id, target, hour, n_left, gain): rows at most the threshold of each model's first
    split, and what the split gains."""
    first = models.select("series_id", "target", "hour", "base",
                          F.get("feature", F.lit(0)).alias("at"),
                          F.get("threshold", F.lit(0)).alias("cut"))
    rows = with_daily(train).select("series_id", "x", "y").join(first, "series_id")
    side = F.get("x", F.col("at")) <= F.col("cut")
    sign = F.signum(F.get("y", F.coalesce("hour", F.lit(24))) - F.col("base"))
    own = lambda c: F.sum(F.when(side, c).otherwise(0))
    sums = rows.groupBy("series_id", "target", "hour").agg(
        F.count("*").alias("n"), F.sum(sign).alias("s"), own(F.lit(1)).alias("n_left"),
        own(sign).alias("s_left"))
    n, s, nl, sl = (F.col(c) for c in ("n", "s", "n_left", "s_left"))
    return sums.select("series_id", "target", "hour", "n_left", (
        sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n).alias("gain"))


# ---- attribution ------------------------------------------------------------------------


def attribute_trees(models: DataFrame, days: DataFrame, names: Sequence[str],
                    run_days: int = RUN_DAYS) -> DataFrame:
    """I2. Exact tree attributions of every input, zeros included, for every model and day.

    A task gets one model's trees and one run of days.
    """
    names = list(names)
    runs, keyed = _by_run(models, days.select(*SERIES_DAY, "x"), run_days)
    keyed = keyed.withColumn("key", F.coalesce("hour", F.lit(24)))
    spread = runs.join(keyed.select("series_id", "run", F.col("key").alias("_key")),
                       ["series_id", "run"]).withColumnRenamed("_key", "key")
    by = ["series_id", "run", "key"]

    def explain(m: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(m["key"].iloc[0])
        x = _stack(pdf["x"])
        fit = _from_rows(m)
        values, expected = Paths.of(fit, 0).attributions(x)
        return pd.DataFrame({
            "series_id": np.repeat(pdf["series_id"].to_numpy(), len(names)),
            "target": m["target"].iloc[0],
            "hour": pd.array([None if at == 24 else at] * x.size, "Int32"),
            "day": np.repeat(pdf["day"].to_numpy(), len(names)),
            "feature": np.tile(names, len(x)), "value": values.ravel(),
            "feature_value": x.ravel(), "expected": expected + float(fit.base[0])})

    return keyed.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(explain, ATTRIBUTION)


# ---- search -----------------------------------------------------------------------------


def tree_trials(n: int = 50, seed: int = 42, trees: tuple[int, int] = (100, 400)
                ) -> list[tuple[int, TreeParams]]:
    """Seeded draws: rounds uniform, depth 2 to 4, rate log-uniform in [0.02, 0.3], rows of a leaf
    5 to 60. All share one number of bins, so one window's cuts serve every trial."""
    rng = np.random.default_rng(seed)
    return [(i, TreeParams(int(rng.integers(trees[0], trees[1] + 1)), int(rng.integers(2, 5)),
                           float(10 ** rng.uniform(np.log10(0.02), np.log10(0.3))),
                           TreeParams.bins, int(rng.integers(5, 61)))) for i in range(n)]


def search_trees(roles: DataFrame, features: DataFrame, trials: Sequence[tuple[int, TreeParams]],
                 arms: Sequence[str] = ("daily",), trials_per_task: int = 5) -> DataFrame:
    """M13. Mean absolute validation error of every trial: (series_id, trial, parameters, mae).

    ``roles`` marks days as fit or validation (V8). A task fits a batch of trials on one series'
    window and cuts its inputs once for all of them.
    """
    wanted = _targets(arms)
    names = [f.name for f in fields(TreeParams)]
    batches = [list(trials[i:i + trials_per_task]) for i in range(0, len(trials), trials_per_task)]
    rows = with_daily(features).join(roles.filter("role <> 'unused'"), SERIES_DAY).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))))

    def one_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        fit, val = pdf[pdf["role"] == "fit"], pdf[pdf["role"] == "validation"]
        y, yv, xv = _stack(fit["y"])[:, wanted], _stack(val["y"])[:, wanted], _stack(val["x"])
        cuts: dict[int, Cuts] = {}
        out = []
        for i, p in batches[int(pdf["batch"].iloc[0])]:
            if p.bins not in cuts:
                cuts = {p.bins: Cuts(_stack(fit["x"]), p.bins)}
            error = np.abs(fit_boosted(cuts[p.bins], y, p).predict(xv) - yv).mean()
            out.append((pdf["series_id"].iloc[0], i, *asdict(p).values(), float(error)))
        return pd.DataFrame(out, columns=["series_id", "trial", *names, "mae"])

    return rows.groupBy("series_id", "batch").applyInPandas(
        one_batch, "series_id string, trial int, trees int, depth int, rate double, bins int, "
                   "min_leaf int, mae double")


def best_trees(scores: DataFrame) -> DataFrame:
    """M13. Per series the trial with the smallest error, the earlier one on a tie, as a table
    that ``gbt_walk_forward`` takes."""
    best = Window.partitionBy("series_id").orderBy("mae", "trial")  # one row per trial
    ranked = scores.withColumns({
        "_rank": F.row_number().over(best),
        "n_trials": F.count("*").over(Window.partitionBy("series_id"))})
    return ranked.filter("_rank = 1").drop("_rank")
