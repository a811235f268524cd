"""Fitted forecasts as partitioned jobs (M3-M6, M9, M13); boosted trees are in ``boosting``.

Work is split by (series, run of refit blocks), so one series spreads over as many tasks as it
has runs, and a task never holds more than one training window plus one run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.operators.features import SERIES_DAY, calendar_lags, day_vectors, vector_mean
from daymark.operators.solvers import centre_scale, elastic_net, lasso_aic
from daymark.operators.splits import positions, validate_range

FitPredict = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
LONG = "series_id string, origin date, hour int, y_true double, y_pred double, model string"
DAILY = "series_id string, origin date, y_true double, y_pred double, model string"


# ---- walk-forward -----------------------------------------------------------------------


def run_rows(features: DataFrame, window: int, refit_every: int = 1,
             first_origin: dt.date | None = None, last_origin: dt.date | None = None,
             todo: DataFrame | None = None, run_days: int | None = None) -> DataFrame:
    """Rows of each run of refit blocks: (series_id, run, pos, block_pos, own, open, day, x, y).

    A block is ``refit_every`` calendar days counted from the first origin; ``block_pos`` is the
    position of its first day. A run holds the blocks that start within ``run_days`` positions
    and gets their days (``own``) and the ``window`` days before them once, however many blocks
    those days train. A day is sent about ``1 + window / run_days`` times: under twice where
    ``run_days`` is the window, its default. Fewer days a run spread one series over more tasks.
    With ``todo`` (series_id, origin) only runs that still hold such an origin are kept, and
    ``open`` marks these origins.
    """
    validate_range(first_origin, last_origin)
    stride = max(run_days or window, refit_every)
    stride = -(-stride // refit_every) * refit_every
    ranked = positions(features)
    usable = F.col("pos") >= window
    if first_origin is not None:
        usable = usable & (F.col("day") >= F.lit(first_origin))
    series = Window.partitionBy("series_id")
    ranked = ranked.withColumn("_first", F.min(F.when(usable, F.struct("pos", "day"))).over(series))
    ranked = ranked.filter("_first IS NOT NULL").select(
        *SERIES_DAY, (F.col("pos") - F.col("_first.pos")).alias("pos"),
        F.when(usable, F.floor(F.datediff("day", "_first.day") / refit_every)).alias("_block"))
    if last_origin is not None:
        ranked = ranked.filter(F.col("day") <= F.lit(last_origin))
    placed = ranked.withColumn("block_pos", F.when(F.col("_block").isNotNull(), F.min("pos").over(
        Window.partitionBy("series_id", "_block"))))
    home = F.floor(F.col("block_pos") / stride)
    if todo is None:
        placed = placed.withColumn("open", F.col("block_pos").isNotNull())
    else:
        wanted = todo.select("series_id", F.col("origin").alias("day"), F.lit(True).alias("_open"))
        placed = placed.join(wanted.distinct(), SERIES_DAY, "left").withColumn(
            "open", F.col("_open").isNotNull() & F.col("block_pos").isNotNull())
    # A day may train any run that starts within the next window, and the run it lies in.
    low, high = F.floor(F.col("pos") / stride), F.floor((F.col("pos") + window) / stride)
    reach = F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))
    runs = F.array_distinct(F.when(home.isNull(), reach).otherwise(
        F.concat(F.array(home), reach)))
    placed = placed.select(
        *SERIES_DAY, "pos", "block_pos", "open", home.alias("_home"),
        F.explode(F.when(F.col("pos") >= -window, runs)).alias("run")).withColumn(
        "own", F.coalesce(F.col("_home") == F.col("run"), F.lit(False)))
    needed = placed.filter("own AND open").select("series_id", "run").distinct()
    return placed.drop("_home").join(needed, ["series_id", "run"], "left_semi").join(
        features.select(*SERIES_DAY, "x", "y"), SERIES_DAY)


def own_tasks(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to a fixed number of tasks, for work that is long on few rows.

    A shuffle left to adaptive execution is merged by bytes, so that a few tasks get all runs. Most
    of these tasks stay empty; so many keep the few keys of one series apart.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                32 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def run_blocks(rows: DataFrame, window: int, one_block: Callable[[pd.DataFrame, pd.DataFrame],
               pd.DataFrame], schema: str) -> DataFrame:
    """``one_block(train, test)`` of every open block, run by run. An incomplete window is an
    error."""

    def one_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        done = [pd.DataFrame()]
        for first, test in pdf[pdf["own"]].groupby("block_pos"):
            if not test["open"].any():
                continue
            train = pdf[(pdf["pos"] >= first - window) & (pdf["pos"] < first)]
            if len(train) != window:
                raise ValueError(f"a block has {len(train)} training days instead of {window}")
            done.append(one_block(train, test))
        return pd.concat(done[1:] or done, ignore_index=True)

    return own_tasks(rows, "series_id", "run").groupBy("series_id", "run").applyInPandas(
        one_run, schema)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def run_walk_forward(features: DataFrame, fit_predict: FitPredict, model: str, window: int,
                     refit_every: int = 1, first_origin: dt.date | None = None,
                     last_origin: dt.date | None = None, daily: bool = False,
                     todo: DataFrame | None = None, run_days: int | None = None) -> DataFrame:
    """M9. Fit on every block's window, forecast its days, emit the long frame.

    ``fit_predict(x_train, y_train, x_test)`` gets plain arrays; ``y`` has 24 columns, or one
    for the daily route. Without origins the result is empty with the right schema.
    """
    rows = run_rows(features, window, refit_every, first_origin, last_origin, todo, run_days)
    if daily:
        rows = rows.withColumn("y", F.array(vector_mean("y")))

    def one_block(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        truth = _stack(test["y"])
        pred = fit_predict(_stack(train["x"]), _stack(train["y"]), _stack(test["x"]))
        width = truth.shape[1]
        out = pd.DataFrame({
            "series_id": np.repeat(test["series_id"].to_numpy(), width),
            "origin": np.repeat(test["day"].to_numpy(), width),
            "hour": np.tile(np.arange(width, dtype=np.int32), len(test)),
            "y_true": truth.ravel(), "y_pred": np.asarray(pred, dtype=float).ravel(),
            "model": model})
        return out.drop(columns="hour") if daily else out

    out = run_blocks(rows, window, one_block, DAILY if daily else LONG)
    return out if todo is None else out.join(
        todo.select("series_id", "origin"), ["series_id", "origin"], "left_semi")


def window_mean(x: np.ndarray, y: np.ndarray, x_new: np.ndarray) -> np.ndarray:
    """Reference model: the mean of the calibration window, per target column."""
    return np.tile(y.mean(axis=0), (len(x_new), 1))


@dataclass
class LassoFit:
    """Lasso of one window: scaling of inputs and targets, and weights of every target."""

    x_centre: np.ndarray
    x_width: np.ndarray
    y_centre: np.ndarray
    y_width: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    inputs_mean: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Scaled inputs; the weekday flags stay as they are."""
        n = len(self.x_centre)
        return np.hstack([np.arcsinh((x[:, :n] - self.x_centre) / self.x_width), x[:, n:]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.sinh(self.inputs(x) @ self.weights + self.bias) * self.y_width + self.y_centre


def fit_lasso(x: np.ndarray, y: np.ndarray) -> LassoFit:
    """asinh-median scaling of targets and all inputs but the weekday flags, then a lasso with
    its penalty chosen by AIC, independently per target column."""
    mx, dx = centre_scale(x[:, :x.shape[1] - 7])
    my, dy = centre_scale(y)
    fit = LassoFit(mx, dx, my, dy, np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1]),
                   np.zeros(x.shape[1]))
    xs, ys = fit.inputs(x), np.arcsinh((y - my) / dy)
    for j in range(y.shape[1]):
        fit.weights[:, j], fit.bias[j] = lasso_aic(xs, ys[:, j])
    fit.inputs_mean = xs.mean(axis=0)
    return fit


def lasso_recipe(x: np.ndarray, y: np.ndarray, x_new: np.ndarray) -> np.ndarray:
    return fit_lasso(x, y).predict(x_new)


COEFFICIENTS = ("series_id string, target string, hour int, feature string, coef double, "
                "mean double, expected double, x_centre double, x_width double, "
                "y_centre double, y_width double")


def lasso_coefficients(features: DataFrame, names: Sequence[str], window: int,
                       targets_per_task: int = 25) -> DataFrame:
    """M3/M4 for explanation: the models of each series' last window, one row per feature.

    ``coef``, ``mean`` and ``expected`` are on the scaled side, where the model is additive;
    a forecast is ``sinh(expected + sum of attributions) * y_width + y_centre``. An input is
    ``asinh((x - x_centre) / x_width)``, or ``x`` where these are null. Fewer targets a task
    spread one series over more tasks, each of which gets the window.
    """
    names = list(names)
    parts = -(-25 // targets_per_task)
    rows = final_window(features, window).select(
        *SERIES_DAY, "x", F.concat("y", F.array(vector_mean("y"))).alias("y"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def one_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        low = int(pdf["part"].iloc[0]) * targets_per_task
        at = list(range(low, min(low + targets_per_task, 25)))
        fit = fit_lasso(_stack(pdf["x"]), _stack(pdf["y"])[:, at])
        expected = fit.bias + fit.inputs_mean @ fit.weights
        flags = [None] * (len(names) - len(fit.x_centre))
        return pd.concat([pd.DataFrame({
            "series_id": pdf["series_id"].iloc[0], "target": "hourly" if t < 24 else "daily",
            "hour": pd.array([t if t < 24 else None] * len(names), "Int32"), "feature": names,
            "coef": fit.weights[:, j], "mean": fit.inputs_mean, "expected": expected[j],
            "x_centre": [*fit.x_centre, *flags], "x_width": [*fit.x_width, *flags],
            "y_centre": fit.y_centre[j], "y_width": fit.y_width[j]})
            for j, t in enumerate(at)], ignore_index=True)

    return rows.groupBy("series_id", "part").applyInPandas(one_part, COEFFICIENTS)


def lasso_inputs(features: DataFrame, names: Sequence[str], coefs: DataFrame) -> DataFrame:
    """(series_id, day, feature, value): inputs as the models of ``lasso_coefficients`` see them."""
    scales = coefs.groupBy("series_id", "feature").agg(
        F.first("x_centre").alias("_m"), F.first("x_width").alias("_d"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"),
                         F.col("x").alias("value"))
    long = features.select(*SERIES_DAY, F.inline(pairs).alias("feature", "_x"))
    return long.join(scales, ["series_id", "feature"]).select(
        *SERIES_DAY, "feature",
        F.when(F.col("_d").isNull(), F.col("_x"))
        .otherwise(F.asinh((F.col("_x") - F.col("_m")) / F.col("_d"))).alias("value"))


def fit_lasso_aic(features: DataFrame, window: int, refit_every: int = 1, model: str = "lasso",
                  **bounds) -> DataFrame:
    """M3. One lasso per hour and block."""
    return run_walk_forward(features, lasso_recipe, model, window, refit_every, **bounds)


def fit_lasso_aic_daily(features: DataFrame, window: int, refit_every: int = 1,
                        model: str = "lasso", **bounds) -> DataFrame:
    """M4. The same recipe on the baseload."""
    return run_walk_forward(features, lasso_recipe, model, window, refit_every, daily=True, **bounds)


# ---- seasonal autoregression from additive sums -----------------------------------------

REGRESSORS = ("dy_1", "dy_7", "dx_1", "dx_2")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_normal(sums: pd.Series) -> pd.Series:
    """Coefficients from a flattened upper triangle of [Z'Z, Z'y]; one row per fit."""
    k = len(REGRESSORS)
    iu = np.triu_indices(k)

    def one(v: np.ndarray) -> list[float] | None:
        if v is None or any(s is None for s in v):
            return None
        v = np.asarray(v, dtype=float)
        a = np.zeros((k, k))
        a[iu] = v[:len(iu[0])]
        a = a + np.triu(a, 1).T
        return np.linalg.lstsq(a, v[len(iu[0]):], rcond=1e-10)[0].tolist()

    return sums.map(one)


def _arx(rows: DataFrame, keys: Sequence[str], window: int, refit_every: int, model: str
         ) -> DataFrame:
    """Rolling least squares of the day-on-day change, refitted every ``refit_every`` days.

    Blocks are calendar days counted from a key's first day. A block is fitted on the last
    ``window`` days with a known target before it; days without one are forecast all the same.
    Cross-products are summed once along the days, and a window is the difference of two of
    these sums: no observation is copied into the windows it belongs to.
    """
    names = list(REGRESSORS)
    ready = rows.filter(" and ".join(f"{c} is not null" for c in (*names, "last_y")))
    group = Window.partitionBy(*keys)
    order = group.orderBy("origin")  # one row per day and key
    placed = ready.withColumns({
        "block": F.floor(F.datediff("origin", F.min("origin").over(group)) / refit_every),
        "known": F.count("y").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    products = [f"{a} * {b}" for i, a in enumerate(names) for b in names[i:]]
    products += [f"{a} * (y - last_y)" for a in names]
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.filter("y is not null").select(
        *keys, (F.col("known") + 1).alias("n"),
        F.array(*[F.sum(F.expr(p)).over(so_far) for p in products]).alias("s"))
    # A shorter history than the window gives no forecast.
    blocks = placed.groupBy(*keys, "block").agg(F.min("known").alias("n")).filter(
        F.col("n") >= window)
    earlier = sums.select(*keys, (F.col("n") + window).alias("n"), F.col("s").alias("s0"))
    fits = blocks.join(sums, [*keys, "n"]).join(earlier, [*keys, "n"], "left").withColumn(
        "_sums", F.when(F.col("s0").isNull(), F.col("s")).otherwise(
            F.zip_with("s", "s0", lambda a, b: a - b))).withColumn(
        "beta", _solve_normal("_sums"))
    step = sum((F.col(n) * F.get("beta", F.lit(i)) for i, n in enumerate(names)), F.lit(0.0))
    return placed.join(fits.select(*keys, "block", "beta"), [*keys, "block"]).withColumns({
        "y_pred": F.col("last_y") + step, "model": F.lit(model)}).withColumnRenamed("y", "y_true")


def _arx_vectors(df: DataFrame) -> DataFrame:
    vectors = day_vectors(df)
    return calendar_lags(vectors, {
        "_y1": ("price", 1), "_y2": ("price", 2), "_y7": ("price", 7), "_y8": ("price", 8),
        "_a1": ("exog_1", 1), "_b1": ("exog_2", 1)})


_ARX_PARTS = {
    "y": "price", "last_y": "_y1", "_p2": "_y2", "_p7": "_y7", "_p8": "_y8",
    "_x1": "exog_1", "_x1p": "_a1", "_x2": "exog_2", "_x2p": "_b1"}


def _changes(rows: DataFrame) -> DataFrame:
    d = lambda a, b: F.col(a) - F.col(b)
    return rows.withColumns({
        "dy_1": d("last_y", "_p2"), "dy_7": d("_p7", "_p8"),
        "dx_1": d("_x1", "_x1p"), "dx_2": d("_x2", "_x2p")})


def fit_seasonal_arx(df: DataFrame, window: int = 1092, refit_every: int = 7,
                     model: str = "arx") -> DataFrame:
    """M5. Per hour: change of price on its changes 1 and 7 days earlier and on the changes of
    the day-ahead exogenous values. Weekly refit, fresh lags every day. No moving-average term."""
    lagged = _arx_vectors(df).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    rows = lagged.select("series_id", F.col("day").alias("origin"), "hour", *[
        F.get(F.col(v), F.col("hour")).alias(k) for k, v in _ARX_PARTS.items()])
    out = _arx(_changes(rows), ["series_id", "hour"], window, refit_every, model)
    return out.select("series_id", "origin", "hour", "y_true", "y_pred", "model")


def fit_seasonal_arx_daily(df: DataFrame, window: int = 1092, refit_every: int = 7,
                           model: str = "arx") -> DataFrame:
    """M6. One model on the baseload with daily-mean exogenous values."""
    rows = _arx_vectors(df).select("series_id", F.col("day").alias("origin"), *[
        vector_mean(v).alias(k) for k, v in _ARX_PARTS.items()])
    out = _arx(_changes(rows), ["series_id"], window, refit_every, model)
    return out.select("series_id", "origin", "y_true", "y_pred", "model")


# ---- windows --------------------------------------------------------------------------


def final_window(features: DataFrame, window: int) -> DataFrame:
    """The last ``window`` rows of each series."""
    pos = positions(features)
    n = pos.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    keep = pos.join(n, "series_id").filter(F.col("_n") - F.col("pos") <= window)
    return features.join(keep.select(*SERIES_DAY), SERIES_DAY)


# ---- parameter search -------------------------------------------------------------------


def random_trials(n: int = 50, seed: int = 42) -> list[tuple[int, float, float]]:
    """(trial, alpha, l1): seeded draws, alpha log-uniform in [1e-4, 1], l1 uniform."""
    rng = np.random.default_rng(seed)
    return [(i, float(10 ** a), float(b))
            for i, (a, b) in enumerate(zip(rng.uniform(-4, 0, n), rng.uniform(0, 1, n)))]


def search(roles: DataFrame, features: DataFrame, trials: Sequence[tuple[int, float, float]],
           trials_per_task: int = 5) -> DataFrame:
    """M13. Mean absolute validation error of every trial: (series_id, trial, alpha, l1, mae,
    converged).

    ``roles`` marks days as fit or validation (V8). Trials are dealt into small batches; a
    task fits one batch on one series' window, all hours at once.
    """
    batches = [list(trials[i:i + trials_per_task]) for i in range(0, len(trials), trials_per_task)]
    rows = features.join(roles.filter("role <> 'unused'"), SERIES_DAY).withColumn(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))))

    def one_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        fit, val = pdf[pdf["role"] == "fit"], pdf[pdf["role"] == "validation"]
        arr = lambda part, c: np.array(part[c].tolist(), dtype=float)
        x, y, xv, yv = arr(fit, "x"), arr(fit, "y"), arr(val, "x"), arr(val, "y")
        mx, sx = x.mean(axis=0), x.std(axis=0)
        sx = np.where(sx > 0, sx, 1.0)
        out = []
        for i, alpha, l1 in batches[int(pdf["batch"].iloc[0])]:
            w, b, converged = elastic_net((x - mx) / sx, y, alpha * y.std(), l1)
            err = np.abs((xv - mx) / sx @ w + b - yv).mean()
            out.append((pdf["series_id"].iloc[0], i, alpha, l1, float(err), converged))
        return pd.DataFrame(
            out, columns=["series_id", "trial", "alpha", "l1", "mae", "converged"])

    return rows.groupBy("series_id", "batch").applyInPandas(
        one_batch,
        "series_id string, trial int, alpha double, l1 double, mae double, converged boolean")


def best_trial(scores: DataFrame) -> DataFrame:
    """M13. Smallest validation error per series; the earlier trial on a tie. A trial whose
    coefficients did not settle is taken only where none did, and says so."""
    return scores.groupBy("series_id").agg(
        F.min_by(F.struct("trial", "alpha", "l1", "mae", "converged"),
                 F.struct(~F.col("converged"), "mae", "trial")).alias("_t"),
        F.count(F.lit(1)).alias("n_trials")).select("series_id", "_t.*", "n_trials")


