"""Seasonal autoregression with moving-average terms (M5, M6), in two linear stages.

The day-on-day change of a target follows its changes 1 and 7 days earlier, the changes of the
day-ahead exogenous values, and the surprises of 1 and 7 days earlier. A surprise is what a long
autoregression, with the exogenous changes of the same days, leaves unexplained (Hannan and
Rissanen, 1982). Both stages are least squares on one window, for all hours at once.

Blocks are calendar days, windows count usable days (all changes of the last ``REACH`` days
known), and a run of blocks gets its days once. Days whose own price is unknown are forecast from
what is known before them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.operators.features import SERIES_DAY, day_number, day_vectors, vector_mean
from daymark.operators.models import DAILY, LONG

#: Lags of the long autoregression: two seasons and a day, so that what it cuts off of a seasonal
#: moving average has faded.
LONG_LAGS = 15
SEASON = 7
#: Days back that a forecast may read: the surprise a season ago and its own long lags, as changes.
REACH = SEASON + LONG_LAGS + 1


@dataclass
class ArmaFit:
    """Coefficients per target: long (lags and exogenous changes), and the six of the model in the
    order change 1, change 7, exogenous changes, surprise 1, surprise 7."""

    long: np.ndarray
    short: np.ndarray


def _back(a: np.ndarray, k: int) -> np.ndarray:
    """The values of k days earlier, unknown at the start."""
    if not k:
        return a
    out = np.full_like(a, np.nan)
    out[k:] = a[:-k]
    return out


def long_inputs(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """days x targets x inputs of the long autoregression; ``dx`` is days x targets x exogenous."""
    lags = [_back(dy, k)[..., None] for k in range(1, LONG_LAGS + 1)]
    return np.concatenate(lags + [_back(dx, k) for k in range(LONG_LAGS + 1)], axis=2)


def short_inputs(dy: np.ndarray, dx: np.ndarray, surprise: np.ndarray) -> np.ndarray:
    cols = [_back(dy, 1), _back(dy, SEASON)]
    tail = [_back(surprise, 1), _back(surprise, SEASON)]
    return np.concatenate([np.stack(cols, 2), dx, np.stack(tail, 2)], axis=2)


def _least_squares(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per target, from the normal equations; redundant inputs share their weight."""
    z = z.transpose(1, 0, 2)
    gram = z.transpose(0, 2, 1) @ z
    right = (z.transpose(0, 2, 1) @ y.T[..., None])[..., 0]
    return np.stack([np.linalg.lstsq(a, b, rcond=1e-10)[0] for a, b in zip(gram, right, strict=True)])


def surprises(dy: np.ndarray, long_in: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Changes less what the long autoregression expects; 0 where one of them is unknown, so a day
    missing long ago costs no forecast."""
    out = dy - np.einsum("dmk,mk->dm", long_in, coef)
    return np.where(np.isnan(out), 0.0, out)


def fit_arma(dy: np.ndarray, dx: np.ndarray, long_in: np.ndarray, rows: np.ndarray) -> ArmaFit:
    """Both stages on the days ``rows`` of a calendar without holes."""
    coef = _least_squares(long_in[rows], dy[rows])
    short = short_inputs(dy, dx, surprises(dy, long_in, coef))[rows]
    return ArmaFit(coef, _least_squares(short, dy[rows]))


def normal_gap(dy: np.ndarray, dx: np.ndarray, long_in: np.ndarray, rows: np.ndarray,
               fit: ArmaFit) -> np.ndarray:
    """Largest correlation, per target, of the residuals with an input of either stage."""
    worst = np.zeros(dy.shape[1])
    made = short_inputs(dy, dx, surprises(dy, long_in, fit.long))
    for z, coef in ((long_in[rows], fit.long), (made[rows], fit.short)):
        left = dy[rows] - np.einsum("dmk,mk->dm", z, coef)
        size = np.sqrt((z ** 2).sum(0) * (dy[rows] ** 2).sum(0)[:, None])
        dots = np.abs(np.einsum("dmk,dm->mk", z, left))
        worst = np.maximum(worst, np.where(size > 0, dots / np.where(size > 0, size, 1), 0).max(1))
    return worst


# ---- runs -------------------------------------------------------------------------------


def arma_rows(df: DataFrame, window: int, refit_every: int, run_days: int, daily: bool
              ) -> DataFrame:
    """(series_id, run, first, day, p, a, b): the days of every run of blocks, with those before
    that its windows and lags may read. Only bare days are ordered along a series."""
    days = day_vectors(df).select(*SERIES_DAY, *[
        (F.array(vector_mean(c)) if daily else F.col(c)).alias(n)
        for c, n in (("price", "p"), ("exog_1", "a"), ("exog_2", "b"))])
    known = ~F.exists(F.concat("p", "a", "b"), lambda v: v.isNull())
    series = Window.partitionBy("series_id")
    order = series.orderBy("n")
    bare = days.select(*SERIES_DAY, day_number("day").alias("n"),
                       F.coalesce(known, F.lit(False)).cast("int").alias("k"))
    bare = bare.withColumn("first", F.min("n").over(series)).withColumn(
        "usable", (F.sum("k").over(order.rangeBetween(-REACH, 0)) == REACH + 1).cast("int"))
    stride = -(-run_days // refit_every) * refit_every
    bare = bare.withColumns({
        "run": F.floor((F.col("n") - F.col("first")) / stride),
        "before": F.sum("usable").over(order) - F.col("usable")})
    runs = bare.groupBy("series_id", "run").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("before").alias("before"),
        F.first("first").alias("first"))
    starts = bare.filter("usable = 1").select(
        "series_id", (F.col("before") + window).alias("before"), F.col("n").alias("since"))
    span = runs.join(starts, ["series_id", "before"], "left").select(
        "series_id", "run", "first", F.explode(F.sequence(
            F.greatest(F.coalesce("since", "first") - REACH, F.col("first")), F.col("hi"))
        ).alias("n"))
    return span.join(days.withColumn("n", day_number("day")), ["series_id", "n"])


def _one_run(pdf: pd.DataFrame, window: int, refit_every: int, run_days: int, use) -> list:
    """``use(fit, calendar, rows, block, ...)`` of every block of a run that has a full window."""
    stride = -(-run_days // refit_every) * refit_every
    pdf = pdf.sort_values("n")
    low, high = int(pdf["n"].iloc[0]), int(pdf["n"].iloc[-1])
    first, run = int(pdf["first"].iloc[0]), int(pdf["run"].iloc[0])
    width = len(pdf["p"].iloc[0])

    def laid(column: str) -> np.ndarray:
        out = np.full((high - low + 1, width), np.nan)
        out[pdf["n"].to_numpy() - low] = [[np.nan if v is None else v for v in row]
                                          for row in pdf[column]]
        return out

    price = laid("p")
    dy = price - _back(price, 1)
    dx = np.stack([x - _back(x, 1) for x in (laid("a"), laid("b"))], axis=2)
    long_in = long_inputs(dy, dx)
    # Usable days know every price and exogenous value of the days that their surprises read.
    whole = ~(np.isnan(price).any(1) | np.isnan(laid("a")).any(1) | np.isnan(laid("b")).any(1))
    upto = np.concatenate([[0], np.cumsum(whole)])
    at = np.arange(len(whole))
    usable = (at >= REACH) & (upto[at + 1] - upto[np.maximum(at - REACH, 0)] == REACH + 1)
    out = []
    for start in range(first + run * stride, min(first + (run + 1) * stride, high + 1), refit_every):
        begin = max(start - low, 0)
        rows = np.flatnonzero(usable[:begin])[-window:]
        if len(rows) < window:
            continue
        fit = fit_arma(dy, dx, long_in, rows)
        out.append(use(fit, price, dy, dx, long_in, rows, begin,
                       min(start + refit_every, first + (run + 1) * stride, high + 1) - low, low))
    return out


def fit_seasonal_arma(df: DataFrame, window: int = 1092, refit_every: int = 7, daily: bool = False,
                      model: str = "arma", run_days: int = 182) -> DataFrame:
    """M5 (M6 with ``daily``). Weekly refit, fresh lags and surprises every day. A day is forecast
    where its inputs are known; a history shorter than the window gives no forecast."""
    rows = arma_rows(df, window, refit_every, run_days, daily)

    def forecast(fit, price, dy, dx, long_in, _, begin, end, low):
        z = short_inputs(dy, dx, surprises(dy, long_in, fit.long))[begin:end]
        told = _back(price, 1)[begin:end] + np.einsum("dmk,mk->dm", z, fit.short)
        width = price.shape[1]
        n = np.repeat(np.arange(begin, end) + low, width)
        return pd.DataFrame({
            "origin": (pd.Timestamp("1970-01-01") + pd.to_timedelta(n, "D")).date,
            "hour": np.tile(np.arange(width, dtype=np.int32), end - begin),
            "y_true": price[begin:end].ravel(), "y_pred": told.ravel()})

    def one_run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = _one_run(pdf, window, refit_every, run_days, forecast)
        if not made:
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        out = pd.concat(made, ignore_index=True)
        out = out[out["y_pred"].notna()].assign(series_id=pdf["series_id"].iloc[0], model=model)
        return out.drop(columns="hour") if daily else out

    schema = DAILY if daily else LONG
    out = rows.groupBy("series_id", "run").applyInPandas(one_run, schema)
    return out.withColumn("y_true", F.when(~F.isnan("y_true"), F.col("y_true")))


def arma_certificate(df: DataFrame, window: int = 1092, refit_every: int = 7, daily: bool = False,
                     run_days: int = 182) -> DataFrame:
    """(series_id, block_start, n_days, normal_gap): on every block's own window, the largest
    correlation of the residuals of either stage with one of its inputs. Least squares leaves none."""
    rows = arma_rows(df, window, refit_every, run_days, daily)

    def check(fit, price, dy, dx, long_in, used, begin, _, low):
        return (pd.Timestamp("1970-01-01") + pd.Timedelta(days=begin + low)).date(), len(used), float(
            normal_gap(dy, dx, long_in, used, fit).max())

    def one_run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_one_run(pdf, window, refit_every, run_days, check),
                           columns=["block_start", "n_days", "normal_gap"])
        return out.assign(series_id=pdf["series_id"].iloc[0])

    return rows.groupBy("series_id", "run").applyInPandas(
        one_run, "series_id string, block_start date, n_days int, normal_gap double")
