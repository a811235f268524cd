"""Ensembles, regimes and bias recalibration."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import ratio
from daymark.operators.features import calendar_lags
from daymark.operators.ordered import attach
from daymark.operators.quality import CheckFailed, refuse_any, require_no_nulls
from daymark.operators.scoring import pack_days, signed_error, unpack_days
from daymark.operators.splits import require_before
from daymark.session import materialize

CALM, STRESSED = "calm", "stressed"
CELL = ["series_id", "origin", "hour"]


# ---- combining --------------------------------------------------------------------------


def check_weights(weights: Mapping[str, float]) -> None:
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise CheckFailed("every weight has to be zero or more, and one above zero")


def _fixed_weight(weights: Mapping[str, float]) -> Column:
    """Weight of the row's model as a literal lookup: no join. Unknown models raise."""
    out = F.when(F.lit(False), F.lit(0.0))
    for model, w in weights.items():
        out = out.when(F.col("model") == model, F.lit(float(w)))
    return out.otherwise(F.raise_error(F.concat(F.lit("no weight for model "), F.col("model"))))


def _weighted(frame: DataFrame, n_models: Column, name: str) -> DataFrame:
    complete = F.count("y_pred") == n_models
    mix = F.sum(F.col("_w") * F.col("y_pred")) / F.sum("_w")
    return frame.groupBy(*CELL).agg(
        F.first("y_true").alias("y_true"), F.when(complete, mix).alias("y_pred"),
    ).withColumn("model", F.lit(name))


def combine(frame: DataFrame, weights: Mapping[str, float] | DataFrame,
            name: str = "ensemble") -> DataFrame:
    """E1. Normalised weighted mean of the members per (series, origin, hour).

    ``weights`` is one fixed set, or a frame (series_id, model, weight) with one set per
    series. A cell lacking a member becomes NULL rather than a mean of the others.
    """
    if isinstance(weights, Mapping):
        check_weights(weights)
        return _weighted(frame.withColumn("_w", _fixed_weight(weights)),
                         F.lit(len(weights)), name)
    sized = weights.join(weights.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_m")), "series_id").withColumnRenamed("weight", "_w")
    rows = attach(frame, sized, ["series_id", "model"], "origin", how="left")
    return _weighted(_require_weight(rows), F.max("_m"), name)


def _require_weight(rows: DataFrame) -> DataFrame:
    missing = F.raise_error(F.concat(F.lit("no weight for model "), F.col("model")))
    return rows.withColumn("_w", F.coalesce("_w", missing.cast("double")))


def day_peaks(frame: DataFrame) -> DataFrame:
    """(series_id, origin, peak): highest realized hour of each day; one row per day."""
    return frame.groupBy("series_id", "origin").agg(F.max("y_true").alias("peak"))


def _previous_peak(peaks: DataFrame) -> DataFrame:
    """Adds the peak of the previous calendar day and whether that day exists."""
    return calendar_lags(peaks.withColumn("_here", F.lit(True)), {
        "prev_peak": ("peak", 1), "_known": ("_here", 1)}, day="origin").select(
        "series_id", "origin", "prev_peak", "_known")


def regime_labels(frame: DataFrame, threshold: float | DataFrame, default: str = CALM
                  ) -> DataFrame:
    """E2. A day is stressed iff the previous calendar day peaked above the threshold.

    Nothing of the day itself is read. Without a previous day in the frame the label is
    ``default``. ``threshold`` is a number or a frame (series_id, threshold); a series without
    a threshold fails the job.
    """
    days = _previous_peak(day_peaks(frame))
    if isinstance(threshold, DataFrame):
        days = days.join(threshold.select("series_id", "threshold"), "series_id", "left")
        limit = F.coalesce("threshold", F.raise_error(F.concat(
            F.lit("no regime threshold for series "), F.col("series_id"))).cast("double"))
    else:
        limit = F.lit(float(threshold))
    over = F.coalesce(F.col("prev_peak"), F.lit(float("-inf"))) > limit
    label = F.when(over, STRESSED).when(F.col("_known").isNull(), default).otherwise(CALM)
    return days.select("series_id", "origin", label.alias("regime"))


def combine_by_regime(frame: DataFrame, weights: Mapping[str, Mapping[str, float]] | DataFrame,
                      threshold: float | DataFrame, name: str = "regime-ensemble") -> DataFrame:
    """E3. Each day uses the weight set of its regime.

    ``weights`` maps calm/stressed to a set, or is (series_id, regime, model, weight). The
    left join on labels keeps every origin.
    """
    rows = frame.join(regime_labels(frame, threshold), ["series_id", "origin"], "left")
    if isinstance(weights, Mapping):
        if set(weights) != {CALM, STRESSED}:
            raise CheckFailed("regime weights need exactly the keys calm and stressed")
        if set(weights[CALM]) != set(weights[STRESSED]):
            raise CheckFailed("both regimes need the same models")
        for w in weights.values():
            check_weights(w)
        # Each set is normalised by its own sum inside the weighted mean.
        w = F.when(F.col("regime") == STRESSED, _fixed_weight(weights[STRESSED])).otherwise(
            _fixed_weight(weights[CALM]))
        return _weighted(rows.withColumn("_w", w), F.lit(len(weights[CALM])), name)
    sized = weights.join(weights.groupBy("series_id", "regime").agg(
        F.count(F.lit(1)).alias("_m")), ["series_id", "regime"]).withColumnRenamed("weight", "_w")
    rows = attach(rows, sized, ["series_id", "regime", "model"], "origin", how="left")
    return _weighted(_require_weight(rows), F.max("_m"), name)


# ---- fitting weights --------------------------------------------------------------------

#: Relative gap between the error of the weights and its lower bound at which a fit ends.
GAP = 1e-4
#: An error this small counts as none: a bound of zero is all there is then.
TINY = 1e-9
#: Passes after which a fit that has not closed its gap fails the job.
MAX_PASSES = 200
#: What the rounding of the error's corner is multiplied by once its own minimum is found.
SHARPEN = 0.3
#: A search in hundredths: a full grid first, then ever smaller moves around the best.
COARSE = 10
REFINE = (4, 2, 1)
REACH = 2


def member_columns(frame: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (series, origin, hour) with the truth and one column ``_p{i}`` per member."""
    return frame.filter(F.col("model").isin(*models)).groupBy(*CELL, *keep).agg(
        F.first("y_true").alias("y_true"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"_p{i}")
          for i, m in enumerate(models)])


def _simplex_minimum(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """argmin of w'Aw / 2 - b'w over weights that are not negative and sum to one.

    Goes from ``start`` by minima over the weights in use; each step lowers the value.
    """
    n = len(b)
    scale = max(np.trace(a) / n, np.abs(b).max(), 1e-300)
    a, b = a / scale + 1e-12 * np.eye(n), b / scale
    full, used = start.copy(), [i for i in range(n) if start[i] > 0]
    for _ in range(8 * n + 8):
        k = len(used)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k] = a[np.ix_(used, used)]
        system[:k, k] = system[k, :k] = 1.0
        solved = np.linalg.lstsq(system, np.append(b[used], 1.0), rcond=None)[0]
        step, level = solved[:k] - full[used], solved[k]
        down = solved[:k] < 0
        if down.any() and k > 1:
            room = np.where(down, full[used] / np.where(down, -step, 1.0), np.inf)
            out = int(room.argmin())
            full[used] = np.maximum(full[used] + room[out] * step, 0.0)
            full[used.pop(out)] = 0.0
            continue
        full[used] = np.maximum(solved[:k], 0.0)
        slope = b - a @ full - level
        slope[used] = -np.inf
        if slope.max() <= 1e-12:
            break
        used.append(int(slope.argmax()))
    return full / full.sum()


STATE = ("w array<double>, base array<double>, target array<double>, step double, value double, "
         "width double, best array<double>, mae double, bound double")


def fit_weights(frame: DataFrame, models: Sequence[str], keys: Sequence[str] = ("series_id",),
                test_days: DataFrame | None = None, strict: bool = False,
                gap: float = GAP) -> DataFrame:
    """E4. MAE-minimising convex weights per key, with a certificate.

    The corner of the absolute error is rounded to ``sqrt(r^2 + width^2)`` and the rounded error
    minimised by Newton steps inside the simplex, a step halved where it does not lower it; near
    each minimum the width shrinks. Every pass adds up, per key, the error with its first and
    second derivatives: n by n sums for n members are all that leaves a task, and the cells are
    stored once and read once a pass. A residual divided by its rounded size, below 1, also bounds
    the error of all weights from below, so a fit ends when error and bound are within ``gap`` of
    each other.

    Pass validation forecasts only; with ``test_days`` the ordering is checked, and strict mode
    also refuses missing values. A cell that lacks a value takes no part in the fit. Returns
    (keys, model, weight, mae, bound, n_cells); ``bound`` is the lower bound of the error.
    """
    if strict:
        require_no_nulls(frame)
    if test_days is not None:
        require_before(frame.select("series_id", F.col("origin").alias("day")), test_days)
    keys, n = list(keys), len(models)
    extra = [k for k in keys if k != "series_id"]
    cells = materialize(member_columns(frame, models, extra).dropna(
        subset=["y_true", *[f"_p{i}" for i in range(n)]]), "weights")
    even = F.array_repeat(F.lit(1.0 / n), n)
    mean = " + ".join(f"_p{i} / {n}" for i in range(n))
    state = materialize(cells.groupBy(*keys).agg(
        F.expr(f"avg(abs(y_true - ({mean})))").alias("width")).select(
        *keys, even.alias("w"), even.alias("base"), even.alias("target"), F.lit(1.0).alias("step"),
        F.lit(float("inf")).alias("value"), F.greatest("width", F.lit(1e-12)).alias("width"),
        even.alias("best"), F.lit(float("inf")).alias("mae"), F.lit(0.0).alias("bound")),
        "weight-pass")
    for done in range(1, MAX_PASSES + 1):
        state = materialize(_weight_pass(cells, state, keys, n, gap), "weight-pass")
        # A pass costs about as much as the question, and few fits end within eight.
        if (done % 4 == 0 or n == 1) and not state.filter(~_closed(gap)).limit(1).count():
            break
    refuse_any(state.filter(~_closed(gap)).select(*keys, "mae", "bound"),
               f"weights are not within {gap} of the smallest error")
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.get("best", F.lit(i)).alias("weight"))
                      for i, m in enumerate(models)])
    return state.select(*keys, "mae", "bound", "n_cells", F.inline(pairs))


def _closed(gap: float):
    return F.col("mae") - F.col("bound") <= gap * F.col("mae") + TINY


def _weight_pass(cells: DataFrame, state: DataFrame, keys: Sequence[str], n: int,
                 gap: float) -> DataFrame:
    """Error, bound and next weights of every key from one reading of its cells."""
    told = state.select(*keys, "w", F.col("width").alias("_d"))
    rows = attach(cells, told, keys, "origin")
    # Weights sum to one, so a residual is the weighted sum of the members' own errors.
    rows = rows.select(*keys, "w", "_d", *[F.expr(f"y_true - _p{i}").alias(f"_e{i}")
                                           for i in range(n)])
    rows = rows.withColumn("_r", F.expr(" + ".join(f"w[{i}] * _e{i}" for i in range(n))))
    rows = rows.withColumn("_s", F.expr("sqrt(_r * _r + _d * _d)")).withColumns({
        "_u": F.expr("_r / _s"), "_v": F.expr("_d / _s * (_d / _s) / _s")})
    sums = {"_n": "count(*)", "_f": "sum(abs(_r))", "_h": "sum(_s)"}
    sums |= {f"_g{i}": f"sum(_u * _e{i})" for i in range(n)}
    sums |= {f"_a{i}_{j}": f"sum(_v * _e{i} * _e{j})" for i in range(n) for j in range(i, n)}
    added = rows.groupBy(*keys).agg(*[F.expr(f"{v} as {k}") for k, v in sums.items()])
    kinds = {f.name: f.dataType.simpleString() for f in state.schema if f.name in keys}
    own = [f.split()[0] for f in STATE.split(", ")]
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + f", {STATE}, n_cells bigint"

    def step(batches):
        for pdf in batches:
            out = [{**{k: r[k] for k in keys}, **_next_state(r, n, gap), "n_cells": r["_n"]}
                   for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=[*keys, *own, "n_cells"])

    return added.join(state.select(*keys, *own), keys).mapInPandas(step, schema)


def _next_state(r: Mapping, n: int, gap: float) -> dict:
    """State of a key after a pass at its weights ``w``, from the pass's sums."""
    new = {k: r[k] for k in ("step", "value", "width")}
    new |= {k: np.array(r[k], float) for k in ("w", "base", "target", "best")}
    slope = np.array([r[f"_g{i}"] for i in range(n)]) / r["_n"]
    mae, w = r["_f"] / r["_n"], new["w"]
    new["best"] = w if mae <= r["mae"] else new["best"]
    new["mae"], new["bound"] = min(mae, r["mae"]), max(slope.min(), r["bound"])
    if new["mae"] - new["bound"] <= gap * new["mae"] + TINY:
        return new
    rounded = r["_h"] / r["_n"]
    if rounded > r["value"] * (1 + 1e-13) and r["step"] > 1e-9:
        new["step"] = r["step"] / 2
        new["w"] = new["base"] + new["step"] * (new["target"] - new["base"])
        return new
    # The gap is what rounding leaves and what is left of the slope; the width shrinks once the
    # latter is the smaller part, or where sums of this precision show no further descent.
    left = float(slope @ w - slope.min())
    new["value"] = rounded
    if left <= max(mae - float(slope @ w), 0.0) or r["step"] <= 1e-9:
        new["width"] = max(r["width"] * SHARPEN, 1e-12)
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = r[f"_a{i}_{j}"] / r["_n"]
    new["base"], new["step"] = w, 1.0
    new["target"] = new["w"] = _simplex_minimum(a, a @ w - slope, w)
    return new


# ---- weights in hundredths --------------------------------------------------------------


def simplex_grid(n: int, step: int = COARSE) -> list[tuple[int, ...]]:
    """All weight vectors in multiples of ``step`` hundredths that sum to 100."""
    units = 100 // step
    return [tuple(step * u for u in (*head, units - sum(head)))
            for head in itertools.product(range(units + 1), repeat=n - 1) if sum(head) <= units]


def simplex_moves(n: int, step: int, reach: int = REACH) -> list[tuple[int, ...]]:
    """All moves of up to ``reach`` steps per weight that keep the sum."""
    return [tuple(step * m for m in move)
            for move in itertools.product(range(-reach, reach + 1), repeat=n) if sum(move) == 0]


def _best(cells: DataFrame, keys: Sequence[str], moves: Sequence[Sequence[int]],
          around: bool) -> DataFrame:
    """Smallest-MAE candidate per key: one running sum per candidate in a single aggregation.

    Candidates are ``moves`` themselves, or ``moves`` added to the weights ``_b{i}`` on the
    row. Rows are never multiplied by candidates and no candidate table is joined. A candidate
    with a negative weight scores NULL and is skipped. Ties go to the earliest candidate.
    """
    n = len(moves[0])
    scores = []
    for move in moves:
        w = [f"(_b{i} + {m})" if around else str(m) for i, m in enumerate(move)]
        mix = " + ".join(f"{w[i]} * _p{i}" for i in range(n))
        error = f"abs(y_true - ({mix}) / 100)"
        if around:
            allowed = " and ".join(f"{x} >= 0" for x in w)
            error = f"case when {allowed} then {error} end"
        scores.append(f"round(avg({error}), 9)")
    base = [f"first(_b{i}) as _b{i}" for i in range(n)] if around else []
    scored = cells.groupBy(*keys).agg(
        F.expr(f"array({', '.join(scores)}) as _scores"), *[F.expr(x) for x in base],
        F.count(F.lit(1)).alias("n_cells"))
    table = "array(" + ", ".join(f"array({', '.join(map(str, m))})" for m in moves) + ")"
    pick = f"element_at({table}, cast(array_position(_scores, array_min(_scores)) as int))"
    return scored.withColumn("_pick", F.expr(pick)).select(
        *keys, *[F.expr(f"{f'_b{i} + ' if around else ''}_pick[{i}] as _b{i}") for i in range(n)],
        F.array_min("_scores").alias("mae"), "n_cells")


def search_weights(frame: DataFrame, models: Sequence[str], keys: Sequence[str] = ("series_id",)
                   ) -> DataFrame:
    """E4 in hundredths: (keys, model, weight, mae, n_cells) of the coarse-to-fine search.

    The grid grows fast with the members: meant for a handful of them, ``fit_weights`` takes any
    number and says how far from the smallest error it is.
    """
    keys, n = list(keys), len(models)
    cells = materialize(member_columns(frame, models, [k for k in keys if k != "series_id"]),
                        "weights")
    best = _best(cells, keys, simplex_grid(n), around=False)
    for step in REFINE:
        rows = attach(cells, best.select(*keys, *[f"_b{i}" for i in range(n)]), keys, "origin")
        best = _best(rows, keys, simplex_moves(n, step), around=True)
    pairs = F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col(f"_b{i}") / 100).alias("weight"))
        for i, m in enumerate(models)])
    return best.select(*keys, "mae", "n_cells", F.inline(pairs))


def regime_day_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("n_days"))


def fit_regime_weights(frame: DataFrame, models: Sequence[str], threshold: float | DataFrame,
                       min_days: int = 20, test_days: DataFrame | None = None,
                       strict: bool = False) -> DataFrame:
    """E5. E4 per regime; a regime with fewer than ``min_days`` days is refused.

    Returns (series_id, regime, model, weight, mae, bound, n_cells).
    """
    labelled = labelled_by_regime(frame, threshold, min_days)
    return fit_weights(labelled, models, ("series_id", "regime"), test_days, strict)


def labelled_by_regime(frame: DataFrame, threshold: float | DataFrame, min_days: int = 20
                       ) -> DataFrame:
    """``frame`` with the regime of its days; one with fewer than ``min_days`` days is refused."""
    labels = regime_labels(frame, threshold)
    counts = labels.groupBy("series_id").agg(*[
        F.count_if(F.col("regime") == r).alias(r) for r in (CALM, STRESSED)])
    refuse_any(counts.filter(F.least(CALM, STRESSED) < min_days),
               f"each regime needs {min_days} validation days or more")
    return frame.join(labels, ["series_id", "origin"])


def regime_threshold(train: DataFrame, validation: DataFrame,
                     ks: Sequence[float] = (3.0, 2.5, 2.0, 1.5), min_days: int = 20) -> DataFrame:
    """E6. mean + k std of the training prices, with the largest admissible k.

    ``train`` is (series_id, ts, price) from before every tuning window; k is admissible when
    both regimes keep ``min_days`` validation days. All k are counted in one aggregation. A
    series without an admissible k fails the job.
    """
    ks = sorted(ks, reverse=True)
    stats = train.groupBy("series_id").agg(
        F.avg("price").alias("_mean"), F.stddev_samp("price").alias("_std"))
    days = _previous_peak(day_peaks(validation)).join(stats, "series_id")  # one row per day
    limit = [F.col("_mean") + k * F.col("_std") for k in ks]
    counts = days.groupBy("series_id").agg(
        F.first("_mean").alias("mean_price"), F.first("_std").alias("std_price"),
        F.count(F.lit(1)).alias("n_days"),
        *[F.count_if(F.col("prev_peak") > t).alias(f"_s{i}") for i, t in enumerate(limit)])
    options = F.array(*[
        F.struct(F.lit(float(k)).alias("k"), F.col(f"_s{i}").alias("stressed_days"))
        for i, k in enumerate(ks)])
    admissible = F.filter(options, lambda o: (o["stressed_days"] >= min_days)
                          & (F.col("n_days") - o["stressed_days"] >= min_days))
    none = F.raise_error(F.concat(F.lit("no k leaves both regimes enough days in series "),
                                  F.col("series_id")))
    picked = counts.withColumn("_o", F.when(F.size(admissible) > 0, F.get(admissible, F.lit(0)))
                               .otherwise(none))
    return picked.select(
        "series_id", F.col("_o.k").alias("k"), "mean_price", "std_price",
        (F.col("mean_price") + F.col("_o.k") * F.col("std_price")).alias("threshold"),
        F.col("_o.stressed_days").alias("stressed_days"),
        (F.col("n_days") - F.col("_o.stressed_days")).alias("calm_days"))


# ---- recalibration ----------------------------------------------------------------------

MODEL_DAY = ["series_id", "model", "origin"]
COLD_START = ("exclude", "expanding")


def daily_signed_error(frame: DataFrame) -> DataFrame:
    """E7. Mean (truth - forecast) per day; the sign is the point."""
    return frame.groupBy(*MODEL_DAY).agg(
        F.avg(F.col("y_true") - F.col("y_pred")).alias("signed"))


def _correction(window: int, cold_start: str) -> Column:
    """Mean of the previous ``window`` rows, never the row itself.

    Runs over one row per model and day, so a partition is bounded by the calendar.
    """
    if cold_start not in COLD_START:
        raise ValueError(f"cold_start must be one of {COLD_START}")
    if window < 1:
        raise ValueError("the window must be at least one day")
    past = Window.partitionBy("series_id", "model").orderBy("origin").rowsBetween(-window, -1)
    needed = window if cold_start == "exclude" else 1
    return F.when(F.count("signed").over(past) >= needed, F.avg("signed").over(past))


def rolling_correction(frame: DataFrame, window: int, cold_start: str = "exclude") -> DataFrame:
    """E8. (series_id, model, origin, correction); NULL without enough history, never 0."""
    return daily_signed_error(frame).withColumn(
        "correction", _correction(window, cold_start)).select(*MODEL_DAY, "correction")


def recalibrate(frame: DataFrame, window: int, cold_start: str = "exclude") -> DataFrame:
    """E9. Add the day's correction to all its hours; days without one are dropped."""
    c = rolling_correction(frame, window, cold_start).filter("correction is not null")
    return frame.join(c, MODEL_DAY).withColumn("y_pred", F.col("y_pred") + F.col("correction"))


def recalibration_sweep(frame: DataFrame, windows: Sequence[int] = (7, 14, 30),
                        cold_start: str = "exclude", by: Sequence[str] = ("model",)) -> DataFrame:
    """E10/E11. Raw against corrected errors on the same surviving days, per window.

    All windows are carried side by side on day vectors: corrections are one window over the
    days, last week's truth a calendar lag, and the summary is unpivoted at the end. The
    hourly frame is shuffled once and never joined with itself.
    """
    names = [f"_c{w}" for w in windows]
    days = pack_days(frame, MODEL_DAY).withColumn("signed", signed_error())
    days = days.withColumns({n: _correction(w, cold_start) for n, w in zip(names, windows)})
    days = calendar_lags(days, {
        "_week": ("y_true", 7), **{f"_w{n}": (n, 7) for n in names}},
        day="origin", keys=("series_id", "model"))
    rows = unpack_days(days, [*names, *[f"_w{n}" for n in names]], {"_last_week": "_week"})
    error = F.col("y_true") - F.col("y_pred")
    week = F.abs(F.col("y_true") - F.col("_last_week"))
    aggs = [F.avg(F.abs(error)).alias("_all"), F.avg(week).alias("_all_naive")]
    for n in names:
        known = F.col(n).isNotNull()
        fixed = error - F.col(n)
        aggs += [
            F.avg(F.when(known, F.abs(error))).alias(f"{n}_raw"),
            F.avg(F.when(known, F.abs(fixed))).alias(f"{n}_new"),
            F.sqrt(F.avg(F.when(known, error * error))).alias(f"{n}_raw2"),
            F.sqrt(F.avg(F.when(known, fixed * fixed))).alias(f"{n}_new2"),
            F.avg(F.when(known & F.col(f"_w{n}").isNotNull(), week)).alias(f"{n}_naive"),
            F.count_if(known & (F.col("hour") == 0)).alias(f"{n}_days"),
        ]
    wide = rows.groupBy(*by).agg(*aggs)
    items = F.array(*[
        F.struct(
            F.lit(w).alias("window"), F.col(f"{n}_days").alias("n_days"),
            ratio(F.col("_all"), F.col("_all_naive")).alias("rmae_raw_all"),
            F.col(f"{n}_raw").alias("mae_raw"), F.col(f"{n}_new").alias("mae_recal"),
            F.col(f"{n}_raw2").alias("rmse_raw"), F.col(f"{n}_new2").alias("rmse_recal"),
            ratio(F.col(f"{n}_raw"), F.col(f"{n}_naive")).alias("rmae_raw"),
            ratio(F.col(f"{n}_new"), F.col(f"{n}_naive")).alias("rmae_recal"),
        ) for n, w in zip(names, windows)])
    return wide.select(*by, F.inline(items)).withColumn(
        "rmae_change", F.col("rmae_recal") - F.col("rmae_raw"))


def compare_recalibration(frame: DataFrame, window: int, cold_start: str = "exclude",
                          by: Sequence[str] = ("model",)) -> DataFrame:
    """E10."""
    return recalibration_sweep(frame, (window,), cold_start, by)


def crossings(sweep: DataFrame, reference: str = "naive") -> DataFrame:
    """E12. Trained rows that move from rMAE >= 1 to below 1."""
    return sweep.filter((F.col("model") != reference)
                        & (F.col("rmae_raw") >= 1) & (F.col("rmae_recal") < 1))


def regime_share(labels: DataFrame, degenerate_above: float = 0.9) -> DataFrame:
    """E13. Stressed share per series, flagged when the switch hardly ever rests."""
    share = F.avg((F.col("regime") == STRESSED).cast("double"))
    return labels.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("regime") == STRESSED).alias("n_stressed"), share.alias("share"),
    ).withColumn("degenerate", F.col("share") > degenerate_above)


def level_shift(live: DataFrame, train: DataFrame) -> DataFrame:
    """E14. Mean live price over mean training price."""
    both = live.select("series_id", F.col("price").alias("_live"), F.lit(None).cast("double").alias("_train"))
    both = both.unionAll(train.select("series_id", F.lit(None).cast("double"), "price"))
    return both.groupBy("series_id").agg(
        F.avg("_live").alias("live_mean"), F.avg("_train").alias("train_mean")).withColumn(
        "shift", ratio(F.col("live_mean"), F.col("train_mean")))
