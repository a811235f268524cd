"""Forecast-comparison tests on daily loss differentials.

A differential has one row per day, so a (series, pair) group is bounded by the calendar and a
window over it is safe. The hourly frame is reduced to days before anything is ordered.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import bias_corrected_skewness, newey_west_lags, ratio
from daymark.functions.tails import upper_tail
from daymark.operators.ensemble import regime_labels
from daymark.operators.quality import refuse_any

DAY = ["series_id", "origin"]
#: Differences within this share of the mean difference (or of one) count as none.
FLAT = 1e-12
BOOT_BLOCKS = (3, 4, 5, 7, 9, 10)
BOOT_DRAWS = 20_000
BOOT_SEED = 42


def daily_losses(frame: DataFrame, norm: int = 1) -> DataFrame:
    """(series_id, model, origin, loss): mean absolute (1) or mean squared (2) error of a day.

    The squared loss keeps its square: a root would not survive the difference of two losses.
    """
    if norm not in (1, 2):
        raise ValueError("norm must be 1 or 2")
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return frame.groupBy("series_id", "model", "origin").agg(
        F.avg(e if norm == 1 else e * e).alias("loss"))


def loss_columns(frame: DataFrame, models: Sequence[str], norm: int = 1) -> DataFrame:
    """One row per (series, day) with the loss of every listed model as ``_l{i}``."""
    return daily_losses(frame, norm).groupBy(*DAY).agg(*[
        F.max(F.when(F.col("model") == m, F.col("loss"))).alias(f"_l{i}")
        for i, m in enumerate(models)])


def loss_differential(frame: DataFrame, first: str, second: str, norm: int = 1) -> DataFrame:
    """A8. ``d = loss(first) - loss(second)`` per day that both models have: positive where
    ``second`` wins."""
    wide = loss_columns(frame.filter(F.col("model").isin(first, second)), (first, second), norm)
    return wide.select(*DAY, (F.col("_l0") - F.col("_l1")).alias("d")).filter("d IS NOT NULL")


def pair_differentials(frame: DataFrame, models: Sequence[str], norm: int = 1) -> DataFrame:
    """(series_id, origin, model_row, model_col, d) for every unordered pair, row before col.

    ``d = loss(col) - loss(row)``. The opposite direction is its negative and is added after
    the test, so each pair is computed once.
    """
    pairs = F.array(*[
        F.struct(F.lit(models[i]).alias("model_row"), F.lit(models[j]).alias("model_col"),
                 (F.col(f"_l{j}") - F.col(f"_l{i}")).alias("d"))
        for i, j in itertools.combinations(range(len(models)), 2)])
    return loss_columns(frame, models, norm).select(*DAY, F.inline(pairs)).filter("d IS NOT NULL")


def dm_statistics(d: DataFrame, keys: Sequence[str], method: str = "hac",
                  bandwidth: int | None = None) -> DataFrame:
    """A9/A10. One row per key: n, dbar, the variance, the statistic and a status.

    ``hac`` uses Bartlett weights over ``bandwidth`` lags (default rule
    max(1, floor(4 (n/100)^(2/9))), at most n - 1); ``uncorrected`` assumes independent days.
    Days are ordered and counted as adjacent even if a subset left gaps. Statuses other than
    ``ok``: ``identical`` (no difference, p = 0.5), ``degenerate`` (constant non-zero
    difference), ``too few days``.
    """
    if method not in ("hac", "uncorrected"):
        raise ValueError("method must be 'hac' or 'uncorrected'")
    top = 0 if method == "uncorrected" else bandwidth
    if top is None:
        longest = d.groupBy(*keys).count().select(newey_west_lags(F.col("count")).alias("lags"))
        top = longest.agg(F.max("lags")).first()[0] or 0
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("origin")
    e = F.col("_e")
    rows = d.withColumn("_e", F.col("d") - F.avg("d").over(group)).withColumns({
        f"_x{k}": e * F.lag("_e", k).over(ordered) for k in range(1, top + 1)})
    agg = rows.groupBy(*keys).agg(
        F.count("d").alias("n"), F.avg("d").alias("dbar"),
        F.avg(e * e).alias("iid_var"),
        *[F.sum(f"_x{k}").alias(f"_x{k}") for k in range(1, top + 1)])
    n = F.col("n")
    if method == "uncorrected":
        lags = F.lit(0)
    elif bandwidth is None:
        lags = newey_west_lags(n)
    else:
        lags = F.least(F.lit(bandwidth), (n - 1).cast("int"))
    out = agg.withColumn("lags", lags)
    var = F.col("iid_var")
    for k in range(1, top + 1):
        term = 2 * (1 - k / (F.col("lags") + 1.0)) * F.col(f"_x{k}") / n
        var = var + F.when(F.col("lags") >= k, term).otherwise(0.0)
    size = F.abs("dbar")
    tolerance = FLAT * F.greatest(size, F.lit(1.0))
    constant = F.sqrt("iid_var") <= tolerance
    status = (
        F.when(n < 3, "too few days").when(~constant, "ok")
        .when(size > tolerance, "degenerate").otherwise("identical"))
    out = out.withColumn("_v", var).withColumn("status", status).withColumn(
        "variance", F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.col("iid_var")))
    stat = F.when(F.col("status") == "identical", 0.0).when(
        F.col("status") == "ok", F.col("dbar") / F.sqrt(F.col("variance") / n))
    return out.select(*keys, "n", "dbar", "lags", "iid_var", "variance", stat.alias("stat"),
                      "status")


def with_p(stats: DataFrame, name: str = "p") -> DataFrame:
    """One-sided p-value: small when the second model of the differential is better."""
    return stats.withColumn(name, upper_tail(F.col("stat")))


def require_testable(stats: DataFrame) -> DataFrame:
    refuse_any(stats.filter("status in ('degenerate', 'too few days')"),
               "the loss differential cannot be tested")
    return stats


def require_comparable(frame: DataFrame, models: Sequence[str]) -> None:
    """Refuse members that do not forecast the same origins against the same truth."""
    listed = frame.filter(F.col("model").isin(*models))
    cells = listed.groupBy(*DAY, "hour").agg(
        F.count_distinct("model").alias("held"), F.min("y_true").alias("low"),
        F.max("y_true").alias("high"))
    refuse_any(cells.filter((F.col("held") < len(models)) | (F.col("low") < F.col("high"))),
               "the models must share every origin and its truth")


def dm_matrix(frame: DataFrame, models: Sequence[str], method: str = "hac",
              strict: bool = True) -> DataFrame:
    """A11. Every ordered pair: p that the row model is more accurate than the column model.

    Long form (series_id, model_row, model_col, n, stat, p, status); the diagonal is absent.
    Strict mode refuses models with different origins or truth.
    """
    if strict:
        require_comparable(frame, models)
    stats = dm_statistics(pair_differentials(frame, models),
                          ["series_id", "model_row", "model_col"], method)
    both = F.array(
        F.struct(F.col("model_row"), F.col("model_col"), F.col("stat")),
        F.struct(F.col("model_col").alias("model_row"), F.col("model_row").alias("model_col"),
                 (-F.col("stat")).alias("stat")))
    return with_p(stats.select("series_id", "n", "status", F.inline(both)))


# ---- block bootstrap --------------------------------------------------------------------


def _bootstrap_hits(d: np.ndarray, block: int, draws: int, seed: int, step: int = 1000) -> int:
    """Circular block resamples whose centred mean reaches the observed mean.

    Block sums come from one prefix sum over the doubled series; memory stays at
    ``step`` x blocks however many draws are asked for.
    """
    n = len(d)
    block = max(1, min(block, n - 1))
    blocks = -(-n // block)
    tail = n - (blocks - 1) * block
    centred = d - d.mean()
    prefix = np.concatenate([[0.0], np.cumsum(np.concatenate([centred, centred]))])
    full = prefix[block:block + n] - prefix[:n]
    last = prefix[tail:tail + n] - prefix[:n]
    rng = np.random.default_rng(seed)
    hits = 0
    for begin in range(0, draws, step):
        starts = rng.integers(0, n, size=(min(step, draws - begin), blocks))
        means = (full[starts[:, :-1]].sum(axis=1) + last[starts[:, -1]]) / n
        hits += int((means >= d.mean()).sum())
    return hits


def block_bootstrap(d: DataFrame, keys: Sequence[str], blocks: Sequence[int] = BOOT_BLOCKS,
                    draws: int = BOOT_DRAWS, seed: int = BOOT_SEED) -> DataFrame:
    """A12. (keys, block, n, p): circular block bootstrap of mean(d) <= 0 per block length.

    A key's days travel as one bounded array; every (key, block length) is its own row, so the
    resampling spreads over tasks. Lengths of n or more are skipped. p = (1 + hits)/(draws + 1).
    """
    series = d.filter("d is not null").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("origin", "d"))).alias("_days"))
    jobs = series.select(
        *keys, F.col("_days.d").alias("_d"),
        F.explode(F.array(*[F.lit(b) for b in blocks])).alias("block"),
    ).filter(F.col("block") < F.size("_d"))
    jobs = jobs.repartition(*keys, "block")

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "block"]].copy()
            out["n"] = [len(x) for x in pdf["_d"]]
            out["p"] = [
                (1.0 + _bootstrap_hits(np.asarray(x, dtype=float), int(b), draws, seed))
                / (draws + 1.0) for x, b in zip(pdf["_d"], pdf["block"])]
            yield out

    kinds = dict(jobs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "block"]) + ", n int, p double"
    return jobs.mapInPandas(resample, schema)


# ---- reports ----------------------------------------------------------------------------


def _pair_days(frame: DataFrame, first: str, second: str, threshold: float | DataFrame
               ) -> DataFrame:
    """Per day: both losses, the differential, the spread of predictions and the subsets.

    ``d`` is positive where ``first`` wins. A day belongs to ``all`` and to its regime.
    """
    p = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"_p{i}")
         for i, m in enumerate((first, second))]
    cells = frame.filter(F.col("model").isin(first, second)).groupBy(*DAY, "hour").agg(
        F.first("y_true").alias("y_true"), *p)
    gap = F.abs(F.col("_p0") - F.col("_p1"))
    days = cells.groupBy(*DAY).agg(
        F.avg(F.abs(F.col("y_true") - F.col("_p0"))).alias("_l0"),
        F.avg(F.abs(F.col("y_true") - F.col("_p1"))).alias("_l1"),
        F.avg(gap).alias("_gap"), F.max(gap).alias("_gap_max"))
    labelled = days.join(regime_labels(frame, threshold), DAY)
    return labelled.withColumn("d", F.col("_l1") - F.col("_l0")).withColumn(
        "subset", F.explode(F.array(F.lit("all"), F.col("regime"))))


def dm_regime_split(frame: DataFrame, first: str, second: str, threshold: float | DataFrame
                    ) -> DataFrame:
    """A14. (series_id, subset, n, mae_first, mae_second, stat, p) for all, stressed and calm."""
    days = _pair_days(frame, first, second, threshold)
    keys = ["series_id", "subset"]
    maes = days.groupBy(*keys).agg(F.avg("_l0").alias("mae_first"), F.avg("_l1").alias("mae_second"))
    return with_p(dm_statistics(days, keys).join(maes, keys))


def dm_regime_report(frame: DataFrame, first: str, second: str, threshold: float | DataFrame,
                     blocks: Sequence[int] = BOOT_BLOCKS, draws: int = BOOT_DRAWS,
                     seed: int = BOOT_SEED) -> DataFrame:
    """A13. Per subset: errors, how far the forecasts differ, dependence of the differential,
    both tests, and the bootstrap range over block lengths (NULL when none is short enough)."""
    days = _pair_days(frame, first, second, threshold)
    keys = ["series_id", "subset"]
    base = dm_regime_facts(days)
    hac = with_p(dm_statistics(days, keys), "p_hac").select(
        *keys, F.col("lags").alias("bandwidth"), F.col("stat").alias("stat_hac"), "p_hac")
    iid = with_p(dm_statistics(days, keys, "uncorrected"), "p_uncorrected").select(
        *keys, F.col("stat").alias("stat_uncorrected"), "p_uncorrected")
    boot = block_bootstrap(days.select(*keys, "origin", "d"), keys, blocks, draws, seed).groupBy(
        *keys).agg(F.min("p").alias("boot_low"), F.max("p").alias("boot_high"))
    out = base.join(hac, keys).join(iid, keys).join(boot, keys, "left")
    return out.withColumn("range_low", F.least("boot_low", "p_hac")).withColumn(
        "range_high", F.col("boot_high"))


def dm_regime_facts(days: DataFrame) -> DataFrame:
    keys = ["series_id", "subset"]
    w = Window.partitionBy(*keys).orderBy("origin")
    rows = days.withColumn("_prev", F.lag("d").over(w))
    # Pearson correlation of a series with its own shift: both sides without the first day.
    both = F.col("_prev").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_l0").alias("mae_first"),
        F.avg("_l1").alias("mae_second"), F.avg("_gap").alias("mean_gap"),
        F.max("_gap_max").alias("max_gap"),
        F.corr(F.when(both, F.col("d")), F.col("_prev")).alias("lag1_autocorr"),
        bias_corrected_skewness("d").alias("skewness"),
    ).withColumn("delta_pct", ratio(
        100 * (F.col("mae_first") - F.col("mae_second")), F.col("mae_second")))


def verdict(p_ours: Column, p_theirs: Column, level: float = 0.05) -> Column:
    return (
        F.when(p_ours < level, f"ours better (p<{level})")
        .when(p_theirs < level, f"theirs better (p<{level})")
        .otherwise("no significant difference"))


def dm_vs_published(frame: DataFrame, ours: Sequence[str], theirs: Sequence[str],
                    level: float = 0.05) -> DataFrame:
    """A18. Each own model against each published one, both directions, with a verdict."""
    models = [*ours, *theirs]
    pairs = F.array(*[
        F.struct(F.lit(o).alias("ours"), F.lit(t).alias("theirs"),
                 F.col(f"_l{models.index(o)}").alias("_lo"),
                 F.col(f"_l{models.index(t)}").alias("_lt"))
        for o in ours for t in theirs])
    days = loss_columns(frame, models).select(*DAY, F.inline(pairs)).withColumn(
        "d", F.col("_lt") - F.col("_lo"))
    keys = ["series_id", "ours", "theirs"]
    maes = days.groupBy(*keys).agg(F.avg("_lo").alias("mae_ours"), F.avg("_lt").alias("mae_theirs"))
    out = with_p(dm_statistics(days, keys).join(maes, keys), "p_ours_better")
    out = out.withColumn("p_theirs_better", upper_tail(-F.col("stat")))
    return out.withColumn("verdict", verdict(
        F.col("p_ours_better"), F.col("p_theirs_better"), level))
