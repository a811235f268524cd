"""Exploratory summaries of hourly series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.functions.exprs import (
    bias_corrected_kurtosis, bias_corrected_skewness, nan_to_null, non_negative_root, ratio)
from daymark.functions.tails import upper_tail
from daymark.operators.ordered import attach, running_sum, with_halo, with_position
from daymark.operators.quantiles import quantiles
from daymark.session import materialize

SERIES = ["series_id"]


def _month(ts: str = "ts") -> Column:
    return F.trunc(F.to_date(ts), "month")


def _negatives(price: Column) -> list[Column]:
    n = F.count_if(price < 0)
    return [n.alias("negative_hours"),
            ratio(100.0 * n, F.count(F.lit(1))).alias("negative_pct")]


def distribution_stats(df: DataFrame, by: Sequence[str] = ("series_id", "split")) -> DataFrame:
    """X1. Mean, sample std, bias-corrected skewness and kurtosis, negative hours."""
    p = F.col("price")
    return df.groupBy(*by).agg(
        F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
        bias_corrected_skewness(p).alias("skew"), bias_corrected_kurtosis(p).alias("kurt"),
        *_negatives(p))


def histogram(df: DataFrame, bins: int = 100, by: Sequence[str] = ("series_id", "split")
              ) -> DataFrame:
    """X2. Equal-width counts between each group's minimum and maximum, last edge included."""
    span = df.groupBy(*by).agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.floor((F.col("price") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    rows = attach(df.filter("price is not null"), span, by, "ts").withColumn(
        "bin", F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
            F.least(slot, F.lit(bins - 1))).cast("int"))
    return rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("_lo") + F.col("bin") * width).alias("left_edge"))


def box_stats(df: DataFrame, by: Sequence[str] = ("series_id", "split")) -> DataFrame:
    """X3. Exact interpolated quartiles, by counting passes."""
    return quantiles(df, "price", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)


def hour_profile(df: DataFrame) -> DataFrame:
    """X4. Mean price per hour of day, weekdays against weekends."""
    weekend = F.weekday(F.to_date("ts")) >= 5
    return df.groupBy("series_id", F.hour("ts").alias("hour")).agg(
        F.avg(F.when(~weekend, F.col("price"))).alias("weekday"),
        F.avg(F.when(weekend, F.col("price"))).alias("weekend"))


def weekday_means(df: DataFrame) -> DataFrame:
    """X5. Monday is 0."""
    return df.groupBy("series_id", F.weekday(F.to_date("ts")).alias("weekday")).agg(
        F.avg("price").alias("mean"))


def month_means(df: DataFrame) -> DataFrame:
    """X6."""
    return df.groupBy("series_id", F.month("ts").alias("month")).agg(F.avg("price").alias("mean"))


def rolling_sums(df: DataFrame, width: int, terms: dict[str, Column], centre: Sequence[str]
                 ) -> DataFrame:
    """Trailing ``width``-row sums of ``terms`` over ``centre`` columns, at constant cost per row.

    Blocks overlap by one window. Inside a block each column is centred on its block mean,
    summed cumulatively, and two cumulative sums are subtracted; centring keeps the
    subtraction accurate. Terms see the centred columns as ``_{name}``. A window that holds a
    NULL, or fewer than ``width`` rows, yields NULL.
    """
    blocks = with_halo(with_position(df, SERIES, "ts", _month()), "pos", width - 1)
    group = Window.partitionBy("series_id", "_block")
    upto = group.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = group.orderBy("pos")
    known = F.lit(True)
    for c in centre:
        known = known & F.col(c).isNotNull()
    rows = blocks.withColumns({f"_{c}": F.col(c) - F.avg(c).over(group) for c in centre})
    rows = rows.withColumns({
        "_t_n": F.sum(F.when(known, 1).otherwise(0)).over(upto),
        **{f"_t_{k}": F.sum(F.coalesce(F.when(known, t), F.lit(0.0))).over(upto)
           for k, t in terms.items()}})
    wanted = {k: F.col(f"_t_{k}") - F.coalesce(F.lag(f"_t_{k}", width).over(order), F.lit(0))
              for k in ("n", *terms)}
    rows = rows.withColumns({f"_w_{k}": c for k, c in wanted.items()}).filter("_own")
    full = F.col("_w_n") == width
    return rows.select(*df.columns, *[
        F.when(full, F.col(f"_w_{k}")).alias(k) for k in terms])


def rolling_std(df: DataFrame, width: int = 168) -> DataFrame:
    """X7. Sample std of the last ``width`` rows, NULL until full."""
    x = F.col("_price")
    sums = rolling_sums(df.select("series_id", "ts", "price"), width,
                        {"_s": x, "_ss": x * x}, ["price"])
    var = (F.col("_ss") - F.col("_s") * F.col("_s") / width) / (width - 1)
    return sums.select("series_id", "ts", non_negative_root(var).alias("rolling_std"))


def spike_counts(df: DataFrame, k: float = 3.0) -> DataFrame:
    """X8. Hours above the training mean + k std, in each split. ``df`` carries ``split``."""
    train = F.when(F.col("split") == "train", F.col("price"))
    limit = df.groupBy(*SERIES).agg((F.avg(train) + k * F.stddev_samp(train)).alias("threshold"))
    above = F.count_if(F.col("price") > F.col("threshold"))
    return attach(df, limit, SERIES, "ts").groupBy("series_id", "split").agg(
        F.first("threshold").alias("threshold"), above.alias("spikes"),
        ratio(100.0 * above, F.count(F.lit(1))).alias("spike_pct"))


def days_over_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """X9. Days with any hour above the threshold, per year."""
    days = df.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.max("price").alias("peak"))
    return days.groupBy("series_id", F.year("day").alias("year")).agg(
        F.count_if(F.col("peak") > threshold).alias("days_over"),
        F.count(F.lit(1)).alias("n_days"))


# ---- dependence -------------------------------------------------------------------------


def _centred(df: DataFrame) -> DataFrame:
    """Known prices with their 0-based position, their number and deviation from the mean."""
    known = df.select("series_id", "ts", nan_to_null("price").alias("price")).filter(
        "price is not null")
    rows = with_position(known, SERIES, "ts", _month(), totals={
        "_sum": F.sum("price"), "n": F.count(F.lit(1))})
    return rows.withColumn("e", F.col("price") - F.col("_sum") / F.col("n"))


def _blocks(rows: DataFrame, reach: int, value: str) -> DataFrame:
    """(series_id, own_from, values): overlapping blocks of bounded size as arrays."""
    return with_halo(rows, "pos", reach).groupBy("series_id", "_block").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("_p"),
        F.count_if(~F.col("_own")).cast("int").alias("own_from"),
    ).select("series_id", "own_from", F.col("_p.v").alias("values"))


def _lag_products(values: np.ndarray, own_from: int, top: int) -> np.ndarray:
    """Sum of v[t] v[t-k] over the block's own t, for k = 0..top."""
    out = np.zeros(top + 1)
    for k in range(top + 1):
        start = max(own_from, k)
        if start < len(values):
            out[k] = values[start:] @ values[start - k:len(values) - k]
    return out


def autocovariance(df: DataFrame, lags: int) -> DataFrame:
    """(series_id, k, n, acov) for k = 0..lags, common mean, divided by n.

    Every block multiplies its own rows with up to ``lags`` earlier ones; the products are
    summed per (series, k). Rows are not multiplied by lags in any shuffle.
    """
    return _autocovariance(_centred(df), lags)


def _autocovariance(rows: DataFrame, lags: int) -> DataFrame:
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [_lag_products(np.asarray(v, dtype=float), int(o), lags)
                     for v, o in zip(pdf["values"], pdf["own_from"])]
            own = [len(v) - int(o) for v, o in zip(pdf["values"], pdf["own_from"])]
            yield pd.DataFrame({
                "series_id": np.repeat(pdf["series_id"].to_numpy(), lags + 1),
                "k": np.tile(np.arange(lags + 1, dtype=np.int32), len(pdf)),
                "s": np.concatenate(parts) if parts else np.zeros(0),
                "own": np.repeat(np.array(own, dtype=np.int64), lags + 1)})

    partial = _blocks(rows, lags, "e").mapInPandas(
        products, "series_id string, k int, s double, own bigint")
    return partial.groupBy("series_id", "k").agg(
        F.sum("own").alias("n"), F.sum("s").alias("_s")).filter("k < n").select(
        "series_id", "k", "n", (F.col("_s") / F.col("n")).alias("acov"))


def acf(df: DataFrame, lags: int = 192) -> DataFrame:
    """X10. Autocorrelation at lags 0..``lags``."""
    zero = F.first("acov").over(Window.partitionBy("series_id").orderBy("k"))
    return autocovariance(df, lags).withColumn("_c0", zero).select(
        "series_id", "k", "n", ratio(F.col("acov"), F.col("_c0")).alias("acf"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _durbin_levinson(acov: pd.Series) -> pd.Series:
    """Partial autocorrelations from one series' autocovariances (Yule-Walker)."""

    def one(c: np.ndarray) -> list[float]:
        r = np.asarray(c, dtype=float) / c[0]
        phi, v, out = np.zeros(0), 1.0, [1.0]
        for k in range(1, len(r)):
            a = (r[k] - (phi @ r[k - 1:0:-1] if k > 1 else 0.0)) / v
            phi = np.concatenate([phi - a * phi[::-1], [a]])
            v *= 1 - a * a
            out.append(a)
        return out

    return acov.map(one)


def pacf(df: DataFrame, lags: int = 192) -> DataFrame:
    """X11. Partial autocorrelation by Yule-Walker with the plain (divide by n) covariances."""
    packed = autocovariance(df, lags).groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("k", "acov"))).alias("_c"))
    return packed.select("series_id", F.posexplode(
        _durbin_levinson(F.col("_c.acov"))).alias("k", "pacf"))


# MacKinnon (1994) response surface for the constant-only unit-root test
# (small-p and large-p polynomials, switch point), and asymptotic 1/5/10 % critical values.
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SWITCH = -1.61
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
# Kwiatkowski et al. (1992), level-stationarity critical values and their p.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def _adf_rows(x: np.ndarray, first: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors [x(t-1), 1, dx(t-1..t-lags)] and response dx(t) for t = first..end."""
    dx = np.diff(x)
    t = np.arange(first, len(x))
    cols = [x[t - 1], np.ones(len(t))] + [dx[t - 1 - j] for j in range(1, lags + 1)]
    return np.column_stack(cols), dx[t - 1]


def _adf_solve(gram: np.ndarray, n: int, head: np.ndarray, top: int) -> tuple[float, int, int]:
    """Lag by AIC on the common sample, then the t-statistic with all usable rows.

    ``gram`` is Z'Z of [regressors, response] over t > top; every shorter lag is a leading
    sub-matrix. ``head`` holds the first rows, which a shorter lag can use as well.
    """
    best, pick = np.inf, 0
    for p in range(top + 1):
        a = gram[:p + 2, :p + 2]
        b = gram[:p + 2, -1]
        rss = gram[-1, -1] - b @ np.linalg.solve(a, b)
        aic = n * (np.log(2 * np.pi * rss / n) + 1) + 2 * (p + 2)
        if aic < best - 1e-9:
            best, pick = aic, p
    a, b, yy = gram[:pick + 2, :pick + 2].copy(), gram[:pick + 2, -1].copy(), gram[-1, -1]
    if pick < top:
        z, y = _adf_rows(head[:top + 1], pick + 1, pick)
        a, b, yy, n = a + z.T @ z, b + z.T @ y, yy + y @ y, n + len(y)
    beta = np.linalg.solve(a, b)
    sigma2 = (yy - b @ beta) / (n - pick - 2)
    return float(beta[0] / np.sqrt(sigma2 * np.linalg.inv(a)[0, 0])), pick, n


def adf(df: DataFrame, max_lag: int) -> DataFrame:
    """X12. Augmented Dickey-Fuller test with constant, lag chosen by AIC up to ``max_lag``.

    Blocks contribute partial cross-products of the regression; one small matrix per series is
    solved at the end. Values are centred first, which leaves the statistic unchanged.
    """
    size = max_lag + 3
    rows = _centred(df)
    blocks = with_halo(rows, "pos", max_lag + 1).groupBy("series_id", "_block").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("e").alias("v")))).alias("_p"),
        F.count_if(~F.col("_own")).cast("int").alias("own_from"),
    ).select("series_id", "_block", "own_from", F.col("_p.v").alias("values"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, block, own, values in zip(pdf["series_id"], pdf["_block"], pdf["own_from"],
                                               pdf["values"]):
                x = np.asarray(values, dtype=float)
                first = max(int(own), max_lag + 1)
                g, n = np.zeros((size, size)), 0
                if first < len(x):
                    z, y = _adf_rows(x, first, max_lag)
                    full = np.column_stack([z, y])
                    g, n = full.T @ full, len(y)
                head = x[:max_lag + 1].tolist() if block == 0 else None
                out.append((sid, g.ravel().tolist(), n, head))
            yield pd.DataFrame(out, columns=["series_id", "g", "n", "head"])

    partial = blocks.mapInPandas(
        grams, "series_id string, g array<double>, n bigint, head array<double>")
    # Element-wise sums of the partial matrices, spread over (series, cell).
    cells = partial.select("series_id", F.posexplode("g").alias("i", "v")).groupBy(
        "series_id", "i").agg(F.sum("v").alias("v"))
    packed = cells.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_g"))
    facts = partial.groupBy(*SERIES).agg(
        F.sum("n").alias("n"), F.first("head", ignorenulls=True).alias("head"))

    @F.pandas_udf(T.StructType().add("stat", T.DoubleType()).add("used_lag", T.IntegerType()).add("nobs", T.LongType()))
    def solve(g: pd.Series, n: pd.Series, head: pd.Series) -> pd.DataFrame:
        rows = [_adf_solve(np.asarray(a, dtype=float).reshape(size, size), int(m),
                           np.asarray(h, dtype=float), max_lag) for a, m, h in zip(g, n, head)]
        return pd.DataFrame(rows, columns=["stat", "used_lag", "nobs"])

    out = packed.join(facts, SERIES).withColumn("_r", solve(F.col("_g.v"), "n", "head")).select(
        "series_id", "_r.stat", "_r.used_lag", "_r.nobs")
    s = F.col("stat")
    small = sum((c * F.pow(s, F.lit(i)) for i, c in enumerate(ADF_SMALL_P)), F.lit(0.0))
    large = sum((c * F.pow(s, F.lit(i)) for i, c in enumerate(ADF_LARGE_P)), F.lit(0.0))
    z = F.when(s <= ADF_SWITCH, small).otherwise(large)
    return out.withColumn("p", upper_tail(-z)).withColumn(
        "stationary", s < ADF_CRITICAL["5%"])


def kpss(df: DataFrame, lags: int | None = None) -> DataFrame:
    """X13. Level-stationarity statistic: prefix sums over a Bartlett long-run variance.

    Without ``lags`` the data-dependent rule of Hobijn et al. (1998) is used. It is evaluated
    from the first n^(2/9) autocovariances; then as many are computed as it asks for.
    """
    rows = materialize(_centred(df), "centred")  # read by both parts of the statistic
    sums = running_sum(rows, SERIES, "ts", _month(), "e", "_s").groupBy(*SERIES).agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.first("n").alias("n"))
    if lags is None:
        longest = sums.agg(F.max("n")).first()[0] or 1
        chosen = kpss_lags(_autocovariance(rows, int(longest ** (2 / 9)) + 1))
        chosen = materialize(chosen, "kpss-lags")
        most = chosen.agg(F.max("lags")).first()[0] or 0
    else:
        chosen, most = sums.select("series_id", F.lit(lags).alias("lags")), lags
    cov = _autocovariance(rows, most)
    weight = F.when(F.col("k") == 0, 1.0).otherwise(
        2 * (1 - F.col("k") / (F.col("lags") + 1.0)))
    lrv = cov.join(chosen, SERIES).filter("k <= lags").groupBy(*SERIES).agg(
        F.sum(weight * F.col("acov")).alias("_lrv"), F.first("lags").alias("lags"))
    stat = F.col("_ss") / (F.col("n") * F.col("n")) / F.col("_lrv")
    out = sums.join(lrv, SERIES).select(
        "series_id", "n", "lags", stat.alias("stat"))
    p = F.lit(KPSS_P[-1])
    for i in reversed(range(3)):
        lo, hi = KPSS_CRITICAL[i], KPSS_CRITICAL[i + 1]
        line = KPSS_P[i] + (F.col("stat") - lo) * (KPSS_P[i + 1] - KPSS_P[i]) / (hi - lo)
        p = F.when(F.col("stat") < hi, line).otherwise(p)
    return out.withColumn("p", F.when(F.col("stat") < KPSS_CRITICAL[0], KPSS_P[0]).otherwise(p))


def kpss_lags(cov: DataFrame) -> DataFrame:
    """(series_id, lags): data-dependent lag count from autocovariances."""
    n = F.col("n").cast("double")
    use = F.col("k") <= F.floor(F.pow(n, F.lit(2.0 / 9.0)))
    c = F.col("acov")
    s0 = F.sum(F.when(use, F.when(F.col("k") == 0, c).otherwise(2 * c)))
    s1 = F.sum(F.when(use, 2 * F.col("k") * c))
    agg = cov.groupBy(*SERIES).agg(s0.alias("_s0"), s1.alias("_s1"), F.max("n").alias("n"))
    r = F.col("_s1") / F.col("_s0")
    gamma = 1.1447 * F.pow(r * r, F.lit(1.0 / 3.0))
    return agg.select("series_id", F.least(
        F.floor(gamma * F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))),
        F.col("n") - 1).cast("int").alias("lags"))


def exog_corr(df: DataFrame, exog: Sequence[str] = ("exog_1", "exog_2")) -> DataFrame:
    """X14. Pearson correlation of the price with each exogenous column."""
    return df.groupBy(*SERIES).agg(*[F.corr("price", c).alias(f"corr_{c}") for c in exog])


def rolling_corr(df: DataFrame, width: int = 720, other: str = "exog_1") -> DataFrame:
    """X15. Correlation of price and ``other`` over the last ``width`` rows."""
    x, y = F.col("_price"), F.col(f"_{other}")
    sums = rolling_sums(df.select("series_id", "ts", "price", other), width, {
        "_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}, ["price", other])
    cov = F.col("_xy") - F.col("_x") * F.col("_y") / width
    vx = F.col("_xx") - F.col("_x") * F.col("_x") / width
    vy = F.col("_yy") - F.col("_y") * F.col("_y") / width
    ok = (vx > 0) & (vy > 0)
    return sums.select("series_id", "ts", F.when(ok, cov / F.sqrt(vx * vy)).alias("rolling_corr"))


def yearly_summary(df: DataFrame) -> DataFrame:
    """X16."""
    return df.groupBy("series_id", F.year("ts").alias("year")).agg(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"),
        F.min("price").alias("min"), F.max("price").alias("max"))


def daily_series(df: DataFrame) -> DataFrame:
    """X17. Daily mean over a gapless calendar; a day without data is NULL."""
    from daymark.operators.quality import densify_days

    return densify_days(df.groupBy("series_id", F.to_date("ts").alias("day")).agg(
        F.avg("price").alias("baseload")))


def daily_missing(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("baseload").isNull()).alias("missing_days"))
