"""Exact quantiles by counting passes over narrowing value ranges.

A percentile aggregate keeps every distinct value of a group in one buffer. Here a group is cut
into equal ranges between its smallest and largest value, the ranges are counted with map-side
combine, and only the range that holds a wanted rank is cut again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import nan_to_null
from daymark.operators.ordered import attach
from daymark.session import materialize

BINS = 1024
#: A range of at most this many values is ordered at once instead of being cut again.
SMALL = 4096


def _narrow(values: DataFrame, wanted: DataFrame, keys: Sequence[str], bin_of: Column) -> DataFrame:
    """Each wanted rank with the smallest and largest value of the bin that it falls in.

    ``bin_of`` must not decrease with ``x``. Ranges of one key are equal or do not overlap, so a
    value meets at most one.
    """
    ranges = wanted.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    inside = attach(values, ranges, keys, "x").select(
        *keys, "x", "copies", F.expr("inline(filter(_ranges, r -> x between r.lo and r.hi))"))
    bins = inside.groupBy(*keys, "lo", "hi", bin_of.alias("bin")).agg(
        F.sum("copies").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
    earlier = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    counted = bins.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    at = F.col("rank") - F.col("below") - F.col("before")
    return wanted.join(counted, [*keys, "lo", "hi"]).filter((at >= 0) & (at < F.col("n"))).select(
        *keys, "total", "rank", F.col("first").alias("lo"), F.col("last").alias("hi"),
        (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("size"))


def quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], keys: Sequence[str],
              bins: int = BINS, small: int = SMALL) -> DataFrame:
    """One row per key with the interpolated quantile of ``value`` under every name of ``wanted``.

    NULL and NaN do not count; a key without values gets NULLs. Keys are not NULL and values are
    finite. Equal values travel as one row with their number, so neither a large group nor a value
    that fills a third of it meets in one task. A pass leaves one bin of 1024 per rank, and every
    pass leaves fewer distinct values, so any distribution ends; usual ones take two or three.
    """
    x = nan_to_null(F.col(value).cast("double"))
    values = materialize(df.select(*keys, x.alias("x")).groupBy(*keys, "x").agg(
        F.count(F.lit(1)).alias("copies")), "quantile-values")
    whole = values.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("copies"))), F.lit(0)).alias("total"),
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = lambda q: F.lit(q) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*[
        edge(at(q)).cast("bigint") for q in wanted.values() for edge in (F.floor, F.ceil)]))
    found = materialize(whole.select(
        *keys, "total", F.explode_outer(F.when(F.col("total") > 0, ranks)).alias("rank"),
        "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("total").alias("size")),
        "quantile-ranks")
    wide = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    coarse = wide & (F.col("size") > small)
    bin_of = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                     F.lit(bins - 1))
    while not found.filter(coarse).isEmpty():
        found = materialize(found.filter(~coarse).unionByName(
            _narrow(values, found.filter(coarse), keys, bin_of)), "quantile-ranks")
    found = found.filter(~wide).unionByName(_narrow(values, found.filter(wide), keys, F.col("x")))
    known = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "lo")))
    picked = found.groupBy(*keys).agg(
        F.first("total").alias("total"), F.map_from_entries(known).alias("_at"))

    def between(q: float) -> Column:
        low, high = (F.get(F.map_values(F.map_filter("_at", lambda k, _: k == edge(at(q)))), F.lit(0))
                     for edge in (F.floor, F.ceil))
        return low + (high - low) * (at(q) - F.floor(at(q)))

    return picked.select(*keys, *[between(q).alias(name) for name, q in wanted.items()])
