"""Order-dependent work on long series without ever putting one series in one task.

A window ``partitionBy(series)`` gathers a whole series in a single task, which fails when one
series holds a large share of the rows. The helpers here split every series into bounded
chunks: positions and running sums combine a chunk-local part with a chunk offset, rolling
frames copy the few rows that reach over a chunk edge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], spread: str | Column,
           how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join per-key facts onto rows, spreading every key over ``salts`` tasks.

    ``small`` has at most one row per key. ``spread`` is a column that varies inside a key; its
    hash picks the salt, so a key with a third of all rows is shared by ``salts`` tasks. If
    ``small`` turns out tiny the optimizer still broadcasts it.
    """
    spread = F.col(spread) if isinstance(spread, str) else spread
    left = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _chunk_offsets(df: DataFrame, keys: Sequence[str], chunk: str, value: Column,
                   totals: dict[str, Column] | None = None) -> DataFrame:
    """Sum of ``value`` over all earlier chunks of a key; one row per (key, chunk).

    ``totals`` are additive aggregates; their sum over the whole key is attached as well.
    """
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals or {}
    parts = df.groupBy(*keys, chunk).agg(
        value.alias("_total"), *[c.alias(n) for n, c in totals.items()])
    return parts.select(
        *keys, chunk, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
        *[F.sum(n).over(whole).alias(n) for n in totals])


def with_position(df: DataFrame, keys: Sequence[str], order: str, chunk: Column,
                  name: str = "pos", totals: dict[str, Column] | None = None) -> DataFrame:
    """0-based rank of each row inside its key by ``order``.

    ``chunk`` must be monotone in ``order`` (for example the month of a timestamp). Only one
    row per (key, chunk) is ever ordered across the whole key. ``totals`` adds sums over the
    whole key at no extra pass.
    """
    df = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    offsets = _chunk_offsets(df, keys, "_chunk", F.count(F.lit(1)), totals)
    return (
        df.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_chunk", "_local", "_offset")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, value: str,
                name: str) -> DataFrame:
    """Inclusive running sum inside each key, chunk by chunk."""
    df = df.withColumn("_chunk", chunk)
    local = (
        Window.partitionBy(*keys, "_chunk").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = _chunk_offsets(df, keys, "_chunk", F.sum(value))
    return (
        df.withColumn("_local", F.sum(value).over(local))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_chunk", "_local", "_offset")
    )


def with_halo(df: DataFrame, pos: str, reach: int, size: int | None = None) -> DataFrame:
    """Cut a positioned series into blocks that overlap by ``reach`` rows.

    Adds ``_block`` and ``_own``. The last ``reach`` rows of a block are repeated at the head
    of the next one with ``_own`` false, so a frame of up to ``reach`` preceding rows is
    complete inside a block. With the default size at most one row in eight is repeated.
    """
    size = size or max(8 * reach, 1024)
    if size < reach:
        raise ValueError("block size must be at least the reach")
    home = F.floor(F.col(pos) / size).cast("long")
    edge = F.pmod(F.col(pos), F.lit(size)) >= size - reach
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(
            F.when(edge, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )


def rolling(df: DataFrame, keys: Sequence[str], pos: str, width: int,
            make: Callable[[object], dict[str, Column]]) -> DataFrame:
    """Trailing ``width``-row frames, ending at the current row.

    ``make`` receives the window and returns the columns to add.
    """
    blocks = with_halo(df, pos, width - 1)
    w = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-(width - 1), 0)
    return blocks.withColumns(make(w)).filter("_own").drop("_block", "_own")
