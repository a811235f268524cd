"""Display tables: number formatting, best-in-block marks and CSV output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions.exprs import col


def display_number(c: str | Column, pvalue: bool = False) -> Column:
    """Three decimals, never a signed zero; probabilities print as bounds near 0 and 1."""
    c = col(c)
    shown = F.format_string("%.3f", c)
    shown = F.when(shown == "-0.000", "0.000").otherwise(shown)
    out = F.when(c.isNull() | F.isnan(c), "--")
    if pvalue:
        out = out.when((c >= 0) & (c < 0.001), "<0.001").when((c > 0.999) & (c <= 1), ">0.999")
    return out.otherwise(shown)


def display_table(df: DataFrame, pvalue_cols: Sequence[str] = ()) -> DataFrame:
    """S10. Every double becomes display text; integers and strings are kept as they are."""
    return df.select(*[
        display_number(name, name in pvalue_cols).alias(name)
        if kind in ("double", "float") else F.col(name)
        for name, kind in df.dtypes
    ])


def export_table(df: DataFrame, path: str, pvalue_cols: Sequence[str] = ()) -> None:
    """S10. Display form as CSV with a header."""
    display_table(df, pvalue_cols).write.mode("overwrite").option("header", True).csv(path)


def mark_best(table: DataFrame, metrics: Sequence[str], within: Sequence[str],
              reference: str = "naive") -> DataFrame:
    """S11. Adds ``best_<metric>``: lowest value in its block, the reference row never eligible.

    Runs on summary tables (one row per model and target), where a window group is a handful
    of rows.
    """
    w = Window.partitionBy(*within)
    eligible = F.col("model") != reference
    return table.withColumns({
        f"best_{m}": F.coalesce(
            eligible & (F.col(m) == F.min(F.when(eligible, F.col(m))).over(w)), F.lit(False))
        for m in metrics
    })
