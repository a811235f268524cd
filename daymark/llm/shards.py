"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by leading bits of a key's hash. It starts with one bucket; a bucket over
the byte limit, and no other, is split on one more bit, until every bucket fits. A bucket is named
by its bits, so shards of one run are stable when rows are added: only grown buckets split.

Rows of one key share all 60 bits of the key's hash. Where such a bucket is still too large, it is
split on further bits taken from a number of the row, so a key with a third of all rows is spread
over as many shards as it needs. Only a single row over the limit keeps a shard that is too large.

Bytes are first summed by hash cell, so the splitting works on a small table; only cells that are
themselves too large are looked at again row by row.

Defined results: a null key hashes as the empty text, a null text has zero bytes; repeated rows
count each; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.words import masked, position
from daymark.session import materialize

KEY_BITS = 60
MAX_DEPTH = 2 * KEY_BITS
#: Depth of the cells on which bytes are summed first; deeper splits go cell by cell.
CELL_BITS = 16
MAX_BYTES = 64 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def row_hash() -> Column:
    return F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(
        F.lit((1 << KEY_BITS) - 1).cast("bigint"))


def bits(depth: Column, key: Column, row: Column) -> Column:
    """That many leading bits of a row's key and row hashes, as text."""
    text = F.concat(F.lpad(F.bin(key), KEY_BITS, "0"), F.lpad(F.bin(row), KEY_BITS, "0"))
    return F.substring(text, F.lit(1), depth)


def directory(sizes: DataFrame, max_bytes: int = MAX_BYTES, first: int = 0,
              last: int = CELL_BITS) -> DataFrame:
    """Buckets (shard, depth, n_bytes, n_rows) of cells (cell, n_bytes, n_rows).

    ``cell`` is a text of ``last`` bits, of which the first ``first`` are settled. A bucket is the
    shortest prefix that fits the limit; cells that do not fit keep their full depth.
    """
    spread = sizes.select(
        "cell", "n_bytes", "n_rows",
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"))
    nodes = (
        spread.groupBy("depth", F.substring("cell", F.lit(1), F.col("depth")).alias("node"))
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"),
                           F.col("n_bytes").alias("parent_bytes"),
                           F.col("n_rows").alias("parent_rows"))
    held = nodes.withColumn("parent", F.substring(
        "node", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))))
    splits = ((F.col("depth") == first)
              | ((F.col("parent_bytes") > max_bytes) & (F.col("parent_rows") > 1)))
    fits = (F.col("n_bytes") <= max_bytes) | (F.col("n_rows") == 1) | (F.col("depth") == last)
    return (held.join(parents, ["depth", "parent"], "left").filter(splits & fits)
            .select(F.col("node").alias("shard"), "depth", "n_bytes", "n_rows"))


def shard(docs: DataFrame, key_column: str = "doc_id", size: Column | None = None,
          max_bytes: int = MAX_BYTES, result: tuple[str, str] = ("shard", "shard_bytes")
          ) -> DataFrame:
    """``docs`` with the bits of every row's shard and the shard's bytes.

    ``size`` is the bytes of a row, by default those of its text. Columns of ``docs`` under the
    result's names are replaced.
    """
    size = F.octet_length("text") if size is None else size
    docs = docs.drop(*result)
    n = len(docs.columns)
    rows = materialize(masked(docs.select("*", size)).select(
        *[f"d{i}" for i in range(n)],
        bits(F.lit(MAX_DEPTH), key_hash(F.col(position(docs, key_column))),
             row_hash()).alias("whole"),
        F.coalesce(F.col(f"d{n}").cast("bigint"), F.lit(0).cast("bigint")).alias("size")),
        "sharded-rows")
    parts, left = [], rows
    for level in _levels(rows.select("whole", "size"), max_bytes):
        joined = _look_up(left, level)
        parts.append(joined.filter("shard IS NOT NULL"))
        left = joined.filter("shard IS NULL").drop("shard", "shard_size")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*[f"d{i}" for i in range(n)], "shard", "shard_size").toDF(
        *docs.columns, *result)


def _levels(rows: DataFrame, max_bytes: int) -> list[DataFrame]:
    """Directories of CELL_BITS bits each: the first over all rows, the next over the rows of
    cells that still do not fit. Every level is written, and there are at most
    MAX_DEPTH / CELL_BITS of them."""
    levels, depth, source = [], 0, rows
    while True:
        deeper = min(depth + CELL_BITS, MAX_DEPTH)
        cells = source.groupBy(F.substring("whole", 1, deeper).alias("cell")).agg(
            F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows"))
        found = materialize(directory(cells, max_bytes, depth, deeper), "shard-directory")
        split = ((F.col("n_bytes") > max_bytes) & (F.col("n_rows") > 1)
                 & (F.col("depth") == deeper) & (F.col("depth") < MAX_DEPTH))
        levels.append(found.filter(~split))
        open_cells = found.filter(split)
        if not open_cells.limit(1).count():
            return levels
        source = source.join(open_cells.select(F.col("shard").alias("at")),
                             F.substring("whole", 1, deeper) == F.col("at"), "left_semi")
        depth = deeper


def _look_up(rows: DataFrame, level: DataFrame) -> DataFrame:
    """Rows with the bucket of their index entry, null where the level has none.

    A bucket shallower than the level's index fills all entries that begin with its bits.
    """
    top = level.agg(F.max("depth")).first()[0] or 0
    tail = F.lpad(F.bin("tail"), F.lit(top) - F.col("depth"), F.lit("0"))
    index = level.select(
        "shard", "depth", F.col("n_bytes").alias("shard_size"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(
            f"shiftleft(1L, cast({top} - depth as int)) - 1"))).alias("tail")).select(
        F.when(F.col("depth") == top, F.col("shard"))
        .otherwise(F.concat("shard", tail)).alias("at"), "shard", "shard_size")
    return rows.join(index, F.substring("whole", 1, top) == F.col("at"), "left").drop("at")
