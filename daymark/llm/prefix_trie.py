"""Prefix trie of conversations from range minima over sorted longest common prefixes.

A conversation is a sequence of turns. Sorted by their turns, all conversations that share a prefix
stand next to each other, and two neighbours share as many first turns as their LCP says. So the
members of the prefix of length d of the conversation at one place reach as far to either side as
the smallest LCP on the way is d or more. A sparse table holds the minima of all runs of 2, 4, 8,
... LCPs; every candidate prefix binary-searches its left and right extent in it, on its own,
without a stack. The interval then gives the node's members, and prefix sums over the sorted
places give what a node asks of its subtree: leaves, repeated words.

Turns are compared by their md5, so the sort moves 16 bytes a turn and no texts. The sorted table
is cut into units of bounded size, in the order of a global sort by turns and id, which also
spreads equal conversations. Every unit builds its own sparse table. Only prefixes of a unit's
first and last conversation can reach beyond it; they are told by the LCP with the neighbouring
unit, give partial rows, and these are added up by prefix in a second, small aggregation. All
other nodes are complete in their unit.

The ids of conversations that end at a node are hashed as one text, and such a hash cannot be
split. Where the ends of a node fill several units, each unit hands on its ids as one text, and
these are fed to the hash one by one; no list of members is ever gathered.

Defined results: turns are ordered by number, null first, ties by the md5 of role and text; null
role or text is empty; rows without a conversation id belong to none and are left out; repeated
rows are turns each. An empty table has no nodes. A conversation's turns, 28 bytes each, meet in
one row; texts of any length are read once, where they are stored. Only the four columns named
are read, so others cannot clash. Ids must fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.operators.ordered import attach
from daymark.session import materialize

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
KEY_BYTES = 16
#: Most conversations and bytes of turn keys of a unit; a longer conversation is a unit of its own.
UNIT_ROWS = 1 << 16
UNIT_BYTES = 8 << 20
#: Head turns that are taken from another conversation: crc32(id) modulo this.
HEADS = 4
#: Conversations share the head of the next lower id divisible by this.
FAMILY = 20

SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_key(role: Column, text: Column) -> Column:
    """md5 of role and text; the length of the role keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
                         .cast("binary")))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, turns): one row a conversation, its turns in order as (n, key, words)."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN))
    return (
        turns.filter(F.col(conv).isNotNull())
        .select(F.col(conv).cast("bigint").alias("conv_id"), F.struct(
            F.col(turn).alias("n"), turn_key(F.col(role), F.col(text)).alias("key"),
            words.cast("bigint").alias("words")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Every conversation led by the first turns of its family's first one, in place of its own."""
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    empty = F.slice("turns", 1, 0)
    return (
        convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(heads, "base", "left")
        .select("conv_id", F.concat(
            F.slice(F.coalesce("head", empty), F.lit(1), n),
            F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0)))).alias("turns")))


def units(convs: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Conversations in the order of their turns, cut into units.

    (part, place, ids, lengths, path, words, first, last): the ids of the unit's conversations,
    their numbers of turns, all turn keys and words in order, the first and the last path.
    """
    ordered = convs.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "").alias("hex"),
        F.transform("turns", lambda t: t["words"]).alias("words")).select(
        "conv_id", F.unhex("hex").alias("path"), "words").orderBy("path", "conv_id").select(
        F.spark_partition_id().alias("part"), "conv_id", "path", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place, part = [], 0, 0, 0

        def unit() -> pa.RecordBatch:
            ids, paths, words = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([place], pa.int64()),
                pa.array([list(ids)], pa.list_(pa.int64())),
                pa.array([[len(p) // KEY_BYTES for p in paths]], pa.list_(pa.int64())),
                pa.array([b"".join(paths)], pa.binary()),
                pa.array([[w for ws in words for w in ws]], pa.list_(pa.int64())),
                pa.array([paths[0]], pa.binary()), pa.array([paths[-1]], pa.binary())],
                names=["part", "place", "ids", "lengths", "path", "words", "first", "last"])

        for batch in batches:
            for part, conv, path, words in zip(*[c.to_pylist() for c in batch.columns],
                                               strict=True):
                if held and (len(held) >= unit_rows or size + len(path) > unit_bytes):
                    yield unit()
                    held, size, place = [], 0, place + 1
                held.append((conv, path, words))
                size += len(path)
        if held:
            yield unit()

    return ordered.mapInArrow(
        run, "part int, place bigint, ids array<bigint>, lengths array<bigint>, path binary, "
             "words array<bigint>, first binary, last binary")


def with_neighbours(cut: DataFrame) -> DataFrame:
    """Units numbered in order, each with the turns it shares with the one before and after.

    ``before`` and ``after`` are -1 at the ends. The driver sees one count per sorted partition.
    """
    counts = sorted(cut.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part], total = total, total + n
    offsets = cut.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)],
                                               "part int, start bigint")
    numbered = cut.join(offsets, "part").withColumn("unit", F.col("start") + F.col("place"))
    edges = numbered.select("unit", "first", "last")
    pairs = edges.select("unit", "first").join(
        edges.select((F.col("unit") + 1).alias("unit"), "last"), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [_common(a, b) for a, b in zip(batch.column(1).to_pylist(),
                                                    batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int64())],
                                             names=["unit", "shared"])

    shared = materialize(pairs.mapInArrow(run, "unit bigint, shared bigint"), "trie-edges")
    minus = F.lit(-1).cast("bigint")
    return (
        numbered.drop("part", "place", "start", "first", "last")
        .join(shared.withColumnRenamed("shared", "before"), "unit", "left")
        .join(shared.select((F.col("unit") - 1).alias("unit"), F.col("shared").alias("after")),
              "unit", "left")
        .withColumns({"before": F.coalesce("before", minus), "after": F.coalesce("after", minus)}))


def _common(a: bytes, b: bytes) -> int:
    """Leading turn keys that two paths share."""
    n = min(len(a), len(b)) // KEY_BYTES
    x = np.frombuffer(a, "V16", n) == np.frombuffer(b, "V16", n)
    return n if x.all() else int(x.argmin())


class SparseTable:
    """Minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minimum of values[start..stop], ends included."""
        level = np.frexp(stop - start + 1)[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            run = self.levels[k]
            out[at] = np.minimum(run[start[at]], run[stop[at] - (1 << k) + 1])
        return out

    def reach_right(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Last place p such that values[place + 1 .. p] are all at least ``bound``."""
        place = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            run = self.levels[k]
            ahead = place + 1
            inside = np.flatnonzero(ahead < len(run))
            go = inside[run[ahead[inside]] >= bound[inside]]
            place[go] += 1 << k
        return place

    def reach_left(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First place p such that values[p + 1 .. place] are all at least ``bound``."""
        place = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            run, span = self.levels[k], 1 << k
            inside = np.flatnonzero(place - span >= 0)
            go = inside[run[place[inside] - span + 1] >= bound[inside]]
            place[go] -= span
        return place


def shared_turns(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: int
                 ) -> np.ndarray:
    """Turns that every conversation shares with the one before it; the first is given."""
    out = np.zeros(len(lengths), np.int64)
    out[0] = before
    open_, depth = np.arange(1, len(lengths)), 0
    while len(open_):
        open_ = open_[(lengths[open_] > depth) & (lengths[open_ - 1] > depth)]
        open_ = open_[codes[starts[open_] + depth] == codes[starts[open_ - 1] + depth]]
        depth += 1
        out[open_] = depth
    return out


#: What a unit tells of a node, or of its part of one.
NODE_TYPES = {
    "unit": pa.int64(), "left": pa.int64(), "depth": pa.int64(), "parent_left": pa.int64(),
    "parent_unit": pa.int64(), "prefix": pa.binary(), "conv_id": pa.int64(),
    "parent_conv_id": pa.int64(), **dict.fromkeys(SUMS, pa.int64()), "ends": pa.string(),
    "ends_sha256": pa.string()}
SQL_NAMES = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}


def unit_nodes(unit: int, ids: np.ndarray, lengths: np.ndarray, path: bytes, words: np.ndarray,
               before: int, after: int) -> dict[str, list]:
    """Nodes of one unit. Those that reach beyond it have a ``prefix``: they are parts."""
    n = len(ids)
    starts = np.cumsum(lengths) - lengths
    keys = np.frombuffer(path, "V16")
    codes = np.unique(keys, return_inverse=True)[1] if len(keys) else np.zeros(0, np.int64)
    lcp = shared_turns(codes, starts, lengths, before)
    # told[starts + e + row] = words of the first e turns, e from 0 to the length
    upto = np.concatenate([[0], np.cumsum(words)])
    told = (upto[np.repeat(starts, lengths + 1) + _counters(lengths + 1)]
            - np.repeat(upto[starts], lengths + 1))
    row_start = starts + np.arange(n)
    repeats = np.where(lcp > 0, told[row_start + np.maximum(lcp, 0)], 0)
    next_lcp = np.concatenate([lcp[1:], [after]])
    leaves_upto = np.concatenate([[0], np.cumsum(next_lcp < lengths)])
    repeats_upto = np.concatenate([[0], np.cumsum(repeats)])

    # Every prefix of every conversation, the empty one included, looks for its own extent.
    table = SparseTable(lcp)
    place, depth = np.repeat(np.arange(n), lengths + 1), _counters(lengths + 1)
    left = table.reach_left(place, depth)
    first = np.flatnonzero(left == place)
    left, depth = place[first], depth[first]
    right = table.reach_right(left, depth)
    open_left = (left == 0) & (lcp[0] >= depth)
    is_open = open_left | ((right == n - 1) & (after >= depth))
    # nodes are in the order of their first member and depth
    node_start = np.searchsorted(left, np.arange(n))
    least = SparseTable(ids).least(left, right)

    parent_left = np.where(depth > 0, table.reach_left(left, np.maximum(depth - 1, 0)), -1)
    parent = np.full(len(left), -1)
    inner = np.flatnonzero(depth > 0)
    own_first = np.where(parent_left[inner] == 0, 0, lcp[parent_left[inner]] + 1)
    parent[inner] = node_start[parent_left[inner]] + depth[inner] - 1 - own_first
    children = np.zeros(len(left), np.int64)
    np.add.at(children, parent[inner], ~open_left[inner])

    over = np.where(depth > 0, told[row_start[left] + np.maximum(depth - 1, 0)], 0)
    since = np.where(open_left, left, left + 1)
    saved = repeats_upto[right + 1] - repeats_upto[since] - (right + 1 - since) * over

    # Conversations that end at a node are equal and stand first in its interval, ids ascending.
    breaks = np.flatnonzero(np.concatenate(
        [[True], (lcp[1:] < lengths[1:]) | (lengths[1:] != lengths[:-1])]))
    stops = np.append(breaks, n)[np.searchsorted(breaks, left, "right")]
    listed = [""] * len(left)
    for i in np.flatnonzero(lengths[left] == depth).tolist():
        listed[i] = ",".join(map(str, ids[left[i]:stops[i]].tolist()))
    parts, whole_parent = is_open.tolist(), np.where(parent >= 0, is_open[parent], False)
    digest = hashlib.sha256
    return {
        "unit": [unit] * len(left), "left": left.tolist(), "depth": depth.tolist(),
        "parent_left": [p if o else None for p, o in zip(parent_left.tolist(), whole_parent)],
        "parent_unit": [unit if o else None for o in whole_parent],
        "prefix": [digest(path[KEY_BYTES * starts[a]:KEY_BYTES * (starts[a] + d)]).digest()
                   if o else None for a, d, o in zip(left.tolist(), depth.tolist(), parts)],
        "conv_id": least.tolist(),
        "parent_conv_id": [None if p < 0 or o else int(least[p])
                           for p, o in zip(parent.tolist(), whole_parent)],
        "n_convs": (right - left + 1).tolist(), "n_children": children.tolist(),
        "n_leaves": (leaves_upto[right + 1] - leaves_upto[left]).tolist(),
        "saved_tokens": saved.tolist(),
        "ends": [t if o and t else None for t, o in zip(listed, parts)],
        "ends_sha256": [None if o else digest(t.encode()).hexdigest()
                        for t, o in zip(listed, parts)]}


def _counters(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _unit_nodes(cut: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = unit_nodes(
                    row["unit"], np.array(row["ids"], np.int64),
                    np.array(row["lengths"], np.int64), row["path"],
                    np.array(row["words"], np.int64), row["before"], row["after"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, NODE_TYPES[k]) for k, v in made.items()], names=list(made))

    schema = ", ".join(f"{k} {SQL_NAMES[t]}" for k, t in NODE_TYPES.items())
    return cut.select("unit", "ids", "lengths", "path", "words", "before", "after").mapInArrow(
        run, schema)


def _hashed_ends(parts: DataFrame) -> DataFrame:
    """(prefix, ends_sha256): the texts of a node's ends, fed to one hash in the units' order."""
    texts = parts.filter(F.col("ends").isNotNull()).select("prefix", "unit", "ends")
    dealt = texts.repartition("prefix").sortWithinPartitions("prefix", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([last], pa.binary()), pa.array([digest.hexdigest()])],
                names=["prefix", "ends_sha256"])

        for batch in batches:
            for prefix, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                    strict=True):
                if prefix != last:
                    if last is not None:
                        yield done()
                    last, digest = prefix, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if last is not None:
            yield done()

    return dealt.mapInArrow(run, "prefix binary, ends_sha256 string")


def trie(convs: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, turns) rows as ``sequences`` makes them.

    Per node: conv_id, the smallest member; depth; parent_conv_id; n_convs members; n_children;
    n_leaves, childless nodes in its subtree; saved_tokens, the words that its subtree would
    repeat without sharing; ends_sha256 of the ids that end here.
    """
    cut = materialize(units(convs, unit_rows, unit_bytes), "trie-units")
    nodes = materialize(_unit_nodes(with_neighbours(cut)), "trie-nodes")
    parts = nodes.filter(F.col("prefix").isNotNull())
    parent = F.struct("parent_unit", "parent_left")
    merged = materialize(
        parts.groupBy("prefix", "depth").agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS],
            F.min(parent).alias("parent"))
        .join(_hashed_ends(parts), "prefix", "left"), "trie-open-nodes")
    # The smallest member of each unit's parts, for children that know only their own unit.
    looked_up = attach(parts.select("prefix", "unit", "left", "depth"),
                       merged.select("prefix", F.col("conv_id").alias("found")), ["prefix"], "unit")
    found = looked_up.select(
        F.col("unit").alias("parent_unit"), F.col("left").alias("parent_left"),
        (F.col("depth") + 1).alias("depth"), "found")
    inner = nodes.filter(F.col("prefix").isNull())
    result = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    known = inner.filter(F.col("parent_unit").isNull()).select(result)
    nothing = F.lit(None).cast("bigint")
    asking = inner.filter(F.col("parent_unit").isNotNull()).select(
        *result, "parent_unit", "parent_left").unionByName(
        merged.select(
            "conv_id", "depth", nothing.alias("parent_conv_id"), *SUMS,
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
            "parent.parent_unit", "parent.parent_left"))
    keys = ["parent_unit", "parent_left", "depth"]
    told = asking.join(found, keys, "left").withColumn("parent_conv_id", F.col("found"))
    return known.unionByName(told.select(result))
