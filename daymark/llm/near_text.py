"""Near copies by five-word shingles: wide SimHash candidates, exact Jaccard check.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at
least ``SIMILARITY``. Texts with the same set are one node. Candidates come from fingerprints of
128 bits over the set: at a similarity of 0.8 about 15 % of the bits differ, so nodes within
``RADIUS`` bits are linked. They meet in files by all pairs of the sixteen 8-bit blocks, and are
compared bit-sliced: 64 fingerprints to a word of each bit plane, carry-save counters.

Links make candidate groups. Inside a group every pair is compared by its shingle sets, so a
candidate link that is no near copy joins nothing, and a pair that no file held together is found
where other members tie it to the group. Groups and files with very many members are cut into
tiles, and every pair of tiles meets once.

Candidates are found with high probability, not with certainty: a pair is missed if fewer than two
blocks agree or over ``RADIUS`` bits differ, and no third text ties it. README has the recall.

Defined results: texts without words are one group; of each group the row with the smallest id
stays; rows without an id stay only where their group has no id, one for each group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.components import connected_components
from daymark.llm.simhash import join_labels, shingle_hashes
from daymark.llm.words import add_columns, masked, position, unmasked
from daymark.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of 128 up to which two fingerprints are candidates.
RADIUS = 30
WORDS, BLOCK = 2, 8
#: Planes of the counters; they hold distances up to 63.
COUNTER = 6
#: Members of a tile: of a file, of a candidate group.
FILE_TILE = 16384
GROUP_TILE = 256
#: One node in so many is counted to see which files need tiles.
SAMPLE = 32

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIRS = np.array(list(itertools.combinations(range(64 * WORDS // BLOCK), 2)))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def node_of(hashes: np.ndarray) -> int:
    """One number for a set of shingles."""
    digest = xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """128 majority bits over a set of shingles; the second word's bits are a mix of the hash."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    mixed = hashes + np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    both = np.stack([hashes, mixed ^ (mixed >> np.uint64(31))], axis=1).astype("<u8")
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(both), 1 << 15):
        part = np.ascontiguousarray(both[at:at + (1 << 15)]).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").copy()


def printed(frame: DataFrame, text_column: str, drop=(), width: int = SHINGLE) -> DataFrame:
    """``frame`` with node, fp0 and fp1."""

    def start():
        def compute(texts):
            sets = [shingle_set(t, width) for t in texts]
            prints = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, WORDS)
            signed = prints.view(np.int64)
            return [node_of(s) for s in sets], signed[:, 0], signed[:, 1]
        return compute

    return add_columns(frame, [text_column], {"node": "bigint", "fp0": "bigint", "fp1": "bigint"},
                       start, drop)


def _filed(nodes: DataFrame) -> DataFrame:
    """(key, node, fp0, fp1): every node under each pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node, fp0, fp1 = (part.column(c).to_numpy() for c in ("node", "fp0", "fp1"))
                blocks = np.ascontiguousarray(np.stack([fp0, fp1], axis=1)).view(
                    np.uint8).astype(np.int64)
                keys = ((np.arange(len(_PAIRS)) << 2 * BLOCK)
                        | (blocks[:, _PAIRS[:, 0]] << BLOCK) | blocks[:, _PAIRS[:, 1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), *[pa.array(np.repeat(c, len(_PAIRS)))
                                               for c in (node, fp0, fp1)]],
                    names=["key", "node", "fp0", "fp1"])

    return nodes.select("node", "fp0", "fp1").mapInArrow(
        run, "key bigint, node bigint, fp0 bigint, fp1 bigint")


def _tiled(rows: DataFrame, key: str, tiles: DataFrame, carried: list[str]) -> DataFrame:
    """``rows`` dealt by (key, a, b): each row of a crowded key meets every tile of it."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    return (
        rows.join(tiles, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(F.col(key).alias("key"), F.least("own", "other").alias("a"),
                F.greatest("own", "other").alias("b"), F.col("own").alias("side"), *carried)
        .repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side"))


def _in_groups(batches: Iterator[pd.DataFrame], least: int, links) -> Iterator[pd.DataFrame]:
    """``links`` of rows sorted by group, over whole groups of ``least`` rows together."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < least:
            continue
        frame = pd.concat(held, ignore_index=True)
        keys = frame[["key", "a", "b"]].to_numpy()
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(frame.iloc[:cut])
        held, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield links(pd.concat(held, ignore_index=True))


def candidate_links(nodes: DataFrame, radius: int = RADIUS, tile: int = FILE_TILE,
                    sample: int = SAMPLE) -> DataFrame:
    """Spanning links (src, dst) of every file, between ``nodes`` (node, fp0, fp1), node distinct."""
    crowded = (
        _filed(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0))
        .groupBy("key").count().filter(F.col("count") * sample > tile)
        .select("key", F.ceil(F.col("count") * sample / tile).cast("int").alias("tiles")))
    crowded = materialize(crowded, "crowded-files")
    placed = _tiled(_filed(nodes), "key", crowded, ["node", "fp0", "fp1"])

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame[["key", "a", "b"]].to_numpy()
        fps = np.ascontiguousarray(frame[["fp0", "fp1"]].to_numpy()).view(np.uint64)
        node, side, n = frame["node"].to_numpy(), frame["side"].to_numpy(), len(frame)
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        group = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        # Within one tile each row meets the rows after it; across two, the other tile's rows.
        lo, hi = np.arange(1, n + 1), np.append(starts[1:], n)[group]
        across = keys[:, 1] != keys[:, 2]
        if across.any():
            second = side == keys[:, 2]
            firsts = np.add.reduceat((~second).astype(np.int64), starts)
            lo = np.where(across, starts[group] + firsts[group], lo)
            hi = np.where(across & second, 0, hi)
        label = wide_forest(fps, lo, hi, radius)
        moved = np.flatnonzero(label != np.arange(n))
        return pd.DataFrame({"src": node[label[moved]], "dst": node[moved]})

    return placed.mapInPandas(lambda batches: _in_groups(batches, 1 << 16, links),
                              "src bigint, dst bigint").distinct()


def wide_forest(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int,
                chunk: int = 1 << 15) -> np.ndarray:
    """Component label (smallest position) of every fingerprint (row of two words); position i is
    compared with positions lo[i] .. hi[i]-1, 64 at a time."""
    n = len(fps)
    label = np.arange(n)
    asking = np.flatnonzero(hi > lo)
    if not len(asking):
        return label
    planes = wide_planes(fps)
    first = lo[asking] >> 6
    spans = ((hi[asking] - 1) >> 6) - first + 1
    edge = np.cumsum(spans)
    for done in range(0, int(edge[-1]), chunk):
        pair = np.arange(done, min(done + chunk, int(edge[-1])))
        at = np.searchsorted(edge, pair, side="right")
        q, b = asking[at], first[at] + pair - (edge[at] - spans[at])
        begin = np.maximum(lo[q] - (b << 6), 0).astype(np.uint64)
        end = np.minimum(hi[q] - (b << 6), 64).astype(np.uint64)
        close = wide_lanes(planes, fps, q, b, (_FULL << begin) & (_FULL >> (np.uint64(64) - end)),
                           radius)
        hit = np.flatnonzero(close)
        if len(hit):
            row, lane = np.nonzero(np.unpackbits(
                close[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                bitorder="little"))
            label = join_labels(label, q[hit][row], (b[hit][row] << 6) + lane)
    return label


def wide_planes(fps: np.ndarray) -> np.ndarray:
    """Planes (bit, block): bit j of word (i, k) is bit i of fingerprint 64 k + j."""
    blocks = -(-len(fps) // 64)
    padded = np.zeros((blocks * 64, WORDS), np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(blocks, 64, 8 * WORDS), axis=2,
                         bitorder="little")
    packed = np.packbits(bits, axis=1, bitorder="little")  # (block, 8 bytes of lanes, bit)
    words = np.ascontiguousarray(packed.transpose(0, 2, 1)).view("<u8")[:, :, 0]
    return np.ascontiguousarray(words.T)


def wide_lanes(planes: np.ndarray, fps: np.ndarray, q: np.ndarray, b: np.ndarray,
               lanes: np.ndarray, radius: int) -> np.ndarray:
    """For every (query, block): the lanes of ``lanes`` within ``radius`` differing bits."""
    if not 0 <= radius < (1 << COUNTER) - 1:
        raise ValueError("the counters hold distances up to 62")
    out = np.zeros(len(q), np.uint64)
    live, fp, over = np.arange(len(q)), fps[q], ~lanes
    counter = [np.zeros(len(q), np.uint64) for _ in range(COUNTER)]
    one, zero = np.uint64(1), np.uint64(0)
    bits = 64 * WORDS
    for step in range(0, bits, 3):
        x = [planes[i][b] ^ (zero - ((fp[:, i >> 6] >> np.uint64(i & 63)) & one))
             for i in range(step, min(step + 3, bits))]
        while len(x) < 3:
            x.append(np.zeros(len(b), np.uint64))
        half = x[0] ^ x[1]
        for weight, up in ((0, half ^ x[2]), (1, (x[0] & x[1]) | (half & x[2]))):
            for k in range(weight, COUNTER):
                counter[k], up = counter[k] ^ up, counter[k] & up
            over = over | up  # the count passed the counters
        if step >= radius and (step % 12 == 0 or step + 3 >= bits):
            over = over | _exceeds(counter, radius)
            keep = over != _FULL
            if not keep.all():
                live, fp, b, over = live[keep], fp[keep], b[keep], over[keep]
                counter = [c[keep] for c in counter]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``: a comparison from the highest bit down."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _FULL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above |= equal & counter[k]
            equal = equal & ~counter[k]
    return above


def similar_links(sets: DataFrame, similarity: float = SIMILARITY,
                  tile: int = GROUP_TILE) -> DataFrame:
    """Spanning links (src, dst) of the near copies inside every group of ``sets`` (component,
    node, hashes), node distinct."""
    crowded = materialize(
        sets.groupBy("component").count().filter(F.col("count") > tile)
        .select("component", F.ceil(F.col("count") / tile).cast("int").alias("tiles")),
        "crowded-groups")
    placed = _tiled(sets, "component", crowded, ["node", "hashes"])

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame[["key", "a", "b"]].to_numpy()
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        edges = np.append(np.flatnonzero(fresh), len(frame))
        node, hashes = frame["node"].to_numpy(), frame["hashes"].to_numpy()
        src, dst = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            label = jaccard_forest(hashes[a:b], similarity)
            moved = np.flatnonzero(label != np.arange(b - a))
            src.append(node[a:b][label[moved]])
            dst.append(node[a:b][moved])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return placed.mapInPandas(lambda batches: _in_groups(batches, 1 << 11, links),
                              "src bigint, dst bigint").distinct()


def jaccard_forest(sets: np.ndarray, similarity: float) -> np.ndarray:
    """Component label (smallest position) of the sets under the links of near copies."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    filled = np.flatnonzero(size)
    if len(filled) < 2:
        return label
    starts = np.cumsum(size[filled]) - size[filled]
    _, flat = np.unique(np.concatenate([sets[i] for i in filled]), return_inverse=True)
    ends = starts + size[filled]
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    for k in range(len(filled) - 1):
        if (label[filled] == label[filled[0]]).all():
            break
        mark[flat[starts[k]:ends[k]]] = 1
        shared = np.add.reduceat(mark[flat[starts[k + 1]:]], starts[k + 1:] - starts[k + 1])
        mark[flat[starts[k]:ends[k]]] = 0
        union = size[filled[k]] + size[filled[k + 1:]] - shared
        near = filled[k + 1:][shared >= similarity * union]
        if len(near):
            label = join_labels(label, np.full(len(near), filled[k]), near)
    return label


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, node, component_id) for every row; equal component_id means near copies."""
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                         F.col(text_column).alias("text"))
    prints = materialize(printed(source, "text", drop=["text"]), "wide-prints")
    nodes = materialize(
        prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp0").alias("fp0"),
                                   F.first("fp1").alias("fp1")), "print-nodes")
    members = materialize(connected_components(candidate_links(nodes)), "candidate-groups")
    reps = (nodes.join(members, "node", "left_semi").filter("rep IS NOT NULL")
            .select(F.col("rep").alias("doc_id")).distinct())
    # The texts of the members are read once more; all other texts are left behind.
    texts = (source.join(reps, "doc_id", "left_semi").unionByName(
        source.filter("doc_id IS NULL")))

    def start():
        def compute(found):
            sets = [shingle_set(t) for t in found]
            return [node_of(s) for s in sets], [s.view(np.int64) for s in sets]
        return compute

    sets = materialize(
        add_columns(texts, ["text"], {"node": "bigint", "hashes": "array<bigint>"}, start,
                    drop=["text"])
        .join(members, "node").groupBy("node").agg(
            F.first("component").alias("component"), F.first("hashes").alias("hashes")),
        "candidate-sets")
    found = connected_components(similar_links(sets))
    return prints.join(found, "node", "left").select(
        "doc_id", "node", F.coalesce("component", "node").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies."""
    named = materialize(groups(docs, id_column, text_column), "near-groups")
    firsts = named.groupBy("component_id").agg(F.min("doc_id").alias("keep"))
    keepers = firsts.filter("keep IS NOT NULL").select("keep").distinct()
    inner = masked(docs)
    key = position(docs, id_column)
    kept = (inner.join(keepers, F.col(key).cast("bigint") == F.col("keep"), "left_semi")
            .dropDuplicates([key]))
    stray = inner.filter(F.col(key).isNull())
    if stray.limit(1).count():
        text = position(docs, text_column)
        open_ = firsts.filter("keep IS NULL").select("component_id")
        place = (named.filter("doc_id IS NULL").select("node", "component_id").distinct()
                 .join(open_, "component_id", "left_semi"))
        kept = kept.unionByName(
            printed(stray, text).join(place, "node").dropDuplicates(["component_id"])
            .drop("node", "component_id", "fp0", "fp1"))
    return unmasked(kept, docs)
