"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is set where over half of a text's shingle hashes have it set. Two fingerprints
within ``RADIUS`` differing bits are linked. Exact copies collapse first: only distinct
fingerprints are compared, each standing for the smallest id that has it.

Candidates come from six bit blocks: four differing bits leave at least two blocks untouched, so
every link has two equal blocks, and each fingerprint is filed under its fifteen pairs of blocks.
Inside a file, fingerprints are stored vertically: 64 of them make a block of 64 bit planes, one
machine word each. A query fingerprint is compared with a whole block by xor of the planes and
carry-save counters, 64 distances at a time; a block is abandoned as soon as all its distances
exceed the radius. Links are kept as a spanning forest per file, never as all pairs.

A file with very many members (near copies of one text) is cut into tiles of bounded size; every
pair of tiles meets in one group. Where tiles are cut is read off a hash sample of the
fingerprints; that decides how work is spread, never which links are found.

Defined results: null and empty texts have fingerprint zero; rows without an id get the component
of their fingerprint, null where no row with an id shares it; repeated rows are kept.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.components import connected_components
from daymark.llm.words import add_columns, masked, position, unmasked
from daymark.session import materialize

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Widths of the six bit blocks, low bits first.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Members of a tile.
TILE = 16384
#: One fingerprint in so many is counted to see which files need tiles.
SAMPLE = 32

_WORD = re.compile(b"[^\x20\x09-\x0d]+")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words (of all words where there are fewer), A-Z folded."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(),
                                                   (ends[k - 1:] - 1).tolist())),
        np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit number."""

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                         F.col(text_column).alias("text"))
    return _printed(source, "text", width, drop=["text"])


def _printed(frame: DataFrame, text_column: str, width: int, drop=()) -> DataFrame:
    """``frame`` with the column fp."""

    def start():
        def compute(texts):
            values = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
            return (values.view(np.int64),)
        return compute

    return add_columns(frame, [text_column], {"fp": "bigint"}, start, drop)


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_keys(fp: Column) -> Column:
    """Array of the fifteen (pair of blocks, their bits) keys of a fingerprint."""
    offsets = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    part = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1).cast("bigint"))
            for o, w in zip(offsets, BLOCKS)]
    return F.array(*[
        (F.shiftleft(part[a], 11).bitwiseOR(part[b])).bitwiseOR(F.lit(n << 22).cast("bigint"))
        for n, (a, b) in enumerate(itertools.combinations(range(len(BLOCKS)), 2))])


def link_fingerprints(reps: DataFrame, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Spanning links (src, dst) between the ids of ``reps`` (rep, fp), fp distinct."""
    filed = reps.select("rep", "fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    crowded = (
        reps.filter(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0)
        .select(F.explode(block_keys(F.col("fp"))).alias("key"))
        .groupBy("key").count().filter(F.col("count") * sample > tile)
        .select("key", F.ceil(F.col("count") * sample / tile).cast("int").alias("tiles")))
    crowded = materialize(crowded, "crowded-files")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    placed = (
        filed.join(crowded, "key", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                F.col("own").alias("side"), "rep", "fp")
        .repartition("key", "a", "b")
        .sortWithinPartitions("key", "a", "b", "side"))
    return placed.mapInPandas(_link_groups, "src bigint, dst bigint").distinct()


def _link_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of rows sorted by group; whole groups are gathered and compared together."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows += len(pdf)
        if rows < 1 << 16:
            continue
        frame = pd.concat(held, ignore_index=True)
        keys = frame[["key", "a", "b"]].to_numpy()
        cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 \
            if (keys != keys[-1]).any() else 0
        if cut:
            yield _links(frame.iloc[:cut])
        held, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield _links(pd.concat(held, ignore_index=True))


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    keys = frame[["key", "a", "b"]].to_numpy()
    reps, fps = frame["rep"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
    side = frame["side"].to_numpy()
    n = len(frame)
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    # Within one tile each row meets the rows after it; across two tiles, the other tile's rows.
    lo, hi = np.arange(1, n + 1), ends[group].copy()
    across = keys[:, 1] != keys[:, 2]
    if across.any():
        second = side == keys[:, 2]
        firsts = np.add.reduceat(~second, starts)
        lo = np.where(across, starts[group] + firsts[group], lo)
        hi = np.where(across & second, 0, hi)
    label = forest(fps, lo, hi)
    moved = np.flatnonzero(label != np.arange(n))
    return pd.DataFrame({"src": reps[label[moved]], "dst": reps[moved]})


def forest(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS,
           chunk: int = 1 << 15) -> np.ndarray:
    """Component label (smallest position) of every fingerprint.

    Position i is compared with positions lo[i] .. hi[i]-1, 64 at a time.
    """
    n = len(fps)
    planes = bit_planes(fps)
    first, last = lo >> 6, np.where(hi > lo, (hi - 1) >> 6, -1)
    spans = np.where(hi > lo, last - first + 1, 0)
    label = np.arange(n)
    edge = np.cumsum(spans)
    at = 0
    while at < n:
        # As many queries as fill a chunk of (query, block) comparisons, one at least.
        done = edge[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(edge, done + chunk, side="right")))
        queries = np.repeat(np.arange(at, stop), spans[at:stop])
        if len(queries):
            offset = np.arange(len(queries)) - np.repeat(edge[at:stop] - spans[at:stop] - done,
                                                         spans[at:stop])
            blocks = first[queries] + offset
            for part in range(0, len(queries), chunk):
                q, b = queries[part:part + chunk], blocks[part:part + chunk]
                begin = np.maximum(lo[q] - (b << 6), 0).astype(np.uint64)
                end = np.minimum(hi[q] - (b << 6), 64).astype(np.uint64)
                lanes = (_FULL << begin) & (_FULL >> (np.uint64(64) - end))
                hit = np.flatnonzero(close := near_lanes(planes, fps, q, b, lanes, radius))
                if len(hit):
                    row, lane = np.nonzero(np.unpackbits(
                        close[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                        bitorder="little"))
                    label = join_labels(label, q[hit][row], (b[hit][row] << 6) + lane)
        at = stop
    return label


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Planes (block, bit): bit j of word (k, i) is bit i of fingerprint 64 k + j."""
    blocks = -(-len(fps) // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(blocks, 64, 8), axis=2,
                         bitorder="little")
    packed = np.packbits(bits, axis=1, bitorder="little")  # (block, 8 bytes of lanes, bit)
    return np.ascontiguousarray(packed.transpose(0, 2, 1)).view("<u8").reshape(blocks, 64)


def near_lanes(planes: np.ndarray, fps: np.ndarray, q: np.ndarray, b: np.ndarray,
               lanes: np.ndarray, radius: int) -> np.ndarray:
    """For every (query, block): the lanes of ``lanes`` within ``radius`` differing bits.

    Three planes at a time go through a carry-save adder into the counters of weight 1, 2 and 4;
    a lane whose count passes the radius is marked, and pairs with all lanes marked are dropped.
    """
    out = np.zeros(len(q), np.uint64)
    live = np.arange(len(q))
    fp, over = fps[q], ~lanes
    ones, twos, fours = (np.zeros(len(q), np.uint64) for _ in range(3))
    above = _above(radius)
    for step in range(0, 64, 3):
        x = [planes[b, i] ^ (np.uint64(0) - ((fp >> np.uint64(i)) & np.uint64(1)))
             for i in range(step, min(step + 3, 64))]
        while len(x) < 3:
            x.append(np.zeros_like(fp))
        half = x[0] ^ x[1]
        total, carry = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        up = ones & total
        ones = ones ^ total
        # two numbers of weight 2 join the counter of twos
        both = twos ^ carry
        up2 = (twos & carry) | (both & up)
        twos = both ^ up
        over |= fours & up2  # the count passed seven
        fours = fours | up2
        over |= above(ones, twos, fours)
        if step % 6 == 3:
            keep = over != _FULL
            if not keep.all():
                live, fp, b, over = live[keep], fp[keep], b[keep], over[keep]
                ones, twos, fours = ones[keep], twos[keep], fours[keep]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _above(radius: int):
    """Lanes whose three-bit count exceeds the radius, for a radius up to seven."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold distances up to seven")

    def above(ones, twos, fours):
        found = np.zeros_like(ones)
        for value in range(radius + 1, 8):
            found |= ((ones if value & 1 else ~ones) & (twos if value & 2 else ~twos)
                      & (fours if value & 4 else ~fours))
        return found

    return above


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after linking positions u and v; every label is the smallest position reached."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, id_column, text_column, width), "fingerprints")
    reps = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"),
        "distinct-fingerprints")
    found = connected_components(link_fingerprints(reps))
    named = (reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest id of every component, once.

    Rows without an id stay only where no row with an id shares their fingerprint, one for each
    fingerprint.
    """
    ids = near_duplicates(docs, id_column, text_column, width)
    keepers = (ids.filter("doc_id = component_id").select(F.col("doc_id").alias("keep"))
               .distinct())
    inner = masked(docs)
    key = position(docs, id_column)
    kept = (inner.join(keepers, F.col(key).cast("bigint") == F.col("keep"), "left_semi")
            .dropDuplicates([key]))
    stray = inner.filter(F.col(key).isNull())
    if stray.limit(1).count():
        text = position(docs, text_column)
        printed = _printed(stray, text, width)
        open_prints = ids.filter("component_id IS NULL").select("fp").distinct()
        kept = kept.unionByName(
            printed.join(open_prints, "fp", "left_semi").dropDuplicates(["fp"]).drop("fp"))
    return unmasked(kept, docs)
