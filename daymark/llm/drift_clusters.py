"""Centroid clustering in exact integers, with bounds tightened by the geometry of the drift.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the
distance to all others. While the upper is below the lower, the assignment stands and no distance
is computed. When centroids move, the upper bound grows by the own centroid's drift. The lower
bound usually falls by the largest drift of all; here it falls by less. All vectors of a cluster
lie in a sphere around its centroid, and only their nearness to the moved centroid counts: in the
plane through the sphere's centre and the old and the new place of the other centroid, the points
that come nearer by s lie inside a cone around the line of movement, of angle acos(s / drift) at
its middle. The angle from that line to the sphere's edge therefore bounds what any vector of the
cluster can lose, and a sphere that lies behind the movement loses nothing. Vectors whose bounds
meet, and no others, are compared with all centroids, exactly.

Vectors are kept in blocks of some thousand, in the narrowest integer type, together with their
bounds; a round reads the blocks of the last one and writes new ones, without a shuffle. Sums by
cluster are made in the blocks, so only ``k`` sums, counts and radii come to the driver.

Defined results: vectors with another number of components, or a null or non-finite one, are left
out; so is a null vector. Equal distances go to the smaller number, equal hashes of the start (a
repeated id) to the smaller vector; repeated rows count each; fewer vectors than ``k`` make as many
centroids; no vectors, no rows. A null id counts as the empty text in the hash. Components must
stay below 2**27 after scaling, else the squared distance would not fit a long: that is an error.
Only the id and the vector of the input are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import materialize

BLOCK_ROWS = 8192
LARGEST = 1 << 27
#: Up to here sums of squares of 64 components are exact in doubles.
SMALL = 1 << 22
#: Relative room that bounds in doubles are given.
GUARD = 1e-9


def usable(vector: Column, n: int) -> Column:
    """Exactly ``n`` components, none of them null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == n) & good


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component."""
    out = np.floor(vectors.astype(np.float64) * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ArithmeticError(f"scaled components must be below {LARGEST}")
    return out.astype(np.int64)


def loosening(radius: float, centre: np.ndarray, old: np.ndarray, new: np.ndarray) -> float:
    """Most by which a point within ``radius`` of ``centre`` comes nearer when ``old`` moves to
    ``new``."""
    move = (new - old).astype(np.float64)
    drift = float(np.sqrt(move @ move))
    if drift == 0.0:
        return 0.0
    arm = centre - (old + new) / 2.0
    reach = float(np.sqrt(arm @ arm))
    if reach <= radius * (1 + GUARD):
        return drift
    angle = np.arccos(np.clip(arm @ move / (reach * drift), -1.0, 1.0))
    edge = max(0.0, float(angle - np.arcsin(radius / reach)) - GUARD)
    return min(drift, drift * max(0.0, float(np.cos(edge))))


@dataclass
class Move:
    """What the blocks need to know of one round."""

    centroids: np.ndarray
    drifts: np.ndarray
    loosened: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> Move:
        drifts = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
        loosened = np.array([
            max([loosening(radii[i], old[i], old[j], new[j])
                 for j in range(len(old)) if j != i], default=0.0) for i in range(len(old))])
        return cls(new, drifts * (1 + GUARD), loosened * (1 + GUARD))


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row a vector and one column a centroid."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if top < SMALL:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def own_squares(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((vectors - centroids[cluster]) ** 2).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray):
    """Cluster, distance to it and distance to the next nearest centroid."""
    d = squares(vectors, centroids)
    cluster = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(d)), cluster].astype(np.float64))
    if d.shape[1] == 1:
        return cluster, upper, np.full(len(d), np.inf)
    return cluster, upper, np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))


def reassign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray,
             move: Move):
    """New clusters and bounds after a move, and the number of vectors compared with all."""
    cluster, upper = cluster.copy(), (upper + move.drifts[cluster]) * (1 + GUARD)
    lower = (lower - move.loosened[cluster]) * (1 - GUARD)
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = np.sqrt(
        own_squares(vectors[open_], move.centroids, cluster[open_]).astype(np.float64))
    open_ = open_[~(upper[open_] * (1 + GUARD) < lower[open_])]
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = nearest(vectors[open_], move.centroids)
    return cluster, upper, lower, len(open_)


def _narrow(values: np.ndarray) -> tuple[bytes, str]:
    top = int(np.abs(values).max(initial=0))
    kind = next(k for k, room in (("<i1", 127), ("<i2", 32767), ("<i4", 1 << 31)) if top <= room)
    return values.astype(kind).tobytes(), kind


def _block_schema(id_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    fields = {"ids": T.ArrayType(id_type), "vectors": T.BinaryType(), "kind": T.StringType(),
              "cluster": T.BinaryType(), "upper": T.BinaryType(), "lower": T.BinaryType(),
              "scanned": T.LongType(), "counts": longs, "sums": longs, "inertia": longs,
              "radii": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _block_row(vectors, cluster, upper, lower, scanned, centroids) -> dict:
    k = len(centroids)
    sums = np.zeros((k, vectors.shape[1]), np.int64)
    np.add.at(sums, cluster, vectors)
    spread, radii = np.zeros(k, np.int64), np.zeros(k)
    np.add.at(spread, cluster, own_squares(vectors, centroids, cluster))
    np.maximum.at(radii, cluster, upper)
    data, kind = _narrow(vectors)
    return {"vectors": data, "kind": kind, "cluster": cluster.astype("<i4").tobytes(),
            "upper": upper.tobytes(), "lower": lower.tobytes(), "scanned": scanned,
            "counts": np.bincount(cluster, minlength=k).tolist(), "sums": sums.ravel().tolist(),
            "inertia": spread.tolist(), "radii": radii.tolist()}


def _to_batch(rows: list[dict], ids: pa.Array) -> pa.RecordBatch:
    kinds = {"vectors": pa.binary(), "kind": pa.string(), "cluster": pa.binary(),
             "upper": pa.binary(), "lower": pa.binary(), "scanned": pa.int64(),
             "counts": pa.list_(pa.int64()), "sums": pa.list_(pa.int64()),
             "inertia": pa.list_(pa.int64()), "radii": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays(
        [ids] + [pa.array([r[n] for r in rows], t) for n, t in kinds.items()],
        names=["ids", *kinds])


def _state(row: dict, n: int):
    vectors = np.frombuffer(row["vectors"], row["kind"]).astype(np.int64).reshape(-1, n)
    return (vectors, np.frombuffer(row["cluster"], "<i4").astype(np.int64),
            np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))


def _first_blocks(rows: DataFrame, n: int, scale: float, centroids: np.ndarray) -> DataFrame:
    """Blocks with every vector compared with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = whole(np.asarray(part.column(1).flatten()).reshape(-1, n), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()),
                                               part.column(0))
                cluster, upper, lower = nearest(vectors, centroids)
                yield _to_batch([_block_row(vectors, cluster, upper, lower, len(vectors),
                                            centroids)], ids)

    return rows.mapInArrow(run, _block_schema(rows.schema[0].dataType))


def _next_blocks(blocks: DataFrame, n: int, move: Move) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(["vectors", "kind", "cluster", "upper", "lower"]).to_pylist()[0]
                vectors, *bounds = _state(row, n)
                cluster, upper, lower, scanned = reassign(vectors, *bounds, move)
                yield _to_batch([_block_row(vectors, cluster, upper, lower, scanned,
                                            move.centroids)], one.column("ids"))

    return blocks.mapInArrow(run, blocks.schema)


def _totals(blocks: DataFrame, k: int, n: int):
    """Counts, sums, inertia and radii by cluster: k rows, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, n), np.int64)
        spread, radii = np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            for row in batch.to_pylist():
                counts += np.array(row["counts"])
                sums += np.array(row["sums"]).reshape(k, n)
                spread += np.array(row["inertia"])
                radii = np.maximum(radii, row["radii"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(counts), pa.array(sums.tolist()),
             pa.array(spread), pa.array(radii)],
            names=["cluster", "n", "sums", "inertia", "radius"])

    parts = blocks.select("counts", "sums", "inertia", "radii").mapInArrow(
        run, "cluster int, n bigint, sums array<bigint>, inertia bigint, radius double")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("inertia").alias("inertia"),
        F.max("radius").alias("radius"),
        *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)])
    rows = {r["cluster"]: r for r in added.collect()}
    empty = [0] * n
    return (np.array([rows[c]["n"] if c in rows else 0 for c in range(k)]),
            [[rows[c][f"s{i}"] for i in range(n)] if c in rows else empty for c in range(k)],
            [int(rows[c]["inertia"]) if c in rows else 0 for c in range(k)],
            np.array([rows[c]["radius"] if c in rows else 0.0 for c in range(k)]))


def moved(centroids: np.ndarray, counts: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """Exact floors of the means; centroids without vectors stay."""
    return np.array([[s // int(n) for s in row] if n else list(old)
                     for old, n, row in zip(centroids.tolist(), counts, sums, strict=True)],
                    np.int64)


def start_centroids(rows: DataFrame, n: int, scale: float, k: int) -> np.ndarray:
    """The vectors with the smallest hash of ``1:<id>``, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(digest, "v").limit(k).select("v").collect()
    return whole(np.array([r["v"] for r in first], np.float64).reshape(-1, n), scale)


def cluster_blocks(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                   dimensions: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3):
    """(blocks, centroids, inertia by cluster) after ``rounds`` moves and a last assignment."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).filter(
        usable(F.col("v"), dimensions))
    centroids = start_centroids(rows, dimensions, scale, k)
    made = max(len(centroids), 1)
    centroids = centroids if len(centroids) else np.zeros((1, dimensions), np.int64)
    blocks = materialize(_first_blocks(rows, dimensions, scale, centroids), "cluster-blocks")
    for _ in range(rounds):
        counts, sums, _, radii = _totals(blocks, made, dimensions)
        after = moved(centroids, counts, sums)
        move = Move.between(centroids, after, radii)
        blocks, centroids = materialize(
            _next_blocks(blocks, dimensions, move), "cluster-blocks"), after
    return blocks, centroids, _totals(blocks, made, dimensions)[2]


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
            dimensions: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector.

    ``distance`` is squared, in scaled integers; ``centroid`` has the components of the final
    centroid. The inertias are sums of distances over the cluster and over all.
    """
    blocks, centroids, inertia = cluster_blocks(
        vectors, id_column, vector_column, dimensions, scale, k, rounds)
    id_type = vectors.schema[id_column].dataType
    schema = (T.StructType().add("id", id_type).add("cluster", T.IntegerType())
              .add("distance", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                values, number, *_ = _state(one.select(
                    ["vectors", "kind", "cluster", "upper", "lower"]).to_pylist()[0], dimensions)
                yield pa.RecordBatch.from_arrays(
                    [one.column("ids").flatten(), pa.array(number.astype(np.int32)),
                     pa.array(own_squares(values, centroids, number))],
                    names=["id", "cluster", "distance"])

    def by_cluster(values: list, kind: str) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]

    rows = blocks.select("ids", "vectors", "kind", "cluster", "upper", "lower").mapInArrow(
        run, schema)
    listed = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in c]) for c in centroids.tolist()])
    return rows.select(
        F.col("id").alias(id_column), "cluster", "distance",
        by_cluster(inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        listed[F.col("cluster")].alias("centroid"))
