"""Exact integer k-means over vectors that are dictionary-encoded by blocks of dimensions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import query, stored, table

# Scaled components up to this size keep 64-bit sums of squares exact for up to 64 dimensions.
LARGEST = 1 << 27
# Vectors of one dictionary at most, so that a code fits 16 bits.
CHUNK_ROWS = 16_384


@dataclass(frozen=True)
class Clustering:
    """``assigned`` (id, ``cluster``, ``distance``), the final centroids, and the summed distance of each cluster with vectors."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]


def whole_vectors(df: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """The rows whose vector has exactly ``dims`` components, none of them null or not finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & finite)


def _scaled(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integers, one row per vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    whole = np.floor(scale * flat)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ArithmeticError(f"a component beyond {LARGEST / scale} in size cannot be summed exactly")
    return whole.astype(np.int64)


def encode_chunks(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, block: int) -> DataFrame:
    """Rows of up to ``CHUNK_ROWS`` vectors, each with one dictionary per block of ``block`` dimensions.

    ``entries`` holds the distinct subvectors of all blocks in a row (64-bit
    integers), ``sizes`` how many each block has, ``codes`` for each block the
    16-bit place in its dictionary of every vector; nothing is lost.  A chunk is
    of bounded size, whatever the number of distinct subvectors in the table.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(first, CHUNK_ROWS)
                vectors = _scaled(part.column(1), dims, scale)
                entries, codes, sizes = [], [], []
                for at in range(0, dims, block):
                    found, code = np.unique(vectors[:, at : at + block], axis=0, return_inverse=True)
                    entries.append(found.ravel())
                    codes.append(code.ravel().astype("<u2"))
                    sizes.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                        pa.array([sizes], pa.list_(pa.int32())),
                        pa.array([np.concatenate(entries).astype("<i8").tobytes()], pa.binary()),
                        pa.array([np.concatenate(codes).tobytes()], pa.binary()),
                    ],
                    names=["ids", "sizes", "entries", "codes"],
                )

    rows = df.select(F.col(id_col), F.col(vector_col))
    return rows.mapInArrow(encode, f"ids array<{id_type}>, sizes array<int>, entries binary, codes binary")


def _blocks(row: dict, dims: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of one chunk: first dimension, dictionary and codes of every block."""
    entries, codes = np.frombuffer(row["entries"], "<i8"), np.frombuffer(row["codes"], "<u2")
    rows = len(codes) // len(row["sizes"])
    at = 0
    for n, size in enumerate(row["sizes"]):
        width = min(block, dims - n * block)
        yield n * block, entries[at : at + size * width].reshape(size, width), codes[n * rows : (n + 1) * rows]
        at += size * width


def _nearest(row: dict, centroids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equal ones) and the squared distance, for each vector of a chunk.

    Each distinct subvector meets each centroid once; a vector's distance is the sum of its codes' entries.
    """
    total: np.ndarray | int = 0
    for at, entries, codes in _blocks(row, centroids.shape[1], block):
        apart = entries[:, None, :] - centroids[None, :, at : at + block]
        total = total + (apart * apart).sum(axis=2)[codes]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


def _updated(chunks: DataFrame, centroids: list[list[int]], block: int) -> list[list[int]]:
    """The centroids after one round: componentwise floor of each cluster's mean, empty clusters as they were."""
    if not centroids:
        return centroids
    now, dims = np.array(centroids, np.int64), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(now.shape, np.int64)
        count = np.zeros(len(now), np.int64)
        for row in _rows(batches):
            cluster, _ = _nearest(row, now, block)
            count += np.bincount(cluster, minlength=len(now))
            for at, entries, codes in _blocks(row, dims, block):
                # How often a code stands in a cluster, times its subvector.
                often = np.bincount(cluster * len(entries) + codes, minlength=len(now) * len(entries))
                total[:, at : at + block] += often.reshape(len(now), -1) @ entries
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(np.column_stack([count, total])[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    parts = chunks.mapInArrow(sums, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    # As decimals, since sums over all tasks may pass 64 bits; k * (dims + 1) rows come to the driver.
    totals = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = {(row["cluster"], row["at"]): int(row["total"]) for row in totals.collect()}
    return [
        [found[c, d + 1] // found[c, 0] for d in range(dims)] if (c, 0) in found else list(old)
        for c, old in enumerate(centroids)
    ]


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    k: int = 16,
    rounds: int = 3,
    scale: int = 64,
    seed: str = "1",
    block: int = 2,
) -> Clustering:
    """Cluster the vectors of exactly ``dims`` finite components, in integers ``floor(scale * x)``.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:id``
    (all, if there are fewer).  Vectors are dictionary-encoded once and written;
    a round reads only codes and dictionaries.  What meets the driver are ``k``
    centroids.  Repeated rows are vectors like all others; of several with one id
    the componentwise smaller one comes first among the start vectors, and null
    ids come after all others.  Null, short, long and not finite vectors are left
    out, and an empty table has no centroids and no rows.  Other columns play no
    part.  A component too large for exact 64-bit sums is an error.
    """
    if dims > 64 or not 0 < k < 1 << 16:
        raise ValueError("at most 64 dimensions and 65,535 clusters")
    rows = whole_vectors(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector")), "vector", dims)
    chunks = stored(encode_chunks(rows, "id", "vector", dims, scale, block), "subvectors")
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    starts = (
        rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), scaled.alias("whole"))
        .orderBy(F.col("hash").asc_nulls_last(), "whole")
        .limit(k)
    )
    centroids = [row["whole"] for row in starts.collect()]
    for _ in range(rounds):
        centroids = _updated(chunks, centroids, block)
    id_type = rows.schema["id"].dataType.simpleString()
    final = np.array(centroids, np.int64).reshape(-1, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                part = batch.slice(n, 1)
                cluster, distance = _nearest(part.to_pylist()[0], final, block)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).flatten(), pa.array(cluster, pa.int32()), pa.array(distance)],
                    names=["id", "cluster", "distance"],
                )

    assigned = stored(chunks.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()
    return Clustering(assigned.withColumnRenamed("id", id_col), centroids, {row["cluster"]: row["total"] for row in sums})


def _digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


_ASSIGN = """r{n} AS (
  SELECT copy, vec_id, v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT copy, vec_id, k.v, c, list_sum(list_transform(list_zip(k.v, s.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM k, c{n} s) GROUP BY ALL)"""
_UPDATE = """c{m} AS (
  SELECT c, coalesce(list(q ORDER BY dim) FILTER (q IS NOT NULL), any_value(old)) AS v FROM (
    SELECT s.c, s.v AS old, x.dim, (x.total - ((x.total % x.n) + x.n) % x.n) // x.n AS q
    FROM c{n} s LEFT JOIN (
      SELECT c, dim, sum(x)::BIGINT AS total, count(*) AS n
      FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM r{n}) GROUP BY ALL) x USING (c))
  GROUP BY c)"""

SQL = """WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
k AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS copy FROM whole),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT 16)),
""" + ",\n".join(
    part for n in range(4) for part in ([_UPDATE.format(m=n, n=n - 1)] if n else []) + [_ASSIGN.format(n=n)]
) + """
SELECT vec_id, best.c::INT AS cluster, best.d AS distance,
  sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM r3 JOIN c3 ON c3.c = best.c"""


@query("op13_centroid_clustering", SQL)
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after 3 rounds."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    total = sum(found.inertia.values())
    # One row per cluster, 16 at most.
    named = spark.createDataFrame(
        [(c, at, total, _digest(found.centroids[c])) for c, at in found.inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
