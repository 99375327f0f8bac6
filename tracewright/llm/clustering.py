"""Exact k-means on whole-number vectors through dictionaries of subvectors.

Vectors are cut into blocks of dimensions, and each block of a chunk of vectors is stored as a lossless
dictionary: its distinct subvectors and a code per vector. A round computes the squared distances of the
distinct subvectors to the centroids' blocks, once per subvector, and a vector's distance is the sum of
the entries that its codes name. All arithmetic is in whole numbers. The chunks are written once and stay
where they are; what a round moves is one row of sums per centroid and task, and the centroids, whose
number is a parameter, are all that the driver holds.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out.
Repeated rows count each. Start centroids are the rows whose ids hash lowest (null ids last, equal ids by their vectors);
where fewer vectors than `k` are usable, each is a centroid. Of equally near centroids the smaller number is
taken; an empty centroid stays where it is. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import cut
from tracewright.llm.vectors import quantised, stacked

#: Vectors of a chunk (codes have 16 bits), and dimensions of a block.
CHUNK, WIDTH = 8192, 2


def encoded(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows (id, vec) as chunks: ids, and for each block of dimensions its distinct subvectors and the vectors' codes."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = stacked(t["vec"])
        dictionaries, codes = [], []
        for b in range(0, x.shape[1], width):
            distinct, code = np.unique(x[:, b : b + width], axis=0, return_inverse=True)
            dictionaries.append(distinct.astype("<i4").tobytes())
            codes.append(code.reshape(-1).astype("<u2").tobytes())
        ids = t["id"].combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([ids, pa.array([dictionaries], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], names=["ids", "subvectors", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = CHUNK
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, room))
                batch, room = batch.slice(room), room - held[-1].num_rows
                if not room:
                    yield pack(held)
                    held, room = [], CHUNK
        if held:
            yield pack(held)

    return rows.select("id", "vec").mapInArrow(run, f"ids array<{rows.schema['id'].dataType.simpleString()}>, subvectors array<binary>, codes array<binary>")


def blocks(row: dict, width: int, dim: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(dimensions, distinct subvectors, codes) of each block of a chunk."""
    for i, (sub, code) in enumerate(zip(row["subvectors"], row["codes"], strict=True)):
        at = slice(i * width, min((i + 1) * width, dim))
        yield at, np.frombuffer(sub, "<i4").astype(np.int64).reshape(-1, at.stop - at.start), np.frombuffer(code, "<u2")


def nearest(row: dict, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of a chunk's vectors."""
    total = np.zeros((len(row["ids"]), len(centroids)), np.int64)
    for at, sub, code in blocks(row, width, centroids.shape[1]):
        partial = np.zeros((len(sub), len(centroids)), np.int64)
        for j in range(at.stop - at.start):
            partial += (sub[:, j, None] - centroids[None, :, at.start + j]) ** 2
        total += partial[code]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(total)), cluster]


def moved(chunks: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                cluster, _ = nearest(row, centroids, width)
                n += np.bincount(cluster, minlength=k)
                for at, sub, code in blocks(row, width, dim):
                    for j in range(at.stop - at.start):
                        # whole numbers below 2**53, so exact
                        sums[:, at.start + j] += np.bincount(cluster, weights=sub[code, j], minlength=k).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = chunks.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
    out = centroids.copy()
    for r in total.collect():  # k rows at most
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2", scale: int = 256, width: int = WIDTH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each usable vector."""
    spark = vectors.sparkSession
    rows = quantised(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v", scale, dim)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "vec").limit(k).collect()
    centroids = np.array([np.frombuffer(r.vec, "<i4") for r in first], np.int64).reshape(len(first), dim)
    kind = rows.schema["id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = cut(encoded(rows, width), "chunks")
    for _ in range(rounds):
        centroids = moved(chunks, centroids, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                cluster, distance = nearest(row.to_pylist()[0], centroids, width)
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    out = cut(chunks.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.inertia) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("inertia")).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
