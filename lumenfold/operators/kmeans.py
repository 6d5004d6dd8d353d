"""K-means clusters as neighbourhoods.

The first k points are the seeds. Each round assigns every point to its nearest centroid (then by the centroid's
coordinates, then its number) and moves centroids to their points' mean, truncated for whole coordinates; an empty
cluster keeps its centroid. After `rounds` rounds the clusters are those of the last assignment, made before the last
move. Centroids are k rows on the driver; the points are written once and stay where they are, and a round moves k partial
sums per partition."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import equalized, squared_distance
from ..plans.staging import BROADCAST_BYTES, staged
from ..schema import check_k, is_whole, validated

Centroids = list[tuple]
#: Up to so many centroids the nearest one is found by generated code, beyond by array arithmetic in Python workers.
UNROLLED = 48
#: Points that are compared with all centroids at once.
CHUNK = 4096
#: Points of a file that is read in every round.
PART = 1 << 18


def seeds(points: DataFrame, k: int) -> Centroids:
    rows = points.where(F.col("idx") < k).orderBy("idx").collect()  # k rows
    if len(rows) != k:
        raise ValueError(f"k = {k} needs as many points")
    return [(r["x"], r["y"], r["z"]) for r in rows]


def assigned_to(points: DataFrame, centroids: Centroids) -> DataFrame:
    """points with cluster, the number of the nearest centroid."""
    k = len(centroids)
    if k == 1:
        return points.withColumn("cluster", F.lit(0))
    kind = "long" if is_whole(points) else "float"

    def option(xyz: list[Column], j: Column) -> Column:
        d = squared_distance(F.col("x"), F.col("y"), F.col("z"), *xyz)
        return F.struct(d.alias("d"), *[v.alias(c) for v, c in zip(xyz, "xyz", strict=True)], j.alias("j"))

    if k <= UNROLLED:
        options = [option([F.lit(v).cast(kind) for v in c], F.lit(j)) for j, c in enumerate(centroids)]
        return points.withColumn("cluster", F.least(*options)["j"])
    number = _numbering(centroids, kind == "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cluster", pa.array(number(batch), pa.int32()))

    schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType(), False)])
    return points.mapInArrow(assign, schema)


def _numbering(centroids: Centroids, whole: bool) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The function that gives the number of the nearest centroid of each point of a batch, in the types and the order of
    operations of squared_distance."""
    kind = np.int64 if whole else np.float32
    # in the order of ties, so that the first of the nearest decides
    ranked = sorted(range(len(centroids)), key=lambda j: (*centroids[j], j))
    numbers, axes = np.asarray(ranked, np.int32), np.asarray([centroids[j] for j in ranked], kind).T

    def number(batch: pa.RecordBatch) -> np.ndarray:
        xyz = [batch.column(c).to_numpy(zero_copy_only=False).astype(kind) for c in "xyz"]
        if whole and any(np.abs(v).max(initial=0) >= 1 << 30 for v in [*xyz, axes]):
            raise OverflowError("squared distances of these coordinates exceed 64 bits")
        out = np.empty(batch.num_rows, np.int32)
        for lo in range(0, batch.num_rows, CHUNK):
            d = 0
            for v, c in zip(xyz, axes, strict=True):
                step = v[lo : lo + CHUNK, None] - c
                d = d + step * step
            if not whole:  # as Spark orders it, nothing is farther
                d = np.where(np.isnan(d), np.float32(np.inf), d)
            out[lo : lo + CHUNK] = numbers[d.argmin(axis=1)]
        return out

    return number


def round_sums(points: DataFrame, centroids: Centroids) -> DataFrame:
    """centroid_sums of the points' nearest centroids. Beyond UNROLLED centroids a batch is summed where it is assigned."""
    points = points.select("x", "y", "z")
    if len(centroids) <= UNROLLED:
        return centroid_sums(assigned_to(points, centroids))
    whole = is_whole(points)
    number, k, kind = _numbering(centroids, whole), len(centroids), np.int64 if whole else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((3, k), kind)
        for batch in batches:
            own = number(batch)
            n += np.bincount(own, minlength=k)
            for a, c in enumerate("xyz"):
                np.add.at(sums[a], own, batch.column(c).to_numpy(zero_copy_only=False).astype(kind))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *[pa.array(v[some]) for v in sums]], names=["cluster", "n", "sx", "sy", "sz"])

    total = "long" if whole else "double"
    parts = points.mapInArrow(add, f"cluster int, n long, sx {total}, sy {total}, sz {total}")
    return parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sz")])


def centroid_sums(assigned: DataFrame) -> DataFrame:
    """cluster, n, sx, sy, sz."""
    kind = "long" if is_whole(assigned) else "double"
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast(kind)).alias(f"s{c}") for c in "xyz"])


def moved(centroids: Centroids, sums: list, whole: bool) -> Centroids:
    """The centroids after a move, by the rows of centroid_sums."""
    out = list(centroids)
    for r in sums:
        s = (r["sx"], r["sy"], r["sz"])
        if whole:
            out[r["cluster"]] = tuple(abs(v) // r["n"] * (1 if v >= 0 else -1) for v in s)
        else:
            out[r["cluster"]] = tuple(struct.unpack("f", struct.pack("f", v / r["n"]))[0] for v in s)
    return out


def centroids_after(points: DataFrame, k: int, moves: int) -> Centroids:
    whole = is_whole(points)
    centroids = seeds(points, k)
    for _ in range(moves):
        new = moved(centroids, round_sums(points, centroids).collect(), whole)
        if new == centroids:  # from here on nothing changes
            break
        centroids = new
    return centroids


def clustered(points: DataFrame, k: int, rounds: int) -> DataFrame:
    """points with cluster. Without rounds, all points are one cluster."""
    if rounds < 0:
        raise ValueError("rounds must be 0 or more")
    if rounds == 0:
        return points.withColumn("cluster", F.lit(0))
    # every round reads the points: files of equal size keep all cores busy, whatever the files of the cloud
    parts = max(points.sparkSession.sparkContext.defaultParallelism, points.count() // PART)
    points = staged(points.repartition(parts), "kmeans-points")
    return assigned_to(points, centroids_after(points, k, rounds - 1))


def histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster", "intensity").agg(F.count("*").alias("n"))


def cluster_cdf(hist: DataFrame) -> DataFrame:
    """cluster, intensity, cdf, cdf_min, m: 256 rows a cluster at most."""
    own = Window.partitionBy("cluster")
    up = own.orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("cluster", "intensity", F.sum("n").over(up).alias("cdf"), F.first("n").over(up).alias("cdf_min"), F.sum("n").over(own).alias("m"))


def equalize_kmeans(cloud: DataFrame, k: int, rounds: int) -> DataFrame:
    """cloud with cluster and new_intensity."""
    check_k(k)
    assigned = clustered(validated(cloud), k, rounds)
    new = equalized(F.col("intensity"), F.col("cdf"), F.col("cdf_min"), F.col("m"))
    table = cluster_cdf(histogram(assigned)).select("cluster", "intensity", new.alias("new_intensity"))
    # 256 rows for each of k clusters at most
    table = F.broadcast(table) if k * 256 * 24 <= BROADCAST_BYTES else table
    return assigned.join(table, ["cluster", "intensity"]).select("idx", "x", "y", "z", "intensity", "cluster", "new_intensity")


def equalize_global(cloud: DataFrame) -> DataFrame:
    """All points as one neighbourhood."""
    points = validated(cloud)
    return equalize_kmeans(points, 1, 0).drop("cluster")


