"""Comparing results: mean absolute error, alignment, overlays, and the comparison of all methods."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import shuffled, staged
from .approx_knn import equalize_approx_knn
from .exact_knn import equalize_knn
from .kmeans import equalize_kmeans

#: The names of the methods.
KNN, APPROX, KMEANS = "knn", "approx_knn", "kmeans"


def equalizer(algo: str, k: int, rounds: int = 50, voxel_mode: str = "truncated") -> Callable[[DataFrame], DataFrame]:
    """The method of that name; ValueError for any other."""
    known = {
        KNN: lambda cloud: equalize_knn(cloud, k),
        APPROX: lambda cloud: equalize_approx_knn(cloud, k, voxel_mode),
        KMEANS: lambda cloud: equalize_kmeans(cloud, k, rounds).drop("cluster"),
    }
    if algo not in known:
        raise ValueError(f"unknown algorithm {algo!r}; there are {', '.join(known)}")
    return known[algo]


def settled(result: DataFrame, *more: str) -> DataFrame:
    """idx, the columns that `more` names, and new_intensity of a result, found now and written, so that what is made of several
    results plans, and finds anew, none of them."""
    return staged(result.select("idx", *more, "new_intensity"), "result")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx, a, b: the new intensities of two results, point by point."""
    left = a.select("idx", F.col("new_intensity").alias("a"))
    return left.join(shuffled(b.select("idx", F.col("new_intensity").alias("b"))), "idx")


def mean_absolute_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, mae (0 for no points)."""
    return aligned(a, b).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.abs(F.col("a") - F.col("b")).cast("double")), F.lit(0.0)).alias("mae"))


def check_same_points(a: DataFrame, b: DataFrame) -> None:
    """ValueError unless both results hold the same points at the same idx."""
    both = a.select("idx", *[F.col(c).alias(f"a_{c}") for c in "xyz"]).join(b.select("idx", *[F.col(c).alias(f"b_{c}") for c in "xyz"]), "idx", "full")
    same = F.lit(True)
    for c in "xyz":
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    bad = both.where(~same).limit(1).collect()
    if bad:
        raise ValueError(f"the results differ at {bad[0]}")


def overlay(cloud: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """idx, x, y, z, value, method: the original intensities and each method's, below one another. Results are found once, one
    after another."""
    out = cloud.select("idx", "x", "y", "z", F.col("intensity").alias("value"), F.lit("original").alias("method"))
    for name, df in results.items():
        df = settled(df, *"xyz")
        out = out.unionByName(df.select("idx", "x", "y", "z", F.col("new_intensity").alias("value"), F.lit(name).alias("method")))
    return out


def compare(clouds: dict[str, DataFrame], k: int, rounds: int, timed: bool = True) -> DataFrame:
    """precision, algo, n, mae (against exact KNN of the same precision), elapsed_ms (null unless timed; with writing the result)
    per cloud."""
    out = None
    for precision, cloud in clouds.items():
        results, took = {}, {}
        for algo in (KNN, APPROX, KMEANS):
            start = time.perf_counter()
            results[algo] = settled(equalizer(algo, k, rounds)(cloud))
            took[algo] = (time.perf_counter() - start) * 1000 if timed else None
        for algo, df in results.items():
            row = mean_absolute_error(df, results[KNN]).select(
                F.lit(precision).alias("precision"), F.lit(algo).alias("algo"), "n", "mae", F.lit(took[algo]).cast("double").alias("elapsed_ms")
            )
            out = row if out is None else out.unionByName(row)
    return out
