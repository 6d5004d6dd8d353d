"""Synthetic clouds: n distinct points with coordinates in [-10000, 10000] and intensities in 0..255, from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

#: The reach of coordinates, and the decimals of float ones.
REACH, DECIMALS = 10000, 4
RANGE = 1 << 16


def _uniform(seed: int, name: str) -> Column:
    """In [0, 1), by the row's id."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(name)), 11).cast("double") / float(1 << 53)


def generate_cloud(spark: SparkSession, n: int, coordinates: str = "int", seed: int = 42) -> DataFrame:
    """idx 0..n-1, x, y, z, intensity, all points distinct. The same rows for the same seed."""
    if coordinates == "int":
        axis = lambda c: (F.floor(_uniform(seed, c) * (2 * REACH + 1)) - REACH).cast("int")
    else:
        axis = lambda c: F.round(_uniform(seed, c) * (2 * REACH) - REACH, DECIMALS).cast("float")
    drawn, most = None, n + 16 + n // 100
    while True:
        rows = spark.range(most).select("id", *[axis(c).alias(c) for c in "xyz"], F.floor(_uniform(seed, "i") * 256).cast("int").alias("intensity"))
        first = rows.groupBy("x", "y", "z", "intensity").agg(F.min("id").alias("id"))
        drawn = staged(first, "drawn")
        if drawn.count() >= n:
            break
        most *= 2
    # dense numbers by id: counts of id ranges, then places within each
    ranges = drawn.groupBy(F.expr(f"id div {RANGE}").alias("range")).agg(F.count("*").alias("c"))
    ranges = ranges.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    numbered = drawn.withColumn("range", F.expr(f"id div {RANGE}")).withColumn("own", own).join(ranges, "range")
    return numbered.select((F.col("before") + F.col("own")).alias("idx"), "x", "y", "z", "intensity").where(F.col("idx") < n)


def dataset_path(folder: str, n: int, k: int, rounds: int, coordinates: str) -> str:
    return f"{folder}/{coordinates}/dataset_n_{n}_k_{k}_T_{rounds}.txt"
