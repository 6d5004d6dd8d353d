"""The voxel grid: bounding box, cell size, cells and their counts, neighbouring cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cell, chebyshev
from ..plans.staging import BROADCAST_BYTES, shuffled
from ..schema import is_whole

CELL = ["gx", "gy", "gz"]
#: Tables of at most so many rows are spread over all cores before they are joined to many times their size.
FEW_ROWS = 1 << 20
#: Of a point or cell with its keys, at most.
ROW_BYTES = 64


def bounding_box(cloud: DataFrame) -> DataFrame:
    """One row: n, and the least and greatest of each coordinate."""
    return cloud.agg(F.count("*").alias("n"), *[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])


def voxel_size(cloud: DataFrame) -> DataFrame:
    """One row: n, volume, voxel_size (about 16 points in 27 cells; 1 where the volume is 0), truncated_size (a whole
    number of 1 or more)."""
    box = bounding_box(cloud)
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    size = F.when(F.col("volume") <= 0, F.lit(1.0)).otherwise(F.cbrt(F.lit(16.0) / (F.lit(27.0) * (F.col("n") / F.col("volume")))))
    return box.withColumn("volume", volume).withColumn("voxel_size", size).select("n", "volume", "voxel_size", F.greatest(F.col("voxel_size").cast("long"), F.lit(1)).alias("truncated_size"))


@dataclass(frozen=True)
class Grid:
    size: float
    #: Integer division, for whole coordinates and a whole size.
    whole: bool

    @classmethod
    def of(cls, cloud: DataFrame, mode: str = "truncated") -> Grid:
        """mode `truncated`: the size as a whole number; `float`: as it is."""
        if mode not in ("truncated", "float"):
            raise ValueError(f"voxel mode {mode!r}")
        row = voxel_size(cloud).first()
        size = row["voxel_size"] if row["n"] else 1.0
        return cls(float(max(1, math.trunc(size))), is_whole(cloud)) if mode == "truncated" else cls(size, False)

    def number(self, coordinate: Column) -> Column:
        return cell(coordinate, self.size, self.whole)

    def assign(self, points: DataFrame) -> DataFrame:
        """points with gx, gy, gz."""
        return points.withColumns({f"g{c}": self.number(F.col(c)) for c in "xyz"})


def cell_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(*CELL).agg(F.count("*").alias("n"))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df over all cores by keys if its rows are few: adaptive execution merges partitions by their bytes, not by the pairs
    that a join makes of them. More rows are as many partitions anyway, which it may still split where they are skewed."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if rows <= FEW_ROWS else df


def fits(rows: int) -> bool:
    """Whether so many counted points or cells may be broadcast."""
    return rows * ROW_BYTES <= BROADCAST_BYTES


def cell_pairs(cells: DataFrame, others: DataFrame, radius: int, rows: int, n_others: int) -> DataFrame:
    """Every cell with each other occupied cell within Chebyshev distance `radius`: c_ columns, o_ columns, ring. Both
    sides meet in blocks of radius cells: a cell looks into the 27 blocks around it, whatever the radius. rows and n_others:
    the numbers of cells and others, or more."""
    block = {f"b{c}": F.floor(F.col(f"g{c}") / radius).cast("long") for c in "xyz"}
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    few = fits(n_others)
    # spread by cell, what follows per cell needs no other shuffle, and no core gets more than its share of a block
    left = (spread(cells, rows, *CELL) if few else cells).withColumns(block)
    for c in "xyz":
        left = left.withColumn(f"s{c}", F.explode(near)).withColumn(f"b{c}", F.col(f"b{c}") + F.col(f"s{c}")).drop(f"s{c}")
    left = left.select(*[F.col(f"b{c}") for c in "xyz"], *[F.col(c).alias(f"c_{c}") for c in cells.columns])
    right = others.withColumns(block).select(*[F.col(f"b{c}") for c in "xyz"], *[F.col(c).alias(f"o_{c}") for c in others.columns])
    right = F.broadcast(right) if few else shuffled(right)
    ring = chebyshev(*[F.col(f"c_g{c}") - F.col(f"o_g{c}") for c in "xyz"])
    return left.join(right, ["bx", "by", "bz"]).withColumn("ring", ring).where(F.col("ring") <= radius).drop("bx", "by", "bz")
