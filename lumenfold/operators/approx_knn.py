"""Approximate KNN by an expanding search over voxel rings.

A cell's rings are searched outward from ring 1 (the cell itself only on request) until they hold k points, and then up
to twice that ring, MAX_RADIUS at most. Where the search ends depends on the cell alone, so it is found per cell: rounds
with growing radius, in which only cells that have not found k points yet take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import shuffled, staged
from ..schema import check_k, validated
from . import tiles
from .neighbours import distinct_places, equalize, listed, nearest, others_of, queries_of
from .voxel import CELL, Grid, cell_counts, cell_pairs, fits, spread

MAX_RADIUS = 50
LADDER = (2, 4, 8, 16, 32, MAX_RADIUS)
#: So few open cells among so few cells are searched to the last radius at once.
FEW_OPEN, FEW_CELLS = 2048, 32768


def stop_radii(counts: DataFrame, k: int, include_home: bool = False) -> DataFrame:
    """gx, gy, gz, stop for every cell of counts (gx, gy, gz, n), which is read more than once."""
    open_cells, found = counts.select(*CELL), []
    first = 0 if include_home else 1
    cells = n_open = counts.count()
    for radius in LADDER:
        if n_open <= FEW_OPEN and cells <= FEW_CELLS:
            radius = MAX_RADIUS
        rings = cell_pairs(open_cells, counts, radius, n_open, cells).where(F.col("ring") >= first).groupBy("c_gx", "c_gy", "c_gz", "ring").agg(F.sum("o_n").alias("n"))
        run = F.sum("n").over(Window.partitionBy("c_gx", "c_gy", "c_gz").orderBy("ring"))
        done = rings.withColumn("run", run).where(F.col("run") >= k).groupBy("c_gx", "c_gy", "c_gz").agg(F.min("ring").alias("ring"))
        # the home cell alone counts as ring 1, the first that is searched
        stop = F.least(F.greatest("ring", F.lit(1)) * 2, F.lit(MAX_RADIUS)).cast("int")
        done = staged(done.select(*[F.col(f"c_{c}").alias(c) for c in CELL], stop.alias("stop")), "stops")
        found.append(done)
        open_cells = open_cells.join(shuffled(done), CELL, "left_anti")
        if radius == MAX_RADIUS:
            found.append(open_cells.withColumn("stop", F.lit(MAX_RADIUS)))
            break
        open_cells = staged(open_cells, "open-cells")
        n_open = open_cells.count()
        if not n_open:
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def candidates(points: DataFrame, places: DataFrame, k: int, voxel_mode: str = "truncated", include_home: bool = False) -> DataFrame:
    grid, stops, n_cells = _stops(points, k, voxel_mode, include_home)
    return _candidates(places, grid, stops, n_cells, include_home)


def _stops(points: DataFrame, k: int, voxel_mode: str, include_home: bool) -> tuple[Grid, DataFrame, int]:
    """The grid, its cells with stop and step, and their number."""
    grid = Grid.of(points, voxel_mode)
    cells = staged(cell_counts(grid.assign(points)), "cells")
    # cells meet in blocks as wide as the step of the ladder that their radius needs
    step = F.lit(MAX_RADIUS)
    for radius in reversed(LADDER[:-1]):
        step = F.when(F.col("stop") <= radius, F.lit(radius)).otherwise(step)
    return grid, staged(stop_radii(cells, k, include_home).withColumn("step", step), "stop-radii"), cells.count()


def _candidates(places: DataFrame, grid: Grid, stops: DataFrame, n_cells: int, include_home: bool, beyond: int = 0) -> DataFrame:
    """Pairs of places (q_ columns) and the points (n_ columns) that their points may find. places: from distinct_places,
    read more than once. beyond: only places whose search ends farther than so many cells."""
    least = 0 if include_home else 1
    occupied, stops = stops.select(*CELL), stops.where(F.col("stop") > beyond)
    pairs = None
    for row in stops.groupBy("step").agg(F.count("*").alias("n")).orderBy("step").collect():  # the steps of the ladder at most
        near = cell_pairs(stops.where(F.col("step") == row["step"]).drop("step"), occupied, row["step"], row["n"], n_cells)
        near = near.where(F.col("ring").between(least, F.col("c_stop"))).select("c_gx", "c_gy", "c_gz", "o_gx", "o_gy", "o_gz")
        pairs = near if pairs is None else pairs.unionByName(near)
    queries, others = _celled(queries_of(places), grid, "q_", "c_"), _celled(others_of(places), grid, "n_", "o_")
    if pairs is None:
        return queries.join(others, F.lit(False))
    pairs = staged(pairs, "cell-pairs")
    pairs = spread(pairs, pairs.count(), *[f"c_{c}" for c in CELL])
    meet = F.broadcast if fits(places.count()) else shuffled
    joined = pairs.join(meet(queries), [f"c_{c}" for c in CELL]).join(meet(others), [f"o_{c}" for c in CELL])
    return joined.drop(*[f"{p}{c}" for p in ("c_", "o_") for c in CELL])


def _celled(points: DataFrame, grid: Grid, p: str, to: str) -> DataFrame:
    """points, whose columns have the prefix p, with the columns of their cells, which have the prefix `to`."""
    return points.withColumns({f"{to}g{c}": grid.number(F.col(f"{p}{c}")) for c in "xyz"})


def approx_neighbours(points: DataFrame, k: int, voxel_mode: str = "truncated", include_home: bool = False) -> DataFrame:
    """points with found, the k nearest of their candidates in order."""
    places = staged(distinct_places(points, k), "places")
    grid, stops, n_cells = _stops(points, k, voxel_mode, include_home)
    celled = grid.assign(places).join(F.broadcast(stops) if fits(n_cells) else shuffled(stops), CELL).drop("step")
    if tiles.largest(celled, tiles.cell_tile()) > tiles.TILE_PLACES:  # too dense for tasks that hold tiles
        return listed(points, places, nearest(_candidates(places, grid, stops, n_cells, include_home), k), k)
    lists = staged(tiles.approx_lists(celled, k, 0 if include_home else 1), "tile-lists")
    more = nearest(_candidates(places, grid, stops, n_cells, include_home, beyond=tiles.HALO), k)
    return listed(points, places, lists.unionByName(more), k)


def equalize_approx_knn(cloud: DataFrame, k: int, voxel_mode: str = "truncated", include_home_voxel: bool = False) -> DataFrame:
    """cloud with new_intensity. A point without candidates keeps its intensity."""
    check_k(k)
    points = validated(cloud)
    return equalize(approx_neighbours(points, k, voxel_mode, include_home_voxel), k, keep_lonely=True)
