"""Exact KNN.

Up to SMALL points (counted), every pair is ranked against a broadcast copy. Beyond that, the search goes by grids of
doubling cell size. First tiles of a bounded number of places are searched each in a task, which does for all places but
those in sparse surroundings. Then a place looks at the 27 cells around it and is done once its last neighbour is no farther than the
border of these cells. Places that are not done, those in sparse surroundings, go on to the next grid, where a cell
holds eight of the former; in the last one the 27 cells hold the whole cloud. The first grid is made finer until no cell
holds more than DENSE distinct places, so that dense parts are searched at a scale of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import shuffled, staged
from ..schema import check_k, is_whole, validated
from . import tiles
from .neighbours import PLACE, distinct_places, equalize, listed, nearest, others_of, queries_of
from .voxel import bounding_box, fits, spread

SMALL = 2000
DENSE = 512


def all_pairs(places: DataFrame) -> DataFrame:
    """Every place with every point, for SMALL points at most."""
    return spread(queries_of(places), SMALL, "q_idx").crossJoin(F.broadcast(others_of(places)))


def _cells(points: DataFrame, low: dict[str, float], size: float, p: str) -> DataFrame:
    return points.withColumns({f"{p}g{c}": F.floor((F.col(f"{p}{c}").cast("double") - low[c]) / size).cast("long") for c in "xyz"})


def _within(places: DataFrame, others: DataFrame, low: dict[str, float], size: float, rows: int, few: bool) -> DataFrame:
    """Pairs of places (q_) and points (n_) in touching cells; reach: the squared distance from q to the border of the
    cells that were searched. rows: the number of places; few: whether others may be broadcast."""
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    # spread by place, the pairs are ranked where they are made
    q = _cells(spread(places, rows, "q_idx") if few else places, low, size, "q_")
    inside = [F.least(F.col(f"q_{c}").cast("double") - low[c] - (F.col(f"q_g{c}") - 1) * size, (F.col(f"q_g{c}") + 2) * size - (F.col(f"q_{c}").cast("double") - low[c])) for c in "xyz"]
    # a little less than the border, so that rounding never certifies too much
    q = q.withColumn("reach", F.pow(F.least(*inside) * (1 - 1e-6), F.lit(2)))
    for c in "xyz":
        q = q.withColumn("step", F.explode(near)).withColumn(f"g{c}", F.col(f"q_g{c}") + F.col("step")).drop("step", f"q_g{c}")
    n = _cells(others, low, size, "n_").withColumnsRenamed({f"n_g{c}": f"g{c}" for c in "xyz"})
    return q.join(F.broadcast(n) if few else shuffled(n), ["gx", "gy", "gz"]).drop("gx", "gy", "gz")


def _by_grids(points: DataFrame, places: DataFrame, box: dict[str, float], k: int) -> DataFrame:
    """The lists of all places."""
    low = {c: box[f"min_{c}"] for c in "xyz"}
    extent = max(box[f"max_{c}"] - box[f"min_{c}"] for c in "xyz")
    if extent == 0:
        extent = 1.0
    others, left = others_of(places), queries_of(places)
    n = queries_of(places).count()
    done = []
    wide, finest = extent / max(1.0, (n / tiles.AIM) ** (1 / 3)), extent / 2**20
    number = lambda s: {c: F.floor((F.col(c).cast("double") - low[c]) / s) for c in "xyz"}
    while wide > finest and tiles.largest(places, number(wide)) > tiles.TILE_PLACES:
        wide /= 2
    if wide > finest:
        done = [staged(tiles.exact_lists(places, low, wide, k), "tile-lists")]
        left = staged(left.join(shuffled(done[0].select("q_idx")), "q_idx", "left_anti"), "left-places")
        if left.isEmpty():
            return done[0]
    n = places.count()
    size = extent / max(1.0, (n * 27 / (2 * (k + 1))) ** (1 / 3))
    while size > finest:
        dense = _cells(left, low, size, "q_").groupBy("q_gx", "q_gy", "q_gz").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        if dense <= DENSE:
            break
        size /= 2
    rows = left.count()
    # whole coordinates give whole squared distances; floats are compared with a margin for their rounding
    limit = F.col("reach") if is_whole(points) else F.col("reach") * (1 - 1e-4)
    sure = (F.size("found") == k + 1) & (F.element_at("found", -1)["d"] < limit)
    while True:
        last = size >= extent
        if last:
            size = extent * (1 + 1e-6) + 1
        found = staged(nearest(_within(left, others, low, size, rows, fits(n)), k, "reach"), "near")
        if last:
            done.append(found)
            break
        done.append(found.where(sure))
        left = found.where(~sure).select("q_idx", *[F.col(c).alias(f"q_{c}") for c in PLACE])
        rows = left.count()
        if not rows:
            break
        size *= 2
    out = done[0].select("q_idx", *PLACE, "found")
    for x in done[1:]:
        out = out.unionByName(x.select("q_idx", *PLACE, "found"))
    return out


def exact_neighbours(points: DataFrame, k: int, small: int = SMALL) -> DataFrame:
    """points with found, their k nearest others in order."""
    box = bounding_box(points).first()
    places = staged(distinct_places(points, k), "places")
    lists = nearest(all_pairs(places), k) if box["n"] <= small else _by_grids(points, places, box, k)
    return listed(points, places, lists, k)


def equalize_knn(cloud: DataFrame, k: int) -> DataFrame:
    """cloud with new_intensity."""
    check_k(k)
    points = validated(cloud)
    return equalize(exact_neighbours(points, k), k, keep_lonely=False)
