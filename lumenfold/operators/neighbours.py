"""From candidate pairs to the k nearest neighbours and the equalized intensities.

Points at one place see the same others at the same distances, so a place is searched once, for the k + 1 nearest points
without leaving any out; each of its points takes the first k that are not itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import equalized, squared_distance
from ..plans.staging import shuffled, staged

PLACE = ["x", "y", "z"]
#: Places of more than a HOT-th of all points, fewer than HOT, get their lists by a broadcast table.
HOT = 256


def prefixed(points: DataFrame, p: str) -> DataFrame:
    return points.select(*[F.col(c).alias(f"{p}{c}") for c in points.columns])


def distinct_places(points: DataFrame, k: int) -> DataFrame:
    """The points that can be among anyone's k nearest, with nth: of those at one place, the k + 1 of lowest idx. Points at
    one place are equally far from any other and rank by idx, so the others never come first."""
    place = Window.partitionBy(*PLACE).orderBy("idx")
    return points.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k + 1)


def queries_of(places: DataFrame) -> DataFrame:
    """q_idx, q_x, q_y, q_z of every place of distinct_places; q_idx is its lowest idx."""
    return prefixed(places.where("nth = 1").select("idx", *PLACE), "q_")


def others_of(places: DataFrame) -> DataFrame:
    return prefixed(places.drop("nth"), "n_")


def nearest(pairs: DataFrame, k: int, *more: str) -> DataFrame:
    """pairs: q_ columns of places and n_ columns of points. q_idx, x, y, z of every place that has pairs, the columns that
    `more` names, and found: its k + 1 pairs of least (distance, x, y, z, idx), in that order."""
    d = squared_distance(*[F.col(f"{p}{c}") for p in ("q_", "n_") for c in "xyz"])
    order = Window.partitionBy("q_idx").orderBy("d", "n_x", "n_y", "n_z", "n_idx")
    ranked = pairs.withColumn("d", d).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    found = F.array_sort(F.collect_list(F.struct("rn", "d", "n_idx", "n_intensity")))
    place = [F.first(f"q_{c}").alias(c) for c in PLACE]
    return ranked.groupBy("q_idx").agg(*place, *[F.first(c).alias(c) for c in more], found.alias("found"))


def listed(points: DataFrame, places: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """points with found: d, n_idx and n_intensity of each one's k nearest others. places: from distinct_places, read more
    than once; lists: from nearest."""
    lists = lists.select(*PLACE, "found")
    out = points.join(shuffled(lists), PLACE, "left")
    if not places.where(F.col("nth") > k).isEmpty():
        least = max(k, points.count() // HOT)
        crowded = points.groupBy(*PLACE).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*PLACE)
        crowded, lists = F.broadcast(staged(crowded, "crowded")), staged(lists, "place-lists")
        hot = points.join(crowded, PLACE, "left_semi").join(F.broadcast(lists.join(crowded, PLACE, "left_semi")), PLACE, "left")
        out = points.join(crowded, PLACE, "left_anti").join(shuffled(lists), PLACE, "left").unionByName(hot)
    found = F.slice(F.filter("found", lambda e: e["n_idx"] != F.col("idx")), 1, k)
    return out.select(*points.columns, F.coalesce(found, F.array().cast(lists.schema["found"].dataType)).alias("found"))


def neighbour_rows(points: DataFrame) -> DataFrame:
    """idx, rn, d, n_idx: a row per neighbour of points from listed."""
    each = points.select("idx", F.posexplode("found").alias("pos", "e"))
    return each.select("idx", (F.col("pos") + 1).alias("rn"), "e.d", "e.n_idx")


def neighbourhood_cdf(points: DataFrame) -> DataFrame:
    """points from listed with n (neighbours found), cdf and cdf_min of the neighbourhood with the point itself, without
    found."""
    every = F.concat(F.transform("found", lambda e: e["n_intensity"]), F.array("intensity"))
    own = points.withColumn("every", every)
    own = own.withColumn("least", F.array_min("every"))
    count = lambda test: F.size(F.filter("every", test)).cast("long")
    columns = [c for c in points.columns if c != "found"]
    return own.select(*columns, F.size("found").cast("long").alias("n"), count(lambda v: v <= F.col("intensity")).alias("cdf"), count(lambda v: v == F.col("least")).alias("cdf_min"))


def equalize(points: DataFrame, k: int, keep_lonely: bool) -> DataFrame:
    """points from listed with new_intensity. The nominal size is k + 1 even where fewer neighbours exist. keep_lonely: a
    point without neighbours keeps its intensity."""
    new = equalized(F.col("intensity"), F.col("cdf"), F.col("cdf_min"), F.lit(k + 1))
    if keep_lonely:
        new = F.when(F.col("n") == 0, F.col("intensity")).otherwise(new)
    return neighbourhood_cdf(points).withColumn("new_intensity", new.cast("int")).drop("n", "cdf", "cdf_min")
