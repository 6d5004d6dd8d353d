import random

import model
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import approx_knn, exact_knn, kmeans, metrics, tiles, voxel
from lumenfold.operators.neighbours import distinct_places, equalize, nearest, neighbour_rows, queries_of
from lumenfold.schema import cloud_schema

LATTICE = [(i % 5 - 2, (i // 5) % 5 - 2, (i // 25) % 4 - 2, (i * 53) % 256) for i in range(250)]
PLANE = [(i % 17 - 8, i // 17 - 5, 3, (i * 29) % 256) for i in range(180)]
CONSTANT = [(i, i * i % 31, -i, 77) for i in range(30)]
OUTLIER = [((i * 37) % 100 - 50, (i * 61) % 100 - 50, (i * 17) % 100 - 50, i) for i in range(100)] + [(1000000, 0, 0, 200)]
ONE_VOXEL = [(-10, -10, -10, 5), (10, 10, 10, 9)]
ONE = [(1, 2, 3, 44)]


def scattered(n, seed=3):
    r = random.Random(seed)
    return [(r.randint(-9999, 9999), r.randint(-9999, 9999), r.randint(-9999, 9999), r.randint(0, 255)) for _ in range(n)]


def cloud(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], cloud_schema("int"))


def values(df, column="new_intensity"):
    return [r[column] for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("points, k", [(LATTICE, 8), (PLANE, 8), (CONSTANT, 4), (LATTICE[:10], 16), (ONE, 3), (scattered(200), 500)])
def test_exact_small(spark, points, k):
    assert values(exact_knn.equalize_knn(cloud(spark, points), k)) == model.exact(points, k)


@pytest.mark.parametrize("points, k", [(LATTICE, 8), (PLANE, 5), (OUTLIER, 6), (ONE_VOXEL, 2), (scattered(300), 16)])
def test_exact_by_grid(spark, points, k):
    df = cloud(spark, points).select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    found = neighbour_rows(exact_knn.exact_neighbours(df, k, small=0))
    plain = neighbour_rows(exact_knn.exact_neighbours(df, k))
    key = ["idx", "rn", "d", "n_idx"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, plain.select(*key).collect()))


@pytest.mark.parametrize("points, k, home", [(LATTICE, 8, False), (LATTICE, 8, True), (PLANE, 8, False), (OUTLIER, 4, False), (ONE_VOXEL, 4, False), (ONE, 2, False), (scattered(150), 16, False)])
def test_approx(spark, points, k, home):
    assert values(approx_knn.equalize_approx_knn(cloud(spark, points), k, include_home_voxel=home)) == model.approx(points, k, home)


@pytest.mark.parametrize("points, k, rounds", [(LATTICE, 10, 4), (LATTICE, 120, 3), (PLANE, 10, 4), (LATTICE, 3, 0), (ONE, 1, 5)])
def test_kmeans(spark, points, k, rounds):
    out = kmeans.equalize_kmeans(cloud(spark, points), k, rounds)
    assert (values(out, "cluster"), values(out)) == model.kmeans(points, k, rounds)


def test_global_is_one_cluster(spark):
    assert values(kmeans.equalize_global(cloud(spark, LATTICE))) == model.kmeans(LATTICE, 1, 0)[1]


def test_float_clouds_agree_with_whole_ones(spark):
    ints = cloud(spark, LATTICE)
    floats = ints.select("idx", *[F.col(c).cast("float").alias(c) for c in "xyz"], "intensity")
    for run in (lambda c: exact_knn.equalize_knn(c, 8), lambda c: approx_knn.equalize_approx_knn(c, 8)):
        assert values(run(ints)) == values(run(floats))


def test_row_order_does_not_matter(spark):
    df = cloud(spark, LATTICE)
    assert values(approx_knn.equalize_approx_knn(df.orderBy(F.desc("idx")), 8)) == values(approx_knn.equalize_approx_knn(df, 8))


def test_empty_cloud(spark):
    empty = cloud(spark, [])
    assert values(exact_knn.equalize_knn(empty, 4)) == values(approx_knn.equalize_approx_knn(empty, 4)) == []


def test_coincident_points_stay_bounded(spark):
    points = [(7, 7, 7, i % 256) for i in range(3000)] + scattered(50)
    df = cloud(spark, points).select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    found = neighbour_rows(exact_knn.exact_neighbours(df, 4)).cache()
    assert found.count() == 4 * len(points)
    own = lambda i: [r["n_idx"] for r in found.where(f"idx = {i}").orderBy("rn").collect()]
    assert own(2999) == [0, 1, 2, 3] and own(2) == [0, 1, 3, 4]


@pytest.mark.parametrize("home", [False, True])
def test_points_at_one_place(spark, home):
    points = [(7, 7, 7, i % 256) for i in range(60)] + [(8, 7, 7, i) for i in range(5)] + scattered(40) + [(-3, 2, 1, 9)] * 3
    random.Random(1).shuffle(points)
    df = cloud(spark, points)
    assert values(exact_knn.equalize_knn(df, 6)) == model.exact(points, 6)
    assert values(approx_knn.equalize_approx_knn(df, 6, include_home_voxel=home)) == model.approx(points, 6, home)


def test_shuffled_joins_agree(spark, monkeypatch):
    monkeypatch.setattr(voxel, "ROW_BYTES", 1 << 30)
    assert not voxel.fits(100)
    df = cloud(spark, OUTLIER)
    points = df.select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    assert values(equalize(exact_knn.exact_neighbours(points, 6, small=0), 6, keep_lonely=False)) == model.exact(OUTLIER, 6)
    assert values(approx_knn.equalize_approx_knn(df, 4)) == model.approx(OUTLIER, 4)


def test_no_search_grows_with_the_points_of_a_place(spark):
    points = [(7, 7, 7, i % 256) for i in range(3000)] + scattered(50)
    df = cloud(spark, points).select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    places = distinct_places(df, 4).cache()
    assert queries_of(places).count() == 51
    assert exact_knn.all_pairs(places).count() == 51 * 55


def test_bad_input(spark):
    with pytest.raises(ValueError, match="k must"):
        exact_knn.equalize_knn(cloud(spark, ONE), 0)
    with pytest.raises(ValueError, match="needs as many points"):
        kmeans.equalize_kmeans(cloud(spark, ONE), 2, 1)
    with pytest.raises(ValueError, match="not a point"):
        exact_knn.equalize_knn(cloud(spark, [(0, 0, 0, 256)]), 1)
    with pytest.raises(ValueError, match="not a point"):
        exact_knn.equalize_knn(cloud(spark, [(0, None, 0, 1)]), 1)


def test_range_and_monotony(spark):
    out = kmeans.equalize_kmeans(cloud(spark, scattered(200)), 5, 3).collect()
    assert all(0 <= r["new_intensity"] <= 255 for r in out)
    for c in range(5):
        own = sorted((r["intensity"], r["new_intensity"]) for r in out if r["cluster"] == c)
        assert [b for _, b in own] == sorted(b for _, b in own)


def test_tables_too_large_by_count_are_never_broadcast(spark, monkeypatch):
    # with few bytes of rows as the limit, Spark's own threshold must not choose broadcasts by the bytes of the files
    monkeypatch.setattr(voxel, "ROW_BYTES", 1 << 30)
    points = cloud(spark, OUTLIER).select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        cells = voxel.cell_counts(voxel.Grid.of(points).assign(points)).cache()
        searched = [
            approx_knn.candidates(points, distinct_places(points, 4).cache(), 4),
            voxel.cell_pairs(cells.select(*voxel.CELL), cells, 2, 101, 101),
            exact_knn.exact_neighbours(points, 4, small=0),
            metrics.aligned(*[points.withColumn("new_intensity", F.col("intensity"))] * 2),
        ]
        for df in searched:
            df.collect()
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kind", ["long", "float"])
def test_many_centroids_are_compared_in_python_as_in_sql(spark, monkeypatch, kind):
    # ties between centroids, at one place too
    df = cloud(spark, LATTICE + scattered(100)).select("idx", *[F.col(c).cast(kind) for c in "xyz"], "intensity")
    seeds = [*kmeans.seeds(df, 60), *kmeans.seeds(df, 20)]
    many, sums = kmeans.assigned_to(df, seeds), kmeans.round_sums(df, seeds)
    assert "MapInArrow" in many._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(kmeans, "UNROLLED", 100)
    assert values(many, "cluster") == values(kmeans.assigned_to(df, seeds), "cluster")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, kmeans.centroid_sums(kmeans.assigned_to(df, seeds)).collect()))


def test_tiles_list_the_nearest_without_shuffled_pairs(spark):
    df = cloud(spark, scattered(600) + [(5, 5, 5, 1)] * 40).select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    places = distinct_places(df, 4).cache()
    found = tiles.exact_lists(places, {c: -9999.0 for c in "xyz"}, 10000.0, 4)
    plain = {r["q_idx"]: r["found"] for r in nearest(exact_knn.all_pairs(places), 4).collect()}
    rows = found.collect()
    assert len(rows) > 300 and all(plain[r["q_idx"]] == r["found"] for r in rows)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_approximate_search_moves_points_not_pairs(spark):
    df = cloud(spark, LATTICE).select("idx", *[F.col(c).cast("long") for c in "xyz"], "intensity")
    places = distinct_places(df, 8).cache()
    celled = voxel.Grid.of(df).assign(places).withColumn("stop", F.lit(2)).cache()
    found = tiles.approx_lists(celled, 8, 1)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    q, n = [r.asDict() for r in celled.where("nth = 1").collect()], [r.asDict() for r in celled.collect()]
    ring = lambda a, b: max(abs(a[f"g{c}"] - b[f"g{c}"]) for c in "xyz")
    order = lambda a, b: (sum((a[c] - b[c]) ** 2 for c in "xyz"), b["x"], b["y"], b["z"], b["idx"])
    want = {a["idx"]: [b["idx"] for b in sorted((b for b in n if 1 <= ring(a, b) <= 2), key=lambda b: order(a, b))[:9]] for a in q}
    assert {r["q_idx"]: [e["n_idx"] for e in r["found"]] for r in found.collect()} == {i: v for i, v in want.items() if v}


def test_results_that_meet_are_not_searched_again(spark):
    # the plan of a comparison holds no search of any method, else the driver's plans grow with every result it reads
    from lumenfold.plans.queries import QUERIES

    for name in ("mae_approx_vs_exact", "compare_metrics", "overlay_methods"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "FlatMapGroups", "Generate", "posexplode", "BroadcastHashJoin")), name
        assert plan.count("Exchange") <= 30, name
