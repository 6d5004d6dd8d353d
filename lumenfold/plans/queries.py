"""The queries over the engine's operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import approx_knn, exact_knn, kmeans, metrics, neighbours, voxel
from ..schema import FLOAT_CLOUD_SQL, INT_CLOUD_SQL, float_cloud, int_cloud, typed
from ..sources import text
from ..sources.generator import generate_cloud
from . import benchmark
from .staging import new_path, shuffled, staged

#: Parameters of the headline queries.
K, CLUSTERS, ROUNDS, UNDERFULL = 16, 16, 5, 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _int(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(int_cloud(spark, sf_dir))


def _float(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(float_cloud(spark, sf_dir))


# SQL pieces: a cloud p, the nearest neighbours h of its points, equalized intensities
def _p(cloud: str) -> str:
    return f"p AS MATERIALIZED ({cloud})"


_D = "(q.x - n.x) * (q.x - n.x) + (q.y - n.y) * (q.y - n.y) + (q.z - n.z) * (q.z - n.z)"
_EXACT_PAIRS = "FROM p q JOIN p n ON q.idx <> n.idx"


def _ranked(pairs: str, k: int) -> str:
    return f"""r AS MATERIALIZED (SELECT * FROM (SELECT q.idx AS idx, q.intensity AS qi, n.intensity AS ni, n.idx AS n_idx, {_D} AS d,
  row_number() OVER (PARTITION BY q.idx ORDER BY {_D}, n.x, n.y, n.z, n.idx) AS rn {pairs}) WHERE rn <= {k})"""


_CDF = """h AS (SELECT idx, qi, ni FROM r UNION ALL SELECT idx, intensity, intensity FROM p),
mi AS (SELECT idx, min(ni) AS mi FROM h GROUP BY idx),
cdf AS (SELECT h.idx, any_value(qi) AS intensity, count(*) - 1 AS n, count(*) FILTER (ni <= qi) AS cdf, count(*) FILTER (ni = mi) AS cdf_min FROM h JOIN mi USING (idx) GROUP BY h.idx)"""


def _equalized(cloud: str, pairs: str, k: int, more: str = "", lonely: bool = False) -> str:
    new = f"CASE WHEN {k + 1} = cdf_min THEN intensity ELSE (cdf - cdf_min) * 255 // ({k + 1} - cdf_min) END"
    new = f"CASE WHEN n = 0 THEN intensity ELSE {new} END" if lonely else new
    return f"""WITH {_p(cloud)},{more} {_ranked(pairs, k)}, {_CDF}
SELECT p.idx, p.x, p.y, p.z, p.intensity, e.new_intensity FROM p JOIN (SELECT idx, CAST({new} AS INTEGER) AS new_intensity FROM cdf) e USING (idx)"""


# --- scans and the voxel grid
_add("scan_pc_int", _int(lambda c: c), INT_CLOUD_SQL)
_add("scan_pc_float", _float(lambda c: c), FLOAT_CLOUD_SQL)
_BOX = ", ".join(f"CAST({f}({c}) AS DOUBLE) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))
_add("pc_bbox", _int(voxel.bounding_box), f"WITH {_p(INT_CLOUD_SQL)} SELECT count(*) AS n, {_BOX} FROM p")
_VS = f"""b AS (SELECT count(*) AS n, {_BOX} FROM p), vol AS (SELECT n, (max_x - min_x) * (max_y - min_y) * (max_z - min_z) AS volume FROM b),
vs AS MATERIALIZED (SELECT n, volume, voxel_size, CAST(greatest(trunc(voxel_size), 1) AS BIGINT) AS truncated_size FROM (
  SELECT n, volume, CASE WHEN volume <= 0 THEN 1.0::DOUBLE ELSE cbrt(16.0::DOUBLE / (27.0::DOUBLE * (n / volume))) END AS voxel_size FROM vol))"""
_add("voxel_size", _int(lambda c: voxel.voxel_size(c).withColumn("voxel_size", F.round("voxel_size", 6))), f"WITH {_p(INT_CLOUD_SQL)}, {_VS} SELECT n, volume, round(voxel_size, 6) AS voxel_size, truncated_size FROM vs")


def _grid_sql(whole: bool = True, size: str = "truncated_size") -> str:
    if whole:
        cells = ", ".join(f"{c} // (SELECT {size} FROM vs) AS g{c}" for c in "xyz")
    else:
        cells = ", ".join(f"CAST(trunc(CAST({c} AS FLOAT) / CAST((SELECT {size} FROM vs) AS FLOAT)) AS BIGINT) AS g{c}" for c in "xyz")
    return f"{_VS}, g AS MATERIALIZED (SELECT *, {cells} FROM p)"


_INT_GRID = f"WITH {_p(INT_CLOUD_SQL)}, {_grid_sql()}"
_assigned = lambda c: voxel.Grid.of(typed(c)).assign(typed(c))
_add("voxel_assign", _int(lambda c: _assigned(c).select("idx", "gx", "gy", "gz")), f"{_INT_GRID} SELECT idx, gx, gy, gz FROM g")
_add("voxel_assign_float", _float(lambda c: _assigned(c).select("idx", "gx", "gy", "gz")), f"WITH {_p(FLOAT_CLOUD_SQL)}, {_grid_sql(False)} SELECT idx, gx, gy, gz FROM g")
_add("voxel_counts", _int(lambda c: voxel.cell_counts(_assigned(c))), f"{_INT_GRID} SELECT gx, gy, gz, count(*) AS n FROM g GROUP BY gx, gy, gz")


def _hashes(c: DataFrame) -> DataFrame:
    g = [F.col(x) for x in voxel.CELL]
    low = scalars.cell_hash_32(*g)
    return _assigned(c).select("idx", scalars.cell_hash(*g).alias("cell_hash"), low.alias("cell_hash_32"), (low % scalars.HASH_BUCKETS).alias("bucket"))


_HASH = f"xor(xor(gx * {scalars.HASH_X}, gy * {scalars.HASH_Y}), gz * {scalars.HASH_Z})"
_add("voxel_hash", _int(_hashes), f"{_INT_GRID} SELECT idx, {_HASH} AS cell_hash, {_HASH} & 4294967295 AS cell_hash_32, ({_HASH} & 4294967295) % {scalars.HASH_BUCKETS} AS bucket FROM g")

# --- exact KNN
_pairs_of = lambda df: neighbours.neighbour_rows(df).withColumn("rn", F.col("rn").cast("long"))
_add("exact_knn_neighbors", _int(lambda c: _pairs_of(exact_knn.exact_neighbours(typed(c), K))), f"WITH {_p(INT_CLOUD_SQL)}, {_ranked(_EXACT_PAIRS, K)} SELECT idx, rn, n_idx, d FROM r")
_add("exact_knn_neighbors_by_grid", _int(lambda c: _pairs_of(exact_knn.exact_neighbours(typed(c), K, small=0))), ORACLES["exact_knn_neighbors"])
_add(
    "exact_knn_cdf",
    _int(lambda c: neighbours.neighbourhood_cdf(exact_knn.exact_neighbours(typed(c), K)).select("idx", "n", "cdf", "cdf_min")),
    f"WITH {_p(INT_CLOUD_SQL)}, {_ranked(_EXACT_PAIRS, K)}, {_CDF} SELECT idx, n, cdf, cdf_min FROM cdf",
)
_add("exact_knn_equalize_int", _int(lambda c: exact_knn.equalize_knn(c, K)), _equalized(INT_CLOUD_SQL, _EXACT_PAIRS, K))
_add("exact_knn_equalize_float", _float(lambda c: exact_knn.equalize_knn(c, K)), _equalized(FLOAT_CLOUD_SQL, _EXACT_PAIRS, K))
_add("exact_knn_underfull", _int(lambda c: exact_knn.equalize_knn(c.where(F.col("idx") < UNDERFULL), K)), _equalized(f"SELECT * FROM ({INT_CLOUD_SQL}) WHERE idx < {UNDERFULL}", _EXACT_PAIRS, K))


# --- approximate KNN
def _stops_sql(k: int, home: bool = False) -> str:
    cheb = "greatest(abs(a.gx - b.gx), abs(a.gy - b.gy), abs(a.gz - b.gz))"
    return f"""cells AS MATERIALIZED (SELECT gx, gy, gz, count(*) AS n FROM g GROUP BY gx, gy, gz),
rings AS (SELECT a.gx, a.gy, a.gz, {cheb} AS ring, sum(b.n) AS n FROM cells a JOIN cells b ON {cheb} BETWEEN {0 if home else 1} AND 50 GROUP BY ALL),
runs AS (SELECT gx, gy, gz, ring, sum(n) OVER (PARTITION BY gx, gy, gz ORDER BY ring) AS run FROM rings),
first AS (SELECT gx, gy, gz, min(ring) AS ring FROM runs WHERE run >= {k} GROUP BY ALL),
stops AS MATERIALIZED (SELECT c.gx, c.gy, c.gz, CAST(coalesce(least(greatest(ring, 1) * 2, 50), 50) AS INTEGER) AS stop FROM cells c LEFT JOIN first USING (gx, gy, gz))"""


def _approx_pairs(home: bool = False) -> str:
    cheb = "greatest(abs(q.gx - n.gx), abs(q.gy - n.gy), abs(q.gz - n.gz))"
    return f"FROM (SELECT g.*, stop FROM g JOIN stops USING (gx, gy, gz)) q JOIN g n ON q.idx <> n.idx AND {cheb} BETWEEN {0 if home else 1} AND q.stop"


def _approx_sql(cloud: str, k: int, grid: str, home: bool = False) -> str:
    return _equalized(cloud, _approx_pairs(home), k, f" {grid}, {_stops_sql(k, home)},", lonely=True)


_add("approx_stop_radius", _int(lambda c: approx_knn.stop_radii(staged(voxel.cell_counts(_assigned(c)), "cells"), K)), f"{_INT_GRID}, {_stops_sql(K)} SELECT gx, gy, gz, stop FROM stops")
def _candidate_counts(c: DataFrame) -> DataFrame:
    """Of every point with candidates: how many. Of more than K + 1 points at one place only K + 1 are candidates."""
    points = typed(c)
    pairs = approx_knn.candidates(points, staged(neighbours.distinct_places(points, K), "places"), K)
    per_place = pairs.groupBy("q_idx", *[F.col(f"q_{x}").alias(x) for x in neighbours.PLACE]).agg(F.count("*").alias("n"))
    return points.join(shuffled(per_place), neighbours.PLACE).select("idx", "n")


_add(
    "approx_candidates",
    _int(_candidate_counts),
    f"{_INT_GRID}, {_stops_sql(K)} SELECT q.idx, count(*) AS n {_approx_pairs()} GROUP BY q.idx",
)
_add("approx_knn_equalize_int", _int(lambda c: approx_knn.equalize_approx_knn(c, K)), _approx_sql(INT_CLOUD_SQL, K, _grid_sql()))
_add("approx_knn_equalize_float", _float(lambda c: approx_knn.equalize_approx_knn(c, K)), _approx_sql(FLOAT_CLOUD_SQL, K, _grid_sql(False)))
_add("approx_knn_float_voxel", _int(lambda c: approx_knn.equalize_approx_knn(c, K, voxel_mode="float")), _approx_sql(INT_CLOUD_SQL, K, _grid_sql(False, "voxel_size")))
_add("approx_knn_with_home_voxel", _int(lambda c: approx_knn.equalize_approx_knn(c, K, include_home_voxel=True)), _approx_sql(INT_CLOUD_SQL, K, _grid_sql(), home=True))


# --- k-means
def _kmeans_sql(whole: bool, k: int, rounds: int) -> str:
    """CTEs a1..a<rounds> (idx, j) and c0..c<rounds> (j, cx, cy, cz)."""
    parts = [f"c0 AS MATERIALIZED (SELECT CAST(idx AS INTEGER) AS j, x AS cx, y AS cy, z AS cz FROM p WHERE idx < {k})"]
    d = "(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)"
    for t in range(1, rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT idx, j FROM (SELECT idx, j, row_number() OVER (PARTITION BY idx ORDER BY {d}, cx, cy, cz, j) AS rn FROM p CROSS JOIN c{t - 1}) WHERE rn = 1)")
        mean = (lambda c: f"CAST(sum({c}) AS BIGINT) // count(*)") if whole else (lambda c: f"CAST(sum(CAST({c} AS DOUBLE)) / count(*) AS FLOAT)")
        parts.append(
            f"c{t} AS MATERIALIZED (SELECT c.j, coalesce(m.mx, c.cx) AS cx, coalesce(m.my, c.cy) AS cy, coalesce(m.mz, c.cz) AS cz FROM c{t - 1} c LEFT JOIN "
            f"(SELECT j, {mean('x')} AS mx, {mean('y')} AS my, {mean('z')} AS mz FROM p JOIN a{t} USING (idx) GROUP BY j) m USING (j))"
        )
    return ", ".join(parts)


_CLUSTER_CDF = """k AS MATERIALIZED (SELECT p.*, a.j AS cluster FROM p JOIN {a} a USING (idx)),
hist AS (SELECT cluster, intensity, count(*) AS n FROM k GROUP BY ALL),
cdf AS (SELECT cluster, intensity, CAST(sum(n) OVER up AS BIGINT) AS cdf, first_value(n) OVER up AS cdf_min, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS m
  FROM hist WINDOW up AS (PARTITION BY cluster ORDER BY intensity ROWS UNBOUNDED PRECEDING))"""
_NEW = "CAST(CASE WHEN m = cdf_min THEN intensity ELSE (cdf - cdf_min) * 255 // (m - cdf_min) END AS INTEGER) AS new_intensity"
_INT_KMEANS = f"WITH {_p(INT_CLOUD_SQL)}, {_kmeans_sql(True, CLUSTERS, ROUNDS)}, {_CLUSTER_CDF.format(a=f'a{ROUNDS}')}"
_FLOAT_KMEANS = f"WITH {_p(FLOAT_CLOUD_SQL)}, {_kmeans_sql(False, CLUSTERS, ROUNDS)}, {_CLUSTER_CDF.format(a=f'a{ROUNDS}')}"
_clusters = lambda c: kmeans.clustered(typed(c), CLUSTERS, ROUNDS)


def _centroids(c: DataFrame) -> DataFrame:
    found = kmeans.centroids_after(typed(c), CLUSTERS, ROUNDS)
    return c.sparkSession.createDataFrame([(j, *xyz) for j, xyz in enumerate(found)], "j int, cx long, cy long, cz long")


_add("kmeans_seeds", _int(lambda c: c.where(F.col("idx") < CLUSTERS).select(F.col("idx").cast("int").alias("j"), "x", "y", "z")), f"WITH {_p(INT_CLOUD_SQL)} SELECT CAST(idx AS INTEGER) AS j, x, y, z FROM p WHERE idx < {CLUSTERS}")
_add("kmeans_assign", _int(lambda c: kmeans.clustered(typed(c), CLUSTERS, 1).select("idx", "cluster")), f"WITH {_p(INT_CLOUD_SQL)}, {_kmeans_sql(True, CLUSTERS, 1)} SELECT idx, j AS cluster FROM a1")
_add("kmeans_centroids", _int(_centroids), f"WITH {_p(INT_CLOUD_SQL)}, {_kmeans_sql(True, CLUSTERS, ROUNDS)} SELECT j, cx, cy, cz FROM c{ROUNDS}")
_add("kmeans_histogram", _int(lambda c: kmeans.histogram(_clusters(c))), f"{_INT_KMEANS} SELECT cluster, intensity, n FROM hist")
_add("kmeans_cdf", _int(lambda c: kmeans.cluster_cdf(kmeans.histogram(_clusters(c)))), f"{_INT_KMEANS} SELECT cluster, intensity, cdf, cdf_min, m FROM cdf")
_EQ = "SELECT idx, x, y, z, k.intensity, cluster, new_intensity FROM k JOIN (SELECT cluster, intensity, " + _NEW + " FROM cdf) USING (cluster, intensity)"
_add("kmeans_equalize_int", _int(lambda c: kmeans.equalize_kmeans(c, CLUSTERS, ROUNDS)), f"{_INT_KMEANS} {_EQ}")
_add("kmeans_equalize_float", _float(lambda c: kmeans.equalize_kmeans(c, CLUSTERS, ROUNDS)), f"{_FLOAT_KMEANS} {_EQ}")
# the settings of the sweep's largest number of rounds
_add(
    "kmeans_equalize_k64_t50",
    _int(lambda c: kmeans.equalize_kmeans(c, 64, 50)),
    f"WITH {_p(INT_CLOUD_SQL)}, {_kmeans_sql(True, 64, 50)}, {_CLUSTER_CDF.format(a='a50')} {_EQ}",
)
_add(
    "global_equalize",
    _int(kmeans.equalize_global),
    f"WITH {_p(INT_CLOUD_SQL)}, one AS (SELECT idx, 0 AS j FROM p), {_CLUSTER_CDF.format(a='one')} SELECT idx, x, y, z, k.intensity, new_intensity FROM k JOIN (SELECT cluster, intensity, {_NEW} FROM cdf) USING (cluster, intensity)",
)

# --- metrics
_EXACT_INT, _APPROX_INT, _KMEANS_INT = ORACLES["exact_knn_equalize_int"], ORACLES["approx_knn_equalize_int"], ORACLES["kmeans_equalize_int"]
_mae_sql = lambda a, b: f"SELECT count(*) AS n, avg(CAST(abs(a.new_intensity - b.new_intensity) AS DOUBLE)) AS mae FROM ({a}) a JOIN ({b}) b USING (idx)"
_mae = lambda a, b: metrics.mean_absolute_error(metrics.settled(a), metrics.settled(b))
_add("mae_approx_vs_exact", _int(lambda c: _mae(approx_knn.equalize_approx_knn(c, K), exact_knn.equalize_knn(c, K))), _mae_sql(_APPROX_INT, _EXACT_INT))
_add("mae_kmeans_vs_exact", _int(lambda c: _mae(kmeans.equalize_kmeans(c, CLUSTERS, ROUNDS), exact_knn.equalize_knn(c, K))), _mae_sql(_KMEANS_INT, _EXACT_INT))
_compared = [
    (precision, algo, sql, exact)
    for precision, exact, approx, means in (
        ("int", _EXACT_INT, _APPROX_INT, _KMEANS_INT),
        ("float", ORACLES["exact_knn_equalize_float"], ORACLES["approx_knn_equalize_float"], ORACLES["kmeans_equalize_float"]),
    )
    for algo, sql in (("knn", exact), ("approx_knn", approx), ("kmeans", means))
]
_add(
    "compare_metrics",
    lambda spark, sf_dir: metrics.compare({"int": int_cloud(spark, sf_dir), "float": float_cloud(spark, sf_dir)}, K, ROUNDS, timed=False).drop("elapsed_ms"),
    " UNION ALL ".join(f"SELECT '{p}' AS precision, '{a}' AS algo, n, mae FROM ({_mae_sql(s, e)})" for p, a, s, e in _compared),
)
_over = lambda sql, m: f"SELECT idx, x, y, z, new_intensity AS value, '{m}' AS method FROM ({sql})"
_add(
    "overlay_methods",
    _int(lambda c: metrics.overlay(typed(c), {"knn": exact_knn.equalize_knn(c, K), "approx_knn": approx_knn.equalize_approx_knn(c, K), "kmeans": kmeans.equalize_kmeans(c, CLUSTERS, ROUNDS)})),
    f"SELECT idx, x, y, z, intensity AS value, 'original' AS method FROM ({INT_CLOUD_SQL}) UNION ALL {_over(_EXACT_INT, 'knn')} UNION ALL {_over(_APPROX_INT, 'approx_knn')} UNION ALL {_over(_KMEANS_INT, 'kmeans')}",
)

# --- durations and benchmark records (made-up values, not measurements)
_MS = [0.0000005, 0.000999, 0.25, 12.345, 999.9995, 1500.0, 123456.789]
_add(
    "format_duration",
    lambda spark, sf_dir: spark.createDataFrame([(i, v) for i, v in enumerate(_MS)], "i int, ms double").select("i", scalars.format_duration(F.col("ms")).alias("text")),
    "SELECT CAST(i AS INTEGER) AS i, CASE WHEN ms * 1e6 < 1e3 THEN printf('%.3f ns', ms * 1e6) WHEN ms * 1e6 < 1e6 THEN printf('%.3f µs', ms * 1e6 / 1e3) WHEN ms * 1e6 < 1e9 THEN printf('%.3f ms', ms) ELSE printf('%.3f s', ms / 1e3) END AS text "
    f"FROM (VALUES {', '.join(f'({i}, CAST({v!r} AS DOUBLE))' for i, v in enumerate(_MS))}) v(i, ms)",
)
_TEXTS = ["12.345 ms", "500.000 µs", "2.5 us", "900.000 ns", "2.000 s", "", "n/a", "7 h", "1.5", "-", "3e2"]
_add(
    "parse_duration",
    lambda spark, sf_dir: spark.createDataFrame([(i, v) for i, v in enumerate(_TEXTS)], "i int, text string").select("i", F.round(scalars.duration_ms(F.col("text")), 9).alias("ms")),
    "SELECT CAST(i AS INTEGER) AS i, round(TRY_CAST(nullif(regexp_extract(text, '^([-+0-9.eE]+) *(ns|µs|us|ms|s)?$', 1), '') AS DOUBLE) * CASE regexp_extract(text, '^([-+0-9.eE]+) *(ns|µs|us|ms|s)?$', 2) WHEN 'ns' THEN 1e-6 WHEN 'µs' THEN 1e-3 WHEN 'us' THEN 1e-3 WHEN 'ms' THEN 1.0 ELSE 1000.0 END, 9) AS ms "
    f"FROM (VALUES {', '.join(f'''({i}, '{v}')''' for i, v in enumerate(_TEXTS))}) v(i, text)",
)
RECORDS = [
    ("1000", "16", "-", "knn", "float", "10.000 ms", "100.000 ms", "0.0"),
    ("1000", "16", "-", "approx_knn", "float", "500.000 µs", "", "1.500000"),
    ("1000", "16", "50", "kmeans", "float", "2.000 s", "4.000 s", "20.000000"),
    ("1000", "32", "50", "kmeans", "float", "2.500 s", "5.000 s", "21.000000"),
    ("5000", "16", "-", "approx_knn", "float", "900.000 ns", "", "1.200000"),
    ("100000", "16", "-", "knn", "float", "3.000 s", "", "0.0"),
    ("100000", "16", "-", "knn", "float", "4.000 s", "", "0.0"),
    ("100000", "16", "-", "approx_knn", "float", "80.000 ms", "", "1.100000"),
    ("100000", "16", "-", "approx_knn", "int", "64.000 ms", "", "1.000000"),
    ("100000", "32", "50", "kmeans", "float", "750.000 ms", "6.000 s", "22.000000"),
    ("100000", "32", "25", "kmeans", "float", "400.000 ms", "", "23.000000"),
]
_records = lambda spark: spark.createDataFrame([(i, *r) for i, r in enumerate(RECORDS)], f"i int, {benchmark.RECORD}")
_typed_records = lambda spark: benchmark.typed_records(_records(spark))
_RECORDS_SQL = f"(SELECT * FROM (VALUES {', '.join(str((i, *r)) for i, r in enumerate(RECORDS))}) v(i, n, k, t, algo, precision, gpu_time, cpu_time, mae))"
_ms_sql = lambda c: f"CAST(nullif(split_part({c}, ' ', 1), '') AS DOUBLE) * CASE split_part({c}, ' ', 2) WHEN 'ns' THEN 1e-6 WHEN 'µs' THEN 1e-3 WHEN 'ms' THEN 1.0 ELSE 1000.0 END"
_TYPED_SQL = f"(SELECT CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, CAST(nullif(t, '-') AS INTEGER) AS t, algo, precision, {_ms_sql('gpu_time')} AS gpu_ms, {_ms_sql('cpu_time')} AS cpu_ms FROM {_RECORDS_SQL})"
_rounded = lambda df, c: df.withColumn(c, F.round(c, 6))
_add(
    "speedup_join",
    lambda spark, sf_dir: benchmark.speedups(_records(spark), "i").select("i", "algo", "gpu_speedup", "algo_gpu_speedup"),
    f"""WITH r AS (SELECT *, {_ms_sql('gpu_time')} AS g, {_ms_sql('cpu_time')} AS c FROM {_RECORDS_SQL}),
b AS (SELECT n, k, precision, max_by(g, i) AS base FROM r WHERE algo = 'knn' GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS i, algo, CASE WHEN c IS NOT NULL AND g > 0 THEN printf('%.4f', c / g) ELSE '' END AS gpu_speedup,
       CASE WHEN algo <> 'knn' AND base IS NOT NULL AND g > 0 THEN printf('%.4f', base / g) ELSE '-' END AS algo_gpu_speedup
FROM r LEFT JOIN b USING (n, k, precision)""",
)
_add("bench_filter_1", lambda spark, sf_dir: _rounded(benchmark.scaling_n(_typed_records(spark)), "gpu_ms"), f"SELECT n, algo, round(avg(gpu_ms), 6) AS gpu_ms FROM {_TYPED_SQL} WHERE k = 16 AND precision = 'float' AND algo IN ('knn', 'approx_knn') GROUP BY ALL")
_add("bench_filter_2", lambda spark, sf_dir: _rounded(benchmark.device_speedup(_typed_records(spark)), "speedup"), f"SELECT n, round(avg(cpu_ms / gpu_ms), 6) AS speedup FROM {_TYPED_SQL} WHERE algo = 'kmeans' AND precision = 'float' AND k = 32 AND t = 50 AND cpu_ms / gpu_ms IS NOT NULL GROUP BY n")
_add("bench_filter_3", lambda spark, sf_dir: _rounded(benchmark.scaling_k(_typed_records(spark)), "gpu_ms"), f"SELECT k, algo, round(avg(gpu_ms), 6) AS gpu_ms FROM {_TYPED_SQL} WHERE n = 100000 AND precision = 'float' AND (algo <> 'kmeans' OR t = 50) GROUP BY ALL")
_add("bench_filter_4", lambda spark, sf_dir: _rounded(benchmark.precision_impact(_typed_records(spark)), "gpu_ms"), f"SELECT k, precision, round(avg(gpu_ms), 6) AS gpu_ms FROM {_TYPED_SQL} WHERE n = 100000 AND k IN (4, 16, 32, 64) AND algo = 'approx_knn' GROUP BY ALL")
_add(
    "bench_pivot",
    lambda spark, sf_dir: benchmark.exact_over_approx(_typed_records(spark)).select("n", *[F.round(c, 6).alias(c) for c in ("knn", "approx_knn", "algorithmic_speedup")]),
    f"SELECT n, round(knn, 6) AS knn, round(approx_knn, 6) AS approx_knn, round(knn / approx_knn, 6) AS algorithmic_speedup FROM (SELECT n, avg(gpu_ms) FILTER (algo = 'knn') AS knn, avg(gpu_ms) FILTER (algo = 'approx_knn') AS approx_knn FROM {_TYPED_SQL} WHERE k = 16 AND precision = 'float' AND algo IN ('knn', 'approx_knn') GROUP BY n)",
)

# --- generator and text files: rows only
_add("generate_cloud", lambda spark, sf_dir: generate_cloud(spark, 2000))
_add("generate_cloud_float", lambda spark, sf_dir: generate_cloud(spark, 2000, "float"))


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "text")
    text.write_cloud(int_cloud(spark, sf_dir), path, K, ROUNDS)
    return text.read_cloud_lines(spark, path)


def _token_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "text")
    text.write_cloud(float_cloud(spark, sf_dir), path, K, ROUNDS)
    return text.read_cloud(spark, path, "float")[0]


def _result_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result in several files, read back with its line numbers."""
    path = new_path(spark, "result")
    text.write_result(int_cloud(spark, sf_dir).withColumn("new_intensity", F.col("intensity")), path, single=False)
    return text.read_result(spark, path)


_add("token_roundtrip_float", _token_roundtrip, f"SELECT idx, {', '.join(f'CAST(printf({chr(39)}%.4f{chr(39)}, {c}) AS FLOAT) AS {c}' for c in 'xyz')}, intensity FROM ({FLOAT_CLOUD_SQL})")
_add(
    "result_roundtrip",
    _result_roundtrip,
    f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, intensity AS new_intensity FROM ({INT_CLOUD_SQL})",
)
_add("text_roundtrip", _roundtrip, f"SELECT idx, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, intensity FROM ({INT_CLOUD_SQL})")
