import pytest
from pyspark.sql import functions as F

from lumenfold.operators import metrics
from lumenfold.plans import benchmark
from lumenfold.plans.queries import RECORDS
from lumenfold.schema import cloud_schema
from lumenfold.sources import generator, text

POINTS = [(0, -10, 0, 7, 200), (1, 4, 4, 4, 17), (2, 0, -3, 9, 255)]


def write(path, body):
    path.write_text(body)
    return str(path)


def test_tokens_and_lines_and_format(spark, tmp_path):
    path = write(tmp_path / "a.txt", "3\n2\n5\n-10 0 7 200\n4 4 4 17\n0 -3 9 255\n")
    cloud, job = text.read_cloud(spark, path)
    assert job == text.Job(3, 2, 5)
    assert sorted(map(tuple, cloud.collect())) == POINTS
    assert sorted(map(tuple, text.read_cloud_lines(spark, path).collect())) == POINTS
    spark.dataSource.register(text.PointCloudSource)
    assert sorted(map(tuple, spark.read.format("pointcloud").load(path).collect())) == POINTS
    mixed = write(tmp_path / "b.txt", "3 2\n5 -10 0 7 200 4 4\n4 17 0 -3 9 255")
    assert sorted(map(tuple, text.read_cloud(spark, mixed)[0].collect())) == POINTS


@pytest.mark.parametrize("body", ["3 2 5 1 2 3", "x 2 5", "", "1 2 5 0 0 0 256"])
def test_bad_files(spark, tmp_path, body):
    with pytest.raises(ValueError):
        text.read_cloud(spark, write(tmp_path / "c.txt", body))


def test_many_splits_keep_order(spark, tmp_path):
    n = 20000
    path = write(tmp_path / "d.txt", f"{n}\n1\n1\n" + "".join(f"{i} {-i} 0 {i % 256}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = text.read_cloud_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where("idx <> x or x <> -y").count() == 0 and rows.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_result_roundtrip_has_six_digits(spark, tmp_path):
    rows = [(0, -9999.1234, 1234.5678, 100.0, 5), (1, 0.00001234, 1.0, -2.5, 6)]
    result = spark.createDataFrame(rows, "idx long, x float, y float, z float, new_intensity int")
    assert [r[0] for r in text.result_lines(result).collect()] == ["-9999.12 1234.57 100 5", "1.234e-05 1 -2.5 6"]
    text.write_result(result, str(tmp_path / "out"))
    back = text.read_result(spark, str(tmp_path / "out"), "float").orderBy("idx").collect()
    assert [r["new_intensity"] for r in back] == [5, 6]


def test_paths():
    assert text.result_path("o", "knn") == "o/knn.txt"
    assert text.result_path("o", "kmeans", 10, 2, 5, "int") == "o/kmeans/n_10_k_2_t_5_int.txt"
    assert text.result_path("o", "knn", 10, 2, 5, "float") == "o/knn/n_10_k_2_float.txt"
    assert generator.dataset_path("i", 5, 1, 2, "int") == "i/int/dataset_n_5_k_1_T_2.txt"


@pytest.mark.parametrize("kind", ["int", "float"])
def test_generator(spark, kind):
    a = generator.generate_cloud(spark, 3000, kind)
    rows = a.collect()
    assert sorted(r["idx"] for r in rows) == list(range(3000))
    assert len({tuple(r)[1:] for r in rows}) == 3000
    assert all(-10000 <= v <= 10000 for r in rows for v in (r["x"], r["y"], r["z"])) and all(0 <= r["intensity"] <= 255 for r in rows)
    assert sorted(map(tuple, generator.generate_cloud(spark, 3000, kind).collect())) == sorted(map(tuple, rows))


def test_mae_and_alignment(spark):
    a = spark.createDataFrame([(0, 1, 1, 1, 10), (1, 2, 2, 2, 20)], "idx long, x int, y int, z int, new_intensity int")
    b = a.withColumn("new_intensity", F.col("new_intensity") + F.col("idx").cast("int") * 3)
    assert metrics.mean_absolute_error(a, a).first()["mae"] == 0
    assert metrics.mean_absolute_error(a, b).first()["mae"] == 1.5
    assert tuple(metrics.mean_absolute_error(a.limit(0), b).first()) == (0, 0.0)
    metrics.check_same_points(a, b)
    with pytest.raises(ValueError):
        metrics.check_same_points(a, b.withColumn("x", F.col("x") + 1))
    with pytest.raises(ValueError, match="unknown algorithm"):
        metrics.equalizer("other", 1)


def test_records(spark, tmp_path):
    records = spark.createDataFrame(RECORDS, benchmark.RECORD)
    benchmark.write_records(records, str(tmp_path / "r"))
    back = benchmark.read_records(spark, str(tmp_path / "r"))
    assert back.count() == len(RECORDS)
    typed = {(r["n"], r["algo"], r["precision"], r["k"], r["t"]): r for r in benchmark.typed_records(back).collect()}
    r = typed[(5000, "approx_knn", "float", 16, None)]
    assert r["gpu_ms"] == pytest.approx(0.0009) and r["cpu_ms"] is None
    sped = {(r["n"], r["algo"], r["k"]): r for r in benchmark.speedups(back).collect()}
    assert sped[("1000", "approx_knn", "16")]["algo_gpu_speedup"] == "20.0000"
    assert sped[("1000", "knn", "16")]["gpu_speedup"] == "10.0000" and sped[("1000", "knn", "16")]["algo_gpu_speedup"] == "-"
    assert sped[("5000", "approx_knn", "16")]["algo_gpu_speedup"] == "-" and sped[("5000", "approx_knn", "16")]["gpu_speedup"] == ""


def test_sweep(spark):
    out = benchmark.sweep(spark, ns=(60,), ks=(4,), ts=(2,), precisions=("int",)).collect()
    assert [r["algo"] for r in out] == ["knn", "approx_knn", "kmeans"] and all(r["n"] == "60" for r in out)


def test_schema():
    assert [f.name for f in cloud_schema().fields] == ["idx", "x", "y", "z", "intensity"]
