import glob

import pytest

from lumenfold import cli
from lumenfold.plans import benchmark
from lumenfold.sources import generator, text


def test_generate_run_compare(spark, tmp_path, capsys):
    out = str(tmp_path / "in")
    cli.main(["generate", "--n", "50", "--k", "3", "--rounds", "2", "--output", out])
    ints, floats = (generator.dataset_path(out, 50, 3, 2, kind) for kind in ("int", "float"))
    for algo in ("knn", "approx_knn", "kmeans"):
        cli.main(["run", ints, algo, "--output", str(tmp_path / "out")])
        (part,) = glob.glob(f"{capsys.readouterr().out.strip().splitlines()[-1]}/part-*")
        lines = open(part).read().splitlines()
        assert len(lines) == 50 and all(len(x.split()) == 4 for x in lines)
    with pytest.raises(ValueError, match="unknown algorithm"):
        cli.main(["run", ints, "other", "--plain", "--output", str(tmp_path / "out")])
    cli.main(["compare", ints, floats])
    shown = capsys.readouterr().out
    assert shown.count("kmeans") == 2 and "mae" in shown


def test_speedup_command(spark, tmp_path):
    records = spark.createDataFrame([("10", "4", "-", "knn", "int", "2.000 ms", "", "0.0"), ("10", "4", "-", "approx_knn", "int", "1.000 ms", "", "1.0")], benchmark.RECORD)
    benchmark.write_records(records, str(tmp_path / "a"))
    cli.main(["speedup", str(tmp_path / "a"), str(tmp_path / "b")])
    rows = spark.read.csv(str(tmp_path / "b"), header=True).collect()
    assert {r["algo"]: r["algo_gpu_speedup"] for r in rows} == {"knn": "-", "approx_knn": "2.0000"}


def test_mae_command(spark, tmp_path, capsys):
    cloud = spark.createDataFrame([(i, i, i % 7, -i, i % 50) for i in range(3000)], "idx long, x int, y int, z int, new_intensity int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_result(cloud, str(tmp_path / "one"), single=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text.write_result(cloud.withColumn("new_intensity", cloud["new_intensity"] + 2), str(tmp_path / "two"))
    assert len(glob.glob(str(tmp_path / "one/part-*"))) > 1
    cli.main(["mae", str(tmp_path / "one"), str(tmp_path / "two")])
    assert capsys.readouterr().out.strip().splitlines()[-1] == "2.000000"
    text.write_result(cloud.withColumn("x", cloud["x"] + 1), str(tmp_path / "three"))
    with pytest.raises(ValueError, match="differ"):
        cli.main(["mae", str(tmp_path / "one"), str(tmp_path / "three")])


def test_sweep_appends_as_it_goes(spark, tmp_path, capsys):
    cli.main(["sweep", "--n", "40", "--k", "3", "4", "--rounds", "2", "--output", str(tmp_path / "s")])
    rows = benchmark.read_records(spark, str(tmp_path / "s")).collect()
    assert len(rows) == 12 and {r["k"] for r in rows} == {"3", "4"} and len(glob.glob(str(tmp_path / "s/part-*"))) == 2
    cli.main(["charts", str(tmp_path / "s")])
    assert "exact_over_approx" in capsys.readouterr().out
