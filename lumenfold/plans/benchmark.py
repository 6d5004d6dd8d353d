"""Benchmark records: the sweep that makes them, their CSV form, speed-ups, and the tables behind the five charts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_ms, format_duration, ratio_text
from ..operators.metrics import APPROX, KMEANS, KNN, equalizer, mean_absolute_error
from ..sources.generator import generate_cloud

#: The grid of the sweep.
SWEEP_N = (1000, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 750000, 1000000, 2000000, 3000000)
SWEEP_K = (4, 16, 24, 32, 48, 64, 96, 128)
SWEEP_T = (5, 10, 25, 50)
RECORD = "n string, k string, t string, algo string, precision string, gpu_time string, cpu_time string, mae string"


def sweep(spark: SparkSession, ns=SWEEP_N, ks=SWEEP_K, ts=SWEEP_T, precisions=("int", "float"), seed: int = 42, path: str | None = None) -> DataFrame:
    """A record per cloud, method and parameters, in the CSV's text form. gpu_time holds this engine's time. path: where
    the records of each cloud and k are appended as soon as they are measured, so that a sweep that ends early leaves them."""
    rows = []
    for n in ns:
        clouds = {p: generate_cloud(spark, n, p, seed).persist() for p in precisions}
        for k in ks:
            base: dict[str, DataFrame] = {}
            for algo, rounds in [(KNN, None), (APPROX, None), *[(KMEANS, t) for t in ts]]:
                for p, cloud in clouds.items():
                    start = time.perf_counter()
                    result = equalizer(algo, k, rounds or 0)(cloud).persist()
                    result.write.format("noop").mode("overwrite").save()
                    ms = (time.perf_counter() - start) * 1000
                    if algo == KNN:
                        base[p] = result
                    mae = 0.0 if algo == KNN else mean_absolute_error(result, base[p]).first()["mae"]
                    rows.append((n, k, rounds, algo, p, ms, mae))
                    if algo != KNN:
                        result.unpersist()
            for result in base.values():
                result.unpersist()
            if path:
                write_records(_records(spark, rows[-len(precisions) * (2 + len(ts)) :]), path)
        for cloud in clouds.values():
            cloud.unpersist()
    return _records(spark, rows)


def _records(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame(rows, "n long, k int, t int, algo string, precision string, ms double, mae double")
    return df.select(
        F.col("n").cast("string").alias("n"), F.col("k").cast("string").alias("k"), F.coalesce(F.col("t").cast("string"), F.lit("-")).alias("t"), "algo", "precision",
        format_duration(F.col("ms")).alias("gpu_time"), F.lit("").alias("cpu_time"), F.when(F.col("algo") == KNN, "0.0").otherwise(F.format_string("%.6f", "mae")).alias("mae"),
    )


def write_records(records: DataFrame, path: str) -> None:
    records.coalesce(1).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RECORD)


def typed_records(records: DataFrame) -> DataFrame:
    """n, k, t, algo, precision, gpu_ms, cpu_ms, mae with their types; "-" and unreadable times are null."""
    return records.select(
        F.col("n").try_cast("long").alias("n"), F.col("k").try_cast("int").alias("k"), F.nullif(F.col("t"), F.lit("-")).try_cast("int").alias("t"), "algo", "precision",
        duration_ms(F.col("gpu_time")).alias("gpu_ms"), duration_ms(F.col("cpu_time")).alias("cpu_ms"), F.col("mae").try_cast("double").alias("mae"),
    )


def speedups(records: DataFrame, order: str | None = None) -> DataFrame:
    """records with gpu_speedup (cpu time over gpu time) and algo_gpu_speedup (exact KNN's time over this one's for the
    same n, k and precision; "-" for exact KNN itself or without one). Of several exact runs the last by `order` counts."""
    rows = records.withColumns({"gpu_ms": duration_ms(F.col("gpu_time")), "cpu_ms": duration_ms(F.col("cpu_time"))})
    key = ["n", "k", "precision"]
    place = F.col(order) if order else F.monotonically_increasing_id()
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("place").desc()))
    base = rows.where(F.col("algo") == KNN).withColumn("place", place).withColumn("r", last).where("r = 1").select(*key, F.col("gpu_ms").alias("base_ms"))
    out = rows.join(base, key, "left")
    algo = F.when(F.col("algo") == KNN, F.lit("-")).otherwise(F.coalesce(ratio_text(F.col("base_ms"), F.col("gpu_ms")), F.lit("-")))
    return out.select(*records.columns, F.coalesce(ratio_text(F.col("cpu_ms"), F.col("gpu_ms")), F.lit("")).alias("gpu_speedup"), algo.alias("algo_gpu_speedup"))


def scaling_n(typed: DataFrame) -> DataFrame:
    """Chart 1: mean time by n, of both KNN methods at k = 16, float."""
    rows = typed.where("k = 16 and precision = 'float'").where(F.col("algo").isin(KNN, APPROX))
    return rows.groupBy("n", "algo").agg(F.avg("gpu_ms").alias("gpu_ms"))


def device_speedup(typed: DataFrame) -> DataFrame:
    """Chart 2: mean CPU time over GPU time of k-means at k = 32, t = 50, float, where both are known."""
    rows = typed.where("algo = 'kmeans' and precision = 'float' and k = 32 and t = 50").withColumn("speedup", F.col("cpu_ms") / F.nullif(F.col("gpu_ms"), F.lit(0.0)))
    return rows.na.drop(subset=["speedup"]).groupBy("n").agg(F.avg("speedup").alias("speedup"))


def scaling_k(typed: DataFrame) -> DataFrame:
    """Chart 3: mean time by k at n = 100,000, float; k-means at t = 50."""
    rows = typed.where("n = 100000 and precision = 'float' and (algo <> 'kmeans' or t = 50)")
    return rows.groupBy("k", "algo").agg(F.avg("gpu_ms").alias("gpu_ms"))


def precision_impact(typed: DataFrame) -> DataFrame:
    """Chart 4: mean time of approximate KNN by k and precision at n = 100,000."""
    rows = typed.where("n = 100000 and algo = 'approx_knn'").where(F.col("k").isin(4, 16, 32, 64))
    return rows.groupBy("k", "precision").agg(F.avg("gpu_ms").alias("gpu_ms"))


def exact_over_approx(typed: DataFrame) -> DataFrame:
    """Chart 5: exact over approximate time by n at k = 16, float."""
    rows = typed.where("k = 16 and precision = 'float'").where(F.col("algo").isin(KNN, APPROX))
    wide = rows.groupBy("n").pivot("algo", [KNN, APPROX]).agg(F.avg("gpu_ms"))
    return wide.select("n", KNN, APPROX, (F.col(KNN) / F.nullif(F.col(APPROX), F.lit(0.0))).alias("algorithmic_speedup"))
