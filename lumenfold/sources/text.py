"""Point clouds as text: whitespace-separated tokens `n k T`, then n times `x y z intensity`; results without a header.

`read_cloud` takes the tokens wherever line breaks stand; one task reads a file. `read_cloud_lines` takes the layout
that generated files have, three header lines and a point per line, splits large files over tasks and numbers the points
by the rows of each split."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..plans.staging import broadcast_if_small, staged
from ..schema import cloud_schema, validated


@dataclass(frozen=True)
class Job:
    """The header of a file."""

    n: int
    k: int
    rounds: int


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t"))


def read_header(spark: SparkSession, path: str) -> Job:
    row = _tokens(spark, path).select(F.slice("t", 1, 3).alias("h"), F.size("t").alias("size")).first()
    try:
        job = Job(*[int(x) for x in row["h"]])
    except (TypeError, ValueError) as e:
        raise ValueError(f"{path}: no header of three whole numbers") from e
    if row["size"] != 3 + 4 * job.n:
        raise ValueError(f"{path}: {row['size']} tokens, expected {3 + 4 * job.n}")
    return job


def read_cloud(spark: SparkSession, path: str, coordinates: str = "int") -> tuple[DataFrame, Job]:
    """(cloud, header); ValueError for a file that is not whole or has intensities outside 0..255."""
    job = read_header(spark, path)
    kind = "int" if coordinates == "int" else "float"
    points = _tokens(spark, path).select(F.slice("t", 4, 4 * job.n).alias("t"))
    at = F.explode(F.sequence(F.lit(0), F.lit(job.n - 1))) if job.n else F.explode(F.array().cast("array<int>"))
    rows = points.select("t", at.alias("i"))
    value = lambda j, kind: F.col("t")[F.col("i") * 4 + j].cast(kind)
    cloud = rows.select(F.col("i").cast("long").alias("idx"), *[value(j, kind).alias(c) for j, c in enumerate("xyz")], value(3, "int").alias("intensity"))
    validated(cloud)
    return cloud, job


def _numbered(lines: DataFrame) -> DataFrame:
    """lines (value) with at: the number of the line, from 0, in the file or in all files of a folder by their names. One row
    per split is ordered in one task."""
    raw = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")
    splits = staged(splits.select("file", "block", "first", before.alias("before")), "splits")
    return raw.join(broadcast_if_small(splits, 512), ["file", "block"]).select("value", (F.col("before") + F.col("id") - F.col("first")).alias("at"))


def read_cloud_lines(spark: SparkSession, path: str, coordinates: str = "int") -> DataFrame:
    """A file of three header lines and a line per point, read by as many tasks as it has splits."""
    kind = "int" if coordinates == "int" else "float"
    part = F.split(F.trim("value"), r"\s+")
    rows = _numbered(spark.read.text(path)).where((F.col("at") >= 3) & (F.trim("value") != "")).select((F.col("at") - 3).alias("idx"), part.alias("t"))
    return rows.select("idx", *[F.col("t")[j].cast(kind).alias(c) for j, c in enumerate("xyz")], F.col("t")[3].cast("int").alias("intensity"))


def read_result(spark: SparkSession, path: str, coordinates: str = "int") -> DataFrame:
    """A result file: idx, x, y, z, new_intensity; ValueError unless every line has four columns."""
    kind = "int" if coordinates == "int" else "float"
    rows = _numbered(spark.read.text(path)).where(F.trim("value") != "").select(F.col("at").alias("idx"), F.split(F.trim("value"), r"\s+").alias("t"))
    bad = rows.where(F.size("t") != 4).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: line {bad[0]['idx'] + 1} has {len(bad[0]['t'])} columns")
    return rows.select("idx", *[F.col("t")[j].cast(kind).alias(c) for j, c in enumerate("xyz")], F.col("t")[3].cast("int").alias("new_intensity"))


def six_digits(value: Column) -> Column:
    """Numbers with six significant digits, as C++ streams print them."""

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: format(x, ".6g"))

    return text(value.cast("double"))


def result_lines(result: DataFrame, value: str = "new_intensity") -> DataFrame:
    """One column, value: the lines of the result by idx."""
    kinds = dict(result.dtypes)
    axis = [six_digits(F.col(c)) if kinds[c] in ("float", "double") else F.col(c).cast("string") for c in "xyz"]
    return result.select("idx", F.concat_ws(" ", *axis, F.col(value).cast("string")).alias("value")).orderBy("idx").select("value")


def write_result(result: DataFrame, path: str, single: bool = True) -> None:
    """The lines of the result in a folder: one file, or files whose names follow the order of idx."""
    lines = result_lines(result)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_cloud(cloud: DataFrame, path: str, k: int, rounds: int) -> None:
    """A file that read_cloud and read_cloud_lines take."""
    kinds = dict(cloud.dtypes)
    axis = [F.format_string("%.4f", c) if kinds[c] in ("float", "double") else F.col(c).cast("string") for c in "xyz"]
    lines = cloud.select(F.col("idx"), F.concat_ws(" ", *axis, F.col("intensity").cast("string")).alias("value"))
    header = cloud.sparkSession.createDataFrame([(-3, str(cloud.count())), (-2, str(k)), (-1, str(rounds))], "idx long, value string")
    header.unionByName(lines).orderBy("idx").coalesce(1).select("value").write.mode("overwrite").text(path)


def result_path(folder: str, algo: str, n: int | None = None, k: int | None = None, rounds: int | None = None, precision: str | None = None) -> str:
    """<algo>.txt, or with parameters <algo>/n_<n>_k_<k>[_t_<rounds>]_<precision>.txt."""
    if n is None:
        return f"{folder}/{algo}.txt"
    t = f"_t_{rounds}" if algo == "kmeans" else ""
    return f"{folder}/{algo}/n_{n}_k_{k}{t}_{precision}.txt"


class PointCloudSource(DataSource):
    """spark.read.format("pointcloud").option("coordinates", "int" | "float").load(path), for files that Python can open."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self):
        return cloud_schema(self.options.get("coordinates", "int"))

    def reader(self, schema):
        return _PointCloudReader(self.options)


class _PointCloudReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.number = int if options.get("coordinates", "int") == "int" else float

    def read(self, partition):
        with open(self.path) as f:
            words = f.read().split()
        n = int(words[0])
        if len(words) != 3 + 4 * n:
            raise ValueError(f"{self.path}: {len(words)} tokens, expected {3 + 4 * n}")
        for i in range(n):
            x, y, z, intensity = words[3 + 4 * i : 7 + 4 * i]
            yield i, self.number(x), self.number(y), self.number(z), int(intensity)
