"""The point cloud: idx, x, y, z, intensity. idx stands for the point's position in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["idx", "x", "y", "z", "intensity"]


def cloud_schema(coordinates: str = "int") -> T.StructType:
    kind = {"int": T.IntegerType(), "float": T.FloatType()}[coordinates]
    fields = [T.StructField("idx", T.LongType(), False), *[T.StructField(c, kind) for c in "xyz"], T.StructField("intensity", T.IntegerType())]
    return T.StructType(fields)


def is_whole(cloud: DataFrame) -> bool:
    """Whether the coordinates are integers."""
    return dict(cloud.dtypes)["x"] in ("tinyint", "smallint", "int", "bigint")


def typed(cloud: DataFrame) -> DataFrame:
    """The cloud's columns only, with coordinates in the type that distances are computed in."""
    kind = "long" if is_whole(cloud) else "float"
    return cloud.select(F.col("idx").cast("long").alias("idx"), *[F.col(c).cast(kind).alias(c) for c in "xyz"], F.col("intensity").cast("int").alias("intensity"))


def check_k(k: int, least: int = 1) -> None:
    if not isinstance(k, int) or k < least:
        raise ValueError(f"k must be a whole number of {least} or more, not {k!r}")


def validated(cloud: DataFrame) -> DataFrame:
    """typed(cloud), or ValueError if a value is null or an intensity lies outside 0..255. One pass over the cloud."""
    out = typed(cloud)
    known = F.lit(True)
    for c in COLUMNS:
        known = known & F.col(c).isNotNull()
    bad = out.where(~(known & F.col("intensity").between(0, 255))).limit(1).collect()
    if bad:
        raise ValueError(f"not a point: {bad[0]}")
    return out


def int_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer cloud derived from the customer table."""
    key = F.col("c_custkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("idx"),
        F.col("c_acctbal").cast("long").alias("x"),
        ((key * 7919) % 20001 - 10000).alias("y"),
        ((key * 104729) % 20001 - 10000).alias("z"),
        ((key * 37 + F.col("c_nationkey") * 11) % 256).cast("int").alias("intensity"),
    )


def float_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float cloud derived from the embeddings table."""
    axis = lambda i: F.col("embedding")[i].cast("float") * F.lit(10000).cast("float")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("idx"),
        axis(0).alias("x"),
        axis(1).alias("y"),
        axis(2).alias("z"),
        ((F.col("vec_id") * 37 + F.col("label") * 25) % 256).cast("int").alias("intensity"),
    )


#: The same clouds in DuckDB.
INT_CLOUD_SQL = """SELECT CAST(c_custkey AS BIGINT) AS idx, CAST(trunc(c_acctbal) AS BIGINT) AS x, (CAST(c_custkey AS BIGINT) * 7919) % 20001 - 10000 AS y,
  (CAST(c_custkey AS BIGINT) * 104729) % 20001 - 10000 AS z, CAST((CAST(c_custkey AS BIGINT) * 37 + c_nationkey * 11) % 256 AS INTEGER) AS intensity FROM customer"""
FLOAT_CLOUD_SQL = """SELECT CAST(vec_id AS BIGINT) AS idx, CAST(embedding[1] AS FLOAT) * CAST(10000 AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) * CAST(10000 AS FLOAT) AS y,
  CAST(embedding[3] AS FLOAT) * CAST(10000 AS FLOAT) AS z, CAST((vec_id * 37 + label * 25) % 256 AS INTEGER) AS intensity FROM embeddings"""
