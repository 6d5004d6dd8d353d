"""Tables between the jobs of an operator, in the folder that the cluster shares.

Nothing deletes them while the session lives, since a result that is read late still reads them; `clear` does, or whoever
cleans spark.checkpoint.dir. Where that setting is unset, as in tests, they lie in a folder that goes with the process."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many bytes in all may be broadcast, and only after they have been counted.
BROADCAST_BYTES = 16 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: one of this process below spark.checkpoint.dir. Where that is unset, a
    local folder will do for a local master; on a cluster its machines would each see their own files, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="lumenfold-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        base = f"file://{_own['dir']}"
    if "run" not in _own:
        _own["run"] = uuid.uuid4().hex[:12]
    return f"{base.rstrip('/')}/lumenfold-{_own['run']}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has staged. Results that were not written or collected yet can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides. Without it Spark broadcasts a side by the bytes of its compressed files, which
    say little of its rows: 640,000 cells take under 10 MB of Parquet and more than a driver's heap as a broadcast table."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in limit bytes, else df as it is, for a shuffled join.
    df should be cheap to count, such as a staged table."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
