"""Pieces that several corpus operators share: shared scratch storage and distributed ordering."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and all tasks run in this process (tests) a temporary folder stands in, and it
    goes when the process ends. On a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_app_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what materialize() wrote in this application; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_order(df: DataFrame, keys: list[str], label: str, compression: str = "snappy") -> DataFrame:
    """Sorts over all partitions and keeps each row's place as columns: part, row (from 0 in its part).

    Rows with equal keys are salted in the range exchange, so that a key with a third of all
    rows still spreads over many tasks. The result is written, so the places stay as they are.
    """
    salted = df.withColumn("__salt", F.rand(20))
    sort = [F.col(k).asc_nulls_first() for k in keys] + [F.col("__salt")]
    placed = (
        salted.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .drop("__salt")
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return materialize(placed, label, compression)


def apart(names: list[str], own: list[str]) -> list[str]:
    """Result names of carried columns: one that is named like a column of the result's own gets a trailing underscore, or more."""
    taken, out = {x.lower() for x in own}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
