"""Tables written once to the folder that driver and executors share, so that later passes read them instead of their lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folders made, by application.
_MADE: list[tuple[str, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = Path(own).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"
    _MADE.append((spark.sparkContext.applicationId, path))
    return path


class Workspace:
    """The tables that one call of an operator writes. Lineage ends at each of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, scratch_dir(spark)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and read it back. Partitions stay as they are: adaptive execution has sized them."""
        path, schema = f"{self.path}/{label}", df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the folders that this session's operators have written so far, and say how many: for when their results have been written on."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    made = [x for x in _MADE if x[0] == spark.sparkContext.applicationId]
    for own in made:
        path = files.Path(own[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(own)
    return len(made)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver: Spark deletes shuffle files only when the plans that wrote them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df``, written once: for frames that several passes read and that are more than a scan."""
    return Workspace(df.sparkSession).keep(df, label)
