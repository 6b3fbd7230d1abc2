"""Cutting a plan's lineage by a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local
    master gets a temporary folder of its own, and a cluster gets an error, as executors there see no
    folder of the driver's machine."""
    if (base := spark.conf.get("spark.checkpoint.dir", None)) is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if (app := spark.sparkContext.applicationId) not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="sparkloom-")
            atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
        base = _own_folder[app]
    return f"{base.rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so that a lost executor
    costs a read and not the work before it. The folder may go once the results are written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these tables, which nothing may read any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
