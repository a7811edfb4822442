"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that is unset, a new folder of this machine serves in local mode; on a cluster it is an
    error, since executors would write where nobody else reads.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: what is read later survives the loss of any executor. The table stays
    until discard() or clear().
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def tasks_for(rows: DataFrame, most: int = 250_000) -> int:
    """How many tasks share rows so that each holds about `most` of them; no fewer than a shuffle has, which small tables keep."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing reads them any more; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "shared_path", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, when no result of it is read any more."""
    _delete(spark, shared_dir(spark))
