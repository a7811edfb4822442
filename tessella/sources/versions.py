"""Tables published by key: written aside first, then made current by one atomic step.

A root folder holds versions (folders of their own) and a small file `CURRENT` that names one of
them with its key. Readers follow the file, so they see the version before or the one after a
publish, never a part of one, whenever the writer dies.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CURRENT = "CURRENT"
#: Hours after which a version that was never completed counts as left behind.
STALE_HOURS = 24


def _paths(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(key, path) of the current version, None where nothing complete is published."""
    p, fs = _paths(spark, f"{root}/{CURRENT}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        found = json.loads(text)
        path = f"{root}/{found['version']}"
    except (ValueError, KeyError, TypeError):
        return None
    done, fs = _paths(spark, f"{path}/_SUCCESS")
    return (found["key"], path) if fs.exists(done) else None


def _switch(spark: SparkSession, root: str, key: str, version: str) -> None:
    """Write the pointer aside and move it over the old one in one step."""
    jvm = spark._jvm
    aside, fs = _paths(spark, f"{root}/.{CURRENT}-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps({"key": key, "version": version}).encode()))
    finally:
        out.close()
    target, _ = _paths(spark, f"{root}/{CURRENT}")
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, overwrite)


def _drop_stale(spark: SparkSession, root: str, keep: set[str]) -> None:
    """Delete complete versions that nobody needs any more, and incomplete ones that were left behind."""
    p, fs = _paths(spark, root)
    old = (time.time() - STALE_HOURS * 3600) * 1000
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("version-") and name not in keep:
            done, _ = _paths(spark, f"{root}/{name}/_SUCCESS")
            if fs.exists(done) or s.getModificationTime() < old:
                fs.delete(s.getPath(), True)


def publish(rows: DataFrame, root: str, key: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write rows as a new version, make it current under key and return its path.

    The version before stays for those who still read it; older ones are deleted after the switch.
    """
    spark, version = rows.sparkSession, f"version-{uuid.uuid4().hex}"
    before = current(spark, root)
    rows.write.partitionBy(*partition_by).parquet(f"{root}/{version}")
    _switch(spark, root, key, version)
    _drop_stale(spark, root, {version, before[1].rpartition("/")[2]} if before else {version})
    return f"{root}/{version}"


def keyed(spark: SparkSession, root: str, key: str, compute: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table published under this key; where another key or nothing is current, computed and published first."""
    found = current(spark, root)
    path = found[1] if found and found[0] == key else publish(compute(), root, key, partition_by)
    return spark.read.parquet(path)
