"""Dense sums made next to the data and added up in a tree, and draws that depend on keys alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that are added at a time; as many per key at most reach the driver.
FAN = 16


def tree_sum(rows: DataFrame, sums: Callable[[Iterable[pa.RecordBatch]], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sum by key of the arrays that `sums` gives for each partition of rows.

    sums: batches of a partition to (key, array of doubles), each key once. Partitions' arrays stay
    arrays: they are added FAN at a time by Spark until at most FAN for each key are left.
    """

    def part(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for key, x in sums(batches):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([task], pa.int64()), pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary())], ["key", "part", "x"])

    def add(key, table):
        total = sum(np.frombuffer(x) for x in table["x"].to_pylist())
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["key", "part", "x"])

    schema = "key long, part long, x binary"
    left, out = rows.rdd.getNumPartitions(), {}
    parts = rows.mapInArrow(part, schema)
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.groupBy("key", F.floor(F.col("part") / FAN).alias("to")).applyInArrow(add, schema)
    for r in parts.toArrow().to_pylist():
        x = np.frombuffer(r["x"])
        out[r["key"]] = out[r["key"]] + x if r["key"] in out else x.copy()
    return out


def uniform(ids: np.ndarray, *keys: int) -> np.ndarray:
    """A number in (0, 1) for each id that depends on the id and the keys only."""
    x = ids.astype(np.int64).view(np.uint64).copy()
    for k in keys:
        x += np.uint64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def lists(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
