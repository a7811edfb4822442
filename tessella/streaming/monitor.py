"""Live monitor of evaluation results that arrive as files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessella.functions.shared import stored
from tessella.operators.scoring import summary
from tessella.sources.versions import current, publish

RESULT = "event_id long, model string, subpopulation string, is_correct boolean, cross_entropy double, kl_divergence double, failed boolean"
RUN_RESULT = "event_id long, model string, at long, is_correct boolean, cross_entropy double, kl_divergence double, failed boolean"
STATE = "i long, right long, ce double, n_ce long, kl double, n_kl long, streak long, longest long, abort_at long, first_at long"
EVENT = "model string, kind string, i long, accuracy double, cross_entropy double, kl_divergence double, rate double, eta double, longest long, abort_at long, aborted boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_failures(results: DataFrame, keys: list[str]) -> DataFrame:
    """The summary of the results that did not fail, and how many failed, by the keys.

    A failed result has no answer to score; a key all of whose results failed has n 0 and null metrics.
    """
    scored = lambda c: F.when(~F.col("failed"), F.col(c)).alias(c)
    rows = results.select(*keys, "failed", *[scored(c) for c in ("is_correct", "cross_entropy", "kl_divergence")])
    right = F.sum(F.when(F.col("is_correct"), 1).otherwise(0))
    n = F.count_if(~F.col("failed"))
    return rows.groupBy(*keys).agg(n.alias("n"), F.when(F.count("is_correct") > 0, 100 * right / n).alias("accuracy"), F.avg("cross_entropy").alias("cross_entropy"), F.avg("kl_divergence").alias("kl_divergence"), F.count_if("failed").alias("failures"))


def live_summary(spark: SparkSession, path: str, keys: tuple[str, ...] = ("model", "subpopulation"), failures: bool = True) -> DataFrame:
    """Running summary by the keys; the same rows as the batch summary of all files seen so far.

    State is one row of sums per key, so no watermark is needed.
    """
    results = spark.readStream.schema(RESULT).parquet(path)
    return with_failures(results, list(keys)) if failures else summary(results, list(keys))


def start(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("model", "subpopulation")):
    """Keep the newest row of each key as a table published below path; newest() reads it.

    A batch brings only the keys that changed. They replace their old rows in a new version, which
    becomes current at once; a batch that is run again after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, found = batch.sparkSession, current(batch.sparkSession, path)
        if found and int(found[0]) >= number:
            return
        rows = batch
        if found:
            batch = stored(batch, "batch")
            changed = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            rows = spark.read.parquet(found[1]).join(changed, same, "left_anti").unionByName(batch)
        publish(rows, path, str(number))

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path)[1])


# ---------------------------------------------------------------- runs with keyed state


class RunMonitor(StatefulProcessor):
    """One run's state: sums for its means, its streak of failures, when it began.

    Tells its speed at every `every` results and its means at every `snapshot`, and after each batch
    its longest streak of failures and where the first streak of `most` ended, from where on it
    counts as aborted. planned: results that a run is meant to have, for the time left.
    """

    def __init__(self, every: int, snapshot: int, most: int, planned: int | None):
        self.every, self.snapshot, self.most, self.planned = every, snapshot, most, planned

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        i = right = n_ce = n_kl = streak = longest = 0
        ce = kl = 0.0
        abort_at = first_at = None
        if self.state.exists():
            i, right, ce, n_ce, kl, n_kl, streak, longest, abort_at, first_at = self.state.get()
        out = []
        columns = ["at", "is_correct", "cross_entropy", "kl_divergence", "failed"]
        for at, correct, c, d, failed in pd.concat(rows).sort_values("event_id")[columns].astype(object).itertuples(index=False):
            i += 1
            first_at = int(at) if first_at is None else min(first_at, int(at))
            right += bool(correct) if not pd.isna(correct) else 0
            if not pd.isna(c):
                ce, n_ce = ce + c, n_ce + 1
            if not pd.isna(d):
                kl, n_kl = kl + d, n_kl + 1
            streak = streak + 1 if failed else 0
            longest = max(longest, streak)
            if streak == self.most and abort_at is None:
                abort_at = i
            if i % self.every == 0:
                elapsed = (int(at) - first_at) / 1e6
                rate = i / elapsed if elapsed > 0 else None
                out.append({"kind": "speed", "i": i, "rate": rate, "eta": (self.planned - i) / rate if rate and self.planned is not None else None})
            if i % self.snapshot == 0:
                out.append({"kind": "means", "i": i, "accuracy": 100 * right / i, "cross_entropy": ce / n_ce if n_ce else None, "kl_divergence": kl / n_kl if n_kl else None})
        out.append({"kind": "run", "i": i, "longest": longest, "abort_at": abort_at, "aborted": abort_at is not None})
        self.state.update((i, right, float(ce), n_ce, float(kl), n_kl, streak, longest, abort_at, first_at))
        names = [f.split(" ")[0] for f in EVENT.split(", ")]
        frame = pd.DataFrame(out, columns=names).assign(model=key[0])
        for c in ("i", "longest", "abort_at"):
            frame[c] = frame[c].astype("Int64")
        for c in ("accuracy", "cross_entropy", "kl_divergence", "rate", "eta"):
            frame[c] = frame[c].astype(float)
        yield frame.assign(aborted=frame["aborted"].astype("boolean"))

    def close(self) -> None:
        pass


def live_runs(spark: SparkSession, path: str, every: int = 10, snapshot: int = 100, most: int = 10, planned: int | None = None) -> DataFrame:
    """Events of runs whose results arrive as files, from state kept by run.

    A run's results must arrive in their order; those of one batch may be mixed. The same rows as
    running_metrics, failure_streaks and throughput give for all results so far.
    """
    results = spark.readStream.schema(RUN_RESULT).parquet(path)
    return results.groupBy("model").transformWithStateInPandas(RunMonitor(every, snapshot, most, planned), EVENT, "Update", "None")


def start_runs(stream: DataFrame, path: str, checkpoint: str):
    """Write each batch's events once, as a part of the table below path; a batch that is run again replaces its part."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    try:
        return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All events of one kind; of kind `run` the newest for each run."""
    events = spark.read.parquet(path).where(F.col("kind") == kind).drop("kind")
    if kind != "run":
        return events.drop("batch")
    last = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("batch")))
    return events.withColumn("k", last).where("k = 1").drop("k", "batch")
