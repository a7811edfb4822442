"""Running sums, places and exact percentiles in two steps, so that no key's rows ever meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import stored


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with `i`, the place within the key's order from 1, and each of the sums up to that row.

    Rows are cut into ranges of (key, order), summed by range, and then placed within their range.
    Nulls add nothing. Rows that tie in the order are placed as they come.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.withColumns({f"_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}).repartitionByRange(width, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    names = [*sums, "i"]
    ranged = ranged.withColumn("_i", F.lit(1))
    totals = ranged.groupBy(F.col(key).alias("_key"), "_part").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in names])
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_key", F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_ahead_{n}") for n in names])
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_upto_{n}": F.sum(f"_{n}").over(within) for n in names})
    joined = local.join(ahead, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    kept = [c for c in rows.columns if c not in names]
    return joined.select(*kept, *[(F.col(f"_upto_{n}") + F.col(f"_ahead_{n}")).alias(n) for n in names])


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """(key, one column per share): percentiles with linear interpolation, nulls left out.

    Equal values are counted before anything is sorted; the value at a rank is where the running
    count first passes it. weight: how many rows a row stands for, one each without.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    upto = running(counts, key, [value], {"upto": F.col("n")})
    total = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("_total"))
    both = upto.join(total, F.col(key).eqNullSafe(F.col("_key")))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col(value)))

    parts = []
    for name, share in shares.items():
        rank = (F.col("_total") - 1) * F.lit(share)
        parts += [at(F.floor(rank)).alias(f"_low_{name}"), at(F.ceil(rank)).alias(f"_high_{name}"), F.max(rank - F.floor(rank)).alias(f"_rest_{name}")]
    found = both.groupBy(key).agg(*parts)
    return found.select(key, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_rest_{n}")).alias(n) for n in shares])


def resample_summary(rows: DataFrame, key: str, value: str, least: float = 0.7) -> DataFrame:
    """(key, mean, median, low, high, verdict) of resampled values: the middle 95 % and whether their mean reaches least."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    middle = exact_percentiles(rows, key, value, {"median": 0.5, "low": 0.025, "high": 0.975})
    return means.join(middle, key).withColumn("verdict", F.when(F.col("mean") >= least, "stable").otherwise("unstable"))


def exceedance(simulated: DataFrame, observed: DataFrame, key: str, value: str, level: float = 0.05) -> DataFrame:
    """(key, p, rejected): (1 + simulated values at or above the observed one) / (1 + simulated values); observed: (key, observed)."""
    p = (1 + F.count_if(F.col(value) >= F.col("observed"))) / (1 + F.count(value))
    return simulated.join(observed, key).groupBy(key).agg(p.alias("p")).withColumn("rejected", F.col("p") < level)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins from low to high; the highest value falls in the last bin, values outside in none."""
    x = F.col(value)
    at = F.least(F.floor((x - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    return rows.where((x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
