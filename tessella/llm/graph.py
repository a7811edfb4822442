"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Alternates two steps until the links stop changing: every larger neighbour is linked to the
    smallest neighbour, then every smaller one. Rounds grow with the logarithm of the longest path.
    Each round is aggregation and equi-joins over tables in the shared folder; a node with very many
    links is summed before the shuffle, and its join can be split by the adaptive planner. Loops and
    repeated links do no harm; without links the result is empty.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = materialize(pair.distinct(), "links")
    mark = _mark(current)
    while mark[0]:
        both = current.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(current.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low, "hi").select(F.when(F.col("lo") > F.col("low"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("low").alias("lo"))
        following = materialize(small.unionAll(low.select("hi", F.col("low").alias("lo"))).distinct(), "links")
        discard(current)
        current, before = following, mark
        mark = _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
