"""Redundancy components and the greedy pick of questions to hold out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import stored


def redundancy_components(columns: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(column_name, root): columns linked by V above least share the smallest name reachable.

    A round writes one table, which says of each column whether its root changed; the next round
    and the question whether one is needed both read that.
    """
    links = pairs.where(F.col("v") > least).select("a", "b")
    both = stored(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = columns.select("column_name", F.col("column_name").alias("root"))
    while True:
        reach = both.join(roots, both.b == roots.column_name).groupBy("a").agg(F.min("root").alias("r"))
        stepped = roots.join(reach, roots.column_name == reach.a, "left").select("column_name", F.col("root").alias("was"), F.least("root", F.coalesce("r", "root")).alias("root"))
        up = stepped.select(F.col("column_name").alias("c"), F.col("root").alias("up"))
        following = stored(stepped.join(up, stepped.root == up.c).select("column_name", "was", F.least("root", "up").alias("root")))
        roots = following.select("column_name", "root")
        if not following.where("root <> was").limit(1).count():
            return roots


def greedy_pick(ranked: DataFrame) -> DataFrame:
    """Rows (column_name, battery, root, rank) that a walk by rank takes if neither battery nor root was taken.

    In rounds: whoever is first of what is left in both its battery and its root is taken; what
    shares either goes. This equals the walk, without a loop over rows. A round writes one table of
    all rows, in which `taken` is null while a row is open. A null battery or root is one like others.
    """
    state = ranked.withColumn("taken", F.lit(None).cast("boolean"))
    while True:
        free = F.when(F.col("taken").isNull(), F.col("rank"))
        battery, root = Window.partitionBy("battery"), Window.partitionBy("root")
        first = state.withColumn("b1", F.min(free).over(battery)).withColumn("r1", F.min(free).over(root))
        now = first.withColumn("now", F.coalesce((free == F.col("b1")) & (free == F.col("r1")), F.lit(False)))
        near = now.withColumn("gone", F.max("now").over(battery)).withColumn("gone", F.col("gone") | F.max("now").over(root))
        state = stored(near.select(*ranked.columns, F.when(F.col("now"), True).when(F.col("taken").isNull() & F.col("gone"), False).otherwise(F.col("taken")).alias("taken")))
        if not state.where("taken is null").limit(1).count():
            return state.where("taken").select(*ranked.columns)
