"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import beside, discard, materialize, named, place_of, shuffle_width, word_count

ROWS_PER_BUCKET = 100_000


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. share times all sizes is divided by
    weight; a target stops at most times its source's size and the excess goes to the others by
    weight until none is above. In closed form: sorted by most * size / weight, the first sources
    are full, and the level of the rest is what is left divided by their weights.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    a = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    b = a.select(
        "source",
        "source_size",
        "cap",
        "w",
        F.row_number().over(order).alias("k"),
        ((F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))).alias("level"),
    )
    # the first source that is not full sets the level of all from there on
    c = b.withColumn("free", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))).over(every))
    full = F.col("free").isNull() | (F.col("k") < F.col("free.k"))
    return c.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("w")).alias("target"))


def one_by_one(groups: DataFrame, m: str, i: str) -> DataFrame:
    """groups with one row for each i from 1 to m; large groups are cut into runs first and dealt over all tasks."""
    most = ROWS_PER_BUCKET

    def runs(g: DataFrame) -> DataFrame:
        return g.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col(m) - 1) / most))))

    few = groups.where(F.col(m) <= most).withColumn("_run", F.lit(0).cast("long"))
    cut = few.unionByName(runs(groups.where(F.col(m) > most)).repartition(shuffle_width(groups.sparkSession)))
    first = F.col("_run") * most
    return cut.withColumn(i, F.explode(F.sequence(first + 1, F.least(first + most, F.col(m))))).drop("_run")


def mix_groups(docs: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(doc_id, source, size, m, source_size, target, c): c copies are taken of the m rows with these three in common.

    Such rows queue one after the other, so they are counted before anything is sorted: rows without
    a doc_id are as many groups as their source has sizes, and a group's rows are told apart only as
    numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    groups = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = materialize(source_targets(sizes, list(weights), share, most), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    n = groups.agg(F.sum("m")).first()[0] or 0
    buckets = max(1, shuffle_width(spark), -(-n // ROWS_PER_BUCKET))
    goals = targets.withColumnRenamed("source", "t_")

    # finish times: place of a group = words of earlier buckets of its source + words before it in its bucket
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    lot = groups.where("size > 0").withColumn("u", key).withColumn("part", (F.conv(F.substring("u", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long"))
    words = F.col("size") * F.col("m")
    sums = lot.groupBy("source", "part").agg(F.sum(words).alias("s"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = Window.partitionBy("source", "part").orderBy("u", "doc_id", "size")
    queue = lot.withColumn("before", F.sum(words).over(within.rowsBetween(Window.unboundedPreceding, 0)) - words)
    queue = queue.join(ahead.withColumnRenamed("source", "s_").withColumnRenamed("part", "p_"), F.col("source").eqNullSafe(F.col("s_")) & (F.col("part") == F.col("p_"))).withColumn("before", F.col("before") + F.col("ahead"))
    queue = queue.join(goals, F.col("source").eqNullSafe(F.col("t_"))).where("target > 0").select("doc_id", "size", "source", "m", "before", "source_size", "target")
    queue = materialize(queue, "queue")
    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    finish = (F.col("before") + F.col("i") * F.col("size") + F.col("turn") * F.col("source_size")) / F.col("target")
    timed = materialize(one_by_one(queue, "m", "i").withColumn("turn", turns).select("doc_id", "size", "source", "turn", finish.alias("finish")), "finish")
    discard(queue)

    # the order's cut: whole ranges of finish time first, then rows of the one range where the budget ends
    slots = max(1024, buckets)
    slot = F.floor(F.least(F.col("finish"), F.lit(64.0)) * slots)
    spent = timed.groupBy(slot.alias("slot")).agg(F.sum("size").alias("s"))
    edge = spent.select("slot", F.sum("s").over(Window.orderBy("slot")).alias("upto"), "s").where(F.col("upto") > F.lit(total)).orderBy("slot").limit(1).select("slot", (F.col("upto") - F.col("s")).alias("left")).first()
    if edge is None:
        taken = timed
    else:
        last = timed.where(slot == edge["slot"]).withColumn("upto", F.sum("size").over(Window.orderBy("finish", "doc_id", "turn").rowsBetween(Window.unboundedPreceding, 0)))
        taken = timed.where(slot < edge["slot"]).unionByName(last.where(F.col("upto") + edge["left"] <= F.lit(total)).drop("upto"))
    copies = taken.groupBy(*[F.col(x).alias(f"{x}_") for x in ("doc_id", "source", "size")]).agg(F.count(F.lit(1)).alias("c"))
    alike = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))
    out = groups.join(copies, alike, "left").join(goals, F.col("source").eqNullSafe(F.col("t_")), "left")
    out = materialize(out.select("doc_id", "source", "size", "m", "source_size", "target", F.coalesce("c", F.lit(0)).alias("c")), "mix")
    discard(groups, targets, timed)
    return out


def copies_of(i: str) -> Column:
    """Copies that the i-th of m rows gets of the c that are taken of them."""
    return F.floor((F.col("c") + F.col("m") - F.col(i)) / F.col("m")).cast("long")


def fair_mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken.

    size is the number of words (null text: 0). The documents of a source queue in a shuffled order
    (by md5 of doc_id), up to most times over; each one's virtual finish time is the number of the
    source's words up to its end divided by the source's target. All are taken by finish time until
    the next would exceed the sum of the targets.

    Running sums are made in two steps, sums of buckets first, so neither a source with a third of
    all rows nor the whole order ever meets in one task; rows alike in doc_id, source and size are
    counted first, so neither do those. Reruns agree. Rows that repeat queue one after the other;
    documents of size 0 are never taken; null is a source of its own; a null doc_id is an id like
    others; empty tables give no rows. Other columns are not read.
    """
    out = one_by_one(mix_groups(docs, weights, share, most), "m", "i").withColumn("copies", copies_of("i"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs, all columns, each as many times as the mix takes it.

    Rows are told apart by doc_id, source and size; the copies taken of several rows with the same
    three are dealt among them in the order of their texts' hashes, in two steps: a large group is
    cut into buckets by that hash, and only rows with one text stay together. Nulls are values of
    their own.
    """
    chosen = mix_groups(docs, weights, share, most).where("c > 0").select("doc_id", "source", "size", "m", "c")
    rows = beside(docs).withColumn("words", word_count(place_of(docs, "text")))
    who, source = place_of(docs, "doc_id"), place_of(docs, "source").cast("string")
    out = rows.join(chosen.hint("merge"), who.eqNullSafe(F.col("doc_id")) & source.eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    if chosen.where("c % m <> 0").limit(1).count():
        group = ["doc_id", "source", "size"]
        at = F.floor(F.col("m") / ROWS_PER_BUCKET) + 1
        hashed = F.xxhash64(place_of(docs, "text"))
        dealt = materialize(out.withColumn("h", hashed).withColumn("b", F.pmod("h", at)), "dealt")
        sums = dealt.where(at > 1).groupBy(*group, "b").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        ahead = sums.select(*[F.col(x).alias(f"{x}_") for x in group], F.col("b").alias("b_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
        alike = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in group] + [F.col("b") == F.col("b_")]
        ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy(*group, "b").orderBy("h")))
        large = ranked.where(at > 1).join(ahead, alike).withColumn("r", F.col("r") + F.col("ahead")).select(*ranked.columns)
        out = ranked.where(at == 1).unionByName(large).withColumn("turns", copies_of("r").cast("int"))
    else:
        out = out.withColumn("turns", (F.col("c") / F.col("m")).cast("int"))
    return named(out.where("turns > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns")))), docs)
