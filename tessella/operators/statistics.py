"""Distributions, association and agreement of categorical responses.

All inputs are long tables, so every statistic is a few grouped aggregates whatever the number of
questions or respondents. Ties are always broken by an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import stored
from tessella.operators.running import exact_percentiles


def with_overall(responses: DataFrame, label: str = "cluster") -> DataFrame:
    """Each row under its own label and under 'overall', as `subpopulation`."""
    return responses.withColumn("subpopulation", F.explode(F.array(F.col(label).cast("string"), F.lit("overall"))))


def empirical_distribution(labelled: DataFrame, options: DataFrame) -> DataFrame:
    """(subpopulation, column_name, pos, code, n, p) over the listed options, in their order.

    labelled: (subpopulation, column_name, code); options: (column_name, pos, code). Other codes do
    not count; without any valid response the distribution is uniform.
    """
    counts = labelled.groupBy("subpopulation", "column_name", "code").agg(F.count(F.lit(1)).alias("n"))
    grid = labelled.select("subpopulation").distinct().join(options)
    filled = grid.join(counts, ["subpopulation", "column_name", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("subpopulation", "column_name")
    total = F.sum("n").over(w)
    return filled.select("subpopulation", "column_name", "pos", "code", "n", F.when(total > 0, F.col("n") / total).otherwise(1 / F.count(F.lit(1)).over(w)).alias("p"))


def mode_of(distribution: DataFrame) -> DataFrame:
    """Place of the first largest probability."""
    return distribution.groupBy("subpopulation", "column_name").agg(F.max_by("pos", F.struct("p", -F.col("pos"))).alias("mode"))


def _weighted(responses: DataFrame, assignments: DataFrame | None) -> DataFrame:
    """(column_name, code, cluster, w): each answer once per cluster; responses that have `probs` need no assignments."""
    rows = responses if assignments is None else responses.join(assignments.select("respondent_id", "probs"), "respondent_id")
    return rows.select("column_name", "code", F.posexplode("probs").alias("cluster", "w"))


def posterior_distribution(responses: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """(cluster, column_name, code, p) weighted by membership probabilities; missing answers left out."""
    sums = _weighted(responses.where("code is not null"), assignments).groupBy("cluster", "column_name", "code").agg(F.sum("w").alias("w"))
    return sums.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("cluster", "column_name"))).drop("w")


def nonresponse(responses: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    lost = F.sum(F.when(F.col("code").isNull(), F.col("w")).otherwise(0.0))
    return _weighted(responses, assignments).groupBy("cluster", "column_name").agg((lost / F.greatest(F.sum("w"), F.lit(1e-12))).alias("rate"))


def hard_distribution(labelled: DataFrame, weight: str | None = None) -> DataFrame:
    """(label, column_name, code, p) on the full grid of labels and codes; all zero where a label has no response. weight: how many rows a row stands for."""
    known = labelled.where("code is not null")
    counts = known.groupBy("label", "column_name", "code").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    grid = labelled.select("label").distinct().join(known.select("column_name", "code").distinct())
    filled = grid.join(counts, ["label", "column_name", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("label", "column_name"))
    return filled.select("label", "column_name", "code", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("p"))


def informativeness(dist: DataFrame, label: str) -> DataFrame:
    """Mean over pairs of labels of the total variation distance, per column.

    The distribution is stored before its labels meet, so that what it is made of is read once.
    """
    dist = dist if hasattr(dist, "shared_path") else stored(dist, "distribution")
    a, b = dist.alias("a"), dist.alias("b")
    on = (F.col("a.column_name") == F.col("b.column_name")) & F.col("a.code").eqNullSafe(F.col("b.code")) & (F.col(f"a.{label}") < F.col(f"b.{label}"))
    pairs = a.join(b, on).groupBy(F.col("a.column_name").alias("column_name"), F.col(f"a.{label}").alias("x"), F.col(f"b.{label}").alias("y")).agg((F.sum(F.abs(F.col("a.p") - F.col("b.p"))) / 2).alias("tvd"))
    return pairs.groupBy("column_name").agg(F.avg("tvd").alias("informativeness"))


def cluster_sizes(labels: DataFrame, clusters: int, label: str = "cluster") -> DataFrame:
    """(cluster, n, share) of the clusters from 0 to clusters - 1, those without members too; other labels do not count."""
    known = labels.where((F.col(label) >= 0) & (F.col(label) < clusters))
    counts = known.groupBy(F.col(label).cast("int").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    every = labels.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    n = F.coalesce("_n", F.lit(0))
    return every.join(counts, F.col("cluster") == F.col("_c"), "left").select("cluster", n.alias("n"), (n / F.nullif(F.sum(n).over(Window.partitionBy()), F.lit(0))).alias("share"))


def distribution_ablation(soft: DataFrame, hard: dict[str, DataFrame]) -> DataFrame:
    """(column_name, soft_informativeness, and for each labeling <name>_tvd and <name>_informativeness).

    soft: (cluster, column_name, code, p) from posteriors; hard: the same from each labeling's hard
    labels, with the clusters numbered alike. The distance is the mean over clusters of half the sum
    of absolute differences; a cell that one side lacks counts as zero. Distributions and the table
    itself are stored: they are read several times, the responses behind them once.
    """
    soft = stored(soft, "soft")
    out = informativeness(soft, "cluster").withColumnRenamed("informativeness", "soft_informativeness")
    for name, dist in hard.items():
        dist = stored(dist, "hard")
        both = soft.withColumnRenamed("p", "_soft").join(dist.select("cluster", "column_name", "code", F.col("p").alias("_hard")), ["cluster", "column_name", "code"], "full").na.fill(0.0, ["_soft", "_hard"])
        gaps = both.groupBy("column_name", "cluster").agg((F.sum(F.abs(F.col("_soft") - F.col("_hard"))) / 2).alias("t")).groupBy("column_name").agg(F.avg("t").alias(f"{name}_tvd"))
        own = informativeness(dist, "cluster").withColumnRenamed("informativeness", f"{name}_informativeness")
        out = out.join(gaps, "column_name", "full").join(own, "column_name", "full")
    return stored(out, "ablation")


def ablation_summary(ablation: DataFrame) -> DataFrame:
    """(measure, mean, median, p95) over the questions of every measure of a distribution ablation, with linear percentiles."""
    long = ablation.unpivot(["column_name"], [c for c in ablation.columns if c != "column_name"], "measure", "value")
    means = long.groupBy("measure").agg(F.avg("value").alias("mean"))
    return means.join(exact_percentiles(long, "measure", "value", {"median": 0.5, "p95": 0.95}), "measure")


def pair_cells(responses: DataFrame, batteries: DataFrame, across_only: bool = True) -> DataFrame:
    """(a, b, ca, cb, n): joint counts of two columns over respondents who answered both.

    The pairs of one respondent are bounded by the number of questions; they are counted before the
    shuffle. Columns of one battery are not paired unless across_only is false.
    """
    r = responses.where("code is not null").join(batteries, "column_name").select("respondent_id", "column_name", "code", "battery")
    a, b = r.alias("a"), r.alias("b")
    on = (F.col("a.respondent_id") == F.col("b.respondent_id")) & (F.col("a.column_name") < F.col("b.column_name"))
    if across_only:
        on = on & (F.col("a.battery") != F.col("b.battery"))
    return a.join(b, on).groupBy(F.col("a.column_name").alias("a"), F.col("b.column_name").alias("b"), F.col("a.code").alias("ca"), F.col("b.code").alias("cb")).agg(F.count(F.lit(1)).alias("n"))


def cramers_v(cells: DataFrame, least: int = 50) -> DataFrame:
    """(a, b, n, v): Cramer's V, null below `least` pairs or where a side has one level.

    chi2 runs over the full grid of levels; cells that never occur add what is expected of them. With
    two levels on both sides all four cells deviate by the same amount, which shrinks by up to a half
    (Yates). Margins are windows over the cells of a pair, so the cells are moved once.
    """
    pair = Window.partitionBy("a", "b")
    seen = cells.withColumn("total", F.sum("n").over(pair)).withColumn("nr", F.sum("n").over(Window.partitionBy("a", "b", "ca"))).withColumn("nc", F.sum("n").over(Window.partitionBy("a", "b", "cb")))
    e = F.col("nr") * F.col("nc") / F.col("total")
    gap = F.col("n") - e
    levels = [F.size(F.collect_set(c)).alias(x) for c, x in (("ca", "r"), ("cb", "c"))]
    t = seen.groupBy("a", "b").agg(F.max("total").alias("n"), *levels, F.sum(gap * gap / e).alias("seen"), F.sum(e).alias("expected"), F.count(F.lit(1)).alias("cells"), F.max(F.abs(gap)).alias("gap"))
    chi2 = F.col("seen") + F.when(F.col("cells") < F.col("r") * F.col("c"), F.col("n") - F.col("expected")).otherwise(0.0)
    less = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    chi2 = F.when((F.col("r") == 2) & (F.col("c") == 2), F.when(F.col("gap") > 0, chi2 * less * less / (F.col("gap") * F.col("gap"))).otherwise(0.0)).otherwise(chi2)
    k = F.least("r", "c") - 1
    return t.select("a", "b", "n", F.when((F.col("n") >= least) & (k >= 1), F.sqrt(chi2 / (F.col("n") * k))).alias("v"))


def symmetric(pairs: DataFrame) -> DataFrame:
    known = pairs.where("v is not null")
    return known.select(F.col("a").alias("column_name"), F.col("b").alias("partner"), "v").unionAll(known.select(F.col("b").alias("column_name"), F.col("a").alias("partner"), "v"))


def redundancy(pairs: DataFrame) -> DataFrame:
    """Largest V to another battery (3 places) and the partner that has it; first name on ties."""
    s = symmetric(pairs).withColumn("v", F.round("v", 3))
    order = Window.partitionBy("column_name").orderBy(F.desc("v"), "partner")
    return s.withColumn("k", F.row_number().over(order)).where("k = 1").select("column_name", "partner", "v")


def top_partners(pairs: DataFrame, most: int = 3) -> DataFrame:
    order = Window.partitionBy("column_name").orderBy(F.desc("v"), "partner")
    return symmetric(pairs).withColumn("v", F.round("v", 6)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)


def certainty(assignments: DataFrame) -> DataFrame:
    """Mean and median of the largest membership, and the share above 0.9."""
    top = assignments.select(F.lit(1).alias("all"), F.array_max("probs").alias("top"))
    middle = exact_percentiles(top, "all", "top", {"median": 0.5})
    return top.groupBy("all").agg(F.avg("top").alias("mean"), F.avg((F.col("top") > 0.9).cast("double")).alias("above_09")).join(middle, "all").select("mean", "median", "above_09")


def numeric_profile(labelled: DataFrame, label: str, value: str) -> DataFrame:
    """(label, mean, median) of a numeric column."""
    means = labelled.groupBy(label).agg(F.avg(value).alias("mean"))
    return means.join(exact_percentiles(labelled, label, value, {"median": 0.5}), label, "left")


def relative_entropy(assignments: DataFrame) -> DataFrame:
    h = F.aggregate("probs", F.lit(0.0), lambda t, p: t - p * F.ln(p + 1e-12))
    return assignments.agg((1 - F.sum(h) / (F.count(F.lit(1)) * F.ln(F.max(F.size("probs"))))).alias("relative_entropy"))


def size_entropy(labels: DataFrame) -> DataFrame:
    """Entropy of label shares over the log of the number of labels; null below two labels."""
    shares = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return shares.agg(F.when(F.count(F.lit(1)) >= 2, -F.sum(F.col("p") * F.ln("p")) / F.ln(F.count(F.lit(1)))).alias("size_entropy"))


def coherence(labelled: DataFrame, weight: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Mean over questions of the size-weighted 1 - H / ln(levels) within labels.

    weight: how many rows a row stands for; then sizes gives the labels' respondents (label, size).
    """
    known = labelled.where("code is not null")
    levels = known.groupBy("column_name").agg(F.countDistinct("code").alias("levels")).where("levels >= 2")
    cells = known.groupBy("column_name", "label", "code").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    w = Window.partitionBy("column_name", "label")
    p = F.col("n") / F.sum("n").over(w)
    h = cells.withColumn("p", p).groupBy("column_name", "label").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    sizes = sizes if sizes is not None else labelled.select("respondent_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    q = h.join(sizes, "label").join(levels, "column_name").groupBy("column_name").agg((F.sum(F.col("size") * (1 - F.col("h") / F.ln("levels"))) / F.sum("size")).alias("c"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return q.agg(F.avg("c").alias("coherence"))


def adjusted_rand(pairs: DataFrame, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """ARI of two labelings (x, y), from contingency counts; one per value of `by` where given. weight: how many rows a row stands for, one each without."""

    def two(n: Column) -> Column:
        return n * (n - 1) / 2

    cells = pairs.groupBy(*by, "x", "y").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    s = cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    r = cells.groupBy(*by, "x").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("rows"))
    c = cells.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("cols"))
    on = list(by) or None
    expected = F.col("rows") * F.col("cols") / two(F.col("total"))
    most = (F.col("rows") + F.col("cols")) / 2
    return s.join(r, on).join(c, on).select(*by, F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"))


def adjusted_rand_matrix(labels: DataFrame) -> DataFrame:
    """(a, b, ari) for every two methods of (method, respondent_id, label), each with itself too; rows without a label do not count."""
    known = labels.where("label is not null").select("method", "respondent_id", "label")
    a = known.select(F.col("method").alias("a"), "respondent_id", F.col("label").alias("x"))
    b = known.select(F.col("method").alias("b"), "respondent_id", F.col("label").alias("y"))
    return adjusted_rand(a.join(b, "respondent_id"), ("a", "b"))


def dominant_category(labelled: DataFrame) -> DataFrame:
    """Commonest category per (label, column) with its share; first in order on ties."""
    counts = labelled.groupBy("label", "column_name", "code").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label", "column_name")
    return counts.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "code"))).withColumn("percent", 100 * F.col("n") / F.sum("n").over(w)).where("k = 1").drop("k")


def composition(labelled: DataFrame) -> DataFrame:
    """Shares per (label, column) by count, with the running left edge and a flag from 8 % on."""
    counts = labelled.groupBy("label", "column_name", "code").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label", "column_name")
    share = F.col("n") / F.sum("n").over(w)
    order = w.orderBy(F.desc("n"), "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("share", share).withColumn("left_edge", F.sum("share").over(order) - F.col("share")).withColumn("label_shown", F.col("share") >= 0.08)


def cross_table(pairs: DataFrame) -> DataFrame:
    """(x, y, n, column percent, share of all) for two labelings."""
    n = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("y"))).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def demographic_tvd(labelled: DataFrame) -> DataFrame:
    """(column_name, tvd): mean over pairs of labels of the distance of their text values; missing is a value like any other."""
    known = labelled.withColumn("code", F.coalesce("code", F.lit("Missing")))
    return informativeness(hard_distribution(known), "label").withColumnRenamed("informativeness", "tvd")


def demographic_profile(texts: DataFrame, numbers: DataFrame, labels: list, junk: str) -> DataFrame:
    """One row per demographic with its distance (null for numbers) and a text per label, largest distance first.

    texts: (respondent_id, label, column_name, code), shown by the commonest category and its
    percent, junk left out there but not in the distance; numbers: (label, column_name, value), shown
    by mean and median. labels: the labels, so that the pivot needs no job.
    """
    clean = texts.where(F.col("code").isNotNull() & ~F.lower("code").rlike(junk))
    shown = dominant_category(clean).select("column_name", "label", F.format_string("%s (%.1f%%)", F.col("code"), F.col("percent").cast("double")).alias("shown"))
    profile = numeric_profile(numbers.select(F.struct("column_name", "label").alias("who"), "value"), "who", "value")
    means = profile.select("who.column_name", "who.label", F.format_string("%.2f / %.2f", F.col("mean"), F.col("median")).alias("shown"))
    wide = shown.unionByName(means).groupBy("column_name").pivot("label", labels).agg(F.first("shown"))
    return wide.join(demographic_tvd(texts), "column_name", "left").orderBy(F.desc_nulls_last("tvd"), "column_name")


def favours(metrics: DataFrame, larger: list[str]) -> DataFrame:
    """(metric, first, second, favours) of two solutions from (metric, first, second).

    Metrics named in `larger` are better when larger, all others when smaller; a tie or a missing
    side favours neither (a dash).
    """
    gap = F.when(F.col("metric").isin(larger), F.col("first") - F.col("second")).otherwise(F.col("second") - F.col("first"))
    return metrics.withColumn("favours", F.when(gap > 0, "first").when(gap < 0, "second").otherwise("-"))


def largest_differences(a: DataFrame, b: DataFrame, most: int = 3) -> DataFrame:
    """Columns whose (column_name, value) differ most between two solutions; first name on ties."""
    both = a.select("column_name", F.col("value").alias("first")).join(b.select("column_name", F.col("value").alias("second")), "column_name")
    return both.withColumn("difference", F.col("second") - F.col("first")).orderBy(F.desc(F.round(F.abs("difference"), 9)), "column_name").limit(most)


def question_groups(ranked: DataFrame, most: int = 25) -> DataFrame:
    """(battery, best, members): the first items grouped by battery, members in order of rank."""
    top = ranked.where(F.col("rank") <= most)
    return top.groupBy("battery").agg(F.min("rank").alias("best"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "column_name"))), lambda x: x["column_name"]).alias("members"))


def similar_questions(pairs: DataFrame, picked: DataFrame, held_out: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """(column_name, text, k, partner, partner_text, v): per picked question its closest partners that stay in training.

    Partners that are held out themselves are left out before ranking.
    """
    s = symmetric(pairs).withColumn("v", F.round("v", 3)).join(picked.select("column_name"), "column_name", "left_semi")
    s = s.join(held_out.select(F.col("column_name").alias("partner")), "partner", "left_anti")
    top = s.withColumn("k", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("v"), "partner"))).where(F.col("k") <= most)
    named = texts.select(F.col("column_name").alias("partner"), F.col("text").alias("partner_text"))
    return top.join(texts.select("column_name", "text"), "column_name", "left").join(named, "partner", "left").select("column_name", "text", "k", "partner", "partner_text", "v")
