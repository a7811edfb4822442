"""Quality rules whose cutoffs are certified on labelled holdouts [native: DataFrame functions only].

Every document gets statistics of its whole text. A rule rejects a document when one statistic
exceeds a cutoff. The rules' cutoffs are tightened together, step by step, so what a step rejects the
next one rejects too. Which step a stratum (language) uses is decided on labelled documents: the
steps are tested in their order, and a step is certified if the exact binomial test shows that all
its rules together reject at most a given share of the stratum's good documents. The first step that
is not certified ends the sequence, so the steps need no correction among themselves (a later test is
made only where all before it held); the level is divided among the strata. A stratum without
enough labels gets no step and its documents are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, words_of

#: Words of a window, a power of two.
WINDOW = 8
#: Candidate cutoffs of each rule, from loose to strict. All statistics are shares or means.
CUTOFFS = {
    "symbol_share": [1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
    "dup_line_share": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
    "repeat_share": [0.25, 0.2, 0.15, 0.1, 0.05],
    "mean_word": [40.0, 25.0, 18.0, 14.0, 12.0],
}
#: The cutoffs of each step; a rule whose list has ended stays at its last.
STEPS = [{r: cs[min(t, len(cs) - 1)] for r, cs in CUTOFFS.items()} for t in range(max(map(len, CUTOFFS.values())))]


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the statistics of every whole text (null: empty).

    Windows of eight words are compared by a 64-bit hash of the words' hashes. Positions of windows
    found twice are kept in order, so the words they cover are counted in one pass.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    b = a.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # hashes of two words, of two such pairs, and so on, up to WINDOW words
    c, width = b.withColumn("w", F.col("h")).drop("h"), 1
    while width < WINDOW:
        ahead = F.slice("w", width + 1, F.greatest(F.size("w") - width, F.lit(0)))
        c = c.withColumn("w", F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - width, F.lit(0))), ahead, lambda x, y: F.xxhash64(x, y)))
        width *= 2
    d = c.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("w")
    last = F.size("s") - 1
    twice = F.filter("s", lambda y, j: ((j > 0) & (F.get("s", j - 1)["x"] == y["x"])) | ((j < last) & (F.get("s", j + 1)["x"] == y["x"])))
    e = d.withColumn("at", F.array_sort(F.transform(twice, lambda y: y["i"]))).drop("s")
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    return e.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g), F.lit(0).cast("long"))).drop("at")


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series, after moving x up by eight."""
    y = x + 8
    shift = F.ln(x) + F.ln(x + 1) + F.ln(x + 2) + F.ln(x + 3) + F.ln(x + 4) + F.ln(x + 5) + F.ln(x + 6) + F.ln(x + 7)
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the largest term, then the terms below it by their ratios.

    Meant for k below n * p, where the terms fall from k downwards; 1 elsewhere (no test passes there).
    Terms further than ten standard deviations down do not change the sum.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    far = F.least(k, F.ceil(F.sqrt(n * p) * 10 + 50)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        j = k - i + 1
        term = s["term"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    below = F.when(far >= 1, F.aggregate(F.sequence(F.lit(1), far), start, step, lambda s: s["sum"])).otherwise(F.lit(1.0))
    return F.when(k < n * p, top * below).otherwise(F.lit(1.0))


def rule_values() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
    }


def base_failed(min_words: int, max_repeat_pct: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.04, level: float = 0.05, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """(stratum, one column per rule): the cutoffs of the last certified step, null where none is.

    A step may wrongly reject the share risk of a stratum's good documents (label 1, base rules
    passed) by any of its rules. level is the chance that any stratum's step rejects more than that:
    each stratum's sequence is tested at level / strata (Bonferroni). Rows of labels without a label
    or a document do not count; a document labelled twice counts twice.
    """
    good = labels.where("quality = 1").select("doc_id")
    held = stats.where(~base_failed(min_words, max_repeat_pct)).join(good, "doc_id")
    values = rule_values()

    def rejects(step: dict[str, float]) -> Column:
        first, *rest = (values[r] > c for r, c in step.items())
        return reduce(lambda a, b: a | b, rest, first)

    counts = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rejects(x)).alias(f"k{t}") for t, x in enumerate(STEPS)])
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
    # one row for each step
    each = counts.select("lang", "n", "strata", F.inline(F.array(*[F.struct(F.lit(t + 1).alias("step"), F.col(f"k{t}").alias("k")) for t in range(len(STEPS))])))
    sure = binomial_cdf(F.col("k"), F.col("n"), risk) <= F.lit(level) / F.col("strata")
    last = each.groupBy(F.col("lang").alias("stratum")).agg(F.coalesce(F.min(F.when(~sure, F.col("step"))) - 1, F.max("step")).alias("last")).where("last > 0")
    return last.select("stratum", *[F.element_at(F.array(*[F.lit(x[r]) for x in STEPS]), F.col("last")).alias(r) for r in CUTOFFS])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.04, level: float = 0.05, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """One row per row of docs: its statistics, base_failed, the rules it breaks and kept.

    Null texts count as empty and fail the base rule; null languages form a stratum of their own.
    Rows that repeat are judged alike. Without labels, or with empty tables, only the base rules act.
    Other columns of docs and labels are not read.
    """
    stats = materialize(document_stats(docs.select("doc_id", "text", "lang")), "stats")
    cutoffs = materialize(certified_cutoffs(stats, labels.select("doc_id", "quality"), risk, level, min_words, max_repeat_pct), "cutoffs")
    values = rule_values()
    joined = stats.join(cutoffs, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    failed = base_failed(min_words, max_repeat_pct)
    broken = F.array_compact(F.array(*[F.when(values[r] > F.col(r), F.lit(r)) for r in CUTOFFS]))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array_join(broken, ",").alias("broken_rules"), (~failed & (F.size(broken) == 0)).alias("kept"))
