"""Text and prompt assembly as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import stored

#: Subpopulations that a run's name may hold.
SUBPOPULATIONS = ("overall", "cluster_0", "cluster_1")
#: Display names of training methods and subpopulations.
METHOD_NAMES = {"modal_response": "Modal response", "sampled_response": "Sampled response", "first_token_distribution": "First token", "full_string_distribution": "Full string"}
POPULATION_NAMES = {"cluster_0": "cluster 0", "cluster_1": "cluster 1", "overall": "overall"}


def user_prompt(template: Column, question: Column, sub_question: Column, options: Column) -> Column:
    """Template, listed options and sub-question, where there are both; else question and options."""
    listed = F.concat(F.lit("\n\nOptions:\n"), F.array_join(options, "\n"))
    full = F.concat(template, listed, F.lit("\n\n"), sub_question, F.lit(":"))
    return F.when(template.isNotNull() & sub_question.isNotNull(), full).otherwise(F.concat(question, listed))


def lettered(options: Column) -> Column:
    return F.transform(options, lambda x, i: F.concat(F.char(65 + i), F.lit(". "), x))


def letters(options: Column) -> Column:
    return F.transform(options, lambda x, i: F.char(65 + i))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))


def token_jaccard(texts: DataFrame) -> DataFrame:
    """(a, b, jaccard) of all texts that share a token, from (name, text); an equi-join on tokens."""
    t = texts.select("name", token_set(F.col("text")).alias("tokens"))
    sizes = t.select("name", F.size("tokens").alias("size"))
    e = t.select("name", F.explode("tokens").alias("token"))
    shared = e.alias("a").join(e.alias("b"), "token").groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(F.count(F.lit(1)).alias("both"))
    joined = shared.join(sizes.select(F.col("name").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("name").alias("b"), F.col("size").alias("nb")), "b")
    return joined.select("a", "b", (F.col("both") / F.greatest(F.col("na") + F.col("nb") - F.col("both"), F.lit(1))).alias("jaccard"))


def similarity_bounds(texts: DataFrame, band: float = 1.25) -> DataFrame:
    """(name, lower, upper): bounds of the sum of a text's token Jaccards with all texts, itself included.

    Common tokens are counted by token and band of sizes, so no two texts meet. A pair with c tokens
    in common has at most the sum of both sizes and at least the larger of them in its union.
    """
    t = texts.select("name", token_set(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    e = t.select("name", "n", F.explode("tokens").alias("token"))
    at = F.floor(F.ln("n") / F.lit(math.log(band)))
    counts = e.groupBy("token", at.alias("band")).agg(F.count(F.lit(1)).alias("f"), F.min("n").alias("few"), F.max("n").alias("many"))
    met = e.join(counts, "token").groupBy("name").agg(F.sum(F.col("f") / (F.col("n") + F.col("many"))).alias("lower"), F.sum(F.col("f") / F.greatest("n", "few")).alias("upper"))
    none = t.where("n = 0").select("name", F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"))
    return met.unionByName(none)


def least_similar(texts: DataFrame) -> DataFrame:
    """(name, similarity): the one text whose mean similarity to all texts, itself included, is least; first name on ties.

    Names are distinct. Only texts whose lower bound does not exceed the least upper bound are
    compared with those that share a token with them.
    """
    bounds = stored(similarity_bounds(texts), "bounds")
    least = bounds.agg(F.min("upper").alias("least"))
    open_ = bounds.join(F.broadcast(least), F.col("lower") <= F.col("least") + F.lit(1e-9)).select("name")
    t = texts.select("name", token_set(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    e = t.select("name", "n", F.explode("tokens").alias("token"))
    few = stored(e.join(open_, "name", "left_semi"), "open")
    shared = few.alias("a").join(e.alias("b"), "token").groupBy(F.col("a.name").alias("name"), F.col("b.name").alias("b")).agg(F.count(F.lit(1)).alias("both"), F.any_value("a.n").alias("na"), F.any_value("b.n").alias("nb"))
    sums = shared.groupBy("name").agg(F.sum(F.col("both") / F.greatest(F.col("na") + F.col("nb") - F.col("both"), F.lit(1))).alias("s"))
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    means = open_.join(sums, "name", "left").join(n).select("name", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("similarity"))
    return means.orderBy(F.round("similarity", 9), "name").limit(1)


def held_out_prompts(prompts: DataFrame, held: DataFrame, suffix: str = "_letter") -> DataFrame:
    """The prompts (name) held out by their own name or as the lettered twin of a held-out name."""
    plain = F.regexp_replace("name", f"{suffix}$", "")
    return prompts.withColumn("plain", plain).join(held.select(F.col("name").alias("plain")), "plain", "left_semi").drop("plain")


def chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turns = [("system", system), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def base_model(name: Column, marker: str = "nz-wvs-") -> Column:
    """What precedes the marker, without hyphens at its end; the whole name without a marker."""
    return F.when(F.instr(name, marker) > 0, F.regexp_replace(F.substring_index(name, marker, 1), "-+$", "")).otherwise(name)


def adapter(name: Column, marker: str = "nz-wvs-") -> Column:
    """What follows the first marker; 'base' without one."""
    at = F.instr(name, marker)
    return F.when(at > 0, F.substr(name, at + len(marker))).otherwise("base")


def adapter_method(name: Column, marker: str = "nz-wvs-") -> Column:
    """The adapter up to its last hyphen, or all of it."""
    return F.regexp_replace(adapter(name, marker), "(?s)-[^-]*$", "")


def adapter_population(name: Column, marker: str = "nz-wvs-") -> Column:
    """The adapter from its last hyphen on, or all of it."""
    return F.substring_index(adapter(name, marker), "-", -1)


def named(key: Column, names: dict[str, str]) -> Column:
    """Display name of a key, or the key itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], key)


def adapter_label(name: Column) -> Column:
    return F.concat(named(adapter_method(name), METHOD_NAMES), F.lit(" ("), named(adapter_population(name), POPULATION_NAMES), F.lit(")"))


def question_label(question_id: Column, question: Column, sub_question: Column) -> Column:
    """'Q<id>: ' and the sub-question, or else the first 50 signs of the question."""
    sub = F.when(sub_question != "", sub_question)
    return F.concat(F.lit("Q"), question_id.cast("string"), F.lit(": "), F.coalesce(sub, F.left(question, F.lit(50))))


def run_subpopulation(run: Column) -> Column:
    parts = F.split(run, "-")
    second = F.get(parts, F.lit(1))
    return F.when((F.size(parts) >= 3) & second.isin(*SUBPOPULATIONS), second).otherwise("unknown")


def keyed_uniform(*keys: Column, seed: int = 1) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 2**32


def inverse_cdf(distribution: Column, u: Column) -> Column:
    """Index of the first category whose running sum exceeds u; the last one if rounding leaves none."""
    sums = F.aggregate(distribution, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda a, p: F.struct((a["s"] + p).alias("s"), (a["i"] + F.when(a["s"] + p <= u, 1).otherwise(0)).alias("i")))
    return F.least(sums["i"], F.size(distribution) - 1)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """One array of (role, content) per conversation, in the order of the turns."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def first_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("k = 1").drop("k")


def list_literal(text: Column) -> Column:
    """Items of a list written as JSON or with single quotes; the text itself as the only item if neither reads."""
    parsed = F.from_json(text, "array<string>")
    quoted = F.transform(F.regexp_extract_all(text, F.lit("""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    return F.when(parsed.isNotNull() & (F.size(parsed) > 0), parsed).when(F.size(quoted) > 0, quoted).otherwise(F.array(text))


def duration(seconds: Column) -> Column:
    """'1h 02m 03s', '2m 03s' or '3s'; parts of a second are left out."""
    n = seconds.cast("long")
    h, m, r = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
