"""Removal of passages that repeat across the corpus, by overlapping windows of three lines [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, beside, materialize, place_of

SPAN = 3


def line_windows(docs: DataFrame, span: int = SPAN, over: int | None = None) -> DataFrame:
    """(doc_id, tie, first, last, h1, h2): every run of span lines that hold a word.

    With over, also every run of fewer lines that hold more than over words together.

    first and last are the places of the run's outer lines among all lines of the text. Blank lines
    between them belong to the run but not to its hash, which has 128 bits in two halves: at 10**12
    runs two different ones share it with a chance of about 10**-15. tie tells texts with the same
    doc_id apart.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: y["x"].rlike(r"[^\x20\x09-\x0D]"))
    a = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tie"), lines.alias("l"))
    least = span if over is None else 1
    b = a.where(F.size("l") >= least).select("doc_id", "tie", F.col("l.i").alias("i"), F.transform("l", lambda y: F.xxhash64(y["x"])).alias("h"), F.transform("l", lambda y: F.xxhash64(F.lit(1), y["x"])).alias("g"), *([] if over is None else [F.transform("l", lambda y: F.regexp_count(y["x"], F.lit(WORD))).alias("w")]))

    def runs(n: int):
        return F.transform(F.sequence(F.lit(1), F.size("h") - (n - 1)), lambda j: F.struct(F.element_at("i", j).alias("first"), F.element_at("i", j + (n - 1)).alias("last"), F.xxhash64(F.slice("h", j, n)).alias("h1"), F.xxhash64(F.slice("g", j, n)).alias("h2"), *([] if over is None else [F.aggregate(F.slice("w", j, n), F.lit(0), lambda t, x: t + x).alias("words")])))

    if over is None:
        return b.select("doc_id", "tie", F.inline(runs(span)))
    none = F.slice(runs(1), 1, 0)
    every = [F.when(F.size("h") >= n, runs(n)).otherwise(none) for n in range(1, span + 1)]
    every = [F.filter(r, lambda x: x["words"] > over) for r in every[:-1]] + every[-1:]
    return b.select("doc_id", "tie", F.inline(F.concat(*every))).drop("words")


def covered(windows: DataFrame) -> DataFrame:
    """(doc_id, tie, spans): merged places of all windows that occur earlier in the corpus.

    Earlier means a smaller (doc_id, tie, first). The first place of each hash is summed before the
    shuffle; only hashes found more than once are joined back, in a merge join whose large partitions
    the adaptive planner splits (spark.sql.adaptive.skewJoin.enabled, on by default, is needed), so a
    passage that a third of the documents share needs no single task.
    """
    place = F.struct("doc_id", "tie", "first")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.max(place).alias("final")).where("origin <> final").select("h1", "h2", "origin")
    later = windows.join(firsts, ["h1", "h2"]).where(place > F.col("origin")).select("doc_id", "tie", "first", "last")
    order = Window.partitionBy("doc_id", "tie").orderBy("first")
    fresh = F.when(F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, 1).otherwise(0)
    blocks = later.distinct().withColumn("fresh", fresh).withColumn("block", F.sum("fresh").over(order))
    merged = blocks.groupBy("doc_id", "tie", "block").agg(F.min("first").alias("s"), F.max("last").alias("e"))
    return merged.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def line_dedup(docs: DataFrame, span: int = SPAN, over: int | None = None) -> DataFrame:
    """docs with later occurrences of repeated passages removed, plus n_lines and n_removed.

    A passage is a run of span lines with words, equal to a run found earlier in the corpus (by
    doc_id, then place); all lines that such runs cover go, with the blank lines between them. The
    first occurrence stays. With over, a run of fewer lines that hold more than over words is a passage
    too; repeats that begin or end within a line stay. Texts of fewer lines, null and empty texts are unchanged. Rows that
    repeat with the same doc_id and text count as one document, so all of them are treated alike.
    A text that repeats whole under another doc_id becomes empty; its row stays. All columns of docs
    are kept under their names; n_chars, where there is one, follows the new text, and n_lines or
    n_removed give way to the new columns. A null doc_id is an id that comes before all others. A
    text of one line is one line even if it is empty. An empty table gives no rows.
    """
    windows = materialize(line_windows(docs.select("doc_id", "text"), span, over), "windows")
    spans = materialize(covered(windows), "spans")
    who, text = place_of(docs, "doc_id"), place_of(docs, "text")
    # a merge join at every size: the texts are shuffled once, by doc_id, and the plan does not change as the corpus grows
    joined = beside(docs).join(spans.hint("merge"), who.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("tie")) & text.isNotNull(), "left")
    cut = joined.withColumn("lines", F.split(text, "\n"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda j: F.slice(
            "lines",
            F.when(j == 0, F.lit(1)).otherwise(F.get("spans", j - 1)["e"] + 2),
            F.when(j == F.size("spans"), F.size("lines")).otherwise(F.get("spans", j)["s"]) - F.when(j == 0, F.lit(0)).otherwise(F.get("spans", j - 1)["e"] + 1),
        ),
    )
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"] + 1)
    untouched = F.col("spans").isNull()
    new = cut.withColumn("new", F.when(untouched, text).otherwise(F.array_join(F.flatten(pieces), "\n")))
    changed = {"text": F.col("new"), "n_chars": F.when(untouched, place_of(docs, "n_chars")).otherwise(F.char_length("new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("new")}
    kept = [changed.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    return new.select(*kept, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0).cast("long")).alias("n_removed"))
