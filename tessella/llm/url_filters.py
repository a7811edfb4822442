"""Allow and block rules for urls by a sort-merge range join [native: DataFrame functions only].

A host is written in reverse ("com.example.www."), so all its subdomains share a prefix; a rule's
host is then an interval of keys, and so is a path behind one host. Intervals of prefixes are nested
or apart. Sorted together, the borders of the intervals and the keys asked about are swept once: a
border that opens puts its rule on the stack of active rules, one that closes takes it off again, and
a key's rules are what the stack holds when the sweep comes to it. Urls' hosts are swept against the
rules' hosts, then paths within the hosts so found against the rules' paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A byte that no UTF-8 text holds closes an interval; a zero byte parts host and path.
CLOSE, PART = "X'FF'", "X'00'"
ROWS_PER_RANGE, MOST_RANGES = 1_000_000, 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _cuts(asked: DataFrame) -> list[bytes]:
    """Keys that cut the asked ones into ranges: quantiles of a bounded sample, the same in each run."""
    ranges = max(1, min(MOST_RANGES, max(shuffle_width(asked.sparkSession), -(-asked.count() // ROWS_PER_RANGE))))
    sample = asked.select("key").orderBy(F.xxhash64("key")).limit(min(20 * ranges, 20_000)).collect()
    keys = sorted(bytes(r["key"]) for r in sample)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def swept(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with `stack`: what the rules carry whose keys are prefixes of the asked key, outermost first.

    rules: (key binary, load), each key once. asked: each key once, so no range is larger than its
    share. Each range of keys is swept by itself; it begins with the rules open at its cut, which are
    those on a prefix of the cut. The stack's levels are the last rules opened at each depth, up to
    the depth now; their number is that of the deepest nesting among the rules.
    """
    spark = asked.sparkSession
    cuts = _cuts(asked)
    bucket = _range_of(cuts)
    kind = lambda k, step: [F.lit(k).alias("kind"), F.lit(step).alias("step")]
    size = F.length("key").alias("size")
    opens = rules.select(bucket(F.col("key")).alias("bucket"), F.col("key").alias("at"), *kind(1, 1), size, "load")
    ends = F.concat("key", F.expr(CLOSE))
    closes = rules.select(bucket(ends).alias("bucket"), ends.alias("at"), *kind(0, -1), size, "load")
    starts = spark.range(1).select(F.posexplode(_literal(cuts)).alias("i", "cut")).select((F.col("i") + 1).alias("bucket"), "cut")
    # prefixes only as long as some rule's key, so a cut of any length has few
    lengths = F.array(*[F.lit(r[0]) for r in rules.select(F.length("key")).distinct().collect()]).cast("array<int>")
    around = starts.select("bucket", F.explode(F.transform(F.filter(lengths, lambda n: n < F.length("cut")), lambda n: F.substring("cut", F.lit(1), n))).alias("prefix"))
    carried = rules.join(around, rules["key"] == around["prefix"]).select("bucket", F.expr("X''").alias("at"), *kind(-1, 1), size, "load")
    edges = materialize(opens.unionByName(closes).unionByName(carried), "borders")
    sweep = Window.partitionBy("bucket").orderBy("at", "kind", "size").rowsBetween(Window.unboundedPreceding, 0)
    deepest = edges.withColumn("depth", F.sum("step").over(sweep)).agg(F.max("depth")).first()[0] or 0
    extra = [c for c in asked.columns if c != "key"]
    keys = asked.select(bucket(F.col("key")).alias("bucket"), F.col("key").alias("at"), *kind(2, 0), F.lit(0).alias("size"), F.lit(None).cast(edges.schema["load"].dataType).alias("load"), *extra)
    events = edges.select("*", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra]).unionByName(keys).withColumn("depth", F.sum("step").over(sweep))
    levels = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == i), F.col("load")), ignorenulls=True).over(sweep).alias(f"level{i}") for i in range(1, deepest + 1)]
    events = events.select("kind", "depth", F.col("at").alias("key"), *extra, *levels).where("kind = 2 and depth > 0")
    stack = F.slice(F.array(*[F.col(f"level{i}") for i in range(1, deepest + 1)]), F.lit(1), F.col("depth").cast("int")) if deepest else F.array().cast(f"array<{rules.schema['load'].dataType.simpleString()}>")
    return events.select("key", *extra, stack.alias("stack"))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path), as (r_host, r_path, rule, verdict); of two verdicts block wins.

    Rows with a null host, path or verdict are no rules.
    """
    host = F.translate(F.col("host"), UPPER, LOWER)
    return rules.where("host is not null and path is not null and verdict is not null").groupBy(host.alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("r_host", "r_path"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    The longest rule that fits wins (of equally long ones block, then the later by name); urls that
    none fits, null urls and urls without "://" get the default verdict and a null rule. Only
    different hosts are swept, then only different pairs of a rule's host and a path, so a host, a
    path or a url that fills a third of the rows is one key; verdicts go back to the rows by merge
    joins, whose large partitions the adaptive planner splits. Urls of any length are keys like
    others. An empty table of pages gives no rows; without rules all get the default. Other columns
    of pages are not read.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = materialize(canonical_rules(rules), "rules")
    hosts = materialize(judged.select("host").distinct().select("host", reversed_host(F.col("host")).cast("binary").alias("key")), "hosts")
    names = rule.select("r_host").distinct().select(reversed_host(F.col("r_host")).cast("binary").alias("key"), F.col("r_host").alias("load"))
    active = materialize(swept(names, hosts).select("host", "stack"), "stacks")
    asked = judged.select("host", "path").distinct().join(active.hint("merge"), "host").select("host", "path", F.explode("stack").alias("r_host"))
    asked = materialize(asked, "asked")
    key = lambda h, p: F.concat(reversed_host(h).cast("binary"), F.expr(PART), p.cast("binary"))
    known = rule.select(key(F.col("r_host"), F.col("r_path")).alias("key"), F.struct(F.char_length("rule").alias("size"), "verdict", "rule").alias("load"))
    pairs = materialize(asked.select("r_host", "path").distinct().withColumn("key", key(F.col("r_host"), F.col("path"))), "pairs")
    found = materialize(swept(known, pairs).select("r_host", "path", F.try_element_at("stack", F.lit(-1)).alias("top")), "found")
    best = asked.join(found.hint("merge"), ["r_host", "path"]).groupBy("host", "path").agg(F.max("top").alias("top"))
    out = judged.join(materialize(best, "verdicts").hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def _literal(keys: list[bytes]) -> Column:
    return F.array(*[F.expr(f"X'{x.hex()}'") for x in keys]) if keys else F.array().cast("array<binary>")


def _range_of(cuts: list[bytes]):
    """Number of cuts at or below a key, by a search in two steps over at most 64 keys each."""
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::step]

    def bucket(key: Column) -> Column:
        if not cuts:
            return F.lit(0)
        block = F.size(F.filter(_literal(coarse), lambda c: c <= key))
        fine = F.filter(F.slice(_literal(cuts), F.greatest((block - 1) * step + 1, F.lit(1)), step), lambda c: c <= key)
        return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(fine)).cast("int")

    return bucket
