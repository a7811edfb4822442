"""Latent classes of categorical responses by expectation maximisation, as sums made next to the data."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.shared import discard, stored
from tessella.functions.text import inverse_cdf, keyed_uniform
from tessella.operators.arrays import lists, tree_sum, uniform
from tessella.operators.cleaning import is_sensitive
from tessella.operators.running import exact_percentiles
from tessella.operators.statistics import adjusted_rand


#: Combinations of answers that stand as one code, and patterns that a task works on at a time.
COMBINED, HELD = 4096, 1 << 17


class Coding:
    """Answers as places of levels, and sets of answers as one code for each block of questions.

    levels: (column_name, code), sorted; place m + q stands for a row of question q without a known
    code. A block's code tells the answers to all its questions, so that a pattern costs a look per
    block and not one per answer. Where a respondent answers a question twice every level is a block
    of its own and its code says how often.
    """

    def __init__(self, levels: list[tuple[str, float]], names: list[str], most: int = 1):
        m, number = len(levels), {c: q for q, c in enumerate(names)}
        own = [[i for i, (c, _) in enumerate(levels) if number[c] == q] for q in range(len(names))]
        self.levels, self.block, self.weight, self.parts = m, np.zeros(m + len(names), np.int64), np.zeros(m + len(names)), []
        if most > 1:
            self.block[:m], self.weight[:m] = np.arange(m), 1
            self.parts = [([i], [(1, [i])], most + 1, True) for i in range(m)]
            return
        for q, places in enumerate(own):
            size = len(places) + 2
            if not self.parts or self.parts[-1][2] * size > COMBINED:
                self.parts.append(([], [], 1, False))
            held, digits, stride, _ = self.parts[-1]
            at = [*places, m + q]
            self.block[at], self.weight[at] = len(self.parts) - 1, stride * np.arange(1, size)
            self.parts[-1] = (held + places, [*digits, (stride, places)], stride * size, False)

    def codes(self, answers: pa.Array) -> np.ndarray:
        """(row, block) from lists of places."""
        n, g = len(answers), max(len(self.parts), 1)
        at = answers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(answers.offsets.to_numpy()))
        return np.bincount(row * g + self.block[at], self.weight[at], n * g).reshape(n, g).astype(np.int32)

    def tables(self) -> list[tuple[list[int], np.ndarray]]:
        """Of each block its levels and how often each code holds them."""
        out = []
        for held, digits, size, counts in self.parts:
            code, table = np.arange(size), np.zeros((size, len(held)))
            if counts:
                table[:, 0] = code
            for stride, places in () if counts else digits:
                digit = code // stride % (len(places) + 2)
                for j, place in enumerate(places):
                    table[digit == j + 1, held.index(place)] = 1
            out.append((held, table))
        return out


def _gathered(rows: DataFrame, who: list[str], levels: list[tuple[str, float]], names: list[str]) -> tuple[DataFrame, int]:
    """(stored (*who, _at), how often one answers a question at most): each respondent's answers as places, a column of the aggregate per question."""
    spark, m = rows.sparkSession, len(levels)
    kinds = T.StructType([T.StructField("_name", rows.schema["column_name"].dataType), T.StructField("_code", rows.schema["code"].dataType), T.StructField("_level", T.IntegerType())])
    known = spark.createDataFrame([(*x, i) for i, x in enumerate(levels)], kinds)
    asked = F.coalesce(*[F.when(F.col("column_name") == c, m + q) for q, c in enumerate(names)]) if names else F.lit(None).cast("int")
    placed = rows.join(F.broadcast(known), (F.col("column_name") == F.col("_name")) & (F.col("code") == F.col("_code")), "left").withColumn("_at", F.coalesce("_level", asked))
    each = [F.max(F.when(F.col("column_name") == c, F.col("_at"))).alias(f"_q{q}") for q, c in enumerate(names)]
    whole = F.array_compact(F.array(*[F.col(f"_q{q}") for q in range(len(names))])) if names else F.array().cast("array<int>")
    people = placed.groupBy(*who).agg(F.count("_at").alias("_n"), *each).select(*who, whole.cast("array<int>").alias("_at"), (F.col("_n") > F.size(whole)).alias("_twice"))
    people = stored(people, "people")
    if not people.where("_twice").limit(1).count():
        return people, 1
    discard(people)
    people = stored(placed.groupBy(*who).agg(F.sort_array(F.collect_list("_at")).alias("_at")), "people")
    return people, int(people.agg(F.max(F.size("_at"))).first()[0])


class Patterns:
    """Respondents counted by their answers: what a fit reads, stored once for any number of fits."""

    def __init__(self, spark, by: tuple[str, ...], schema: T.StructType, levels: list[tuple[str, float]], names: list[str], most: int, counts: DataFrame):
        """counts: (*by, _at, _w); those without weight are left out."""
        self.spark, self.by, self.schema, self.levels, self.names = spark, by, schema, levels, names
        self.coding = coding = Coding(levels, names, most)
        kinds = T.StructType([T.StructField("_fit", T.StringType()), *[schema[c] for c in by], T.StructField("_b", T.ArrayType(T.IntegerType())), T.StructField("_w", T.DoubleType()), T.StructField("_id", T.LongType())])

        def coded(batches):
            for b in batches:
                codes = coding.codes(b.column("_at"))
                ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
                lists_ = pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("_fit"), *[b.column(c) for c in by], lists_, b.column("_w"), b.column("_id")], ["_fit", *by, "_b", "_w", "_id"])

        key = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
        rows = counts.where("_w > 0").select(key.alias("_fit"), *by, "_at", F.col("_w").cast("double").alias("_w"), F.xxhash64("_at").alias("_id"))
        self.rows = stored(rows.repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("_fit").mapInArrow(coded, kinds), "patterns")
        self.fits = [tuple(r) for r in self.rows.select("_fit", *by).distinct().orderBy("_fit").collect()]


def _known(rows: DataFrame) -> tuple[list[tuple[str, float]], list[str]]:
    """The levels that occur, sorted, and all questions."""
    found = [tuple(r) for r in rows.select("column_name", "code").distinct().collect()]
    return sorted((c, x) for c, x in found if c is not None and x is not None), sorted({c for c, _ in found if c is not None})


def patterns(responses: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> Patterns:
    """Respondents alike in all answers counted (or weighed) once per value of `by`; rows without a respondent are left out."""
    rows = responses.where("respondent_id is not null")
    levels, names = _known(rows)
    people, most = _gathered(rows, [*by, "respondent_id"], levels, names)
    one = (weight if weight is not None else F.lit(1.0)).cast("double")
    counts = people.groupBy(*by, "_at").agg(F.sum(one).alias("_w"))
    found = Patterns(responses.sparkSession, by, responses.select(*by, "column_name", "code").schema, levels, names, most, counts)
    discard(people)
    return found


def _model(parameters: DataFrame, priors: DataFrame, by: tuple[str, ...]):
    """(levels, classes, fits, log-probabilities (fit, level, class), log-priors (fit, class)) as arrays; a level that a fit does not know adds nothing."""
    ps, cs = parameters.select(*by, "column_name", "code", "class", "logp").collect(), priors.select(*by, "class", "logp").collect()
    n = len(by)
    levels, classes, fits = sorted({(r[n], r[n + 1]) for r in ps}), sorted({r[n] for r in cs}), sorted({tuple(r[:n]) for r in cs})
    at, of, fit = ({x: i for i, x in enumerate(xs)} for xs in (levels, classes, fits))
    logp, prior = np.zeros((len(fits), len(levels), len(classes))), np.full((len(fits), len(classes)), -np.inf)
    for r in cs:
        prior[fit[tuple(r[:n])], of[r[n]]] = r[n + 1]
    for r in ps:
        if tuple(r[:n]) in fit and r[n + 2] in of:
            logp[fit[tuple(r[:n])], at[r[n], r[n + 1]], of[r[n + 2]]] = r[n + 3]
    return levels, classes, fits, logp, prior


def _memberships(answers: pa.Array, logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, class) probabilities and log-likelihoods of lists of places under one fit."""
    n, held = len(answers), np.diff(answers.offsets.to_numpy())
    at, row = answers.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n), held)
    on = at < len(logp)
    at, row = at[on], row[on]
    joint = prior + np.stack([np.bincount(row, logp[at, c], n) for c in range(len(prior))], 1)
    top = joint.max(1, keepdims=True)
    loglik = top[:, 0] + np.log(np.exp(joint - top).sum(1))
    return np.exp(joint - loglik[:, None]), loglik


def posteriors(responses: DataFrame, parameters: DataFrame, priors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(respondent_id, class, p, loglik): class probabilities of each respondent, missing answers left out.

    parameters: (class, column_name, code, logp); priors: (class, logp); all with the columns `by`
    where several fits are kept side by side. New respondents may be given; a code never seen is
    treated as missing. Parameters come to the driver, as they were made there.
    """
    who = [*by, "respondent_id"]
    levels, classes, fits, logp, prior = _model(parameters, priors, by)
    people, _ = _gathered(responses, who, levels, sorted({c for c, _ in levels}))
    number, k = {f: i for i, f in enumerate(fits)}, len(classes)
    kind = priors.schema["class"].dataType
    schema = T.StructType([*[people.schema[c] for c in who], T.StructField("class", kind), T.StructField("p", T.DoubleType()), T.StructField("loglik", T.DoubleType())])

    def each(batches):
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in by])) if by else [()] * b.num_rows
            fit = np.array([number.get(x, -1) for x in keys], np.int64)
            for f in np.unique(fit[fit >= 0]):
                part = b.filter(pa.array(fit == f)) if len(fits) > 1 else b
                p, loglik = _memberships(part.column("_at"), logp[f], prior[f])
                many = part.take(pa.array(np.repeat(np.arange(len(p)), k)))
                from pyspark.sql.pandas.types import to_arrow_type

                named = pa.array(classes * len(p), to_arrow_type(kind))
                yield pa.RecordBatch.from_arrays([*[many.column(c) for c in who], named, pa.array(p.ravel()), pa.array(np.repeat(loglik, k))], [*who, "class", "p", "loglik"])

    # a respondent without a name has no answers of its own
    rows = people.select(*who, F.when(F.col("respondent_id").isNull(), F.array().cast("array<int>")).otherwise(F.col("_at")).alias("_at"))
    return rows.mapInArrow(each, schema)


def _round(keys: list[str], coding: Coding, k: int, starts: int, model: tuple[np.ndarray, np.ndarray] | None, going: np.ndarray, salts: list[int]):
    """A partition's sums per fit and start: class-major weights of the levels, sizes of the classes, log-likelihood.

    model: log-probabilities (fit and start, level, class) and log-priors (fit and start, class);
    without one the memberships are those to start from, drawn for each pattern by its key. Only
    those that are going are made.
    """
    number = {f: i for i, f in enumerate(keys)}
    levels = coding.levels

    def sums(batches):
        total, met = np.zeros((len(keys) * starts, k * levels + k + 1)), np.zeros(len(keys) * starts, bool)
        tables, waiting, held = coding.tables(), {}, 0

        def work():
            for f, parts in waiting.items():
                codes, w, ids = (np.concatenate(x) for x in zip(*parts))
                codes = np.ascontiguousarray(codes.T)
                for s in np.flatnonzero(going[f * starts : (f + 1) * starts]):
                    x = f * starts + s
                    if model is None:
                        p = [uniform(ids, salts[x], c) + 0.1 for c in range(k)]
                        whole = sum(p[1:], p[0])
                        p = [y / whole * w for y in p]
                    else:
                        joint = [np.full(len(w), model[1][x, c]) for c in range(k)]
                        for (own, table), code in zip(tables, codes):
                            worth = table @ model[0][x, own]
                            for c in range(k):
                                joint[c] += worth[code, c]
                        top = joint[0]
                        for y in joint[1:]:
                            top = np.maximum(top, y)
                        p = [np.exp(y - top) for y in joint]
                        whole = sum(p[1:], p[0])
                        total[x, -1] += w @ (top + np.log(whole))
                        p = [y * (w / whole) for y in p]
                    for c in range(k):
                        for (own, table), code in zip(tables, codes):
                            total[x, c * levels + np.array(own, int)] += np.bincount(code, p[c], len(table)) @ table
                        total[x, k * levels + c] += p[c].sum()
                    met[x] = True
            waiting.clear()

        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).dictionary_encode()
            every = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
            codes, w, ids = lists(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            for f in np.unique(every):
                on = every == f
                waiting.setdefault(int(f), []).append((codes[on], w[on], ids[on]))
            held += b.num_rows
            if held >= HELD:
                work()
                held = 0
        work()
        for f in np.flatnonzero(met):
            yield int(f), total[f]

    return sums


def fit_many(responses: DataFrame, k: int, by: tuple[str, ...] = (), weight: Column | None = None, rounds: int = 250, tolerance: float = 1e-6, seed: int = 1, starts: int = 1):
    """fit_patterns of the respondents' patterns. weight: how often a respondent counts."""
    found = patterns(responses, by, weight)
    out = fit_patterns(found, k, rounds, tolerance, seed, starts)
    discard(found.rows)
    return out


def fit_patterns(found: Patterns, k: int, rounds: int = 250, tolerance: float = 1e-6, seed: int = 1, starts: int = 1):
    """(parameters, priors, logliks) of one fit per value of `by`, the likeliest of several starts (the first of equals), all in the same jobs.

    Respondents alike in all answers are one pattern with their number, so a round reads each
    pattern once however many respondents there are. It is one pass without a join, for all fits and
    starts: memberships and their sums are made in Arrow batches next to the data, partitions' sums
    are added in a tree as arrays, and fits times starts times classes times levels numbers reach the
    driver, never a respondent. Each start has keyed random memberships, the same for the same
    patterns and seed. They are drawn for patterns and not for respondents, whose mean over many
    alike would be an even membership, from which no class departs.
    Of three rounds two are plain
    steps and one is taken from a squared extrapolation of both; where that is less likely than the
    plain steps, these stand. A fit ends once a plain step gains less than tolerance of its
    log-likelihood, or after rounds passes with the likeliest model met; only the others' patterns
    are read again. Rows without a respondent are left out; a level that no weight falls on counts
    as missing.
    """
    spark, by, levels, fits = found.spark, found.by, found.levels, found.fits
    kinds = found.schema
    schema = T.StructType([*[kinds[c] for c in by], T.StructField("class", T.IntegerType()), kinds["column_name"], kinds["code"], T.StructField("logp", T.DoubleType())])
    salts = [zlib.crc32("|".join([str(seed), *([f[0]] if by else []), *([str(x + 1)] if starts > 1 else [])]).encode()) for f in fits for x in range(starts)]
    people = found.rows
    n, m = len(fits) * starts, len(levels)
    names = sorted({c for c, _ in levels})
    column = np.array([names.index(c) for c, _ in levels], int)
    cut = k * m

    def normal(weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row per fit: the shares of each column's levels in each class, then the classes' shares."""
        total = np.zeros((n, len(names), k))
        np.add.at(total, (slice(None), column), weights * seen[:, :, None])
        p = np.where(seen[:, :, None], np.maximum(weights / np.maximum(total[:, column], 1e-300), 1e-12), 1.0)
        return np.hstack([p.reshape(n, cut), np.maximum(sizes / np.maximum(sizes.sum(1, keepdims=True), 1e-300), 1e-12)])

    def split(model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return model[:, :cut].reshape(len(model), m, k), model[:, cut:]

    model, best, logliks, going = None, np.ones((n, cut + k)), np.full(n, -np.inf), np.ones(n, bool)
    seen, reach = np.zeros((n, m), bool), np.full(n, 4.0)
    for turn in range(rounds + 1 if fits else 0):
        live = going.reshape(-1, starts).any(1)
        some = people if live.all() else people.where(F.col("_fit").isin([f[0] for f, g in zip(fits, live) if g]))
        added = tree_sum(some.select("_fit", "_b", "_w", "_id"), _round([f[0] for f in fits], found.coding, k, starts, None if model is None else split(np.log(model)), going, salts))
        sums = np.zeros((n, cut + k + 1))
        for f, x in added.items():
            sums[f] = x
        weights, now = sums[:, :cut].reshape(n, k, m).transpose(0, 2, 1), sums[:, -1]
        if model is None:
            seen = weights.sum(2) > 0
            model = normal(weights, sums[:, cut : cut + k])
            continue
        better = going & (now >= logliks)
        best[better], logliks = model[better], np.where(better, now, logliks)
        step = normal(weights, sums[:, cut : cut + k])
        if turn % 3 == 1:
            base, before, model = model, now, step
        elif turn % 3 == 2:
            going = going & (now - before > tolerance * np.maximum(1.0, np.abs(now)))
            if not going.any():
                break
            # along the curve of the last two steps; a length of 1 is the plain step
            change, plain, before = model - base, step, now
            bend = step - model - change
            length = np.clip(np.sqrt((change**2).sum(1) / np.maximum((bend**2).sum(1), 1e-300)), 1.0, reach)
            far = length[:, None]
            model = normal(*(np.maximum(x, 1e-12) for x in split(base + 2 * far * change + far**2 * bend)))
        else:
            worse = now < before
            reach = np.where(worse, np.maximum(reach / 4, 1.0), np.where(length == reach, reach * 4, reach))
            model = np.where(worse[:, None], plain, step)
    likeliest = logliks.reshape(-1, starts).argmax(1) + np.arange(len(fits)) * starts
    logp, prior = split(np.log(best[likeliest]))
    logliks, seen = logliks[likeliest], seen[likeliest]
    parameters = [(*f[1:], c, *levels[i], float(logp[j, i, c])) for j, f in enumerate(fits) for i in range(m) if seen[j, i] for c in range(k)]
    classes = [(*f[1:], c, float(prior[j, c])) for j, f in enumerate(fits) for c in range(k)]
    small = T.StructType([f for f in schema if f.name not in ("column_name", "code")])
    found = {f[1:]: float(logliks[j]) for j, f in enumerate(fits)}
    return spark.createDataFrame(parameters, schema), spark.createDataFrame(classes, small), found


def fit_latent_classes(responses: DataFrame, k: int, rounds: int = 250, tolerance: float = 1e-6, seed: int = 1, starts: int = 1):
    """(parameters, priors, loglik) of the best of several starts; the first of equals wins."""
    parameters, priors, logliks = fit_many(responses, k, (), None, rounds, tolerance, seed, starts)
    return parameters, priors, logliks.get((), 0.0)


def hard_labels(post: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(respondent_id, label, certainty): likeliest class, smallest on ties."""
    return post.groupBy(*by, "respondent_id").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("label"), F.max("p").alias("certainty"))


def question_pools(value: DataFrame, asked: DataFrame) -> DataFrame:
    """(pool, column_name, rank): pool `all` and pool `non_sensitive`, each ranked from its most telling question on.

    value: (column_name, value); asked: (column_name, question, sub_question), which the rule of
    sensitive topics reads; a question without texts is judged by its name alone. Ties go by name, a
    null value comes last, and questions that only asked holds are in neither pool.
    """
    texts = asked.groupBy("column_name").agg(F.max(is_sensitive(F.col("question"), F.col("sub_question"), F.col("column_name"))).alias("sensitive"))
    known = value.join(texts, "column_name", "left").withColumn("sensitive", F.coalesce("sensitive", is_sensitive(F.lit(None), F.lit(None), F.col("column_name"))))
    pools = known.withColumn("pool", F.explode(F.when(F.col("sensitive"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("non_sensitive")))))
    return pools.select("pool", "column_name", F.row_number().over(Window.partitionBy("pool").orderBy(F.col("value").desc_nulls_last(), "column_name")).alias("rank"))


def certainty_curve(responses: DataFrame, parameters: DataFrame, priors: DataFrame, ranked: DataFrame, most: int = 15) -> DataFrame:
    """(pool, n, mean, median, above_09): certainty when only the first n questions of a pool are answered.

    ranked: (pool, column_name, rank from 1). Respondents alike in all answers are judged once, and
    all pools and sizes in one pass over their patterns; who has no row for any of the first n
    questions does not count at n.
    """
    levels, classes, _, logp, prior = _model(parameters, priors, ())
    first = [(r["pool"], r["column_name"], r["rank"]) for r in ranked.where(F.col("rank") <= most).select("pool", "column_name", "rank").collect()]
    names, m = sorted({c for c, _ in levels} | {c for _, c, _ in first}), len(levels)
    people, _ = _gathered(responses, ["respondent_id"], levels, names)
    alike = people.groupBy("_at").agg(F.count(F.lit(1)).alias("_w"))
    question = np.array([names.index(c) for c, _ in levels] + list(range(len(names))), int)
    sizes = sorted({(pool, n) for pool, _, rank in first for n in range(rank, most + 1)})
    shown = {x: np.isin(question, [names.index(c) for pool, c, rank in first if pool == x[0] and rank <= x[1]]) for x in sizes}

    def judge(batches):
        for b in batches:
            answers, w = b.column(0), b.column(1)
            at, row = answers.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(b.num_rows), np.diff(answers.offsets.to_numpy()))
            for (pool, n), use in shown.items():
                on = use[at]
                count = np.bincount(row[on], minlength=b.num_rows)
                some = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(at[on].astype(np.int32)))
                p, _ = _memberships(some, logp[0], prior[0])
                here = pa.array(count > 0)
                yield pa.RecordBatch.from_arrays([pa.array([pool] * b.num_rows, pa.string()).filter(here), pa.array([n] * b.num_rows, pa.int32()).filter(here), pa.array(p.max(1)).filter(here), w.filter(here)], ["pool", "n", "certainty", "w"])

    c, w = F.col("certainty"), F.col("w")
    judged = alike.repartition(responses.sparkSession.sparkContext.defaultParallelism).mapInArrow(judge, "pool string, n int, certainty double, w long")
    found = stored(judged.groupBy(F.struct("pool", "n").alias("fit"), "certainty").agg(F.sum("w").alias("w")))
    middle = exact_percentiles(found, "fit", "certainty", {"median": 0.5}, "w")
    means = found.groupBy("fit").agg((F.sum(c * w) / F.sum(w)).alias("mean"), (F.sum((c > 0.9).cast("double") * w) / F.sum(w)).alias("above_09"))
    return means.join(middle, "fit").select("fit.*", "mean", "median", "above_09")


def poisson_one(*keys: Column, seed: int = 1) -> Column:
    """How often a respondent is drawn into a resample: Poisson with mean 1, from a keyed draw."""
    chances = F.array(*[F.lit(math.exp(-1) / math.factorial(i)) for i in range(12)])
    return inverse_cdf(chances, keyed_uniform(*keys, seed=seed)).cast("double")


def _poisson_of(u: Column) -> Column:
    """poisson_one of a draw that is made already: the first running sum that exceeds it, without a loop over them."""
    upto, passed = 0.0, []
    for i in range(11):
        upto += math.exp(-1) / math.factorial(i)
        passed.append(F.when(u >= F.lit(upto), 1.0).otherwise(0.0))
    return sum(passed[1:], passed[0])


def bootstrap_stability(responses: DataFrame, original: DataFrame, k: int, replicates: int = 50, rounds: int = 250, seed: int = 1, starts: int = 3) -> DataFrame:
    """(replicate, ari): agreement of classes refitted on resamples with the original (respondent_id, label).

    Respondents are read once: their draws are summed by replicate over those alike in all answers
    and in the original label. Replicates are fitted side by side on these patterns; each then labels
    every pattern of the full data.
    """
    spark, rows = responses.sparkSession, responses.where("respondent_id is not null")
    levels, names = _known(rows)
    people, most = _gathered(rows, ["respondent_id"], levels, names)
    who, draws = F.col("respondent_id"), {r: f"_u{r}" for r in range(1, replicates + 1)}
    drawn = people.join(original.select("respondent_id", F.col("label").alias("_x")), "respondent_id", "left")
    drawn = drawn.select("_at", "_x", *[keyed_uniform(F.lit(r), who, seed=seed).alias(u) for r, u in draws.items()])
    summed = drawn.groupBy("_at", "_x").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(_poisson_of(F.col(u))).alias(u) for u in draws.values()])
    cells = stored(summed.select("_at", "_x", "_n", F.array(*draws.values()).alias("_draws")), "cells")
    counts = cells.select("_at", F.posexplode("_draws").alias("_r", "_w")).groupBy((F.col("_r") + 1).alias("replicate"), "_at").agg(F.sum("_w").alias("_w"))
    schema = T.StructType([T.StructField("replicate", T.IntegerType()), *responses.select("column_name", "code").schema.fields])
    found = Patterns(spark, ("replicate",), schema, levels, names, most, counts)
    parameters, priors, _ = fit_patterns(found, k, rounds, seed=seed, starts=starts)
    known, classes, fits, logp, prior = _model(parameters, priors, ("replicate",))
    place = np.array([known.index(x) if x in known else -1 for x in levels] + [-1] * len(names), int)
    replicate = [f[0] for f in fits]

    def label(batches):
        for b in batches:
            answers = b.column(0)
            at = place[answers.flatten().to_numpy().astype(np.int64)]
            row = np.repeat(np.arange(b.num_rows), np.diff(answers.offsets.to_numpy()))[at >= 0]
            count = np.bincount(row, minlength=b.num_rows)
            some = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(at[at >= 0].astype(np.int32)))
            for f, r in enumerate(replicate):
                y = np.array(classes, np.int32)[_memberships(some, logp[f], prior[f])[0].argmax(1)]
                yield pa.RecordBatch.from_arrays([pa.array([r] * b.num_rows, pa.int32()), b.column(1), pa.array(y), b.column(2)], ["replicate", "x", "y", "n"])

    kind = original.schema["label"].dataType.simpleString()
    labels = cells.where("_x is not null").select("_at", "_x", "_n").mapInArrow(label, f"replicate int, x {kind}, y int, n long")
    agreed = stored(labels.groupBy("replicate", "x", "y").agg(F.sum("n").alias("n")), "agreement")
    discard(people, found.rows, cells)
    return adjusted_rand(agreed, ("replicate",), "n")


def simulate(parameters: DataFrame, priors: DataFrame, respondents: DataFrame, by: tuple[str, ...] = (), seed: int = 1) -> DataFrame:
    """(respondent_id, column_name, code): complete responses drawn from a fitted model, by keyed draws."""
    who = [F.col(c) for c in (*by, "respondent_id")]
    listed = F.sort_array(F.collect_list(F.struct(F.col("class").alias("v"), F.exp("logp").alias("p"))))
    classes = priors.agg(listed.alias("l"))
    pick = inverse_cdf(F.col("l.p"), keyed_uniform(F.lit("class"), *who, seed=seed))
    drawn = respondents.select(*who).join(classes).select(*who, F.get("l", pick)["v"].alias("class"))
    codes = parameters.groupBy("class", "column_name").agg(F.sort_array(F.collect_list(F.struct(F.col("code").alias("v"), F.exp("logp").alias("p")))).alias("l"))
    pick = inverse_cdf(F.col("l.p"), keyed_uniform(F.col("column_name"), *who, seed=seed))
    return drawn.join(codes, "class").select(*who, "column_name", F.get("l", pick)["v"].alias("code"))


def simulated_counts(spark, parameters: DataFrame, priors: DataFrame, respondents: int, replicates: int, seed: int = 1) -> tuple[DataFrame, list, list]:
    """((replicate, _at, _w), levels, questions): how many of so many respondents give each set of answers, drawn from a fitted model.

    Drawing each respondent's class and answers and counting those alike gives multinomial counts, so
    these are drawn as such: a replicate's respondents are dealt to the classes, then split question
    by question, until every set of answers that occurs has its number. The draws depend on seed,
    replicate, class and the answers before. A task holds HELD sets at a time and goes depth first;
    the sets of the first half of the questions are dealt out again before the others are split.
    """
    levels, classes, _, logp, prior = _model(parameters, priors, ())
    names = sorted({c for c, _ in levels})
    own = [[i for i, (c, _) in enumerate(levels) if c == name] for name in names]
    chance = [[np.exp(logp[0][places, c]) / np.exp(logp[0][places, c]).sum() for places in own] for c in range(len(classes))]
    share = np.exp(prior[0]) / np.exp(prior[0]).sum()
    dealt = [(r, c, int(n)) for r in range(1, replicates + 1) for c, n in enumerate(np.random.default_rng([seed, r]).multinomial(respondents, share)) if n]
    start = spark.createDataFrame([(r, c, [], n) for r, c, n in dealt], "replicate int, class int, _at array<int>, _w long")

    def split(first: int, last: int):
        def grow(rng, c: int, at: np.ndarray, w: np.ndarray):
            for i in range(0, len(w), HELD):
                some, n = at[i : i + HELD], w[i : i + HELD]
                if some.shape[1] == last:
                    yield some, n
                    continue
                q = some.shape[1]
                counts = rng.multinomial(n, chance[c][q])
                row, level = np.nonzero(counts)
                yield from grow(rng, c, np.hstack([some[row], np.array(own[q], np.int32)[level][:, None]]), counts[row, level])

        def run(batches):
            for b in batches:
                for r, c, at, w in zip(*[b.column(x).to_pylist() for x in ("replicate", "class", "_at", "_w")]):
                    for sets, n in grow(np.random.default_rng([seed, r, c, *at]), c, np.array([at], np.int32).reshape(1, first), np.array([w], np.int64)):
                        ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * last)
                        yield pa.RecordBatch.from_arrays([pa.array([r] * len(n), pa.int32()), pa.array([c] * len(n), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(sets.ravel().astype(np.int32))), pa.array(n)], ["replicate", "class", "_at", "_w"])

        return run

    kind, half, width = "replicate int, class int, _at array<int>, _w long", len(names) // 2, 4 * spark.sparkContext.defaultParallelism
    begun = start.repartition(width, "replicate", "class").mapInArrow(split(0, half), kind)
    sets = stored(begun.repartition(width).mapInArrow(split(half, len(names)), kind), "sets")
    return sets.groupBy("replicate", "_at").agg(F.sum("_w").alias("_w")), levels, names


def bootstrap_ratio_test(responses: DataFrame, k: int, replicates: int = 30, rounds: int = 250, tolerance: float = 1e-6, seed: int = 1, starts: int = 2) -> dict[str, float]:
    """Likelihood ratio of k against k + 1 classes and its p-value from responses simulated under k classes.

    All four kinds of fits end by the same tolerance, so that their ratios compare. Respondents are
    read once; simulated ones are drawn as numbers of respondents alike.
    """
    spark, found = responses.sparkSession, patterns(responses)
    parameters, priors, few = fit_patterns(found, k, rounds, tolerance, seed, starts)
    _, _, more = fit_patterns(found, k + 1, rounds, tolerance, seed, starts)
    n = int(found.rows.agg(F.sum("_w")).first()[0] or 0)
    counts, levels, names = simulated_counts(spark, parameters, priors, n, replicates, seed)
    schema = T.StructType([T.StructField("replicate", T.IntegerType()), *responses.select("column_name", "code").schema.fields])
    drawn = Patterns(spark, ("replicate",), schema, levels, names, 1, counts)
    _, _, a = fit_patterns(drawn, k, rounds, tolerance, seed, starts)
    _, _, b = fit_patterns(drawn, k + 1, rounds, tolerance, seed, starts)
    discard(found.rows, drawn.rows)
    observed = 2 * (more.get((), 0.0) - few.get((), 0.0))
    return {"ratio": observed, "p": (1 + sum(2 * (b[f] - a[f]) >= observed for f in a)) / (1 + len(a))}


def model_selection(responses: DataFrame, most: int = 6, starts: int = 2, rounds: int = 250, seed: int = 1) -> DataFrame:
    """(k, loglik, parameters, aic, bic, bic_gap, best) for 1 to `most` classes; best: the smallest BIC's k. Respondents are read once."""
    rows, found, size = [], patterns(responses), _size(responses)
    for k in range(1, most + 1):
        _, _, logliks = fit_patterns(found, k, rounds, seed=seed, starts=starts)
        loglik = logliks.get((), 0.0)
        ic = _criteria(*size, k, loglik)
        rows.append((k, float(loglik), int(ic["parameters"]), float(ic["aic"]), float(ic["bic"])))
    discard(found.rows)
    table = responses.sparkSession.createDataFrame(rows, "k int, loglik double, parameters int, aic double, bic double")
    w = Window.partitionBy()
    return table.withColumn("bic_gap", F.col("bic") - F.min("bic").over(w)).withColumn("best", F.min_by("k", F.struct("bic", "k")).over(w))


def fit_table(sweep: DataFrame) -> DataFrame:
    """A sweep's gaps to the best AIC and BIC, the k of the smallest BIC, and the likelihood ratio of each k against the k before (null for the first)."""
    w = Window.partitionBy()
    ratio = 2 * (F.col("loglik") - F.lag("loglik").over(Window.orderBy("k")))
    best = F.min_by("k", F.struct("bic", "k")).over(w)
    return sweep.select("k", "aic", "bic", (F.col("aic") - F.min("aic").over(w)).alias("aic_delta"), (F.col("bic") - F.min("bic").over(w)).alias("bic_delta"), best.alias("best"), ratio.alias("ratio"))


def _size(responses: DataFrame) -> tuple[int, int]:
    """Free levels of all questions, and respondents."""
    row = responses.where("code is not null").groupBy("column_name").agg((F.countDistinct("code") - 1).alias("d")).agg(F.sum("d").alias("d")).first()
    return row["d"] or 0, responses.select("respondent_id").distinct().count()


def _criteria(free_levels: int, n: int, k: int, loglik: float) -> dict[str, float]:
    free = k * free_levels + k - 1
    return {"parameters": free, "aic": 2 * free - 2 * loglik, "bic": free * math.log(max(n, 1)) - 2 * loglik}


def information_criteria(responses: DataFrame, k: int, loglik: float) -> dict[str, float]:
    """AIC and BIC with k * sum(levels - 1) + k - 1 free parameters."""
    return _criteria(*_size(responses), k, loglik)
