"""Clusterings of responses and embeddings, the space they live in, their repair and comparison.

Only parameters come to the driver: modes, means, level-by-level tables. Their size depends on the
number of questions, levels, dimensions and clusters, never on the number of respondents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.shared import discard, stored
from tessella.operators import latent as LA
from tessella.operators import statistics as ST
from tessella.operators.arrays import lists, tree_sum, uniform
from tessella.operators.running import running

#: Level of a missing answer where missing is a level of its own.
MISSING = -5.0


def _levels(responses: DataFrame) -> DataFrame:
    return responses.select("respondent_id", "column_name", F.coalesce("code", F.lit(MISSING)).alias("code"))


# ------------------------------------------------------------------ K-Modes


def _answers(responses: DataFrame) -> tuple[DataFrame, list[tuple[str, float]], np.ndarray, np.ndarray, list[str]]:
    """(stored (respondent_id, at), levels, their counts, their questions' places, questions): answers as places of levels, by question.

    Levels and their counts reach the driver, respondents do not. A question that a respondent has
    no row for counts as missing.
    """
    rows = _levels(responses)
    ones = rows.groupBy("column_name", "code").agg(F.count(F.lit(1)).alias("n")).orderBy("column_name", "code").toArrow().to_pylist()
    names = sorted({r["column_name"] for r in ones})
    n = rows.select("respondent_id").distinct().count()
    counts = {(r["column_name"], r["code"]): r["n"] for r in ones}
    for c in names:  # respondents without a row
        if short := n - sum(k for (name, _), k in counts.items() if name == c):
            counts[(c, MISSING)] = counts.get((c, MISSING), 0) + max(short, 0)
    levels = sorted(x for x, k in counts.items() if k > 0)
    number = {x: i for i, x in enumerate(levels)}
    column = np.array([names.index(c) for c, _ in levels], int)
    spark, kind = responses.sparkSession, rows.schema["code"].dataType.simpleString()
    places = spark.createDataFrame([(*x, i, names.index(x[0])) for x, i in number.items()], f"column_name string, code {kind}, _at int, _q int")
    filled = [number.get((c, MISSING), -1) for c in names]
    marks = F.map_from_entries(F.collect_list(F.struct("_q", "_at")))
    whole = F.transform(F.array(*[F.lit(x) for x in filled]), lambda x, i: F.coalesce(F.element_at("m", i), x)) if names else F.array().cast("array<int>")
    people = rows.join(F.broadcast(places), ["column_name", "code"]).groupBy("respondent_id").agg(marks.alias("m")).select("respondent_id", whole.alias("at"))
    return stored(people, "answers"), levels, np.array([counts[x] for x in levels], float), column, names


def _mismatches(at: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """(row, start, label): answers that differ from the mode."""
    out = np.zeros((len(at), *modes.shape[:2]), np.int32)
    for q in range(at.shape[1]):
        out += at[:, q, None, None] != modes[None, :, :, q]
    return out


def _first_modes(people: DataFrame, counts: np.ndarray, column: np.ndarray, questions: int, k: int, starts: int, seed: int) -> np.ndarray:
    """(start, label, question): codes drawn by how often they occur, then the respondent nearest to each such mode, no respondent twice.

    All starts take one pass: each task tells the k nearest respondents of each mode.
    """
    drawn = np.zeros((starts, k, questions), np.int64)
    for s in range(starts):
        rng = np.random.default_rng([seed, s])
        for q in range(questions):
            own = np.flatnonzero(column == q)
            drawn[s, :, q] = rng.choice(own, k, p=counts[own] / counts[own].sum())

    def near(batches):
        found = {}
        for b in batches:
            at, who = lists(b.column(1)), b.column(0).to_pylist()
            if not who:
                continue
            cost = _mismatches(at, drawn)
            for s in range(starts):
                for c in range(k):
                    for i in np.argsort(cost[:, s, c], kind="stable")[:k] if len(who) > 4 * k else range(len(who)):
                        found.setdefault((s, c), []).append((int(cost[i, s, c]), who[i], at[i].tolist()))
                    found[s, c] = sorted(found[s, c])[:k]
        rows = [(s, c, *x) for (s, c), xs in found.items() for x in xs]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], kind), pa.array(cols[4], pa.list_(pa.int32()))], ["start", "label", "cost", "who", "at"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(people.schema["respondent_id"].dataType)
    near_rows = people.mapInArrow(near, f"start int, label int, cost long, who {people.schema['respondent_id'].dataType.simpleString()}, at array<int>")
    place = F.row_number().over(Window.partitionBy("start", "label").orderBy("cost", "who"))
    modes, taken = drawn.copy(), {s: set() for s in range(starts)}
    for r in near_rows.withColumn("r", place).where(F.col("r") <= k).orderBy("start", "label", "r").collect():
        key = (r["start"], r["label"])
        if key not in taken and r["who"] not in taken[r["start"]]:
            modes[key] = r["at"]
            taken[r["start"]].add(r["who"])
            taken[key] = True
    return modes


def k_modes(responses: DataFrame, k: int, starts: int = 10, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(respondent_id, label, cost) of the cheapest of several starts; missing is a level of its own.

    A start draws a mode for each cluster by the frequencies of the codes and takes the respondents
    nearest to these. A round assigns everyone to the mode with the fewest mismatches (smallest label
    on ties), then takes each cluster's commonest code (smallest on ties; a cluster without members
    keeps its mode). A start stops when its cost no longer falls. All starts share each pass: counts
    of starts x clusters x levels are made in the tasks and added in a tree.
    """
    people, levels, counts, column, names = _answers(responses)
    kind = people.schema["respondent_id"].dataType.simpleString()
    if not levels:
        return responses.sparkSession.createDataFrame([], f"respondent_id {kind}, label int, cost int")
    modes = _first_modes(people, counts, column, len(names), k, starts, seed)
    least, best = np.full(starts, np.inf), modes.copy()
    last, going = least.copy(), np.ones(starts, bool)
    size, m = len(levels), len(names)
    for _ in range(rounds):

        def count(batches, modes=modes, going=np.flatnonzero(going)):
            total, cost = np.zeros((len(going), k, size)), np.zeros(len(going))
            for b in batches:
                at = lists(b.column(1))
                if not len(at):
                    continue
                away = _mismatches(at, modes[going])
                label = away.argmin(2)
                cost += np.take_along_axis(away, label[:, :, None], 2)[:, :, 0].sum(0)
                for s in range(len(going)):
                    spots = label[:, s, None] * size + at
                    total[s] += np.bincount(spots.ravel(), minlength=k * size).reshape(k, size)
            yield 0, np.concatenate([cost, total.ravel()])

        found = tree_sum(people, count)[0]
        on = np.flatnonzero(going)
        cost, total = found[: len(on)], found[len(on) :].reshape(len(on), k, size)
        better = cost < least[on]
        best[on[better]], least[on[better]] = modes[on[better]], cost[better]
        going[on] = cost < last[on]
        last[on] = cost
        if not going.any():
            break
        for s, t in zip(on, total):
            for q in range(m):
                own = np.flatnonzero(column == q)
                some = t[:, own].sum(1) > 0
                modes[s, some, q] = own[t[some][:, own].argmax(1)]
    chosen = best[int(np.argmin(least))][None]

    def assign(batches):
        for b in batches:
            away = _mismatches(lists(b.column(1)), chosen)[:, 0] if b.num_rows else np.zeros((0, k), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(away.argmin(1).astype(np.int32)), pa.array(away.min(1, initial=2**31 - 1).astype(np.int32))], ["respondent_id", "label", "cost"])

    return people.mapInArrow(assign, f"respondent_id {kind}, label int, cost int")


# ------------------------------------------------------------------ levels against levels


#: Columns of a block that is multiplied in one pass, beyond those asked for; passes at most.
SPARE, PASSES = 10, 30


def _product(people: DataFrame, w: np.ndarray) -> np.ndarray:
    """Z'Zw of the respondents' level indicators Z: each task adds its respondents' rows of Zw to their levels."""

    def sums(batches):
        total = np.zeros(w.shape)
        for b in batches:
            at = lists(b.column(1))
            if len(at):
                rows = sum(w[at[:, q]] for q in range(at.shape[1]))
                for q in range(at.shape[1]):
                    np.add.at(total, at[:, q], rows)
        yield 0, total.ravel()

    return tree_sum(people, sums)[0].reshape(w.shape)


def _largest(people: DataFrame, scale: np.ndarray, factor: float, away: np.ndarray, k: int, tolerance: float = 1e-10, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest values and vectors of scale * (factor Z'Z - away away') * scale, by block Krylov steps.

    A pass multiplies one block of columns; the blocks so far span the space in which the values are
    taken, until the k largest no longer move. Levels times the block's width numbers reach the
    driver in a pass. With fewer levels than the block is wide one pass gives all.
    """
    size, width = len(scale), k + SPARE
    block = np.eye(size) if size <= width else np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    basis = image = np.zeros((size, 0))
    values = vectors = None
    for _ in range(PASSES):
        scaled = scale[:, None] * block
        made = scale[:, None] * (factor * _product(people, scaled) - np.outer(away, away @ scaled))
        basis, image = np.hstack([basis, block]), np.hstack([image, made])
        inner = basis.T @ image
        found, turned = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-found)[:k]
        before, values, vectors = values, found[order], basis @ turned[:, order]
        if basis.shape[1] >= size or before is not None and np.abs(values - before).max() <= tolerance * max(abs(values[0]), 1e-300):
            break
        rest = made - basis @ (basis.T @ made)
        rest -= basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        block = u[:, s > 1e-12 * max(s[0], 1e-300)][:, : size - basis.shape[1]] if len(s) and s[0] > 1e-14 else u[:, :0]
        if not block.shape[1]:
            break
    return values, vectors


def _place(people: DataFrame, weights: np.ndarray, shift: np.ndarray) -> DataFrame:
    """(respondent_id, coordinates): the sum of the weights of a respondent's levels, less a shift."""

    def put(batches):
        for b in batches:
            at = lists(b.column(1))
            x = sum((weights[at[:, q]] for q in range(at.shape[1])), np.zeros((len(at), weights.shape[1]))) - shift
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * weights.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["respondent_id", "coordinates"])

    return people.mapInArrow(put, f"respondent_id {people.schema['respondent_id'].dataType.simpleString()}, coordinates array<double>")


def correspondence(responses: DataFrame, most: int = 50, keep: float = 0.7) -> tuple[DataFrame, list[float], float]:
    """Multiple correspondence analysis: row coordinates, kept inertias, total inertia.

    At most `most` components are fitted; the first ones that reach the share `keep` of the fitted
    inertia (not of the total) are kept. Signs are arbitrary. Missing is a level of its own, as is a
    question without a row. An empty table has no coordinates. Only counts of levels and blocks of
    levels times components reach the driver.
    """
    people, levels, counts, _, names = _answers(responses)
    if not levels:
        return people.select("respondent_id", F.array().cast("array<double>").alias("coordinates")), [], 0.0
    q = len(names)
    n = counts.sum() / q
    mass = counts / (n * q)
    root = np.sqrt(mass)
    k = max(1, min(most, len(levels) - q))
    values, vectors = _largest(people, 1 / root, 1 / (n * q * q), mass, k)
    fitted = np.maximum(values, 0)
    kept = int(np.searchsorted(np.cumsum(fitted) / max(fitted.sum(), 1e-300), keep) + 1)
    return _place(people, vectors[:, :kept] / root[:, None] / q, np.zeros(min(kept, k))), [float(v) for v in values[:kept]], len(levels) / q - 1


def one_hot_components(responses: DataFrame, k: int = 5) -> tuple[DataFrame, list[float]]:
    """Principal components of the standardised level indicators: scores and explained shares.

    The correlations of the indicators are only multiplied, so neither a wide table nor a table of
    level pairs is made. A level that everybody has does not vary and is left out.
    """
    people, levels, counts, column, names = _answers(responses)
    n = counts.sum() / max(len(names), 1)
    p = counts / max(n, 1)
    varies = (p > 0) & (p < 1)
    if not varies.any():
        return people.select("respondent_id", F.array().cast("array<double>").alias("coordinates")).limit(0), []
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, p * (1 - p), 1)), 0.0)
    values, vectors = _largest(people, scale, 1 / n, p, min(k, int(varies.sum())))
    weights = vectors * scale[:, None]
    return _place(people, weights, p @ weights), [float(v) for v in values / varies.sum()]


# ------------------------------------------------------------------ vectors: (id, features array<double>)


def _kept(vectors: DataFrame) -> DataFrame:
    """(id, features), stored unless it is already."""
    if hasattr(vectors, "shared_path") and vectors.columns == ["id", "features"]:
        return vectors
    return stored(vectors.select("id", "features"), "vectors")


def counted(vectors: DataFrame) -> DataFrame:
    """(id, features, n), stored: equal vectors once with their number; id is a hash of the features."""
    alike = vectors.groupBy("features").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("features").alias("id"), "features", "n")
    return stored(alike.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "id").sortWithinPartitions("features"), "counted")


def _weights(b: pa.RecordBatch) -> np.ndarray:
    """How many vectors each row stands for: its third column, one each without."""
    return b.column(2).to_numpy().astype(float) if b.num_columns > 2 else np.ones(b.num_rows)


def _batch(b: pa.RecordBatch, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and features, moved by the mean of all so that squares keep their digits."""
    x = lists(b.column(1)).astype(float) if b.num_rows else np.zeros((0, len(shift)))
    return b.column(0).to_numpy(zero_copy_only=False), x - shift


def _middle(vectors: DataFrame) -> np.ndarray:
    """Mean of all features; empty without rows."""

    def sums(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = lists(b.column(1)).astype(float)
                n = _weights(b)
                total = (0 if total is None else total) + np.append(n @ x, n.sum())
        if total is not None:
            yield 0, total

    found = tree_sum(vectors, sums).get(0)
    return np.zeros(0) if found is None else found[:-1] / found[-1]


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, start, label): squared distances to centres (start, label, dimension)."""
    flat = centres.reshape(-1, centres.shape[-1])
    gaps = (x**2).sum(1)[:, None] - 2 * x @ flat.T + (flat**2).sum(1)[None]
    return np.maximum(gaps, 0).reshape(len(x), *centres.shape[:2])


def k_means_starts(vectors: DataFrame, k: int, starts: int = 10, rounds: int = 300, tolerance: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres by start, costs by start, mean of all) of K-Means from several starts, all in the same passes; centres are less the mean.

    vectors: (id, features), or (id, features, n) where a row stands for n vectors. A first centre is drawn, each further one in proportion to the squared
    distance from those before: every task offers its best draw, keyed by id, start and turn, and the
    best of all is taken. Rounds are Lloyd's; a start ends when its centres' squared moves sum to
    tolerance times the mean variance at most. A cluster without members keeps its centre.
    """
    shift = _middle(vectors)
    if not len(shift):
        return np.zeros((0, k, 0)), np.zeros(0), shift
    dim = len(shift)
    centres = np.zeros((starts, k, dim))
    for turn in range(k):

        def offer(batches, centres=centres, turn=turn):
            best = np.full((starts, dim + 1), -np.inf)
            for b in batches:
                ids, x = _batch(b, shift)
                if not len(x):
                    continue
                n = _weights(b)
                away = _gaps(x, centres[:, :turn]).min(2) if turn else np.ones((len(x), starts))
                for s in range(starts):
                    # the largest of log(weight) + Gumbel noise is a draw in proportion to the weights
                    with np.errstate(divide="ignore"):
                        worth = np.log(n * away[:, s]) - np.log(-np.log(uniform(ids, seed, s, turn)))
                    i = int(worth.argmax())
                    if worth[i] > best[s, 0] or not np.isfinite(best[s, 1:]).all():
                        best[s] = np.append(worth[i], x[i])
            yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["x"])

        offers = np.stack([np.frombuffer(r["x"]).reshape(starts, dim + 1) for r in vectors.mapInArrow(offer, "x binary").collect()])
        offers[:, :, 0] = np.where(np.isfinite(offers[:, :, 1]), offers[:, :, 0], -np.inf)
        for s in range(starts):
            real = np.flatnonzero(np.isfinite(offers[:, s, 1]))
            centres[s, turn] = offers[real[offers[real, s, 0].argmax()], s, 1:]
    going, cost, spread = np.ones(starts, bool), np.full(starts, np.inf), None
    for _ in range(rounds):
        on = np.flatnonzero(going)

        def sums(batches, at=centres[on]):
            size, total, cost, squares = np.zeros((len(at), k)), np.zeros((len(at), k, dim)), np.zeros(len(at)), np.zeros(1)
            n = np.zeros(1)
            for b in batches:
                _, x = _batch(b, shift)
                many = _weights(b)
                gaps = _gaps(x, at)
                label = gaps.argmin(2)
                cost += many @ gaps.min(2)
                squares += many @ (x**2).sum(1)
                n += many.sum()
                for s in range(len(at)):
                    size[s] += np.bincount(label[:, s], many, k)
                    np.add.at(total[s], label[:, s], many[:, None] * x)
            yield 0, np.concatenate([n, squares, cost, size.ravel(), total.ravel()])

        found = tree_sum(vectors, sums)[0]
        spread = found[1] / found[0] / dim
        cost[on] = found[2 : 2 + len(on)]
        size = found[2 + len(on) : 2 + len(on) * (1 + k)].reshape(len(on), k)
        total = found[2 + len(on) * (1 + k) :].reshape(len(on), k, dim)
        moved = np.where(size[:, :, None] > 0, total / np.maximum(size, 1)[:, :, None], centres[on])
        step = ((moved - centres[on]) ** 2).sum((1, 2))
        centres[on] = moved
        going[on] = step > tolerance * spread
        if not going.any():
            break
    return centres, cost, shift


def _first_least(cost: np.ndarray) -> int:
    """The first of those that cost least but for rounding."""
    return int(np.flatnonzero(cost <= cost.min() + 1e-9 * abs(cost.min()))[0])


def _nearest(vectors: DataFrame, centres: np.ndarray, shift: np.ndarray) -> DataFrame:
    def assign(batches):
        for b in batches:
            _, x = _batch(b, shift)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_gaps(x, centres[None])[:, 0].argmin(1).astype(np.int32))], ["id", "label"])

    return vectors.mapInArrow(assign, f"id {vectors.schema['id'].dataType.simpleString()}, label int")


def k_means_labels(vectors: DataFrame, k: int, seed: int = 1, bisecting: bool = False, starts: int = 10, alike: DataFrame | None = None) -> DataFrame:
    """(id, label) by K-Means, the cheapest of several starts (the first of equals), or divisively by bisecting K-Means. alike: counted(vectors), on which centres are then found."""
    if bisecting:
        from pyspark.ml.clustering import BisectingKMeans
        from pyspark.ml.functions import array_to_vector

        v = vectors.select("id", array_to_vector("features").alias("features"))
        return BisectingKMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).select("id", F.col("prediction").alias("label"))
    rows = _kept(vectors)
    centres, cost, shift = k_means_starts(rows if alike is None else alike, k, starts, seed=seed)
    return _nearest(rows, centres[_first_least(cost)] if len(cost) else np.zeros((k, 0)), shift)


def diagonal_mixture(vectors: DataFrame, k: int, rounds: int = 100, tolerance: float = 1e-6, seed: int = 1, starts: int = 10, alike: DataFrame | None = None) -> tuple[DataFrame, float, float]:
    """Gaussian mixture with diagonal covariances: (id, label), log-likelihood and BIC of the likeliest of several starts.

    Each start begins from its own K-Means. A round is one pass for all starts: memberships and
    their moments are made next to the data and added in a tree, around each component's mean of the
    round before, so that variances keep their digits; they have a floor of 1e-6. A start ends when
    its log-likelihood gains less than tolerance of itself. alike: counted(vectors), which is then
    read in the rounds.
    """
    rows = _kept(vectors)
    read = rows if alike is None else alike
    centres, _, shift = k_means_starts(read, k, starts, seed=seed)
    dim = len(shift)
    if not dim:
        return rows.select("id", F.lit(0).alias("label")), 0.0, 0.0
    mean, var, prior = centres.copy(), np.ones((starts, k, dim)), np.full((starts, k), 1 / k)

    def logs(x: np.ndarray, m: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.log(p) - 0.5 * (np.log(2 * np.pi * v).sum(1) + np.stack([((x - m[c]) ** 2 / v[c]).sum(1) for c in range(k)], 1))

    last, loglik, going, n = np.full(starts, -np.inf), np.full(starts, -np.inf), np.ones(starts, bool), 0
    best = [None] * starts
    for turn in range(rounds + 1):
        on = np.flatnonzero(going)

        def sums(batches, mean=mean, var=var, prior=prior, hard=turn == 0):
            out = {int(s): np.zeros(2 + k + 2 * k * dim) for s in on}
            for b in batches:
                _, x = _batch(b, shift)
                many = _weights(b)
                for s, o in out.items():
                    o[0] += many.sum()
                    if hard:
                        p = np.eye(k)[_gaps(x, mean[s][None])[:, 0].argmin(1)]
                    else:
                        joint = logs(x, mean[s], var[s], prior[s])
                        top = joint.max(1, keepdims=True)
                        lse = top[:, 0] + np.log(np.exp(joint - top).sum(1))
                        o[1] += many @ lse
                        p = np.exp(joint - lse[:, None])
                    p = p * many[:, None]
                    o[2 : 2 + k] += p.sum(0)
                    for c in range(k):
                        away, at = x - mean[s, c], 2 + k + 2 * c * dim
                        o[at : at + dim] += p[:, c] @ away
                        o[at + dim : at + 2 * dim] += p[:, c] @ away**2
            yield from out.items()

        found = tree_sum(read, sums)
        for s in on:
            o = found[int(s)]
            n, now = o[0], o[1]
            if turn:
                if now > loglik[s]:
                    loglik[s], best[s] = now, (mean[s].copy(), var[s].copy(), prior[s].copy())
                going[s] = now - last[s] > tolerance * max(1.0, abs(now))
                last[s] = now
            size = np.maximum(o[2 : 2 + k], 1e-12)
            first, second = o[2 + k :].reshape(k, 2, dim).transpose(1, 0, 2) / size[:, None]
            mean[s], var[s], prior[s] = mean[s] + first, np.maximum(second - first**2, 0) + 1e-6, size / size.sum()
        if not going.any():
            break
    chosen = _first_least(-loglik)
    m, v, p = best[chosen]

    def assign(batches):
        for b in batches:
            _, x = _batch(b, shift)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logs(x, m, v, p).argmax(1).astype(np.int32))], ["id", "label"])

    labels = rows.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, label int")
    return labels, float(loglik[chosen]), (k - 1 + 2 * k * dim) * math.log(n) - 2 * float(loglik[chosen])


# ------------------------------------------------------------------ Ward's tree

#: Clustering features that a task, a merge of tasks and the driver hold at most; rows that join them at a time.
FEATURES, CHUNK = 512, 2048
#: Clusters that the driver merges at the end; those that a task seeks the cheapest merge of, and how many of these at a time.
LAST, ASKED, TILE = 2048, 8192, 256


def ward_merges(size: np.ndarray, centre: np.ndarray, height: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Ward's merges (a, b, cost) of features of these sizes and centres, by rising cost; the i-th merge makes number len(size) + i.

    Chains of nearest neighbours: two that are nearest to each other are merged wherever they are
    found, since no later merge can come between them. The cost is the growth of the sum of squares;
    rounding never lets it fall below that of a merge it builds on. height: the cost at which each
    feature was made, 0 without.
    """
    n = len(size)
    height = np.append(np.zeros(n) if height is None else height, np.zeros(max(n - 1, 0)))
    size, centre = np.append(size.astype(float), np.zeros(max(n - 1, 0))), np.vstack([centre, np.zeros((max(n - 1, 0), centre.shape[1]))])
    live = np.zeros(len(size), bool)
    live[:n] = True
    chain, found = [], []
    for new in range(n, 2 * n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            others = np.flatnonzero(live)
            others = others[others != a]
            cost = size[a] * size[others] / (size[a] + size[others]) * ((centre[others] - centre[a]) ** 2).sum(1)
            near = others[cost == cost.min()]
            b = chain[-2] if len(chain) > 1 and chain[-2] in near else int(near[0])
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        height[new] = max(cost.min(), height[a], height[b])
        found.append((a, b, float(height[new]), new))
        size[new] = size[a] + size[b]
        centre[new] = (size[a] * centre[a] + size[b] * centre[b]) / size[new]
        live[[a, b]], live[new] = False, True
    # number the merges by cost, as made from those before
    number, out = {i: i for i in range(n)}, []
    for i, (a, b, cost, new) in enumerate(sorted(found, key=lambda m: (m[2], m[3]))):
        out.append((min(number[a], number[b]), max(number[a], number[b]), cost))
        number[new] = n + i
    return out


def cut_tree(n: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Label of each of n features when all but the k - 1 dearest merges are made; numbered by their first feature."""
    top = np.arange(2 * n)
    for i, (a, b, _) in enumerate(merges[: max(n - k, 0)]):
        top[[a, b]] = n + i
    for i in range(n + len(merges) - 1, -1, -1):  # a merge's number is higher than its parts'
        top[i] = top[top[i]]
    _, first, label = np.unique(top[:n], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def _condensed(size: np.ndarray, centre: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` features: the cheapest of Ward's merges are made. Sizes and centres add up exactly."""
    if len(size) <= most:
        return size, centre
    label = cut_tree(len(size), ward_merges(size, centre), most)
    total = np.bincount(label, size)
    return total, np.stack([np.bincount(label, size * centre[:, d]) for d in range(centre.shape[1])], 1) / total[:, None]


def clustering_features(vectors: DataFrame, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, centres) of at most `most` features that stand for all vectors: a summary, which no linkage here is made from.

    Each task takes its rows CHUNK at a time into its features and condenses them by Ward's own cost;
    the features of four tasks at a time are condensed again, until one set is left. No more than
    CHUNK and `most`, or four times `most`, features ever meet. With at most `most` rows every row is a feature.
    vectors: (id, features), or (id, features, n) where a row stands for n vectors.
    """
    schema = "part long, size array<double>, centre array<double>"

    def table(part: int, size: np.ndarray, centre: np.ndarray) -> list[pa.Array]:
        return [pa.array([part], pa.int64()), pa.array([size.tolist()], pa.list_(pa.float64())), pa.array([centre.ravel().tolist()], pa.list_(pa.float64()))]

    def gather(batches):
        from pyspark import TaskContext

        size, centre = np.zeros(0), None
        for b in batches:
            x, n = lists(b.column(1)).astype(float), _weights(b)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                centre = part if centre is None else np.vstack([centre, part])
                size, centre = _condensed(np.append(size, n[at : at + CHUNK]), centre, most)
        if centre is not None:
            yield pa.RecordBatch.from_arrays(table(TaskContext.get().partitionId(), size, centre), ["part", "size", "centre"])

    def merge(key, t):
        size = np.concatenate([np.array(x) for x in t["size"].to_pylist()])
        centre = np.concatenate([np.array(x) for x in t["centre"].to_pylist()]).reshape(len(size), -1)
        return pa.Table.from_arrays(table(key[0].as_py(), *_condensed(size, centre, most)), names=["part", "size", "centre"])

    left, parts = vectors.rdd.getNumPartitions(), vectors.mapInArrow(gather, schema)
    while left > 1:
        left = -(-left // 4)
        parts = parts.groupBy(F.floor(F.col("part") / 4).alias("to")).applyInArrow(merge, schema)
    rows = parts.toArrow().to_pylist()
    if not rows:
        return np.zeros(0), np.zeros((0, 0))
    size = np.concatenate([np.array(r["size"]) for r in rows])
    return _condensed(size, np.concatenate([np.array(r["centre"]) for r in rows]).reshape(len(size), -1), most)


def _cheapest(asked: DataFrame, live: DataFrame, middle: np.ndarray) -> DataFrame:
    """(node, to): the cluster of live, a stored table, that each one asked for costs least to merge with.

    Every task reads all clusters CHUNK at a time and holds about ASKED of those asked for. What comes
    within rounding of the least by a matrix product is computed again from the differences, in a way
    that gives both ends of a pair the same cost; ties go by a draw keyed by the pair.
    """
    files, n = live.inputFiles(), asked.count()
    tasks = max(1, -(-n // ASKED), min(asked.sparkSession.sparkContext.defaultParallelism, -(-n // TILE)))
    columns = ["node", "size", "centre"]

    def search(batches):
        from pyarrow import fs
        from pyarrow import parquet as pq

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        node, size = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        x = np.concatenate([lists(b.column(2)) for b in held]) - middle
        squares, part, slack = (x**2).sum(1), 1 / size, 8 * (x.shape[1] + 4) * np.finfo(float).eps
        least, drawn, pair, to = np.full(len(node), np.inf), np.ones(len(node)), np.zeros(len(node), np.int64), np.full(len(node), -1)
        for path in files:
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(CHUNK, columns=columns):
                    other, weight, y = b.column(0).to_numpy(), b.column(1).to_numpy(), lists(b.column(2)) - middle
                    near, share = (y**2).sum(1), 1 / weight
                    for at in range(0, len(node), TILE):
                        s = slice(at, at + TILE)
                        unsure = slack * (squares[s] + near.max())
                        low = (squares[s] - unsure)[:, None] + near - 2 * x[s] @ y.T
                        low /= part[s, None] + share
                        _, i, j = np.intersect1d(node[s], other, assume_unique=True, return_indices=True)
                        low[i, j] = np.inf  # itself
                        bound = np.minimum(low.min(1) + 2 * unsure / (part[s] + share.min()), least[s])
                        row, col = np.nonzero((low <= bound[:, None]) & (low < np.inf))
                        if not len(row):
                            continue
                        gaps = np.zeros(len(row))
                        for d in range(x.shape[1]):
                            gaps += (x[at + row, d] - y[col, d]) ** 2
                        cost = size[at + row] * weight[col] / (size[at + row] + weight[col]) * gaps
                        ends = np.minimum(node[at + row], other[col]) << 31 | np.maximum(node[at + row], other[col])
                        draw = uniform(ends, 0)
                        order = np.lexsort((ends, draw, cost, row))
                        order = order[np.unique(row[order], return_index=True)[1]]
                        r, c, u, e = at + row[order], cost[order], draw[order], ends[order]
                        less = (c < least[r]) | (c == least[r]) & ((u < drawn[r]) | (u == drawn[r]) & (e < pair[r]))
                        r = r[less]
                        least[r], drawn[r], pair[r], to[r] = c[less], u[less], e[less], other[col[order]][less]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(to)], ["node", "to"])

    return asked.select(*columns).repartition(tasks, "node").mapInArrow(search, "node long, to long")


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their place from 0 in the order."""
    places = running(rows.withColumn("_all", F.lit(0)), "_all", list(order), {})
    return stored(places.select(*rows.columns, (F.col("i") - 1).alias(name)), "numbered")


def _linkage(alike: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """((features, n, node), (step, a, b, a_made, b_made, made, height, size), number of nodes): all of Ward's merges of counted vectors.

    A vector is a node, numbered in the vectors' order. A cluster is named by its first node and the
    round it was made in, -1 for a node alone; a < b are its parts' first nodes. In a round all pairs
    that are each other's cheapest are merged, wherever they are: no merge elsewhere can come between
    them, so in order of cost these are the merges of the cheapest pair of all, one after the other. What
    is cheapest for a cluster stays so until that one is merged, so only new clusters and those
    that pointed to a merged one are asked for again. Clusters are a table throughout; the driver takes over from
    `most` of them, or from 16 times as many where a round merges less than a 64th.
    """
    spark, middle = alike.sparkSession, _middle(alike)
    nodes = _numbered(alike.select("features", "n"), "node", "features")
    live = stored(nodes.select("node", F.col("n").cast("double").alias("size"), F.col("features").alias("centre"), F.lit(0.0).alias("height"), F.lit(-1).alias("made"), F.lit(None).cast("long").alias("to")), "live")
    n = left = live.count()
    merges, turn, slow = [], 0, False
    merge = "a long, b long, a_made int, b_made int, made int, height double, size double"
    while left > max(16 * most if slow else most, 1):
        near = stored(_cheapest(live.where("to is null"), live, middle), "near")
        to = stored(live.where("to is not null").select("node", "to").unionAll(near), "to")
        back = to.select(F.col("node").alias("b"), F.col("to").alias("a"))
        pairs = stored(to.select(F.col("node").alias("a"), F.col("to").alias("b")).join(back, ["a", "b"]).where("a < b"), "pairs")
        many = pairs.count()
        if not many and near.count() == left:
            raise ValueError("Ward's linkage needs finite vectors")
        side = lambda k: live.select(*[F.col(c).alias(f"{k}_{c}") for c in ("size", "centre", "height", "made")], F.col("node").alias(k))
        size = F.col("a_size") + F.col("b_size")
        centre = F.zip_with("a_centre", "b_centre", lambda x, y: (F.col("a_size") * x + F.col("b_size") * y) / size)
        cost = F.col("a_size") * F.col("b_size") / size * _distance(F.col("a_centre"), F.col("b_centre"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        made = stored(joined.select("a", "b", "a_made", "b_made", F.lit(turn).alias("made"), F.greatest(cost, "a_height", "b_height").alias("height"), size.alias("size"), centre.alias("centre")), "made")
        gone = pairs.select(F.explode(F.array("a", "b")).alias("gone"))
        kept = live.drop("to").join(to, "node").join(gone, F.col("node") == F.col("gone"), "left_anti").join(gone, F.col("to") == F.col("gone"), "left")
        # where nothing was merged, what rounding left behind is asked for again
        still = F.when(F.col("gone").isNull() & F.lit(many > 0), F.col("to"))
        grown = made.select(F.col("a").alias("node"), "size", "centre", "height", "made", F.lit(None).cast("long").alias("to"))
        after = stored(kept.select("node", "size", "centre", "height", "made", still.alias("to")).unionAll(grown), "live")
        discard(live, near, to, pairs)
        live, slow, left, turn = after, many * 64 < left, left - many, turn + 1
        merges.append(made.select(*[c.split()[0] for c in merge.split(", ")]))
    rest = live.drop("to").orderBy("node").toArrow().to_pylist()
    size, height = (np.array([r[c] for r in rest], float) for c in ("size", "height"))
    names, total, last = [(r["node"], r["made"]) for r in rest], size.tolist(), []
    for a, b, cost in ward_merges(size, np.array([r["centre"] for r in rest]), height) if rest else []:
        (a, a_made), (b, b_made), weight = *sorted((names[a], names[b])), total[a] + total[b]
        last.append((a, b, a_made, b_made, turn + len(last), cost, weight))
        names.append((a, turn + len(last) - 1))
        total.append(weight)
    found = spark.createDataFrame(last, merge)
    for m in merges:
        found = found.unionAll(m)
    return nodes, _numbered(found, "step", "height", "made", "a"), n


def _tree(steps: DataFrame, n: int) -> DataFrame:
    """(step, a, b, cost, size): numbers below n are nodes, the step-th merge makes number n + step."""
    by = lambda k: steps.select(F.col("a").alias(k), F.col("made").alias(f"{k}_made"), (F.lit(n) + F.col("step")).alias(f"{k}_number"))
    parts = steps.join(by("a"), ["a", "a_made"], "left").join(by("b"), ["b", "b_made"], "left")
    first, second = F.coalesce("a_number", "a"), F.coalesce("b_number", "b")
    numbers = [F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b")]
    return parts.select(F.col("step").cast("int").alias("step"), *numbers, F.col("height").alias("cost"), F.round("size").cast("long").alias("size"))


def ward_tree(vectors: DataFrame, most: int = LAST, alike: DataFrame | None = None) -> DataFrame:
    """The tree (step, a, b, cost, size) of Ward's linkage, as ward() gives it."""
    _, steps, n = _linkage(counted(_kept(vectors)) if alike is None else alike, most)
    return _tree(steps, n)


def ward(vectors: DataFrame, k: int, most: int = LAST, alike: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, label) for k clusters, the tree (step, a, b, cost, size)) of Ward's linkage over all vectors.

    Equal vectors are one node with their number from the start (Ward's linkage merges them first,
    at no cost); alike: counted(vectors), if it is there already. Nodes are numbered in the vectors'
    order, the step-th merge makes the step-th number after them; no merge of differing vectors is left
    out at any size. Labels are those after all but the k - 1 dearest merges, numbered by first node.
    most: clusters that the driver merges in the end; it does not change the linkage. Quadratic in
    the number of differing vectors.
    """
    rows = _kept(vectors)
    nodes, steps, n = _linkage(counted(rows) if alike is None else alike, most)
    # a merge leads from the first node of one part to that of the other, which comes before it
    made = steps.where(F.col("step") < n - k).select(F.col("b").alias("node"), F.col("a").alias("up"))
    roots = stored(nodes.join(made, "node", "left").select("node", F.coalesce("up", "node").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").limit(1).count():
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = stored(roots.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        discard(roots)
        roots = after
    number = roots.select("root").distinct().select("root", (F.row_number().over(Window.orderBy("root")) - 1).cast("int").alias("label"))
    labels = nodes.join(roots, "node").join(number, "root").select("features", "label")
    return rows.join(labels, "features").select("id", "label"), _tree(steps, n)


def silhouette(labelled: DataFrame) -> float | None:
    """Silhouette with squared Euclidean distances of (features, label); null unless two labels or more have two members each.

    Equal rows are counted first. A vector's mean distance to a cluster follows from the cluster's
    size, sum and sum of squares, so two passes over the counted rows are enough.
    """
    rows = stored(labelled.groupBy(F.col("label").cast("double").alias("label"), "features").agg(F.count(F.lit(1)).alias("n")), "silhouette")
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())
    shift = _middle(rows)
    dim, k = len(shift), len(names)

    def parts(batches):
        for b in batches:
            if b.num_rows:
                yield np.searchsorted(names, b.column(0).to_numpy()), lists(b.column(1)).astype(float) - shift, _weights(b)

    def moments(batches):
        total = np.zeros((k, dim + 2))
        for label, x, n in parts(batches):
            np.add.at(total, label, n[:, None] * np.column_stack([np.ones(len(x)), (x**2).sum(1), x]))
        yield 0, total.ravel()

    found = tree_sum(rows, moments).get(0, np.zeros(0)).reshape(-1, dim + 2)
    size, squares, middle = found[:, 0], found[:, 1], found[:, 2:]
    if k < 2 or size.min() < 2:
        discard(rows)
        return None

    def widths(batches):
        total = np.zeros(2)
        for label, x, n in parts(batches):
            away, at = np.maximum((x**2).sum(1)[:, None] - 2 * x @ (middle / size[:, None]).T + squares / size, 0), np.arange(len(x))
            own = away[at, label] * size[label] / (size[label] - 1)
            away[at, label] = np.inf
            near = away.min(1)
            most = np.maximum(own, near)
            total += [n @ np.where(most > 0, (near - own) / np.where(most > 0, most, 1), 0.0), n.sum()]
        yield 0, total

    got = tree_sum(rows, widths)[0]
    discard(rows)
    return float(got[0] / got[1])


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _centroids(labelled: DataFrame) -> DataFrame:
    means = labelled.select("label", F.posexplode("features").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("centroid"))


def reassign_noise(labelled: DataFrame) -> DataFrame:
    """(id, label, was_noise): rows without a label go to the cluster whose representative is nearest.

    A representative is the member closest to its cluster's mean, smallest id on ties. Without any
    cluster the rows stay unlabelled. Input: (id, features, label).
    """
    known = labelled.where("label is not null")
    gaps = known.join(_centroids(known), "label").withColumn("gap", _distance(F.col("features"), F.col("centroid")))
    reps = gaps.groupBy(F.col("label").alias("to")).agg(F.min_by("features", F.struct("gap", "id")).alias("at"))
    noise = labelled.where("label is null").select("id", "features")
    near = noise.join(reps, how="left").groupBy("id").agg(F.min_by("to", F.struct(_distance(F.col("features"), F.col("at")), "to")).alias("label"))
    return known.select("id", "label", F.lit(False).alias("was_noise")).unionByName(near.withColumn("was_noise", F.lit(True)))


def merge_single_members(labelled: DataFrame) -> DataFrame:
    """(id, features, label) in which clusters of one member have joined the nearest other centroid, smallest label first, until none is left.

    Merges are found on the clusters' sums and sizes alone, which is what reaches the driver (labels
    times dimensions); the rows are relabelled once.
    """
    sums = labelled.select("label", F.posexplode("features").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    clusters: dict = {}
    for r in sums.collect():
        clusters.setdefault(r["label"], {})[r["d"]] = (r["s"], r["n"])
    total = {c: np.array([v[d][0] for d in sorted(v)]) for c, v in clusters.items()}
    size = {c: next(iter(v.values()))[1] for c, v in clusters.items()}
    moved: dict = {}
    while len(size) > 1 and (single := min((c for c, n in size.items() if n == 1), default=None)) is not None:
        to = min((c for c in size if c != single), key=lambda c: (float(((total[c] / size[c] - total[single]) ** 2).sum()), c))
        total[to], size[to] = total[to] + total.pop(single), size[to] + size.pop(single)
        moved = {c: to if t == single else t for c, t in moved.items()} | {single: to}
    rows = labelled.select("id", "features", "label")
    if not moved:
        return rows
    kind = labelled.schema["label"].dataType.simpleString()
    moves = labelled.sparkSession.createDataFrame([*moved.items()], f"_from {kind}, _to {kind}")
    return rows.join(moves, F.col("label") == F.col("_from"), "left").select("id", "features", F.coalesce("_to", "label").alias("label"))


def compare_methods(responses: DataFrame, vectors: DataFrame, labels: dict[str, DataFrame], bics: dict[str, float] | None = None) -> DataFrame:
    """(method, metric, value): silhouette, BIC, size entropy, informativeness, coherence and noise share of each labeling.

    labels: method to (respondent_id, label), label null for noise; bics: method to BIC, for methods
    that have a likelihood (null for others). Each respondent's answers are brought together once;
    a method's labels meet one row for each respondent, and its metrics are made from the numbers of
    those alike in label and answers.
    """
    spark, parts = responses.sparkSession, []
    levels, names = LA._known(responses)
    people, _ = LA._gathered(responses, ["respondent_id"], levels, names)
    kind = responses.select("column_name", "code").schema
    listed = [(i, *x) for i, x in enumerate(levels)] + [(len(levels) + q, c, None) for q, c in enumerate(names)]
    places = spark.createDataFrame(listed, f"_place int, column_name {kind['column_name'].dataType.simpleString()}, code {kind['code'].dataType.simpleString()}")
    for method, frame in labels.items():
        known = frame.where("label is not null")
        cells = stored(people.join(known, "respondent_id").groupBy("label", "_at").agg(F.count(F.lit(1)).alias("n")), "cells")
        rows = stored(cells.select("label", "n", F.explode("_at").alias("_place")).groupBy("label", "_place").agg(F.sum("n").alias("n")).join(F.broadcast(places), "_place").select("label", "column_name", "code", "n"), "rows")
        sizes = cells.groupBy("label").agg(F.sum("n").alias("size"))
        value = silhouette(vectors.join(known, vectors["id"] == known["respondent_id"]))
        score = spark.range(1).select(F.lit("silhouette").alias("metric"), F.lit(value).cast("double").alias("value"))
        for metric, df in (
            ("bic", spark.range(1).select(F.lit((bics or {}).get(method)).alias("bic"))),
            ("size_entropy", ST.size_entropy(known)),
            ("informativeness", ST.informativeness(ST.hard_distribution(rows, "n"), "label").agg(F.avg("informativeness"))),
            ("coherence", ST.coherence(rows, "n", sizes)),
            ("noise_share", frame.agg(F.avg(F.col("label").isNull().cast("double")))),
        ):
            score = score.unionAll(df.select(F.lit(metric), F.col(df.columns[0]).cast("double")))
        parts.append(score.withColumn("method", F.lit(method)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
