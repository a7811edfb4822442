"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.graph import components

BLOCKS = 8
#: Vectors of a cell that are compared in one task, and rows that they are compared with there, as a multiple.
TILE, ASKERS = 4096, 4
#: Coordinates of a unit vector are kept as whole numbers in this scale: sums of squares stay below 2**24, so products in single precision are exact.
SCALE = 1800
#: What a dealt row costs, in comparisons, and about the share of pairs that another coordinate in a cell keeps.
ROW_COST, KEPT = 1000, 0.64


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A fixed random rotation, so that no block of coordinates is special."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors: list, dim: int) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square is lost or infinite."""
    m = np.array(vectors, np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of grid cells (int columns); distinct cells may share a key only in theory."""
    key = np.full(len(cells), 1, np.uint64)
    for c in cells.T:
        key = (key ^ (c.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def half_steps(grid: int) -> np.ndarray:
    """Of each pair of opposite steps to a neighbouring cell, one."""
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * grid, indexing="ij"), -1).reshape(-1, grid)
    return steps[len(steps) // 2 + 1 :]


def grid_for(n: int) -> int:
    """Coordinates that make a cell: more of them for larger tables, where the rows dealt to neighbours cost less than the comparisons saved."""
    return min(range(1, 9), key=lambda k: 3**k * ROW_COST + n * KEPT**k)


class Budgets:
    """What pairs of one length may differ by, in squared units of the kept whole numbers.

    The squared distance radius2 is dealt to the blocks by their numbers of coordinates; a pair
    within radius2 is within its share in one block at least. Rounding moves each difference by one
    unit at most, so shares are widened by that: no pair is lost. Up to `sure` the true distance is
    within radius2 whatever the rounding, beyond `most` it is not.
    """

    def __init__(self, dim: int, cosine: float, blocks: int):
        radius = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.cuts = np.array_split(np.arange(dim), max(1, min(blocks, dim)))
        self.share = [int((radius * math.sqrt(len(c) / dim) * SCALE + math.sqrt(len(c)) + 1e-3) ** 2) for c in self.cuts]
        self.most = int((radius * SCALE + math.sqrt(dim) + 1e-3) ** 2)
        self.sure = int(max(0.0, radius * SCALE - math.sqrt(dim) - 1e-3) ** 2) - 1


def placed(reps: DataFrame, cosine: float, blocks: int, grid: int) -> DataFrame:
    """(dim, rep, n, code, home, probe): the rotated unit vector in whole numbers; for each block its cell and the cells it also looks into."""

    def run(batches):
        for b in batches:
            vectors = b.column(2).to_pylist()
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for dim in np.unique(sizes):
                on = np.flatnonzero(sizes == dim)
                code = np.rint(unit_rows([vectors[i] for i in on], dim) @ rotation(int(dim)) * SCALE).astype(np.int16)
                budget = Budgets(int(dim), cosine, blocks)
                home, probe = [], []
                for cut, share in zip(budget.cuts, budget.share):
                    cell = np.floor_divide(code[:, cut[:grid]].astype(np.int64), math.isqrt(share) + 1)
                    home.append(cell_keys(cell))
                    probe.append(np.stack([cell_keys(cell + s) for s in half_steps(cell.shape[1])], 1))
                one = pa.array(on)
                nested = pa.array([list(x) for x in np.stack(probe, 1)], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(sizes[on], pa.int32()), b.column(0).take(one), b.column(1).take(one), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(list(np.stack(home, 1))), nested], ["dim", "rep", "n", "code", "home", "probe"])

    return reps.select("rep", "n", "embedding").mapInArrow(run, "dim int, rep long, n long, code binary, home array<long>, probe array<array<long>>")


def unite(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the classes of p and q in place; each place's parent is its class's smallest place."""
    while True:
        a, b = parent[p], parent[q]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def compared(dim: int, block: int, budget: Budgets, build: tuple, ask: tuple) -> dict[str, np.ndarray]:
    """What the pairs of build and asking rows give in this block.

    Of a pair that several blocks would find only the first counts. Pairs that are surely near are
    summed here: to each vector the copies on the other side, and links that join the same classes,
    one per vector at most. Pairs too near the limit to tell are listed one by one.
    """
    (rep1, n1, code1), (rep2, n2, code2, both) = build, ask
    cut, near = budget.cuts[block], budget.share[block]
    x, y = code1[:, cut].astype(np.float32), code2[:, cut].astype(np.float32)
    # one product of the widened rows gives the squared distance
    right = np.vstack([-2 * y.T, np.ones(len(y), np.float32), (y * y).sum(1)])
    names, at = np.unique(np.concatenate([rep1, rep2]), return_inverse=True)
    at1, at2 = at[: len(rep1)], at[len(rep1) :]
    parent, links = np.arange(len(names)), np.zeros(len(names), np.int64)
    open_a, open_b = [], []
    for s in range(0, len(x), 256):
        part = x[s : s + 256]
        left = np.hstack([part, (part * part).sum(1)[:, None], np.ones((len(part), 1), np.float32)])
        found = np.flatnonzero(left @ right <= near)
        p, q = found // len(y) + s, found % len(y)
        ok = ~both[q] | (rep1[p] < rep2[q])
        p, q = p[ok], q[ok]
        for t in range(0, len(p), 65536):
            i, j = p[t : t + 65536], q[t : t + 65536]
            gap = code1[i].astype(np.int32) - code2[j]
            gap *= gap
            whole = gap.sum(1)
            take = whole <= budget.most
            for earlier in range(block):
                take[take] = gap[take][:, budget.cuts[earlier]].sum(1) > budget.share[earlier]
            i, j, sure = i[take], j[take], whole[take] <= budget.sure
            open_a.append(rep1[i[~sure]])
            open_b.append(rep2[j[~sure]])
            i, j = i[sure], j[sure]
            np.add.at(links, at1[i], n2[j])
            np.add.at(links, at2[j], n1[i])
            unite(parent, at1[i], at2[j])
    moved, linked = np.flatnonzero(parent != np.arange(len(names))), np.flatnonzero(links)
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *open_a]), np.concatenate([none, *open_b])
    return {"kind": np.repeat([0, 1, 2], [len(linked), len(moved), len(a)]), "a": np.concatenate([names[linked], names[moved], np.minimum(a, b)]), "b": np.concatenate([links[linked], names[parent[moved]], np.maximum(a, b)])}


def near_vectors(cells: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """(kind, a, b): kind 0 gives a vector and a number of links, 1 a link of the classes, 2 a pair still to be verified.

    Rows meet in the cells of each block. The vectors of a cell are cut into tiles of about TILE, the
    rows that look into it into portions of about ASKERS times that, and each tile meets each portion
    in a group of its own, so no task holds a whole cell.
    """
    rows = cells.select("dim", "rep", "n", "code", F.posexplode("home").alias("block", "cell"), F.lit(0).alias("role"))
    asks = cells.select("dim", "rep", "n", "code", F.posexplode("probe").alias("block", "c")).select("dim", "rep", "n", "code", "block", F.explode("c").alias("cell"), F.lit(1).alias("role"))
    both = rows.unionByName(asks)
    counts = both.groupBy("dim", "block", "cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("role") == 0).alias("homes")).where("homes > 0 and rows > 1")
    tiles = materialize(counts.select("dim", "block", "cell", F.ceil(F.col("homes") / TILE).cast("int").alias("tiles"), F.ceil(F.col("rows") / (TILE * ASKERS)).cast("int").alias("portions")), "cells")
    both = both.join(tiles, ["dim", "block", "cell"])
    tile, portion = (F.pmod(F.xxhash64("rep", F.lit(s)), F.col(c)).cast("int") for s, c in ((1, "tiles"), (2, "portions")))
    build = F.transform(F.sequence(F.lit(0), F.col("portions") - 1), lambda y: F.struct(tile.alias("x"), y.alias("y"), F.lit(True).alias("build")))
    asking = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(x.alias("x"), portion.alias("y"), F.lit(False).alias("build")))
    dealt = both.select("dim", "rep", "n", "code", "block", "cell", "role", F.inline(F.when(F.col("role") == 1, asking).otherwise(F.concat(build, asking))))

    def run(key, table):
        dim, block = key[0].as_py(), key[1].as_py()
        rep, n, role, on = (table.column(c).to_numpy() for c in ("rep", "n", "role", "build"))
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int16).reshape(-1, dim)
        found = compared(dim, block, Budgets(dim, cosine, blocks), (rep[on], n[on], code[on]), (rep[~on], n[~on], code[~on], role[~on] == 0))
        return pa.table({"kind": pa.array(found["kind"], pa.int32()), "a": found["a"], "b": found["b"]})

    return dealt.groupBy("dim", "block", "cell", "x", "y").applyInArrow(run, "kind int, a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is at least cosine, with the copies of both sides."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("embedding").alias("ea"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("embedding").alias("eb"))

    def run(batches):
        for t in batches:
            near = []
            for x, y in zip(t.column(4).to_pylist(), t.column(5).to_pylist()):
                u, v = unit_rows([x], len(x)), unit_rows([y], len(y))
                near.append(bool((u * v).sum() >= cosine))
            yield pa.RecordBatch.from_arrays([t.column(i).filter(pa.array(near, pa.bool_())) for i in range(4)], ["a", "b", "na", "nb"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ea", "eb").mapInArrow(run, "a long, b long, na long, nb long")


def embedding_classes(vectors: DataFrame, cosine: float = 0.95, blocks: int = BLOCKS, grid: int | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one length are linked when, scaled to length one, their squared distance is at most
    2 - 2 * cosine; then in one of the blocks it is at most that block's share, which is where
    candidates come from. Vectors of different lengths never meet; each length is joined within
    itself, all in the same plan. Equal vectors are one node, so a group of copies of any size costs
    one row; a group of near copies costs rows per member, not per pair. Null vectors, vectors
    without components, zero vectors and those with null or non-finite components link with
    nothing. Rows that repeat are vectors of their own; a null vec_id is a row like others that no
    class takes its name from. An empty table gives no rows; other columns are not read. Tiny and
    huge components are scaled before anything is squared. grid: coordinates that make a cell
    (default: by the number of vectors).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(good).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), F.col("embedding")))
    reps = materialize(usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "vectors")
    cells = materialize(placed(reps, cosine, blocks, grid or grid_for(reps.count())), "placed")
    found = materialize(near_vectors(cells, cosine, blocks), "found")
    checked = materialize(verified(found.where("kind = 2").select("a", "b"), reps, cosine), "verified")
    sums = found.where("kind = 0").select(F.col("a").alias("rep"), F.col("b").alias("m"))
    sums = sums.unionAll(checked.select("a", "nb")).unionAll(checked.select("b", "na"))
    degree = sums.groupBy("rep").agg(F.sum("m").alias("links"))
    joined = components(found.where("kind = 1").select("a", "b").unionAll(checked.select("a", "b"))).withColumnRenamed("node", "rep")
    nodes = reps.select("k1", "k2", "rep", "n").join(degree, "rep", "left").join(joined, "rep", "left")
    nodes = materialize(nodes.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "nodes")
    keyed = rows.select("vec_id", F.when(good, F.xxhash64("embedding")).alias("k1"), F.when(good, F.xxhash64(F.lit(1), F.col("embedding"))).alias("k2"))
    out = keyed.join(nodes, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
