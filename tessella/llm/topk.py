"""Exact top-k search by inner product over quantised vectors: MaxScore within shards, then a merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, shuffle_width

#: Numbers of a shard's, or a block of queries', matrix at most; rows of a shard at least, where there are so many.
CELLS, FEW = 1 << 22, 1024
#: Candidates and queries that are scored at once; share of them up to which single postings are probed.
TILE, ROUND, SPARSE = 2048, 256, 0.03
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.select("vec_id", x.alias("embedding")).where(x.isNotNull() & ~odd).select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles, shorter ones filled up with zeros."""
    lists = lists.combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


class Best:
    """The k best (score, id, row) of each query so far; ties go to the smaller id, missing ids last."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, score, id, row

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        q, s, i, r = (np.concatenate(x) for x in zip(self.held, (query, score, ident, row)))
        order = np.lexsort((r, i, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.held = q[place < self.k], s[keep], i[keep], r[keep]
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[order][last])


def competitive(w: np.ndarray, v: np.ndarray, top: np.ndarray, low: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs whose score reaches the query's least.

    A dimension is a term; its bound is the most that the query's weight makes of any value in the
    shard. The terms of smallest bounds that together stay below the least are non-essential. The
    essential postings are traversed for all candidates; then the others are probed, dearest first,
    while a candidate's sum and the bounds left can still reach the least. Where many candidates
    stay in the race their rest is added in one product, else posting by posting.
    """
    bound = np.maximum(w * top, w * low)
    order = np.argsort(bound, axis=1, kind="stable")
    upto = np.hstack([np.zeros((len(w), 1)), np.cumsum(np.take_along_axis(bound, order, 1), axis=1)])
    # bounds may be negative, so sums need not ascend: count the terms up to the first sum that reaches the least
    reach = upto >= least[:, None]
    spare = np.where(reach.any(axis=1), reach.argmax(axis=1) - 1, w.shape[1]).clip(0)
    live = spare < w.shape[1]
    if not live.all():  # no candidate of this shard can reach the least of the others
        live = np.flatnonzero(live)
        q, c, s = competitive(w[live], v, top, low, least[live]) if len(live) else (np.zeros(0, np.int64),) * 3
        return live[q] if len(live) else q, c, s
    essential = np.zeros(w.shape, bool)
    np.put_along_axis(essential, order, np.arange(w.shape[1]) >= spare[:, None], axis=1)
    part = (w * essential) @ v.T
    left = upto[np.arange(len(w)), spare]
    race = part + left[:, None] >= least[:, None]
    if race.mean() > SPARSE:
        score = part + (w * ~essential) @ v.T
        q, c = np.nonzero(race & (score >= least[:, None]))
        return q, c, score[q, c]
    q, c = np.nonzero(race)
    score, term = part[q, c], spare[q] - 1
    while (term >= 0).any():
        on = np.flatnonzero(term >= 0)
        dim = order[q[on], term[on]]
        score[on] += w[q[on], dim] * v[c[on], dim]
        ahead = np.zeros(len(q))
        ahead[on] = upto[q[on], term[on]]
        stay = score + ahead >= least[q]
        q, c, score, term = q[stay], c[stay], score[stay], term[stay] - 1
    stay = score >= least[q]
    return q[stay], c[stay], score[stay]


def search_shard(w: np.ndarray, own: np.ndarray, least: np.ndarray, v: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, ...]:
    """(query, score, id, row) of the k best candidates for each query that reach its least.

    w, v: queries and candidates; own, row: what tells rows apart; exact: whether sums of doubles
    are exact. Candidates go by in tiles and the least rises with what is found.
    """
    out = []
    order = np.argsort(ident, kind="stable")
    v, ident, row = v[order], ident[order], row[order]
    top, low = v.max(axis=0, initial=-np.inf), v.min(axis=0, initial=np.inf)
    for start in range(0, len(w), ROUND):
        part, mine = w[start : start + ROUND], own[start : start + ROUND]
        best = Best(k, least[start : start + ROUND].copy())
        for at in range(0, len(v), TILE):
            tile = v[at : at + TILE]
            if exact:
                floor = np.where(best.least == LEAST, -np.inf, best.least.astype(float))
                q, c, s = competitive(part, tile, top, low, floor)
                s = s.astype(np.int64)
            else:
                # numbers beyond the reach of doubles: whole sums of Python's integers, cut to longs
                sums = part.astype(object) @ tile.astype(object).T
                s = np.array([[max(LEAST + 1, min(-LEAST - 1, int(x))) for x in r] for r in sums], np.int64).reshape(len(part), len(tile))
                q, c = np.nonzero(s >= best.least[:, None])
                s = s[q, c]
            stay = mine[q] != row[at + c]
            q, c, s = q[stay], c[stay], s[stay]
            if len(q) > 2 * k * len(part):  # of very many, only those that reach a query's k-th best of this tile
                full = np.full((len(part), max(len(tile), k)), LEAST)
                full[q, c] = s
                kth = np.partition(full, full.shape[1] - k, axis=1)[:, full.shape[1] - k]
                stay = s >= kth[q]
                q, c, s = q[stay], c[stay], s[stay]
            if len(q):
                best.add(q, s, ident[at + c], row[at + c])
        q, s, i, r = best.held
        out.append((q + start, s, i, r))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def top_k(vectors: DataFrame, asks: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest integer inner product with each row for which asks holds.

    vectors: (vec_id, embedding). Every row but the query's own is a candidate, ties go to the
    smaller vec_id (null last). Vectors that are null or hold null or non-finite components take no
    part; a shorter vector counts as zero beyond its end. Rows that repeat are queries and candidates
    of their own; a null vec_id is a candidate. Numbers and sums that no long holds count as the
    nearest one. An empty table gives no rows; other columns are not read.

    Candidates are dealt to shards and queries to blocks of bounded size; each pair of a shard and a
    block is one task's work. A block first meets one shard, whose k-th best is what the others have
    to reach. The shards' best are merged by rank.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialize(quantised(vectors, scale), "quantised").withColumn("row", F.monotonically_increasing_id())
    asking = F.coalesce(asks, F.lit(False))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asking).alias("q"), F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")), F.lit(0))).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    n, asked, width = seen["n"], seen["q"], max(1, seen["width"] or 1)
    high = max(abs(seen["high"] or 0), abs(seen["low"] or 0))
    exact = high * high * width < 2**53
    most = max(FEW, CELLS // width)
    shards = max(-(-n // most), min(shuffle_width(spark), -(-n // FEW)), 1)
    blocks = max(-(-asked // most), 1)
    lean = F.col("v").cast("array<smallint>" if high < 2**15 else "array<bigint>")
    dealt = rows.select("row", "vec_id", asking.alias("asks"), lean.alias("v"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block"))
    dealt = materialize(dealt, "dealt")
    none = F.lit(None).cast("long")
    home = F.pmod(F.col("block"), F.lit(shards))

    def search(key, left, right):
        w, v = matrix(left["v"], width), matrix(right["v"], width)
        ident, own = right["vec_id"].combine_chunks(), left["row"].to_numpy()
        named = ident.cast(pa.int64()).fill_null(-LEAST - 1).to_numpy()
        q, s, i, r = search_shard(w, own, left["least"].combine_chunks().fill_null(LEAST).to_numpy().copy(), v, named, right["row"].to_numpy(), k, exact)
        asker = pa.array(q)
        ids = pc.if_else(pc.equal(pa.array(i), -LEAST - 1), pa.scalar(None, pa.int64()), pa.array(i))
        return pa.Table.from_arrays([left["row"].take(asker), left["vec_id"].take(asker), pa.array(r), ids.cast(left["vec_id"].type), pa.array(s)], names=["query", "query_id", "row", "vec_id", "score"])

    def met(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """Best of each block of queries in each shard that the rows name."""
        a = queries.select("shard", "block", "row", "vec_id", "v", "least").toDF("shard", "block", "row", "vec_id", "v", "least")
        b = candidates.select("shard", "block", "row", "vec_id", "v").toDF("shard", "block", "row", "vec_id", "v")
        return a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInArrow(search, f"query long, query_id {kind}, row long, vec_id {kind}, score long")

    queries = dealt.where("asks").drop("shard")
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    spread = dealt.drop("block").withColumn("block", each_block)
    first = materialize(met(queries.withColumn("shard", home).withColumn("least", none), spread.where(F.col("shard") == home)), "first")
    least = first.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).select(F.col("query").alias("row_"), F.when(F.col("c") >= k, F.col("s")).alias("least"))
    primed = queries.join(least, F.col("row") == F.col("row_"), "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    rest = met(primed.where(F.col("shard") != home), spread.where(F.col("shard") != home))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return first.unionAll(rest).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
