"""Near-duplicates by the share of common shingles, exact; candidates by SimHash and by prefix filtering."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, in_portions, materialize, one_of_each, tie_of
from tessella.llm.graph import components
from tessella.llm.simhash_dedup import near_pairs

SHINGLE, SHARE = 5, 0.8
#: Shingles of all rows are counted by hashed places to tell common ones from rare: two to these powers, by the number of
#: rows. The counts set the order of shingles only, never the result.
PLACES = range(18, 25)
#: Places that are shipped together, and tables of counts that are added up at a time.
BLOCK, FAN = 1 << 16, 16
#: Bytes of text whose shingles a task holds at a time; a longer text stands alone.
PORTION = 4_000_000
#: Long integers of a set's parity sketch: each shingle flips one bit, so sketches differ in no more bits than sets do in shingles.
SKETCH = 8
EPS = 1e-9


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the lower-cased words; of all words where they are fewer; none without words."""
    import xxhash

    # bytes.lower and bytes.split know A-Z and the six ASCII white-space characters only
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(shingle, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def simhash(h: np.ndarray) -> int:
    """A bit is set where it is in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def place(h: np.ndarray, power: int) -> np.ndarray:
    return (h >> np.uint64(64 - power)).astype(np.int64)


def power_of(rows: int) -> int:
    """16 places a row, between the two bounds of PLACES."""
    return min(max(math.ceil(math.log2(max(rows, 1))) + 4, PLACES[0]), PLACES[-1])


def place_counts(docs: DataFrame, shingle: int, power: int) -> np.ndarray:
    """For every place how often all rows' shingles fall there, as 8 times its binary logarithm.

    Each task counts its rows and ships its table in blocks, packed; tables are added FAN at a time
    until the driver gets one byte-packed block for each BLOCK places.
    """
    size = 1 << power

    def count(batches):
        from pyspark import TaskContext

        total, task = np.zeros(size, np.uint32), TaskContext.get().partitionId()
        for b in batches:
            for _, texts in in_portions(b.column(0), PORTION):
                for t in texts.to_pylist():
                    np.add.at(total, place(shingle_hashes(t, shingle), power), 1)
        for k in range(0, size, BLOCK):
            if (part := total[k : k + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK]), pa.array([task]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "task", "counts"])

    def add(key, table):
        total = np.zeros(min(BLOCK, size), np.uint32)
        for c in table["counts"].to_pylist():
            total += np.minimum(np.frombuffer(zlib.decompress(c), np.uint32), np.uint32(2**32 - 1) - total)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "task", "counts"])

    texts = docs.select("text")
    left = texts.rdd.getNumPartitions()
    tables = texts.mapInArrow(count, "block long, task long, counts binary")
    while left > 1:
        left = -(-left // FAN)
        tables = tables.groupBy("block", F.floor(F.col("task") / FAN).alias("to")).applyInArrow(add, "block long, task long, counts binary")
    out = np.zeros(size, np.uint8)
    for r in tables.toLocalIterator():
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(counts)] = 8 * np.log2(1.0 + counts)
    return out


def shingle_prints(docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """(doc_id, tie, node, second, n, rare, sketch, fp) for every row: node and second stand for the set of n shingles, tie for the text.

    Two sets that share enough have one of their rare shingles in common: the first
    n - ceil(share * n) + 1 of n, rare before common, then by hash. fp is the set's SimHash.
    """
    spark = docs.sparkSession
    power = power_of(docs.count())
    often = spark.sparkContext.broadcast(place_counts(docs, shingle, power))

    def run(batches):
        import xxhash

        for b, texts in ((b.slice(at, len(t)), t) for b in batches for at, t in in_portions(b.column(2), PORTION)):
            node, second, n, rare, sketch, fp = [], [], [], [], [], []
            for t in texts.to_pylist():
                h = shingle_hashes(t, shingle)
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                second.append(xxhash.xxh64_intdigest(h.tobytes(), 1))
                n.append(len(h))
                fp.append(simhash(h))
                flips = np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketch.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
                first = len(h) - math.ceil(share * len(h) - EPS) + 1 if len(h) else 0
                rare.append(h[np.argsort(often.value[place(h, power)], kind="stable")[:first]].view(np.int64))
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, second, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), longs[0], longs[1], pa.array(n, pa.int32()), lists, pa.array(sketch, pa.list_(pa.int64())), longs[2]], ["doc_id", "tie", "node", "second", "n", "rare", "sketch", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", tie_of(F.col("text")).alias("tie"), "text").mapInArrow(run, f"doc_id {kind}, tie string, node long, second long, n int, rare array<long>, sketch array<long>, fp long")


def told_apart(prints: DataFrame) -> DataFrame:
    """prints without `second`: sets of one node that differ in it get nodes of their own, so 128 bits tell sets apart."""
    clash = prints.groupBy(F.col("node").alias("_node")).agg(F.min("second").alias("_keep"), F.max("second").alias("_most")).where("_keep <> _most").drop("_most")
    if not clash.limit(1).count():
        return prints.drop("second")
    both = prints.join(materialize(clash, "clash"), F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("second") != F.col("_keep"), F.xxhash64("node", "second")).otherwise(F.col("node"))
    return materialize(both.withColumn("node", own).select(*[c for c in prints.columns if c != "second"]), "prints")


def needed(share: float, na: Column, nb: Column) -> Column:
    """Common shingles from which two sets of na and nb share enough of their union."""
    return F.ceil(F.lit(share / (1 + share)) * (na + nb) - EPS)


def possible(share: float) -> Column:
    """Whether sets a and b whose first common shingle has these places can share enough: by sizes, by what is left after the places, and by the bits in which their sketches differ."""
    na, nb = F.col("a.n"), F.col("b.n")
    least = needed(share, na, nb)
    differ = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    return (F.least(na, nb) >= F.greatest(na, nb) * F.lit(share) - EPS) & (F.least(na - F.col("a.pos"), nb - F.col("b.pos")) >= least) & (differ <= na + nb - 2 * least)


def verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, shingle: int, share: float) -> DataFrame:
    """The pairs (a, b) of nodes that share enough; only texts of nodes in pairs are read again."""

    def run(batches):
        for b, texts in ((b.slice(at, len(t)), t) for b in batches for at, t in in_portions(b.column(1), PORTION)):
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "h"])

    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    one = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("x")).select("node", F.col("x.doc_id").alias("_id"), F.col("x.tie").alias("_tie"))
    one = materialize(one, "wanted")
    texts = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (tie_of(F.col("text")) == F.col("_tie")))
    sets = materialize(texts.select("node", "text").mapInArrow(run, "node long, h array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    out = materialize(both.where(F.size(F.array_intersect("ha", "hb")) >= needed(share, F.size("ha"), F.size("hb"))).select("a", "b"), "near")
    discard(one, sets)
    return out


def alike(nodes: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): candidates by SimHash, each node with one of the nodes whose fingerprints are reached from its own by steps of at most `most` bits."""
    each = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    found = components(near_pairs(each.select("fp", F.col("fp").alias("rep")), most)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    roots = each.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("rep").alias("first"))
    pairs = nodes.select("node", "fp").join(roots.join(least, "root").select("fp", "first"), "fp").where("node <> first")
    return pairs.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))


def near_links(prints: DataFrame, docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """(a, b): links between nodes that join the same groups as all pairs that share enough.

    Nodes meet where their SimHash is alike and where they have a rare shingle in common. Each is
    first compared with one node of its SimHash's class and with one of about its size at each
    shingle, drawn anew for each; then every pair at a shingle that is not yet in one group.
    So a large group of near copies costs a row per member and shingle, not one per pair; members of
    a shingle's largest group are only compared with nodes outside it, and no pair is left out.
    """
    nodes = prints.dropDuplicates(["node"])
    sets = nodes.select("node", "n", F.posexplode("rare").alias("pos", "token"))
    shared = sets.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token")
    sketches = nodes.select("node", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)])
    live = materialize(sets.join(shared.hint("merge"), "token").join(sketches.hint("merge"), "node"), "live")

    sized = live.withColumn("band", F.floor(F.ln("n") / F.lit(-math.log(share))))
    drawn = sized.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("token", "node"), *[c for c in live.columns if c != "token"])).alias("x")).select("token", "band", "x.*")
    first = drawn.alias("a").join(sized.alias("b"), ["token", "band"]).where((F.col("a.node") != F.col("b.node")) & possible(share))
    first = first.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).unionAll(alike(nodes))
    first = materialize(first.distinct(), "pairs")
    links = verified(first, docs, prints, shingle, share)

    grouped = materialize(components(links), "grouped")
    open_ = live.join(grouped, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    mixed = open_.groupBy("token", "g").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("g", F.struct("c", "g")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    open_ = materialize(open_.join(mixed.drop("groups"), "token"), "open")
    # of two nodes in different groups one at least is outside the token's largest group
    outside = open_.where("g <> main")
    rest = outside.alias("a").join(open_.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.g") != F.col("b.g")) & ((F.col("b.g") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))) & possible(share))
    rest = rest.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    rest = materialize(rest, "pairs")
    discard(live, open_, grouped)
    more = verified(rest, docs, prints, shingle, share)
    discard(first, rest)
    return links.unionAll(more)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """The rows of docs, all columns, of which one document of each group of near-duplicates stays.

    Documents are linked where the share of common shingles in all shingles of both (Jaccard, each
    shingle once) is at least share; groups are what links join. The smallest doc_id of a group
    stays (null last, then by text); of rows that repeat with the same doc_id and text one stays.
    Texts of fewer words than a shingle have one shingle of all words; null and empty texts are
    alike. An empty table gives no rows. SimHash and pigeonring only find candidates here: what
    links is the exact share, and the prefix join finds the pairs whose fingerprints differ more.
    """
    raw = materialize(shingle_prints(docs, shingle, share), "prints")
    prints = told_apart(raw)
    found = materialize(components(near_links(prints, docs, shingle, share)), "components")
    out = one_of_each(docs, prints.select("doc_id", "tie", "node").join(found, "node", "left").select("doc_id", "tie", F.coalesce("component", "node").alias("g")))
    discard(raw, prints, found)
    return out
