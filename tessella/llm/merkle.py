"""Merkle manifest of a dataset: a content-addressed graph of digests, and proofs found by descending it.

Every document is a leaf; the leaves of a language form a tree, and the trees' tops form one more.
Trees are cut into packs of SPAN leaves (or nodes) and the levels above them, so a pack is made and
read by one task and a tree of n leaves takes log(n) / log(SPAN) steps. A pack is stored under the
digest of its top node as records digest -> children. Nothing but the root reaches the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize
from tessella.operators.running import running

#: Nodes below the top of a pack, at most.
SPAN = 256
#: Trees up to which their sizes are broadcast, a name and a number each.
FEW_TREES = 20_000
STEPS = "array<struct<before:string,after:string>>"
STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of the values' texts, each led by its bytes and a colon; null is a dash."""
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*fields), 256)


def document_digest(n_chars: Column | None = None) -> Column:
    """The leaf of a row of documents, as it is or with another n_chars."""
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))


def levels_of(nodes: list[str], fan: int, height: int | None) -> list[list[str]]:
    """The nodes and all levels above them: every fan neighbours become one, height times or until one is left."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        below = out[-1]
        out.append([digest(below[i : i + fan]) for i in range(0, len(below), fan)])
    return out


def descend(records: dict[str, list[str]], top: str, rank: int, depth: int, fan: int) -> tuple[str, list[tuple[str, str]]]:
    """The node that rank's digits lead to from top, and the unselected children on the way: (left, right) of each level, lowest first."""
    at, path = top, []
    for level in range(depth - 1, -1, -1):
        children, k = records[at], rank // fan**level % fan
        path.append(("".join(children[:k]), "".join(children[k + 1 :])))
        at = children[k]
    return at, path[::-1]


def _span(fan: int) -> tuple[int, int]:
    height = 1
    while fan ** (height + 1) <= SPAN:
        height += 1
    return height, fan**height


def build_trees(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """(packs of each layer, lowest first; (tree, digest) of the trees' tops).

    nodes: (tree, rank, digest), ranks from 0 without gaps. A pack is (digest, depth, keys,
    children): the records digest -> children of depth levels below digest. Equal packs are one.
    """
    height, span = _span(fan)

    def pack(key, table):
        tree, block = key[0].as_py(), key[1].as_py()
        n = table["n"][0].as_py()
        ranked = sorted(zip(table["rank"].to_pylist(), table["digest"].to_pylist()))
        levels = levels_of([d for _, d in ranked], fan, height if n > span else None)
        records = {above[i // fan]: below[i : i + fan] for below, above in zip(levels, levels[1:]) for i in range(0, len(below), fan)}
        row = {"tree": tree, "rank": block, "digest": levels[-1][0], "n": -(-n // span), "depth": len(levels) - 1, "keys": [*records], "children": [*records.values()]}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("depth", pa.int32()), ("keys", pa.list_(pa.string())), ("children", pa.list_(pa.list_(pa.string())))])
    counts = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "counts")
    trees, most = counts.agg(F.count(F.lit(1)), F.max("n")).first()
    most = most or 0
    layer = nodes.join(F.broadcast(counts) if trees <= FEW_TREES else counts, "tree")
    packs, tops = [], layer.where("n = 1").select("tree", "digest")
    while most > 1:
        grouped = layer.where("n > 1").select("tree", F.floor(F.col("rank") / span).alias("block"), "rank", "digest", "n").repartition("tree", "block").groupBy("tree", "block")
        layer = materialize(grouped.applyInArrow(pack, "tree string, rank long, digest string, n long, depth int, keys array<string>, children array<array<string>>"), "packs")
        packs.append(layer)
        tops = tops.unionAll(layer.where("n = 1").select("tree", "digest"))
        most = -(-most // span)
    return packs, tops


def descend_trees(wanted: DataFrame, starts: DataFrame, packs: list[DataFrame], fan: int) -> DataFrame:
    """The rows of wanted with `subroot`, `found` and `proof`.

    wanted: (tree, rank, any other columns); starts: (tree, digest, path) of the trees' tops, path
    being what is already known above them. Each layer's requests, one for each distinct node, meet
    the pack that the digest above them names, and go down it by the digits of their rank. proof
    holds (before, after) of every level, lowest first: the siblings to the left and to the right,
    written one after the other.
    """
    _, span = _span(fan)
    others = [c for c in wanted.columns if c not in ("tree", "rank")]
    front = starts.select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "digest", "path")
    if not packs:
        return wanted.join(front, "tree").select(*wanted.columns, "subroot", F.col("digest").alias("found"), F.col("path").alias("proof"))
    done = []
    for j in range(len(packs) - 1, -1, -1):
        block = F.floor(F.col("rank") / span)
        asked = wanted.withColumn("block", block) if j == 0 else wanted.select("tree", F.floor(F.col("rank") / span**j).alias("rank")).distinct().withColumn("block", block)
        rest = others if j == 0 else []
        kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["tree", "rank", *rest]) + f", subroot string, found string, proof {STEPS}"

        def step(key, left, right):
            ranks, cols = right["rank"].to_pylist(), [right[c].combine_chunks() for c in ("tree", "rank", *rest)]
            if not left.num_rows:
                raise ValueError(f"no node above {key}")
            top, depth, path, subroot = (left[c][0].as_py() for c in ("digest", "depth", "path", "subroot"))
            above = [(s["before"], s["after"]) for s in path]
            if depth is None:  # the tree ends above this layer: its top is the node itself
                found = [(top, [])] * len(ranks)
            else:
                records = dict(zip(left["keys"][0].as_py(), left["children"][0].as_py()))
                found = [descend(records, top, r % span, depth, fan) for r in ranks]
            steps = [s for _, p in found for s in (*p, *above)]
            ends = [0]
            for _, p in found:
                ends.append(ends[-1] + len(p) + len(above))
            pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["before", "after"])
            proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            return pa.Table.from_arrays([*cols, pa.array([subroot] * len(ranks), pa.string()), pa.array([d for d, _ in found], pa.string()), proof], names=["tree", "rank", *rest, "subroot", "found", "proof"])

        records = packs[j].select("digest", "depth", "keys", "children").dropDuplicates(["digest"])
        above = front.join(records, "digest", "left").select("tree", "block", "subroot", "digest", "path", "depth", "keys", "children").toDF("tree", "block", "subroot", "digest", "path", "depth", "keys", "children")
        got = asked.select("tree", "block", "rank", *rest).toDF("tree", "block", "rank", *rest)
        out = above.groupBy("tree", "block").cogroup(got.groupBy("tree", "block")).applyInArrow(step, schema)
        if j == 0:
            return out.select(*wanted.columns, "subroot", "found", "proof")
        front = materialize(out, "front").select("tree", F.col("rank").alias("block"), "subroot", F.col("found").alias("digest"), F.col("proof").alias("path"))
    return done


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level and left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), 256)


@dataclass
class Manifest:
    """leaves: (tree, rank, doc_id, leaf and the columns asked for); tree names a language. packs and tops hold the records."""

    leaves: DataFrame
    packs: list[DataFrame]
    starts: DataFrame
    root: str | None
    fan: int

    def prove(self, wanted: DataFrame | None = None) -> DataFrame:
        """wanted (rows with tree and rank, all leaves unless given) with `subroot`, `found` (the leaf descended to) and `proof`."""
        return descend_trees(self.leaves if wanted is None else wanted, self.starts, self.packs, self.fan)


def build_manifest(docs: DataFrame, also: dict[str, Column] | None = None, fan: int = 2) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text); also: further columns to carry with each leaf.

    The leaves of a language follow each other by doc_id (null first), then by digest; rows that
    repeat are leaves of their own, with equal digests and different places. Every fan consecutive
    nodes become one, the last run may be shorter, even one node. Languages are ordered by bytes,
    null first. Null and empty texts are leaves like others. An empty table has no root. Other
    columns of docs are not read.
    """
    kept = docs.select("doc_id", "lang", document_digest().alias("leaf"), *[c.alias(n) for n, c in (also or {}).items()])
    # "=" keeps null apart from, and before, the empty name
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = materialize(kept.withColumn("tree", tree).drop("lang"), "leaves").withColumn("_at", F.monotonically_increasing_id())
    ranked = running(rows, "tree", ["doc_id", "leaf", "_at"], {})
    leaves = materialize(ranked.withColumn("rank", F.col("i").cast("long") - 1).drop("i", "_at"), "ranked")
    discard(rows)
    packs, tops = build_trees(leaves.select("tree", "rank", F.col("leaf").alias("digest")), fan)
    tops = materialize(tops, "tops")
    every = running(tops.withColumn("all", F.lit("")), "all", ["tree"], {})
    over = materialize(every.select(F.lit("").alias("tree"), (F.col("i").cast("long") - 1).alias("rank"), F.col("tree").alias("name"), "digest"), "languages")
    upper, top = build_trees(over.select("tree", "rank", "digest"), fan)
    first = top.first()
    root = first["digest"] if first else None
    starts = descend_trees(over.drop("digest"), top.withColumn("path", F.lit([]).cast(STEPS)), upper, fan)
    starts = materialize(starts.select(F.col("name").alias("tree"), F.col("found").alias("digest"), F.col("proof").alias("path")), "starts")
    return Manifest(leaves, packs, starts, root, fan)
