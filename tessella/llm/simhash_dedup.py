"""Near-duplicates by SimHash; candidate pairs by pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, one_of_each, tie_of
from tessella.llm.graph import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the shingles (repeats included) of the lower-cased words; 0 without words."""
    import xxhash

    # bytes.lower and bytes.split know A-Z and the six ASCII white-space characters only
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(g), 42) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, tie: Column | None = None) -> DataFrame:
    """(doc_id, tie, fp as signed long) for every row; tie (a hash of the text unless given) tells texts with the same doc_id apart."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tie", "fp"])

    rows = docs.select("doc_id", (F.xxhash64("text") if tie is None else tie).alias("tie"), "text")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "tie")]
    return rows.mapInArrow(run, f"doc_id {kinds[0]}, tie {kinds[1]}, fp long")


def near_pairs(prints: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): representatives of different fingerprints that differ in at most most bits.

    prints: (fp, rep), each fingerprint once. The bits form a ring of most + 1 segments. If two
    fingerprints differ in at most most bits, then from some segment on every chain of l segments
    holds at most l * most / (most + 1) differences: none in the first, one in the first two and so
    on. So the first segment agrees, and of the second segment one half agrees: these are the join
    key. Longer chains are checked, then the whole distance, inside the join; nothing else leaves it.
    """
    m = most + 1
    width, extra = divmod(BITS, m)
    sizes = [width + (i < extra) for i in range(m)]
    starts = [sum(sizes[:i]) for i in range(m)]

    def part(c, start: int, size: int):
        return F.shiftrightunsigned(c, start).bitwiseAND(F.lit((1 << size) - 1)) if size < 64 else c

    fp = F.col("fp")
    keys = []
    for i in range(m):
        j = (i + 1) % m
        half = sizes[j] // 2
        first = part(fp, starts[i], sizes[i])
        for side, (s, n) in enumerate([(starts[j], half), (starts[j] + half, sizes[j] - half)] if m > 1 else [(0, 64)]):
            keys.append(F.struct(F.lit(2 * i + side).alias("slot"), first.alias("k1"), part(fp, s, n).alias("k2")))
    rows = prints.select("fp", "rep", F.inline(F.array(*keys)))
    a, b = rows.alias("a"), rows.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    ring = None
    for i in range(m):
        chain, total = [], None
        for length in range(1, m + 1):
            s = (i + length - 1) % m
            d = F.bit_count(part(diff, starts[s], sizes[s]))
            total = d if total is None else total + d
            chain.append(total <= length * most // m)
        ok = (F.floor(F.col("a.slot") / 2) == i) & chain[0]
        for c in chain[1:]:
            ok = ok & c
        ring = ok if ring is None else ring | ok
    on = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, on & ring & (F.bit_count(diff) <= most)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def linked_prints(prints: DataFrame, most: int) -> DataFrame:
    """(fp, component_id) for every fingerprint: the smallest doc_id reachable by links, null where all are null."""
    every = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = materialize(components(near_pairs(every.select("fp", F.col("fp").alias("rep")), most)), "components")
    rooted = every.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "id")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def simhash_classes(docs: DataFrame, most: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable by links).

    Equal fingerprints are one node, so a group of copies of any size costs one row per key. Null
    and empty texts have fingerprint zero and are linked like any other. Rows that repeat get equal
    results; a null doc_id names no class; an empty table gives no rows; other columns are not read.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    classes = materialize(linked_prints(prints, most), "classes").select(F.col("fp").alias("print"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, most: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs, all columns, of which one document of each near-duplicate group stays.

    The smallest doc_id of a group stays (null last, then by text), whatever other texts have the
    same doc_id; of rows that repeat with that doc_id and text one stays. Null and empty texts are
    alike. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, tie_of(F.col("text"))), "prints")
    classes = materialize(linked_prints(prints, most), "classes").select(F.col("fp").alias("print"), F.col("root").alias("g"))
    return one_of_each(docs, prints.join(classes, F.col("fp") == F.col("print")).select("doc_id", "tie", "g"))
