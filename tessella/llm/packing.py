"""Best-fit packing of tokenised documents into sequences, by patterns of few documents."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import in_portions, materialize, shuffle_width

#: The form of vocabulary whose ids are those of the runs between blanks, one after the other: it
#: drops white space and never joins across it. Its two settings, as its file must hold them.
RUNS_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
RUNS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs of these signs take the short way: lower-casing and composing them is plain, and the
#: vocabulary splits them into contractions, letters, single digits and other signs.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes without a printable sign take the next free letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - printable))}


#: Bytes of text that a task encodes at once; a longer text is encoded alone.
PORTION = 4_000_000
#: Pieces of one length that a task ranks at once.
ROWS_PER_BUCKET = 100_000
#: Runs, and parts of runs, whose ids a worker keeps in each of two generations.
MOST_KEPT = 200_000


class Kept(dict):
    """What make() gives a key, kept for the keys of late: when a generation is full, it becomes the older one, and that one goes."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) < 64:
            if len(self) >= MOST_KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class PartIds(Kept):
    """The ids that the tokenizer's model gives one part of a run, as bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def make(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()


class RunIds(Kept):
    """The token ids of a run without blanks, as bytes.

    Runs of plain signs are split here and their parts given to the tokenizer's model; all others,
    and those that may hold a special token, to the whole tokenizer. Runs of letters alone are one
    part and kept as that only.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.parts, self.letters = tokenizer, PartIds(tokenizer.model), byte_letters()

    def __missing__(self, run: str) -> bytes:
        if run.isascii() and run.isalpha() and len(run) < 200:
            return self.parts[run.lower()]
        return super().__missing__(run)

    def make(self, run: str) -> bytes:
        if PLAIN.fullmatch(run) and "<|" not in run and len(run) < 200:
            parts = PARTS.findall(run.lower())
            if not run.isascii():
                parts = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
            return b"".join(map(self.parts.__getitem__, parts))
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()


class TextIds:
    """The token ids of whole texts by one vocabulary.

    Where the vocabulary has the form of runs, a batch's runs are split and numbered in Arrow, each
    distinct run is encoded once, and the ids of all runs are gathered by their places. Any other
    vocabulary encodes the texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            form = json.load(f)
        split = json.dumps(form.get("pre_tokenizer"))
        self.by_runs = form.get("normalizer") == RUNS_NORMALIZER and json.dumps(RUNS_SPLIT) in split and '"ByteLevel"' in split
        self.runs = RunIds(self.tokenizer) if self.by_runs else None

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all texts' ids one after the other, each text's closed by the end id; ends are the places behind them."""
        if not self.by_runs:
            found = [[*e.ids, end] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found])
        split = pc.ascii_split_whitespace(texts)
        upto = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        runs = split.flatten().dictionary_encode()
        known = [*map(self.runs.__getitem__, runs.dictionary.to_pylist()), np.uint32(end).tobytes()]
        table = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        # the run behind each text's last one stands for the end id
        codes = np.full(len(runs) + len(texts), len(known) - 1, np.int64)
        within = np.ones(len(codes), bool)
        last = upto + np.arange(len(texts))
        within[last] = False
        codes[within] = runs.indices.to_numpy()
        length = size[codes]
        behind = np.cumsum(length)
        ids = table[np.repeat(at[codes] - behind + length, length) + np.arange(behind[-1] if len(behind) else 0)]
        return ids, behind[last]


@lru_cache(maxsize=2)
def text_ids(vocabulary: str) -> TextIds:
    """One memory of runs per worker process, shared by its tasks."""
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextIds(public_tokenizers.path(vocabulary))


def token_pieces(docs: DataFrame, vocabulary: str, most: int, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids with the end id, cut only where longer than most.

    vocabulary: name of a tokenizer file that public_tokenizers.path finds on every executor.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        from tessella.llm.packing import text_ids

        encode = text_ids(vocabulary)
        for b in batches:
            for first, texts in in_portions(b.column(1).fill_null(""), PORTION):
                ids, ends = encode(texts, end)
                size = np.diff(ends, prepend=0)
                n = -(-size // most)
                who = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(most, size[who] - start)
                at = (ends - size)[who] + start
                crc = [zlib.crc32(ids[s : s + k]) for s, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who + first)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns_of(lengths: np.ndarray, count: np.ndarray, most: int, width: int = 24) -> list[tuple[int, ...]]:
    """Full patterns of one to three lengths: for each longest length, the commonest partners first."""
    have = np.zeros(most + 1, np.int64)
    have[lengths] = count
    out = [(most,)] if have[most] else []
    for a in lengths[::-1]:
        rest = most - int(a)
        if rest < 1:
            continue
        if rest <= a and have[rest]:
            out.append((int(a), rest))
        b = np.arange(-(-rest // 2), min(int(a), rest - 1) + 1)
        value = np.minimum(have[b], have[rest - b])
        for i in np.argsort(-value, kind="stable")[:width]:
            if value[i] > 0:
                out.append((int(a), int(b[i]), rest - int(b[i])))
    return out


def fit_counts(patterns: list[tuple[int, ...]], have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts whose used lengths come near the histogram (projected gradient with momentum)."""
    size = max(map(len, patterns))
    at = np.zeros((len(patterns), size), np.int64)  # length 0 is a place that counts for nothing
    for i, p in enumerate(patterns):
        at[i, : len(p)] = p
    goal = have.astype(float)
    goal[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        u = np.bincount(at.ravel(), weights=np.repeat(x, size), minlength=len(have))
        u[0] = 0
        return u

    uses = np.bincount(at.ravel(), minlength=len(have))
    step = 1.0 / (size * max(1, uses[1:].max()))
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = used(y) - goal
        new = np.maximum(0, y - step * gap[at].sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_sequences(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): how many sequences hold which lengths, using every length as often as it occurs.

    Works on the histogram alone: at most `most` lengths, however many documents there are. The
    fitted counts are rounded down and used from the longest lengths on; what is left is packed by
    best fit: the longest length left, then again and again the longest that still fits, as many
    times over as the counts allow.
    """
    have = np.zeros(most + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    lengths = np.flatnonzero(have)
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = patterns_of(lengths, have[lengths], most) if len(lengths) else []
    if patterns:
        for p, x in sorted(zip(patterns, fit_counts(patterns, have)), key=lambda z: z[0], reverse=True):
            need = {v: p.count(v) for v in p}
            n = min(int(x + 1e-9), *(int(have[v]) // k for v, k in need.items()))
            if n > 0:
                plan.append((p, n))
                for v, k in need.items():
                    have[v] -= n * k
    left = [int(v) for v in np.flatnonzero(have)]
    while left:
        pattern, room, used = [left[-1]], most - left[-1], {left[-1]: 1}
        at = len(left) - 1
        while room > 0:
            at = min(at, bisect_right(left, room) - 1)
            while at >= 0 and used.get(left[at], 0) >= have[left[at]]:
                at -= 1
            if at < 0:
                break
            v = left[at]
            k = min(room // v, int(have[v]) - used.get(v, 0))
            pattern += [v] * k
            used[v] = used.get(v, 0) + k
            room -= k * v
        n = min(int(have[v]) // k for v, k in used.items())
        plan.append((tuple(pattern), n))
        for v, k in used.items():
            have[v] -= n * k
        left = [v for v in left if have[v] > 0]
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]], most: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of the runs of places the plan gives it."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    rank = np.zeros(most + 1, np.int64)
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for v in pattern:
            runs.setdefault(v, []).append((int(rank[v]), sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    return {v: tuple(np.array(x, np.int64) for x in zip(*r)) for v, r in runs.items()}


def pack(docs: DataFrame, most: int = 2048, vocabulary: str = "word_bpe_49k.json", end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of the end id alone. Documents longer than most are cut, no
    others. Rows that repeat are documents of their own; ties are interchangeable. Only the histogram
    of lengths (most entries) reaches the driver, and only the plan made from it goes back. Ranks
    within a length are made in two steps, in buckets that grow in number with the pieces, so neither a
    length that a third of all pieces share nor pieces without a doc_id ever meet in one task. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    # a salt deals rows without a doc_id; it is stored, so all steps see the same
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    pieces = materialize(token_pieces(docs, vocabulary, most, end).withColumn("salt", salt), "pieces")
    buckets = max(1, shuffle_width(spark), -(-pieces.count() // ROWS_PER_BUCKET))
    part = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(buckets)))
    sums = materialize(part.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(plan_sequences(histogram, most), most)
    ahead = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = part.withColumn("r", within).join(ahead, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") - 1 + F.col("ahead")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                on = np.flatnonzero(length == v)
                first, seq, off = slots[int(v)]
                k = np.searchsorted(first, rank[on], side="right") - 1
                sequence[on], offset[on] = seq[k] + rank[on] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
