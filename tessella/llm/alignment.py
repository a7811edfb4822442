"""Alignment of two tokenizers over the same texts, by galloping intersection of their token ends."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import in_portions, materialize
from tessella.llm.packing import byte_letters

#: Bytes of text of a chunk: its documents are aligned together, and its distinct id pairs are priced together.
CHUNK = 4_000_000
#: A cut: a single blank before a sign that is no white space, mark or control sign.
CUT = r" ([^\s\p{Z}\p{M}\p{C}\x{85}])"
BLANK = "▁"
MARK = "\x00"


class Tokenizers:
    """Two vocabularies: A of byte-level pieces, given a blank and the text; B of pieces that mark a blank, given the text.

    A never joins a blank before a sign with what is left of it, and B, having no piece with the
    blank's mark inside, does not either where that blank is single. So texts are cut there, each
    distinct piece is encoded once, and the ids of all pieces are gathered by their places. A text
    that begins with a blank or has a double one, the blank's own mark or a zero sign is encoded
    whole; so are all texts if the vocabularies have other forms.
    """

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = {letter: b for b, letter in byte_letters().items()}
        self.bytes_a = [b"".join(bytes([signs[c]]) if c in signs else c.encode("latin-1") for c in self.a.id_to_token(i)) if self.a.id_to_token(i) is not None else b"" for i in range(self.a.get_vocab_size())]
        spelt = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(spelt)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        with open(path_a) as f:
            form = json.load(f)
        level = form.get("pre_tokenizer") or {}
        plain = form.get("normalizer") is None and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        self.cuts = bool(plain) and not any(BLANK in p.lstrip(BLANK) for p in spelt) and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")
        self.ranks = self._ranks(path_a.removesuffix(".json") + ".tiktoken") if self.cuts else None
        na, nb = len(self.bytes_a), len(self.bytes_b)
        # decimal ids with the sign that follows them: A within and at the end of its side, then B
        self.signs = [f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)] + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)]

    def _ranks(self, path: str):
        """The vocabulary of A as ranks, where the file beside it holds the same tokens: the same ids, found faster."""
        import base64
        import os

        import public_tokenizers
        import tiktoken

        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if any(self.bytes_a[i] != token for token, i in ranks.items()) or len(ranks) + len(self.a.get_added_tokens_decoder()) != len(self.bytes_a):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a(self, text: str) -> list[int]:
        if self.ranks is not None and len(text) < 2000:
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def spelt(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, their number by piece, B's ids, their number, whether both spell the piece) of pieces, which A gets behind a blank."""
        a, b = [self._a(" " + p) for p in pieces], self.b.encode(pieces, num_threads=1) if pieces else []
        plain = [b" " + p.encode() for p in pieces]
        out, length = [], np.fromiter(map(len, plain), np.int64, len(plain))
        same, together = np.ones(len(pieces), bool), b"".join(plain)
        for ids, size, table in ((a, self.size_a, self.bytes_a), (b, self.size_b, self.bytes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, n.sum())
            upto = np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], np.cumsum(n)])]
            if (np.diff(upto) != length).any() or b"".join(map(table.__getitem__, flat.tolist())) != together:
                same &= [b"".join(map(table.__getitem__, x)) == p for x, p in zip(ids, plain)]
            out += [flat, n]
        return *out, same

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their ends by text, ids of B, their ends by text, texts that both spell): texts without any have no ids."""
        n = len(texts)
        if self.cuts:
            odd = pc.match_substring_regex(texts, f"^ |  |{BLANK}|\\x00").to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(n, bool)
        order = np.argsort(odd, kind="stable")
        plain, whole = texts.take(pa.array(order[: n - odd.sum()])), texts.take(pa.array(order[n - odd.sum() :]))
        split = pc.split_pattern(pc.replace_substring_regex(plain, CUT, MARK + r"\1"), MARK)
        coded = split.flatten().dictionary_encode()
        codes = np.concatenate([coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + np.arange(len(whole))])
        counts = np.ones(n, np.int64)
        counts[order[: len(plain)]] = np.diff(split.offsets.to_numpy()) if len(plain) else 0
        ids_a, n_a, ids_b, n_b, same = self.spelt(coded.dictionary.to_pylist() + whole.to_pylist())
        # pieces stand in the order plain texts, whole texts; put the texts' pieces in the texts' own order
        first = np.zeros(n, np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        codes = codes[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        owner = np.repeat(np.arange(n), counts)
        good = np.bincount(owner, ~same[codes], n) == 0
        for i in np.flatnonzero(~good).tolist():  # pieces that differ may still spell the text together
            text = (" " + texts[i].as_py()).encode()
            good[i] = all(b"".join(map(table.__getitem__, gathered(ids, k, codes[owner == i]).tolist())) == text for ids, k, table in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)))
        good &= pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        keep = good[owner]
        codes, owner = codes[keep], owner[keep]
        upto = lambda k: np.cumsum(np.bincount(owner, k[codes], n)).astype(np.int64)
        return gathered(ids_a, n_a, codes), upto(n_a), gathered(ids_b, n_b, codes), upto(n_b), good


def gathered(ids: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the pieces that codes name, one after the other; the pieces' n ids stand one after the other in ids."""
    at, length = np.cumsum(n) - n, n[codes]
    behind = np.cumsum(length)
    return ids[np.repeat(at[codes] - behind + length, length) + np.arange(length.sum())]


def gallop(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each x the first place of ascending y whose value is not below it, searched from the place at.

    Steps of 1, 2, 4, ... away from at until x is passed, then halving of the last step; all x step
    together, those that have passed drop out. The last y must not be below any x.
    """
    n = len(y)
    low, high = np.full(len(x), -1), np.full(len(x), n - 1)  # y[low] < x <= y[high]
    below = y[at] < x
    low[below], high[~below] = at[below], at[~below]
    live, step = np.arange(len(x)), 1
    while len(live):
        up = below[live]
        probe = np.where(up, np.minimum(low[live] + step, n - 1), np.maximum(high[live] - step, 0))
        less = y[probe] < x[live]
        low[live[less]], high[live[~less]] = probe[less], probe[~less]
        # going up it ends at a value not below x, going down at one below x or at the first place
        live = live[(up & less) | (~up & ~less & (probe > 0))]
        step *= 2
    live = np.flatnonzero(high - low > 1)
    while len(live):
        middle = (low[live] + high[live]) // 2
        less = y[middle] < x[live]
        low[live[less]], high[live[~less]] = middle[less], middle[~less]
        live = live[high[live] - low[live] > 1]
    return high


def common_ends(ends_a: np.ndarray, upto_a: np.ndarray, ends_b: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ends_a and ends_b of the values that both hold, for texts one after the other.

    ends: ascending over all texts; upto: the place behind each text's last. Of each text the
    shorter list drives the search in the longer one, from its place in proportion.
    """
    first_a, first_b = upto_a - np.diff(upto_a, prepend=0), upto_b - np.diff(upto_b, prepend=0)
    na, nb = upto_a - first_a, upto_b - first_b
    found = []
    for drive, (x, fx, nx, y, fy, ny) in ((na <= nb, (ends_a, first_a, na, ends_b, first_b, nb)), (na > nb, (ends_b, first_b, nb, ends_a, first_a, na))):
        who = np.repeat(np.flatnonzero(drive), nx[drive])
        if not len(who):
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        i = np.arange(len(who)) - np.repeat(np.cumsum(nx[drive]) - nx[drive], nx[drive])
        mine = fx[who] + i
        place = gallop(x[mine], y, fy[who] + i * ny[who] // nx[who])
        hit = y[place] == x[mine]
        found.append((mine[hit], place[hit]))
    (a1, b1), (b2, a2) = found
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def group_signs(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, t: Tokenizers) -> np.ndarray:
    """Places in t.signs that write `a1,a2|b1;a3|b2,b3;` for the groups that the common ends at cut_a and cut_b close, in order."""
    na, nb = len(t.bytes_a), len(t.bytes_b)
    out = np.empty(len(ids_a) + len(ids_b), np.int32)
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    sign_a, sign_b = ids_a.copy(), ids_b + 2 * na
    sign_a[cut_a] += na
    sign_b[cut_b] += nb
    out[np.arange(len(ids_a)) + np.repeat(cut_b + 1 - size_b, size_a)] = sign_a
    out[np.arange(len(ids_b)) + np.repeat(cut_a + 1, size_b)] = sign_b
    return out


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Tokenizers:
    """One pair of vocabularies per worker process, shared by its tasks."""
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizers(public_tokenizers.path(a), public_tokenizers.path(b))


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(chunk, doc_id, n_a, n_b, n_groups, groups_sha256, at, pairs, times) for every row.

    A chunk is a run of rows of one task with at most CHUNK bytes of text, or one longer text. at
    numbers each link's id pair among the chunk's distinct ones; the chunk's first row holds these
    pairs (A's id times 2^32 plus B's) and how often the chunk links each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "at", "pairs", "times"]

    def run(batches):
        from pyspark import TaskContext

        from tessella.llm.alignment import tokenizers

        t, task, seen = tokenizers(a, b), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in in_portions(batch.column(1).fill_null(""), CHUNK):
                ids_a, upto_a, ids_b, upto_b, _ = t.encode(texts)
                ends_a, ends_b = np.cumsum(t.size_a[ids_a]), np.cumsum(t.size_b[ids_b])
                link_a, link_b = common_ends(ends_a, upto_a, ends_b, upto_b)
                links = ids_a[link_a].astype(np.int64) << 32 | ids_b[link_b]
                pairs, at, times = np.unique(links, return_inverse=True, return_counts=True)
                upto = np.searchsorted(link_a, upto_a)
                # a text's bytes end with a token of both, so no group reaches into the next text
                signs, digests, start = group_signs(ids_a, ids_b, link_a, link_b, t), [], 0
                for stop in (upto_a + upto_b).tolist():
                    groups = "".join(map(t.signs.__getitem__, signs[start:stop].tolist()))[:-1]
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                    start = stop
                rows, n = len(texts), np.diff(upto, prepend=0)
                lead = np.concatenate([[0], np.full(rows, len(pairs))]).astype(np.int32)
                held = np.arange(rows) > 0
                lists = [pa.ListArray.from_arrays(pa.array(lead), pa.array(x, pa.int64()), mask=pa.array(held)) for x in (pairs, times)]
                at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(at.astype(np.int32)))
                counts = [pa.array(x.astype(np.int64)) for x in (np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), n)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{seen}"] * rows), batch.column(0).slice(first, rows), *counts, pa.array(digests), at, *lists], names)
                seen += 1

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk string, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, at array<int>, pairs array<long>, times array<long>")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a, b: names of tokenizer files that public_tokenizers.path finds on every executor. Texts null,
    empty or not spelt by both vocabularies have no tokens: zeros and an empty digest. Every token
    has a byte at least, so ends ascend and each common end is one link. A pair's count is summed
    over the chunks that hold it, and goes back to each of them once; so a pair in all documents
    costs a row per chunk. Rows that repeat count each; an empty table gives no rows; other columns
    are not read.
    """
    found = materialize(aligned(docs, a, b), "aligned")
    chunks = found.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("chunk", "at", "x.pairs", "x.times")
    chunks = chunks.withColumnRenamed("pairs", "pair")
    counts = materialize(chunks.groupBy("pair").agg(F.sum("times").alias("count")), "counts").withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))
    most = counts.groupBy(F.col("b").alias("b_")).agg(F.max("count").alias("most"))
    priced = counts.join(most, F.col("b") == F.col("b_")).select(F.col("pair").alias("pair_"), "count", (F.col("count") == F.col("most")).alias("best"))
    priced = chunks.join(priced, F.col("pair") == F.col("pair_")).select("chunk", "at", "count", "best").toDF("chunk", "at", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def price(key, left, right):
        at = right["at"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        lists = left["at"].combine_chunks()
        n, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(n)])
        totals = [np.concatenate([[0], np.cumsum(x[flat])]) for x in (best, count)]
        sums = [pa.array(c[upto[1:]] - c[upto[:-1]]) for c in totals]
        return pa.Table.from_arrays([*[left[c] for c in ("doc_id", "n_a", "n_b", "n_groups")], pa.array(n.astype(np.int64)), *sums, left["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = found.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "at")
    return rows.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(price, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
