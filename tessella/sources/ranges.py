"""Files read in parallel by byte ranges: numbers of rows in file order, quoted records, digests.

Spark packs the ranges of a table's files into tasks by size, so neither tasks nor their numbers
follow the files. What does is the file's name, the start of the range and the place within it.
"""

from __future__ import annotations

import csv
import hashlib
import re
from urllib.parse import quote as percent

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.shared import stored, tasks_for

#: Bytes that are digested as one range, and ranges (or runs of them) that are joined at a time.
RANGE, JOINED = 64 << 20, 1024
#: Bytes that are cut into records as one range, and files that are read whole.
RECORDS, PACKED = 16 << 20, r"\.(gz|bz2|zst|lz4)$"


def with_origin(rows: DataFrame) -> DataFrame:
    """rows with `_file`, `_block` (first byte of the range they were read from) and `_seen`, ascending within a range."""
    try:
        return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seen"))
    except AnalysisException as e:
        raise ValueError("rows have places only where they are read from files") from e


def ahead_of_blocks(sizes: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(f, b, one column per sum): what the ranges before each one hold, in two steps.

    sizes: a row for each range (f, b). Ranges are summed by file and files by name, so a table's
    ranges never meet in one window, only a row for each file.
    """
    blocks = sizes.select("f", "b", *[c.alias(n) for n, c in sums.items()])
    files = blocks.groupBy("f").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("f").alias("f_"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"f_{n}") for n in sums])
    within = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.select("f", "b", *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(n) for n in sums])
    return local.join(files, F.col("f") == F.col("f_")).select("f", "b", *[(F.col(n) + F.col(f"f_{n}")).alias(n) for n in sums])


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows with their number from 0 in the order of the files' names and of the rows in each file.

    rows must be read from files, or have the column already. Each range's rows are numbered on
    their own and moved by what the ranges before them hold.
    """
    if name in rows.columns:
        return rows
    a = with_origin(rows)
    ahead = ahead_of_blocks(a.groupBy(F.col("_file").alias("f"), F.col("_block").alias("b")).agg(F.count(F.lit(1)).alias("n")), {"n": F.col("n")})
    local = a.withColumn("_i", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_seen")))
    joined = local.join(ahead, (F.col("_file") == F.col("f")) & (F.col("_block") == F.col("b")))
    return joined.select(*rows.columns, (F.col("n") + F.col("_i") - 1).cast("long").alias(name))


def attach_by_place(left: DataFrame, right: DataFrame, name: str = "place") -> DataFrame:
    """The columns of right beside those of left, row by row in file order; rows of left beyond right's last get nulls."""
    shared = (set(left.columns) & set(right.columns)) - {name}
    if shared:
        raise ValueError(f"both tables have {sorted(shared)}")
    return placed(left, name).join(placed(right, name), name, "left").drop(name)


# ---------------------------------------------------------------- quoted records


def _opened(path: str):
    """The file system of a path as Spark lists it, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(percent(path, safe="/:@="))


def _file_ranges(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, size, i): files without their content, cut into ranges of size bytes, no larger than Spark's own; compressed ones are one range."""
    most, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    size = min(RECORDS, int(most) << 10 * " kmgt".index(unit or " "))
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes")).where("bytes > 0")
    files = files.withColumn("size", F.when(F.col("path").rlike(PACKED), F.col("bytes")).otherwise(F.lit(size)).cast("long"))
    return files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / F.col("size")))).alias("i"))


def _pieces(path: str, size: int, i: int):
    """The byte before range i (none before the first), its bytes, and what follows by the megabyte; a compressed file's bytes in pieces."""
    where, name = _opened(path)
    if re.search(PACKED, path):
        yield b""
        with where.open_input_stream(name, compression="detect") as f:
            while piece := f.read(RECORDS):
                yield piece
        return
    with where.open_input_file(name) as f:
        f.seek(max(i * size - 1, 0))
        yield f.read(1) if i else b""
        yield f.read(size)
        while piece := f.read(1 << 20):
            yield piece


def _records_from(path: str, size: int, i: int, inside: int, mark: int):
    """Arrow arrays of the records that start in range i, without their line's end; the last is read to its end beyond the range."""
    pieces = _pieces(path, size, i)
    before = next(pieces)
    # a range that starts within a record leaves what is left of it to the range where it started
    skip = bool(before) and (bool(inside) or before != b"\n")
    held = b""
    for k, piece in enumerate(pieces):
        beyond = k > 0 and not re.search(PACKED, path)
        if beyond and (skip or not held):
            return
        bytes_ = np.frombuffer(piece, np.uint8)
        lines = np.flatnonzero(bytes_ == 10)
        quotes = np.flatnonzero(bytes_ == mark)
        ends = lines[(inside + np.searchsorted(quotes, lines)) % 2 == 0] + 1
        inside = (inside + len(quotes)) % 2
        if not len(ends):
            held = held if skip else held + piece
            continue
        if beyond:
            yield pa.array([held + piece[: ends[0] - 1]], pa.binary())
            return
        edges = ends if skip else np.concatenate([[0], ends])
        if held:
            yield pa.array([held + piece[: ends[0] - 1]], pa.binary())
            edges = ends
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(piece)])
        yield pc.binary_slice(text, 0, -1).cast(pa.binary())
        skip, held = False, piece[ends[-1] :]
    if held and not skip:
        yield pa.array([held], pa.binary())


def quoted_records(spark: SparkSession, path: str, quote: str = '"', origin: dict[str, Column] | None = None) -> DataFrame:
    """(file, record, text) of every record of quoted text files: record counts from 0 in each file.

    A record ends at a line's end outside quotes; a quote stands around a field or doubled within
    it, nowhere else. Files are read by byte ranges, twice, as range_digests reads them. The first
    time a range's quotes are counted: the parity of all before it tells whether it starts inside
    quotes. The second time a range gives the records that start in it, so rows never meet; a
    record must fit a task. Blank lines outside quotes are no records. origin: columns made of
    `file`, once for each range.
    """
    origin, mark = origin or {}, ord(quote)

    def count(batches):
        for b in batches:
            odd = []
            for path, size, i in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                pieces = _pieces(path, size, i)
                next(pieces)
                # a compressed file has no range after its first
                odd.append(0 if size >= b.column(1)[len(odd)].as_py() else int(np.count_nonzero(np.frombuffer(next(pieces), np.uint8) == mark) % 2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odd, pa.int64())], ["path", "bytes", "size", "i", "odd"])

    def cut(batches):
        for b in batches:
            for r, path, size, i, inside in zip(*(c.to_pylist() for c in b.columns)):
                n = 0
                for text in _records_from(path, size, i, inside, mark):
                    text = text.view(pa.string())
                    text = text.filter(pc.greater(pc.binary_length(pc.ascii_ltrim(text, characters=" \t\r")), 0))
                    for at in range(0, len(text), 10_000):
                        part = text.slice(at, 10_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), r)), pa.array(np.arange(n, n + len(part))), part], ["r", "n", "text"])
                        n += len(part)

    found = _file_ranges(spark, path)
    width = tasks_for(found, 4)
    counted = found.repartition(width, "path", "i").mapInArrow(count, "path string, bytes long, size long, i long, odd long")
    within = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("odd").over(within), F.lit(0)), F.lit(2)).alias("inside")
    known = stored(counted.select("path", "size", "i", inside).select(F.monotonically_increasing_id().alias("r"), "path", "size", "i", "inside"), "ranges")
    rows = stored(known.repartition(width, "path", "i").mapInArrow(cut, "r long, n long, text string"), "records")
    starts = known.join(rows.groupBy("r").agg((F.max("n") + 1).alias("n")), "r", "left")
    ahead = starts.select("r", F.col("path").alias("file"), F.coalesce(F.sum("n").over(within), F.lit(0)).alias("ahead")).withColumns(origin)
    text = F.when(F.endswith("text", F.lit("\r")), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text")).alias("text")
    return rows.join(F.broadcast(ahead), "r").select("file", (F.col("ahead") + F.col("n")).alias("record"), *origin, text)


def read_quoted(spark: SparkSession, path: str, sep: str = ";", place: bool = False) -> DataFrame:
    """The records of quoted text files below their header, all columns as text; a byte-order mark goes, names end at their first blank.

    Every file has a header; the first file's names the columns. place adds the records' number in
    file order, from 0 without the headers.
    """
    records = quoted_records(spark, path)
    head = records.where("record = 0").orderBy("file").first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = [c.removeprefix("﻿").split(" ")[0] for c in next(csv.reader([head["text"]], delimiter=sep))]
    kind = ", ".join(f"_{i} string" for i in range(len(names)))
    rows = records.where("record > 0")
    # records of the files before, from a count for each file
    sizes = rows.groupBy(F.col("file").alias("f")).agg(F.count(F.lit(1)).alias("n")) if place else None
    parsed = rows.select("file", "record", F.from_csv("text", kind, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}).alias("x"))
    fields = [F.col(f"x._{i}").alias(n) for i, n in enumerate(names)]
    if not place:
        return parsed.select(*fields)
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return parsed.join(ahead, F.col("file") == F.col("f")).select(*fields, (F.col("ahead") + F.col("record") - 1).cast("long").alias("place"))


def read_by_name(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = ",", absent: dict[str, str] | None = None, origin: dict[str, Column] | None = None) -> DataFrame:
    """`file` and the named columns, as text, of quoted text files whose headers may differ.

    A column stands where its file's header names it. In files without it, it is null or what absent
    says; an empty field is null in any case. The distinct headers reach the driver; a row for each
    file goes to every task. origin: see quoted_records.
    """
    origin = origin or {}
    records = quoted_records(spark, path, origin=origin)
    heads = records.where("record = 0").select("file", F.col("text").alias("head"))
    kinds = {h["head"]: [c.removeprefix("\ufeff") for c in next(csv.reader([h["head"]], delimiter=sep))] for h in heads.select("head").distinct().collect()}
    width = max(map(len, kinds.values()), default=1)
    parsed = records.where("record > 0").join(F.broadcast(heads), "file").select("file", *origin, "head", F.from_csv("text", ", ".join(f"_{i} string" for i in range(width)), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}).alias("x"))
    out = []
    for c in columns:
        value = F.lit(None).cast("string")
        for head, names in kinds.items():
            here = F.nullif(F.col(f"x._{names.index(c)}"), F.lit("")) if c in names else F.lit((absent or {}).get(c)).cast("string")
            value = F.when(F.col("head") == head, here).otherwise(value)
        out.append(value.alias(c))
    return parsed.select("file", *origin, *out)


# ---------------------------------------------------------------- digests


def range_digests(spark: SparkSession, pattern: str, size: int = RANGE) -> DataFrame:
    """(path, bytes, i, digest): SHA-256 of every range of size bytes of the matching files, read in pieces of a megabyte.

    Files are listed by Spark without their content and opened by pyarrow on the executors, which
    must reach them under the same address. Empty files are not listed.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
    last = (F.ceil(F.col("bytes") / size) - 1).cast("long")
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))

    def digest(batches):
        from pyarrow import fs

        for b in batches:
            out = []
            for path, i in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                h, left = hashlib.sha256(), size
                with where.open_input_file(name) as f:
                    f.seek(i * size)
                    while left and (piece := f.read(min(left, 1 << 20))):
                        h.update(piece)
                        left -= len(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["path", "bytes", "i", "digest"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(width, "path", "i").mapInArrow(digest, "path string, bytes long, i long, digest string")


def file_digests(spark: SparkSession, pattern: str, size: int = RANGE) -> DataFrame:
    """(name, bytes, digest) of files of any size; name is the last part of the path.

    A file of one range has the SHA-256 of its bytes. The digests of more ranges are written one
    after the other and digested again, JOINED at a time, until one is left.
    """
    parts = stored(range_digests(spark, pattern, size), "digests")
    most, below = parts.agg(F.max("i")).first()[0], size
    while most:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        level = parts.groupBy("path", "bytes", F.floor(F.col("i") / JOINED).alias("i")).agg(ordered.alias("d"))
        # a file that has come down to one digest keeps it
        joined = F.when(F.col("bytes") <= below, F.get("d", F.lit(0))).otherwise(F.sha2(F.array_join("d", ""), 256))
        parts, below = level.select("path", "bytes", "i", joined.alias("digest")), below * JOINED
        most //= JOINED
    return parts.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", "digest")


def fingerprint(spark: SparkSession, patterns: str | list[str], size: int = RANGE) -> str:
    """The first 16 hexadecimal signs of SHA-256 over the names and digests of all files, pattern by pattern and by name.

    A pattern without files adds nothing. A name and 64 signs per file meet in one place.
    """
    h = hashlib.sha256()
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        try:
            found = file_digests(spark, pattern, size).orderBy("name", "digest").toLocalIterator()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        for r in found:
            h.update(r["name"].encode())
            h.update(r["digest"].encode())
    return h.hexdigest()[:16]
