"""File sources and sinks by byte ranges and by key, against plain Python."""

import csv
import gzip
import hashlib
import io
import os
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessella.operators import cleaning as CL
from tessella.operators import scoring as SC
from tessella.sources import files, ranges, versions


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few hundred bytes, packed into tasks by size."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_are_numbered_in_file_order(spark, tmp_path, small_ranges):
    for folder, width in (("left", 3), ("right", 40)):
        (tmp_path / folder).mkdir()
        n = 0
        for name, rows in (("a", 10), ("b", 2990), ("c", 1), ("d", 0), ("e", 77)):
            lines = ["id;Q1" if folder == "left" else "age;kind"]
            for _ in range(rows):
                lines.append(f"{n};{n % 7}" if folder == "left" else f"{n + 20};{'k' * (width if n < 10 else 1)}{n}")
                n += 1
            (tmp_path / folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    left, right = (spark.read.csv(f"{tmp_path}/{x}", sep=";", header=True) for x in ("left", "right"))
    assert left.rdd.getNumPartitions() > 20
    got = {int(r["id"]): (int(r["age"]), r["kind"].lstrip("k")) for r in ranges.attach_by_place(left, right).collect()}
    assert got == {i: (i + 20, str(i)) for i in range(3078)}
    places = sorted((r["place"], int(r["id"])) for r in ranges.placed(left.select("id")).collect())
    assert places == [(i, i) for i in range(3078)]
    with pytest.raises(ValueError):
        ranges.attach_by_place(left, left)
    with pytest.raises(ValueError):
        ranges.placed(spark.range(3).select(F.col("id").alias("x")))
    assert ranges.placed(spark.read.schema("id string").csv(f"{tmp_path}/left/d.csv", header=True)).count() == 0


def quoted_table(path, names, rng):
    rows, n = [], 0
    path.mkdir()
    for name in names:
        out = io.StringIO()
        w = csv.writer(out, delimiter=";", lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["id of it", "answer in words", "more"])
        for _ in range(rng.choice([0, 1, 60, 300])):
            text = "".join(rng.choice(["a", "b c", ";", '"', '""', "\n", "\n\n", ";\n", "é", "x" * 50]) for _ in range(rng.randint(0, 12)))
            rows.append((str(n), text, "y" * rng.randint(1, 40)))
            w.writerow(rows[-1])
            n += 1
            if rng.random() < 0.05:
                out.write("\n")
        (path / name).write_text(("﻿" if name.startswith("a") else "") + out.getvalue(), encoding="utf-8", newline="")
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_quoted_records_by_parity(spark, tmp_path, small_ranges, seed):
    rows = quoted_table(tmp_path / "t", ["a.csv", "b.csv", "c.csv"], random.Random(seed))
    got = files.read_labels(spark, f"{tmp_path}/t", place=True)
    assert got.columns == ["id", "answer", "more", "place"]
    assert sorted((r["place"], r["id"], r["answer"] or "", r["more"]) for r in got.collect()) == [(i, *r) for i, r in enumerate(rows)]
    assert spark.read.text(f"{tmp_path}/t", lineSep="\n").rdd.getNumPartitions() > len(rows) // 60


def test_one_quoted_text_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i} ; \"{i}\"" for i in range(500))
    with open(tmp_path / "t.csv", "w", newline="") as f:
        w = csv.writer(f, delimiter=";", lineterminator="\n")
        w.writerows([["k", "v"], ["1", long], ["2", "short"], ["3", long + "\n"]])
    assert {r["k"]: r["v"] for r in files.read_labels(spark, f"{tmp_path}/t.csv").collect()} == {"1": long, "2": "short", "3": long + "\n"}
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError):
        files.read_labels(spark, f"{tmp_path}/none.csv")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_results_are_read_by_ranges(spark, tmp_path, small_ranges, end):
    """One run's large file and a packed one: records of any length come whole, from several tasks."""
    rng, want = random.Random(end), []
    for run, name in (("r1", "part-0.csv"), ("r 2%41", "part-0.csv"), ("r 2%41", "part-1.csv.gz")):
        folder = tmp_path / "model=m" / f"run={run}"
        folder.mkdir(parents=True, exist_ok=True)
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end)
        w.writerow(["question_id", "answer"])
        for i in range(200):
            text = "".join(rng.choice(["a", ",", '"', "\n", "\n\n", "é", "x" * 90]) for _ in range(rng.randint(1, 60 if i % 50 == 7 else 4)))
            want.append(("m", run, i, text))
            w.writerow([i, text])
            if i % 9 == 0:
                out.write("  " + end)
        data = out.getvalue().encode()
        (folder / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    rows = files.read_results(spark, str(tmp_path), "question_id int, answer string", "part-*").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["model"], r["run"], r["question_id"], r["answer"]) for r in rows) == sorted(want)
    assert len({r["task"] for r in rows if r["run"] == "r1"}) > 1


def test_records_of_all_cuts(spark, tmp_path):
    """Wherever a file is cut, each record comes from the range where it starts."""
    data = 'a,b\n1,"x\n""y""\n\n"\n\n22,\xff\n"3\n",""\n4,"end\n'.encode("latin-1")
    (tmp_path / "t.csv").write_bytes(data)
    want = [b"a,b", b'1,"x\n""y""\n\n"', b"", b"22,\xff", b'"3\n",""', b'4,"end\n']
    for size in range(1, len(data) + 2):
        got = []
        for i in range(-(-len(data) // size)):
            inside = data[: i * size].count(b'"') % 2
            got += [x for a in ranges._records_from(f"file:{tmp_path}/t.csv", size, i, inside, ord('"')) for x in a.to_pylist()]
        assert got == want, size


def test_named_columns_need_no_rows_moved(spark, tmp_path):
    """Headers and chosen runs go to the tasks; results are not shuffled by their few files or runs."""
    for run, head in (("r1", "model_answer,expected_text,split"), ("r2", "expected_text,model_answer")):
        (tmp_path / "m" / run).mkdir(parents=True)
        (tmp_path / "m" / run / "per_question_results.csv").write_text(head + "\n" + "".join(f'"y\n","y"{",train" if run == "r1" else ""}\n' for _ in range(5)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = files.read_run_results(spark, str(tmp_path))
        configs = spark.createDataFrame([("m", r, "modal_response", False, r) for r in ("r1", "r2")], "model string, run string, dataset string, reasoning boolean, timestamp string")
        out = SC.run_metrics(configs, results)
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        # ranges are numbered in a join of their own small table
        assert joins and all("BroadcastHashJoin" in x or "[r#" in x for x in joins)
        assert [(r["split"], r["n"], r["accuracy"]) for r in out.collect()] == [("validation", 5, 100.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_survey_columns_attached_from_quoted_files(spark, tmp_path, small_ranges):
    """Codes in one table, labels with line breaks in another, of other files: row i belongs to row i."""
    for t in ("codes", "labels"):
        (tmp_path / t).mkdir()
    cuts = {"codes": [0, 5, 400, 500], "labels": [0, 300, 310, 500]}
    for t, at in cuts.items():
        for k, (a, b) in enumerate(zip(at, at[1:])):
            with open(tmp_path / t / f"{k}.csv", "w", newline="") as f:
                w = csv.writer(f, delimiter=";", lineterminator="\n")
                w.writerow(["id", "Q1"] if t == "codes" else ["Q262 age", "Q287 class"])
                w.writerows([i, i % 5] if t == "codes" else [i + 20, f"c{i % 4}\n;"] for i in range(a, b))
    mapping = spark.createDataFrame([("value survey", ["Q1"])], "question_type string, column_names array<string>")
    out = CL.value_survey(files.read_coded(spark, f"{tmp_path}/codes", ["id", "Q1"]), files.read_labels(spark, f"{tmp_path}/labels", place=True), mapping)
    assert {tuple(r) for r in out.collect()} == {(float(i), float(i % 5), str(i + 20), f"c{i % 4}\n;") for i in range(500)} and out.columns == ["id", "Q1", "age", "social_class"]


def plain_tree(data, size):
    d = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
    while len(d) > 1:
        d = [hashlib.sha256("".join(d[i : i + ranges.JOINED]).encode()).hexdigest() for i in range(0, len(d), ranges.JOINED)]
    return d[0]


def test_digests_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "JOINED", 3)
    rng = random.Random(5)
    data = {f"f{n}.bin": rng.randbytes(n) for n in (0, 1, 99, 100, 101, 300, 301, 901, 2701, 5000)}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    got = {r["name"]: (r["bytes"], r["digest"]) for r in ranges.file_digests(spark, f"{tmp_path}/*.bin", 100).collect()}
    data.pop("f0.bin")  # Spark lists no empty files
    assert got == {name: (len(b), plain_tree(b, 100)) for name, b in data.items()}
    whole = {r["name"]: r["digest"] for r in ranges.file_digests(spark, f"{tmp_path}/*.bin").collect()}
    assert whole == {name: hashlib.sha256(b).hexdigest() for name, b in data.items()}
    key = hashlib.sha256("".join(n + whole[n] for n in ("f1.bin", "f99.bin")).encode()).hexdigest()[:16]
    assert ranges.fingerprint(spark, [f"{tmp_path}/f1.bin", f"{tmp_path}/gone.bin", f"{tmp_path}/f99.bin"]) == key


def test_files_beyond_two_gigabytes_are_digested(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:  # sparse: takes no space
        f.seek((1 << 31) + 5)
        f.write(b"end")
    size = 1 << 30
    n = os.path.getsize(tmp_path / "big.bin")
    zero = hashlib.sha256(bytes(size)).hexdigest()
    last = hashlib.sha256(bytes(n - 2 * size - 3) + b"end").hexdigest()
    want = hashlib.sha256((zero * 2 + last).encode()).hexdigest()
    assert [(r["bytes"], r["digest"]) for r in ranges.file_digests(spark, f"{tmp_path}/big.bin", size).collect()] == [(n, want)]


def test_keyed_tables_are_recomputed_and_never_half_read(spark, tmp_path):
    root, calls = f"{tmp_path}/cache", []

    def make(n):
        return lambda: calls.append(n) or spark.range(n).withColumn("p", F.col("id") % 2)

    assert versions.current(spark, root) is None
    assert versions.keyed(spark, root, "k1", make(3)).count() == versions.keyed(spark, root, "k1", make(3)).count() == 3 and calls == [3]
    first = versions.current(spark, root)[1]
    old = spark.read.parquet(first)
    assert versions.keyed(spark, root, "k2", make(5), ("p",)).count() == 5 and calls == [3, 5]
    assert old.count() == 3  # those who read the version before can end
    # a writer that dies half way: its folder has no _SUCCESS and no one points to it
    bad = F.when(F.col("id") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark.range(0, 100, 1, 4).select(bad), root, "k3")
    assert versions.current(spark, root)[0] == "k2" and versions.keyed(spark, root, "k2", make(9), ("p",)).count() == 5 and calls == [3, 5]
    assert versions.keyed(spark, root, "k3", make(7)).count() == 7
    names = [n for n in os.listdir(root) if n.startswith("version-") and os.path.exists(f"{root}/{n}/_SUCCESS")]
    assert len(names) == 2 and os.path.basename(first) not in names and not [n for n in os.listdir(root) if n.startswith(".CURRENT-")]
    # a version whose end mark is gone, and a pointer that cannot be read, count as nothing
    os.remove(f"{versions.current(spark, root)[1]}/_SUCCESS")
    assert versions.current(spark, root) is None and versions.keyed(spark, root, "k3", make(8)).count() == 8
    with open(f"{root}/CURRENT", "w") as f:
        f.write("{")
    os.remove(f"{root}/.CURRENT.crc") if os.path.exists(f"{root}/.CURRENT.crc") else None
    assert versions.current(spark, root) is None


def test_published_dataset_loses_stale_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("c", "train", "0", 1), ("c", "train", "1", 2), ("d", "validation", "0", 3)], "config string, split string, subpopulation string, x int")
    files.write_dataset(rows, f"{tmp_path}/ds", "one")
    assert Counter(r["config"] for r in files.manifest(spark, files.dataset_path(spark, f"{tmp_path}/ds")).collect())[None] == 1
    files.write_dataset(rows.where("config = 'c'"), f"{tmp_path}/ds", "two")
    left = files.manifest(spark, files.dataset_path(spark, f"{tmp_path}/ds")).collect()
    assert {r["config"] for r in left} == {"c", None} and max(r["rows"] for r in left) == 2
