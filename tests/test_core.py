"""The core library on small tables: queries against SQL, sources and sinks, models, the stream."""

import json
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.functions import text as TX
from tessella.operators import cleaning as CL
from tessella.operators import components as CO
from tessella.operators import latent as LA
from tessella.operators import running as RU
from tessella.operators import scoring as SC
from tessella.operators import statistics as ST
from tessella.plans import registry
from tessella.plans import views as V
from tessella.sources import files
from tessella.streaming import monitor

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(columns)
    fix = lambda v: None if v is None or v != v else round(v, 5) if isinstance(v, float) else v
    return Counter(tuple(str(fix(r[c])) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "events", "benchmark", "conversations", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracles()[name])
    columns = want.columns
    assert sorted(got.columns) == sorted(columns)
    a = _rows(columns, [r.asDict() for r in got.collect()])
    b = _rows(columns, [dict(zip(columns, r)) for r in want.fetchall()])
    assert a == b


def test_cramers_v_yates_and_small_tables(spark):
    rows = [(i, c, float(v)) for i in range(100) for c, v in (("a", i % 2), ("b", (i // 2) % 2 if i < 80 else i % 2), ("c", 1), ("d", i % 3 if i < 30 else None or 0))]
    r = spark.createDataFrame(rows, "respondent_id long, column_name string, code double")
    bat = spark.createDataFrame([(c, i) for i, c in enumerate("abcd")], "column_name string, battery int")
    v = {(x["a"], x["b"]): x["v"] for x in ST.cramers_v(ST.pair_cells(r, bat)).collect()}
    assert v[("a", "c")] is None
    n = Counter((i % 2, (i // 2) % 2 if i < 80 else i % 2) for i in range(100))
    chi = 0.0
    for x in (0, 1):
        for y in (0, 1):
            e = sum(n[(x, k)] for k in (0, 1)) * sum(n[(k, y)] for k in (0, 1)) / 100
            d = abs(n[(x, y)] - e)
            chi += (d - min(0.5, d)) ** 2 / e
    assert abs(v[("a", "b")] - (chi / 100) ** 0.5) < 1e-9


def test_redundancy_components_reach_the_smallest_name(spark):
    names = [f"c{i:02d}" for i in range(20)]
    links = [(names[i], names[i + 1], 0.9) for i in range(18, 8, -1)] + [("c01", "c07", 0.6), ("c03", "c07", 0.51), ("c00", "c01", 0.5)]
    columns = spark.createDataFrame([(n,) for n in names], "column_name string")
    got = dict(map(tuple, CO.redundancy_components(columns, spark.createDataFrame(links, "a string, b string, v double")).collect()))
    assert got == {n: "c09" if n > "c09" else "c01" if n in ("c03", "c07") else n for n in names}
    none = spark.createDataFrame([], "a string, b string, v double")
    assert all(r["root"] == r["column_name"] for r in CO.redundancy_components(columns, none).collect())
    assert CO.redundancy_components(columns.limit(0), none).count() == 0


def test_greedy_pick_equals_the_walk(spark):
    rng = random.Random(1)
    rows = [(f"q{i}", rng.randint(0, 8), f"r{rng.randint(0, 8)}", i) for i in range(40)]
    taken, b, r = set(), set(), set()
    for name, battery, root, _ in rows:
        if battery not in b and root not in r:
            taken.add(name)
            b.add(battery)
            r.add(root)
    got = CO.greedy_pick(spark.createDataFrame(rows, "column_name string, battery int, root string, rank int"))
    assert {x["column_name"] for x in got.collect()} == taken


def test_latent_classes_find_planted_groups(spark):
    rng = random.Random(2)
    rows = [(i, f"c{j}", float(rng.random() < (0.9 if i % 2 else 0.1)) if rng.random() > 0.05 else None) for i in range(300) for j in range(8)]
    r = spark.createDataFrame(rows, "respondent_id long, column_name string, code double")
    parameters, priors, loglik = LA.fit_latent_classes(r, 2, rounds=15)
    post = LA.posteriors(r, parameters, priors)
    hard = post.groupBy("respondent_id").agg(F.max_by("class", "p").alias("k")).select((F.col("respondent_id") % 2).alias("x"), F.col("k").alias("y"))
    assert ST.adjusted_rand(hard).first()["ari"] > 0.9
    ic = LA.information_criteria(r, 2, loglik)
    assert ic["parameters"] == 2 * 8 + 1 and ic["bic"] > ic["aic"]


def test_scores_and_text(spark):
    df = spark.createDataFrame([([("A", -0.1), (" B", -2.0), ("C.", -3.0)], "B"), ([("A", -0.1), ("Banana", -2.0)], "B"), ([("A", -0.1)], "B")], "top array<struct<token:string,logprob:double>>, letter string")
    got = [round(r[0], 6) for r in df.select(SC.first_token_probability(F.col("top"), F.col("letter"))).collect()]
    assert got == [0.135335, 0.135335, 0.0]
    one = spark.range(1).select(
        SC.renormalized(F.array(F.lit(1.0), F.lit(3.0))).alias("a"),
        SC.renormalized(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
        SC.after_marker(F.lit("x </think>  yes ")).alias("m"),
        SC.answer_matches(F.lit(" b. "), F.lit("B"), True).alias("eq"),
        F.array_join(TX.lettered(F.array(F.lit("x"), F.lit("y"))), "|").alias("l"),
        TX.base_model(F.lit("m-nz-wvs-modal-overall")).alias("b"),
        TX.adapter_method(F.lit("m-nz-wvs-first_token-overall")).alias("ad"),
        TX.run_subpopulation(F.lit("modal-cluster_1-2026")).alias("s"),
        TX.user_prompt(F.lit("T"), F.lit("Q"), F.lit("S"), F.array(F.lit("o1"), F.lit("o2"))).alias("p"),
        CL.lenient_date(F.lit("20261340")).alias("bad"),
    ).first()
    assert (one["a"], one["z"], one["m"], one["eq"], one["l"], one["b"], one["ad"], one["s"], one["bad"]) == ([0.25, 0.75], [0.0, 0.0], "yes", True, "A. x|B. y", "m", "first_token", "cluster_1", None)
    assert one["p"] == "T\n\nOptions:\no1\no2\n\nS:"


def test_answers_labels_and_losses(spark):
    one = spark.range(1).select(
        SC.after_marker(F.lit("a </think> b </think>\n c <|im_end|> ")).alias("first"),
        SC.after_marker(F.lit("only thought </think>  ")).alias("fallback"),
        SC.after_marker(F.lit(" \n ")).alias("empty"),
        SC.modal_letter(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("letter"),
        SC.modal_letter(F.array().cast("array<double>")).alias("none"),
        SC.option_loss(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(50.0)), F.array(F.lit(True), F.lit(True), F.lit(False))).alias("loss"),
        TX.adapter(F.lit("plain")).alias("plain"),
        TX.adapter_label(F.lit("m-nz-wvs-full_string_distribution-cluster_1")).alias("label"),
        TX.question_label(F.lit(7), F.lit("q" * 60), F.lit("")).alias("long"),
        CL.short_label(F.lit("income_scale"), F.lit("Top{10}")).alias("income"),
        CL.is_junk(F.lit(None).cast("string")).alias("junk"),
        CL.column_kind(F.lit("date")).alias("kind"),
    ).first()
    assert (one["first"], one["fallback"], one["empty"], one["letter"], one["none"]) == ("b </think>\n c", "only thought </think>", None, "B", None)
    assert abs(one["loss"] - 0.693147) < 1e-6
    assert (one["plain"], one["label"], one["long"], one["income"], one["junk"], one["kind"]) == ("base", "Full string (cluster 1)", "Q7: " + "q" * 50, "$100K+", False, None)


def test_fit_table(spark):
    sweep = spark.createDataFrame([(1, -100.0, 1, 202.0, 205.0), (2, -90.0, 3, 186.0, 195.0), (3, -89.0, 5, 188.0, 203.0)], "k int, loglik double, parameters int, aic double, bic double")
    got = {r["k"]: (r["aic_delta"], r["bic_delta"], r["best"], r["ratio"]) for r in LA.fit_table(sweep).collect()}
    assert got == {1: (16.0, 10.0, 2, None), 2: (0.0, 0.0, 2, 20.0), 3: (2.0, 8.0, 2, 2.0)}


def test_items_expand_only_matching_sub_questions(spark):
    rows = [(1, "q", ["s1", "s2"], ["Q1", "Q2"]), (2, "r", ["s"], ["Q3", "Q4"]), (3, "t", [], ["Q5"]), (4, "u", [""], ["Q6"])]
    got = [(r["column_name"], r["sub_question"]) for r in CL.expand_items(spark.createDataFrame(rows, "id int, question string, sub_questions array<string>, column_names array<string>")).orderBy("column_name").collect()]
    assert got == [("Q1", "s1"), ("Q2", "s2"), ("Q3", None), ("Q4", None), ("Q5", None), ("Q6", None)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("id;Q1\n1;2\n2;-5\n")
    assert [tuple(r) for r in files.read_coded(spark, f"{tmp_path}/codes.csv", ["id", "Q1"]).collect()] == [(1.0, 2.0), (2.0, -5.0)]
    (tmp_path / "text.csv").write_text('﻿id x;Q1 long name\n1;"a;b"\n', encoding="utf-8")
    t = files.read_labels(spark, f"{tmp_path}/text.csv")
    assert t.columns == ["id", "Q1"] and t.first()["Q1"] == "a;b"
    (tmp_path / "t.json").write_text(json.dumps({"system_prompts": {"a": "x"}, "question_templates": {"1": None}}))
    assert Counter(r["kind"] for r in files.read_templates(spark, f"{tmp_path}/t.json").collect()) == {"system_prompts": 1, "question_templates": 1}
    run = tmp_path / "evals" / "m1" / "r1"
    run.mkdir(parents=True)
    (run / "config.json").write_text(json.dumps({"split": "train", "timestamp": "2026"}))
    assert [(r["model"], r["run"], r["split"]) for r in files.read_runs(spark, f"{tmp_path}/evals").collect()] == [("m1", "r1", "train")]
    rows = spark.createDataFrame([("c", "train", "0", 1), ("c", "train", "1", 2), ("c", "validation", "0", 3)], "config string, split string, subpopulation string, x int")
    total = [r for r in files.manifest(spark, files.write_dataset(rows, f"{tmp_path}/ds")).collect() if r["config"] is None]
    assert len(total) == 1 and total[0]["rows"] == 3
    d = spark.createDataFrame([("overall", "Q1", 0, 1.0, 0.5), ("0", "Q1", 0, 1.0, 0.25), ("0", "Q1", 1, 2.0, 0.75)], "subpopulation string, column_name string, pos int, code double, p double")
    sizes, labels = spark.createDataFrame([("overall", 8), ("0", 2)], "subpopulation string, size long"), spark.createDataFrame([("Q1", 1.0, "yes"), ("Q1", 2.0, "no")], "column_name string, code double, label string")
    files.write_distributions(d, sizes, labels, f"{tmp_path}/dist")
    found = spark.read.json(f"{tmp_path}/dist").collect()
    assert len(found) == 1 and (found[0]["size"], found[0]["weight"]) == (2, 0.25)
    assert found[0]["items"]["Q1"].asDict() == {"numeric_codes": [1.0, 2.0], "word_labels": ["yes", "no"], "distribution": [0.25, 0.75]}
    (tmp_path / "map.json").write_text(json.dumps([{"id": 1, "question": "q", "column_names": ["Q1"]}, {"id": 2, "question": "r", "column_names": []}]))
    assert [(r["id"], r["column_names"]) for r in files.read_mapping(spark, f"{tmp_path}/map.json").collect()] == [(1, ["Q1"]), (2, [])]
    (run / "per_question_results.csv").write_text('question_id,answer\n7,"a\nb, ""c"""\n,x\n')
    assert [tuple(r) for r in files.read_results(spark, f"{tmp_path}/evals", "question_id int, answer string").orderBy("question_id").collect()] == [(None, "x", "m1", "r1"), (7, 'a\nb, "c"', "m1", "r1")]


def test_columns_are_attached_by_place(spark, tmp_path):
    for name, rows in (("codes", ["id;Q1;Q9", *[f"{i};{i % 5};{i % 3}" for i in range(500)]]), ("labels", ["id;Q262;Q287;Q1", *[f"{i};{i + 20};c{i % 4};x" for i in range(500)]])):
        (tmp_path / f"{name}.csv").write_text("\n".join(rows))
    codes, labels = (spark.read.csv(f"{tmp_path}/{n}.csv", sep=";", header=True) for n in ("codes", "labels"))
    mapping = spark.createDataFrame([("value survey", ["Q1", "Q2"]), ("other", ["Q9"])], "question_type string, column_names array<string>")
    for key in (None, "id"):
        out = CL.value_survey(codes, labels, mapping, key)
        assert out.columns == ["id", "Q1", "age", "social_class"]
        assert {tuple(r) for r in out.collect()} == {(str(i), str(i % 5), str(i + 20), f"c{i % 4}") for i in range(500)}
    assert len(CL.RESPONDENT_COLUMNS) == 38


def test_running_sums_and_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1.0, 2.0, 2.0, 7.5])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    got = {r["o"]: (r["i"], r["s"]) for r in RU.running(df, "k", ["o"], {"s": F.col("v")}).collect()}
    place, total = Counter(), Counter()
    for k, o, v in rows:
        place[k] += 1
        total[k] += v or 0
        assert got[o] == (place[k], total[k])
    found = {r["k"]: (r["a"], r["b"]) for r in RU.exact_percentiles(df, "k", "v", {"a": 0.5, "b": 0.975}).collect()}
    for k in ("a", "b", None):
        v = [x for q, _, x in rows if q == k and x is not None]
        assert np.allclose(found[k], np.percentile(v, [50, 97.5]))
    assert {r["bin"]: r["n"] for r in RU.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,)], "v double"), "v", 0.0, 1.0, 4).collect()} == {0: 1, 2: 1, 3: 1}


def test_completed_runs_and_main_table(spark):
    runs = [("m", "d", None, None, False, ["train", "validation"], 5), ("m", "e", "s", False, None, ["validation", "train", "x"], 1), ("m", "f", "s", True, False, ["train", "validation"], 5), ("m", "g", "s", False, True, ["train", "validation"], 5), ("m", "h", "s", False, False, ["validation"], 5), ("m", "i", "s", False, False, ["train", "validation"], 0), ("m", "j", "s", False, False, ["train", "validation"], None), ("m", "k", "s", False, False, None, 4)]
    done = SC.completed_runs(spark.createDataFrame(runs, "model string, dataset string, subpopulation string, reasoning boolean, aborted boolean, splits array<string>, result_rows long"))
    assert {tuple(r) for r in done.collect()} == {("m", "d", None), ("m", "e", "s")}
    rows = [("b", m, p, s, float(i), 1.0, 2.0) for i, (m, p, s) in enumerate([("base", "overall", "train"), ("base", "cluster_0", "train"), ("zzz-overall", "overall", "train"), ("modal_response-cluster_1", "cluster_0", "train"), ("modal_response-overall", "overall", "overall"), ("modal_response-cluster_0", "cluster_0", "train")])]
    table = SC.main_table(spark.createDataFrame(rows, "base_model string, method string, subpopulation string, split string, accuracy double, cross_entropy double, kl_divergence double")).orderBy("place").collect()
    assert [(r["label"], r["accuracy_train"], r["accuracy_overall"]) for r in table] == [("Base", 0.0, None), ("Modal response (cluster 0)", 5.0, None), ("Modal response (overall)", None, 4.0), ("zzz (overall)", 2.0, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"m{i % 2}", f"s{i % 3}", i % 5 == 0 if i % 7 else None, i / 10, i / 20, i % 9 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, monitor.RESULT)
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = monitor.start(monitor.live_summary(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    live, batch = monitor.newest(spark, f"{tmp_path}/out"), monitor.with_failures(df, ["model", "subpopulation"])
    fix = lambda x: Counter((r["model"], r["subpopulation"], r["n"], round(r["accuracy"], 6), round(r["cross_entropy"], 6), r["failures"]) for r in x.collect())
    assert fix(live) == fix(batch) and sum(r["failures"] for r in live.collect()) == sum(r[6] for r in rows)
    passed = SC.summary(df.where("not failed"), ["model", "subpopulation"])
    assert {(r["model"], r["subpopulation"], r["n"], r["accuracy"]) for r in passed.collect()} == {(r["model"], r["subpopulation"], r["n"], r["accuracy"]) for r in live.collect()}


def test_live_runs_equal_the_batch_operators(spark, tmp_path):
    """Runs in three lots with streaks across lots; each lot is a stream of its own on the same state."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        m = f"m{i % 3}"
        failed = (m == "m0" and 280 < i < 320) or (m == "m1" and i > 850) or rng.random() < 0.1
        rows.append((i, m, 10**6 * (i // 5), None if rng.random() < 0.1 else rng.random() < 0.5, None if failed else rng.random(), rng.random(), failed))
    df = spark.createDataFrame(rows, monitor.RUN_RESULT)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for a, b in ((0, 300), (300, 311), (311, 900)):
        df.where(f"event_id >= {a} and event_id < {b}").write.mode("append").parquet(f"{tmp_path}/in")
        monitor.start_runs(monitor.live_runs(spark, f"{tmp_path}/in", planned=400), out, state).awaitTermination(120)
    fix = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    means = monitor.run_events(spark, out, "means").select("model", "i", "accuracy", "cross_entropy", "kl_divergence").collect()
    assert fix(means) == fix(SC.running_metrics(df, "model", "event_id").collect()) and len(means) == 9
    runs = monitor.run_events(spark, out, "run").select("model", "longest", "abort_at", "aborted").collect()
    assert fix(runs) == fix(SC.failure_streaks(df, "model", "event_id").collect()) and {r["model"] for r in runs if r["aborted"]} == {"m0", "m1"}
    speed = monitor.run_events(spark, out, "speed").collect()
    assert fix((r["model"], r["i"], r["rate"]) for r in speed) == fix((r["model"], r["i"], r["rate"]) for r in SC.throughput(df, "model", "event_id", "at").collect())
    assert all(r["eta"] == (400 - r["i"]) / r["rate"] for r in speed if r["rate"])


def test_summary_keeps_the_newest_row_of_each_key(spark, tmp_path):
    rows = [(i, None if i % 4 == 3 else f"m{i % 4}", "s", True, 1.0, 1.0, False) for i in range(80)]
    df = spark.createDataFrame(rows, monitor.RESULT)
    for some in ("event_id < 20", "event_id >= 20 and event_id % 4 in (0, 3)", "event_id >= 20 and event_id % 4 in (1, 2)"):
        df.where(some).write.mode("append").parquet(f"{tmp_path}/in")
        monitor.start(monitor.live_summary(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert {r["model"]: r["n"] for r in monitor.newest(spark, f"{tmp_path}/out").collect()} == {"m0": 20, "m1": 20, "m2": 20, None: 20}


def test_least_similar_by_bounds(spark):
    rng = random.Random(11)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    for empty in (False, True):
        rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(200)], k=rng.randint(3, 40)))) for i in range(150)] + ([(900, "12 !"), (901, "")] if empty else [])
        sets = {i: set(__import__("re").findall("[a-z]+", t.lower())) for i, t in rows}
        total = {i: sum(len(a & b) / max(1, len(a | b)) for b in sets.values()) for i, a in sets.items()}
        df = spark.createDataFrame(rows, "name long, text string")
        bounds = {r["name"]: (r["lower"], r["upper"]) for r in TX.similarity_bounds(df).collect()}
        assert set(bounds) == set(total) and all(lo <= total[i] + 1e-9 and total[i] <= hi + 1e-9 for i, (lo, hi) in bounds.items())
        least = min(hi for _, hi in bounds.values())
        assert sum(lo <= least for lo, _ in bounds.values()) < 75  # most texts are never compared
        got = TX.least_similar(df).first()
        want = min((round(x / len(rows), 9), i) for i, x in total.items())
        assert (got["name"], round(got["similarity"], 9)) == (want[1], want[0])


def test_run_metrics_over_results_with_differing_columns(spark, tmp_path):
    text = 'expected_text,model_answer,cross_entropy,kl_divergence,system_prompt_id\n" Yes\n",yES,1.5,,p\nno,,2.5,1,p\n"","",,,\n'
    full = "split,subpopulation,kl_divergence,cross_entropy,model_answer,expected_text,system_prompt_id,more\ntrain,,1,2,a,A,p,x\n,s,1,2,b,a,p,y\n"
    for model, run, body, config in (("m1", "r1", text, {"dataset": "modal_response", "timestamp": "2"}), ("m1", "r0", full, {"dataset": "modal_response", "timestamp": "1"}), ("m1", "r9", full, {"dataset": "other", "timestamp": "9"}), ("m2", "r1", full, {"dataset": "modal_response"}), ("m2", "r5", text, {"dataset": "modal_response", "reasoning": True, "timestamp": "5"}), ("m3", "r1", None, {"dataset": "modal_response", "timestamp": "3"})):
        folder = tmp_path / model / run
        folder.mkdir(parents=True)
        (folder / "config.json").write_text(json.dumps(config))
        if body:
            (folder / "per_question_results.csv").write_text(body)
    runs = files.read_runs(spark, str(tmp_path)).select("model", "run", "dataset", "reasoning", "timestamp")
    got = {tuple(r[c] for c in ("model", "subpopulation", "split", "system_prompt_id", "n", "accuracy", "cross_entropy", "kl_divergence")) for r in SC.run_metrics(runs, files.read_run_results(spark, str(tmp_path))).collect()}
    assert got == {("m1", "overall", "validation", "p", 2, 50.0, 2.0, 1.0), ("m1", "overall", "validation", None, 1, 0.0, None, None), ("m2", None, "train", "p", 1, 100.0, 2.0, 1.0), ("m2", "s", None, "p", 1, 0.0, 2.0, 1.0)}


def test_cells_as_shown(spark):
    names = [f"{m}_{x}" for m in SC.METRICS for x in ("train", "validation", "overall")]
    rows = [("b", 0, "Base", 50.04, None, 1.0, 2.0, None, 2.126, 0.5, 0.5, 0.5), ("b", 1, "Tuned", 50.06, None, 1.0, 2.0, 3.0, 2.0, 0.4999, 0.6, None)]
    table = spark.createDataFrame(rows, "base_model string, place int, label string, " + ", ".join(f"{n} double" for n in names))
    got = {(r["place"], f"{r['metric']}_{r['split']}"): r["text"] for r in SC.table_cells(table).collect()}
    bold = lambda x: "\\textbf{" + x + "}"
    assert [got[0, n] for n in names] == ["50.0", "--", bold("1.0"), bold("2.00"), "--", "2.13", "0.500", bold("0.500"), bold("0.500")]
    assert [got[1, n] for n in names] == [bold("50.1"), "--", "1.0", "2.00", bold("3.00"), bold("2.00"), bold("0.500"), "0.600", "--"]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_published_runs_in_parts(spark):
    """A run's results are spread over rows of bounded size, in order; nothing of it is lost."""
    text = "question_id question column_name question_format system_prompt_id sub_question model_reasoning categories model_distribution true_distribution kl_divergence cross_entropy model_answer expected_text subpopulation".split()
    kind = "model string, run string, " + ", ".join(f"{c} string" for c in text)
    row = lambda model, run, q, answer: (model, run, q, *[None] * 11, answer, None, None)
    rows = [row("m", "r-cluster_0-1", f"q{i:03d}", "x" * i) for i in range(230)] + [row("m", "r2", "q1", None), row("m", "r3", None, "a"), row("m", "r3", "", "a"), row("m", "r4", "q1", "a")]
    configs = [("m", r, "t", "d", r, None, None, None) for r in ("r-cluster_0-1", "r2", "r3", "r5")]
    got = SC.published(spark.createDataFrame(configs, "model string, run string, target string, dataset string, run_name string, timestamp string, model_sha string, reasoning boolean"), spark.createDataFrame(rows, kind), size=20).collect()
    assert {r["run"] for r in got} == {"r-cluster_0-1", "r2", "r3"} and all(len(r["results"]) <= 20 and r["config"]["run_name"] == r["run"] for r in got)
    first = sorted((r for r in got if r["run"] == "r-cluster_0-1"), key=lambda r: r["part"])
    assert [(x["question_id"], x["subpopulation"], len(x["model_answer"])) for r in first for x in r["results"]] == [(f"q{i:03d}", "cluster_0", min(i, 200)) for i in range(230)]
    assert [[(x["question_id"], x["model_answer"]) for x in r["results"]] for r in got if r["run"] in ("r2", "r3")] in ([[("q1", "")], []], [[], [("q1", "")]])


def test_joins_of_respondents_grow_in_tasks(spark):
    """A large table's join is dealt among more tasks, a small one's stays as it is."""
    left, right = spark.range(1000).withColumnRenamed("id", "a"), spark.range(1000).withColumnRenamed("id", "b")
    assert all(x is y for x, y in zip(V.met(left, "a", right, "b"), (left, right)))
    a, b = V.met(left, "a", right, "b", most=50)
    held = [len(x) for x in a.hint("merge").join(b, F.col("a") == F.col("b")).rdd.glom().collect()]
    assert len(held) == 20 and sum(held) == 1000 and max(held) < 100


def test_joins_of_respondents_keep_their_tasks_in_wide_sessions(spark):
    """The tasks of a join hold alike many rows where the session has more partitions than the join needs, which Spark would merge."""
    left, right = spark.range(1000).withColumnRenamed("id", "a"), spark.range(1000).withColumnRenamed("id", "b")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        a, b = V.met(left, "a", right, "b", most=50)
        held = [len(x) for x in a.hint("merge").join(b, F.col("a") == F.col("b")).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(held) == 200 and sum(held) == 1000 and max(held) < 100
    # the larger side counts, and tasks fill up before a shuffle gets wider than `widest`
    widths = [V.met(left.limit(10), "a", right, "b", most=m, widest=30)[0].rdd.getNumPartitions() for m in (50, 20, 5)]
    assert widths == [20, 30, 50]


@pytest.mark.parametrize("name", ["A06_hard_distribution", "A10_dominant_category", "A13_composition", "J05_item_distributions", "S09_nested_json"])
def test_queries_deal_their_respondents(spark, monkeypatch, name):
    """The query's joins are dealt where the session has more partitions than they need, and its rows stay the same."""
    met, dealt, run = V.met, [], registry.queries()[name]
    plain = sorted(run(spark, "/root/testdata/sf0.001").collect())

    def small(left, left_key, right, right_key, **more):
        got = met(left, left_key, right, right_key, **(more | {"most": 100}))
        dealt.append(got[0] is not left and got[1] is not right)
        return got

    monkeypatch.setattr(V, "met", small)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert sorted(run(spark, "/root/testdata/sf0.001").collect()) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert dealt == [True, True]
