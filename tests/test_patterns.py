"""Latent classes over answer patterns: copies change nothing, repeated answers count, drawn numbers add up."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.text import keyed_uniform
from tessella.operators import clusters as CU
from tessella.operators import latent as LA
from tessella.operators import running as RU
from tessella.plans import views as V
from tests.test_models import planted


def test_copies_of_respondents_change_no_fit(spark):
    """Starts drawn for each respondent even out over copies; over patterns the fit is the same, each copy adding its log-likelihood."""
    _, r = planted(spark, n=120)
    copies = r.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("respondent_id", F.col("copy") * 1000 + F.col("respondent_id")).drop("copy")
    few, many = LA.fit_many(r, 2, starts=2, rounds=30), LA.fit_many(copies, 2, starts=2, rounds=30)
    assert abs(many[2][()] / 20 - few[2][()]) < 1e-8 * abs(few[2][()])
    assert LA.patterns(copies).rows.count() == LA.patterns(r).rows.count() <= 120
    a, b = ({(x["class"], x["column_name"], x["code"]): x["logp"] for x in f[0].collect()} for f in (few, many))
    assert a.keys() == b.keys() and max(abs(a[x] - b[x]) for x in a) < 1e-6


def test_posteriors_count_repeated_answers_and_leave_unknown_ones_out(spark):
    parameters = spark.createDataFrame([(c, q, v, math.log(p)) for c, q, v, p in [(0, "a", 0.0, 0.9), (0, "a", 1.0, 0.1), (1, "a", 0.0, 0.4), (1, "a", 1.0, 0.6), (0, "b", 0.0, 1.0), (1, "b", 0.0, 1.0)]], "class int, column_name string, code double, logp double")
    priors = spark.createDataFrame([(0, math.log(0.3)), (1, math.log(0.7))], "class int, logp double")
    rows = [(1, "a", 0.0), (1, "a", 0.0), (2, "a", 7.0), (3, "z", 1.0), (4, "a", None), (5, "a", 1.0), (5, "b", 0.0), (None, "a", 0.0)]
    got = {(x["respondent_id"], x["class"]): x["p"] for x in LA.posteriors(spark.createDataFrame(rows, "respondent_id long, column_name string, code double"), parameters, priors).collect()}
    first = lambda x, y: x * 0.3 / (x * 0.3 + y * 0.7)
    want = {1: first(0.81, 0.16), 2: 0.3, 3: 0.3, 4: 0.3, 5: first(0.1, 0.6), None: 0.3}
    assert len(got) == 12 and all(abs(got[i, 0] - p) < 1e-9 and abs(got[i, 1] - 1 + p) < 1e-9 for i, p in want.items())


def test_a_question_answered_twice_is_fitted_with_both_answers(spark):
    rows, r = planted(spark, n=60, columns=3)
    twice = r.unionAll(r.where("respondent_id < 20 and column_name = 'c1'"))
    parameters, priors, logliks = LA.fit_many(twice, 2, rounds=10)
    assert abs(LA.posteriors(twice, parameters, priors).where("class = 0").agg(F.sum("loglik")).first()[0] - logliks[()]) < 1e-6


def test_certainty_counts_only_who_has_a_row(spark):
    _, r = planted(spark, n=80, columns=3)
    parameters, priors, _ = LA.fit_latent_classes(r, 2, rounds=10)
    some = r.where("respondent_id % 4 > 0 or column_name <> 'c2'")
    ranked = spark.createDataFrame([("p", "c2", 1), ("p", "c0", 3)], "pool string, column_name string, rank int")
    got = {x["n"]: x for x in LA.certainty_curve(some, parameters, priors, ranked, 3).collect()}
    assert set(got) == {1, 2, 3}
    for n, names in ((1, ["c2"]), (2, ["c2"]), (3, ["c2", "c0"])):
        c = np.array([x["certainty"] for x in LA.hard_labels(LA.posteriors(some.where(F.col("column_name").isin(names)), parameters, priors)).collect()])
        assert len(c) == (60 if n < 3 else 80)
        assert abs(got[n]["mean"] - c.mean()) < 1e-9 and abs(got[n]["median"] - np.median(c)) < 1e-9 and abs(got[n]["above_09"] - (c > 0.9).mean()) < 1e-9


def test_drawn_numbers_add_up_and_follow_the_model(spark, monkeypatch):
    monkeypatch.setattr(LA, "HELD", 3)
    _, r = planted(spark, n=200, columns=4, missing=0)
    parameters, priors, _ = LA.fit_latent_classes(r, 2, rounds=10)
    counts, levels, names = LA.simulated_counts(spark, parameters, priors, 5000, 3)
    rows = counts.collect()
    assert names == ["c0", "c1", "c2", "c3"] and len(rows) == len({(x["replicate"], tuple(x["_at"])) for x in rows}) and all(len(x["_at"]) == 4 for x in rows)
    share = {(x["column_name"], x["code"]): x["s"] for x in parameters.join(priors.withColumnRenamed("logp", "q"), "class").groupBy("column_name", "code").agg(F.sum(F.exp(F.col("logp") + F.col("q"))).alias("s")).collect()}
    for k in (1, 2, 3):
        mine = [x for x in rows if x["replicate"] == k]
        assert sum(x["_w"] for x in mine) == 5000
        for i, level in enumerate(levels):
            assert abs(sum(x["_w"] for x in mine if i in x["_at"]) / 5000 - share[level]) < 0.04
    again = {(x["replicate"], tuple(x["_at"])): x["_w"] for x in LA.simulated_counts(spark, parameters, priors, 5000, 3)[0].collect()}
    assert again == {(x["replicate"], tuple(x["_at"])): x["_w"] for x in rows}


def test_resample_draws_and_weighted_percentiles(spark):
    got = spark.range(3000).select(LA.poisson_one(F.col("id")).alias("a"), LA._poisson_of(keyed_uniform(F.col("id"))).alias("b")).where("a <> b").count()
    assert got == 0
    rows = spark.createDataFrame([("x", 1.0, 3), ("x", 5.0, 2), ("y", 2.0, 1)], "k string, v double, w int")
    assert {x["k"]: x["m"] for x in RU.exact_percentiles(rows, "k", "v", {"m": 0.75}, "w").collect()} == {"x": 5.0, "y": 2.0}


def test_counted_vectors_stand_for_their_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (90, 2)) + 9.0 * (np.arange(90) % 3)[:, None]
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>")
    alike = CU.counted(v)
    n = len({tuple(f) for f in x})
    assert alike.count() == n < 50 and alike.agg(F.sum("n")).first()[0] == 90
    size, centre = CU.clustering_features(alike, 100)
    assert len(size) == n and size.sum() == 90 and np.allclose(size @ centre, x.sum(0))
    labels, tree = CU.ward(v, 3)
    assert tree.count() == n - 1 and tree.agg(F.max("size")).first()[0] == 90
    whole, _, bic = CU.diagonal_mixture(v, 3, starts=2, alike=alike)
    for found in (labels, whole, CU.k_means_labels(v, 3, alike=alike)):
        got = found.collect()
        assert len(got) == 90 and len({(r["id"] % 3, r["label"]) for r in got}) == 3
    centres, cost, shift = CU.k_means_starts(alike, 3, starts=3)
    gaps = ((x[:, None, None] - shift - centres[None]) ** 2).sum(-1).min(2).sum(0)
    assert np.allclose(gaps, cost) and np.allclose(shift, x.mean(0))


def test_labelled_rows_equal_the_join_of_answers(spark):
    d = "/root/testdata/sf0.001"
    want = V.responses(spark, d).join(V.assignments(spark, d).select("respondent_id", "cluster"), "respondent_id")
    got = V.labelled(spark, d, "cluster")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # answers become rows after the last join
    assert plan.index("Expand") < plan.index("Join")
