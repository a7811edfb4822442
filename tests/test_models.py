"""Clusterings, latent-class checks and whole-option scores against plain versions."""

import math
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tessella.functions import text as TX
from tessella.operators import clusters as CU
from tessella.operators import latent as LA
from tessella.operators import scoring as SC
from tessella.operators import statistics as ST


def planted(spark, n=200, columns=6, missing=0.05):
    rng = random.Random(3)
    rows = [(i, f"c{j}", float(rng.random() < (0.92 if i % 2 else 0.08)) if rng.random() > missing else None) for i in range(n) for j in range(columns)]
    return rows, spark.createDataFrame(rows, "respondent_id long, column_name string, code double")


def agreement(labels):
    return ST.adjusted_rand(labels.select((F.col("respondent_id") % 2).alias("x"), F.col("label").alias("y"))).first()["ari"]


def test_k_modes_find_planted_groups_and_costs_are_right(spark):
    rows, r = planted(spark)
    found = CU.k_modes(r, 2, starts=2, rounds=5)
    assert agreement(found) > 0.7
    label = {x["respondent_id"]: (x["label"], x["cost"]) for x in found.collect()}
    assert len(label) == 200 and all(0 <= c <= 6 for _, c in label.values())
    assert CU.k_modes(r.where("false"), 2, starts=1, rounds=2).count() == 0


def test_correspondence_and_components_equal_the_decomposition(spark):
    rows, r = planted(spark, n=60, columns=4)
    levels = sorted({(c, CU.MISSING if v is None else v) for _, c, v in rows})
    z = np.zeros((60, len(levels)))
    for i, c, v in rows:
        z[i, levels.index((c, CU.MISSING if v is None else v))] = 1
    p = z / z.sum()
    rm, cm = p.sum(1), p.sum(0)
    u, sv, _ = np.linalg.svd((p - np.outer(rm, cm)) / np.sqrt(np.outer(rm, cm)), full_matrices=False)
    place, kept, total = CU.correspondence(r)
    assert abs(total - (sv**2).sum()) < 1e-9 and np.allclose(kept, (sv**2)[: len(kept)])
    got = np.array([x["coordinates"] for x in place.orderBy("respondent_id").collect()])
    want = (u * sv / np.sqrt(rm)[:, None])[:, : len(kept)]
    assert np.allclose(got @ got.T, want @ want.T)
    place, shares = CU.one_hot_components(r, 3)
    x = (z - z.mean(0)) / z.std(0)
    _, sv, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(shares, (sv**2 / (sv**2).sum())[:3])
    got = np.array([y["coordinates"] for y in place.orderBy("respondent_id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:3].T))
    assert CU.correspondence(r.where("false"))[0].count() == 0


def test_mixture_silhouette_noise_and_single_members(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * [1, 0.2, 0.5] + (i % 2) * 6).tolist()) for i in range(80)]
    v = spark.createDataFrame(rows, "id long, features array<double>")
    labels, loglik, bic = CU.diagonal_mixture(v, 2, rounds=5)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert len({(i % 2, c) for i, c in got.items()}) == 2
    x, n = np.array([f for _, f in rows]), 80
    dens = sum(0.5 * np.exp(-0.5 * ((x[:, None] - x[j::2].mean(0)[None]) ** 2 / (x[j::2].var(0) + 1e-6) + np.log(2 * np.pi * (x[j::2].var(0) + 1e-6))).sum(-1))[:, 0] for j in (0, 1))
    assert abs(loglik - np.log(dens).sum()) < 1e-3 and abs(bic - (13 * math.log(n) - 2 * loglik)) < 1e-9
    assert CU.silhouette(v.join(labels, "id")) > 0.8
    assert CU.silhouette(v.withColumn("label", F.lit(1))) is None
    noisy = v.withColumn("label", F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("int")))
    fixed = CU.reassign_noise(noisy).collect()
    assert len(fixed) == 80 and all(r["label"] == r["id"] % 2 for r in fixed) and sum(r["was_noise"] for r in fixed) == 16
    assert {r["label"] for r in CU.reassign_noise(noisy.withColumn("label", F.lit(None).cast("int"))).collect()} == {None}
    lone = v.withColumn("label", F.when(F.col("id") < 3, F.col("id") + 10).otherwise(F.col("id") % 2).cast("int"))
    assert all(r["label"] == r["id"] % 2 for r in CU.merge_single_members(lone).collect())


def test_latent_checks(spark):
    _, r = planted(spark)
    parameters, priors, loglik = LA.fit_latent_classes(r, 2, rounds=10, starts=2)
    post = LA.posteriors(r, parameters, priors)
    assert abs(loglik - post.where("class = 0").agg(F.sum("loglik")).first()[0]) < 1e-6
    better = LA.fit_many(r.withColumn("fit", F.explode(F.array(F.lit(1), F.lit(2)))), 2, ("fit",))
    assert set(better[2]) == {(1,), (2,)} and max(better[2].values()) >= loglik - 1e-3 and better[0].count() == 2 * 2 * 12
    assert LA.fit_many(r.where("false"), 2)[2] == {} and LA.fit_latent_classes(r.where("false"), 2)[2] == 0.0
    original = LA.hard_labels(post)
    assert agreement(original) > 0.8
    stable = LA.bootstrap_stability(r, original, 2, replicates=3, rounds=10).collect()
    assert len(stable) == 3 and all(x["ari"] > 0.8 for x in stable)
    test = LA.bootstrap_ratio_test(r, 1, replicates=4, rounds=8)
    assert test["ratio"] > 0 and test["p"] == 1 / 5
    ranked = spark.createDataFrame([("all", f"c{j}", j + 1) for j in range(6)], "pool string, column_name string, rank int")
    curve = {x["n"]: x["mean"] for x in LA.certainty_curve(r, parameters, priors, ranked, 6).collect()}
    assert set(curve) == set(range(1, 7)) and curve[6] > curve[1]
    whole = LA.hard_labels(LA.posteriors(r, parameters, priors)).agg(F.avg("certainty")).first()[0]
    assert abs(curve[6] - whole) < 1e-9
    table = {x["k"]: x for x in LA.model_selection(r, 2, starts=1, rounds=8).collect()}
    assert table[1]["best"] == 2 and table[2]["bic_gap"] == 0 and table[1]["parameters"] == 6
    one = Counter(x[0] for x in spark.range(4000).select(LA.poisson_one(F.col("id"))).collect())
    assert abs(one[0.0] / 4000 - math.exp(-1)) < 0.03 and abs(sum(k * c for k, c in one.items()) / 4000 - 1) < 0.06


def test_question_pools_leave_sensitive_topics_out(spark):
    value = [("Q1", 0.2), ("Q2", 0.5), ("Q3", 0.5), ("Q189", 0.9), ("Q4", None), ("Q5", 0.7), ("Q6", 0.1)]
    asked = [("Q1", "Work and play", None), ("Q2", None, None), ("Q3", "On IMMIGRANTS", "here"), ("Q5", "How often", "Divorce"), ("Q4", "", ""), ("Q9", "Not a question here", "")]
    got = LA.question_pools(spark.createDataFrame(value, "column_name string, value double"), spark.createDataFrame(asked, "column_name string, question string, sub_question string"))
    pools = {p: [x["column_name"] for x in sorted(got.where(F.col("pool") == p).collect(), key=lambda x: x["rank"])] for p in ("all", "non_sensitive")}
    assert pools == {"all": ["Q189", "Q5", "Q2", "Q3", "Q1", "Q6", "Q4"], "non_sensitive": ["Q2", "Q1", "Q6", "Q4"]}


def test_method_comparison(spark):
    rows, r = planted(spark, n=60, columns=3, missing=0)
    v = spark.createDataFrame([(i, [float(i % 2), float(i % 3) / 10]) for i in range(60)], "id long, features array<double>")
    labels = r.select("respondent_id").distinct().withColumn("label", F.when(F.col("respondent_id") >= 6, (F.col("respondent_id") % 2).cast("int")))
    got = {x["metric"]: x["value"] for x in CU.compare_methods(r, v, {"planted": labels}).collect()}
    assert got["noise_share"] == 0.1 and abs(got["size_entropy"] - 1) < 1e-9 and got["silhouette"] > 0.9 and got["informativeness"] > 0.6


def test_option_probability(spark):
    E = "<|im_end|>"
    answer = [("Very", [("Very", -0.1), ("Not", -2.0)]), (" often", [(" often", -0.2), (" rarely", -1.5)]), (E, [(E, -0.3)])]
    df = spark.createDataFrame([(answer,), ([],)], "a array<struct<token:string,top:array<struct<token:string,logprob:double>>>>")
    options = ["Very often", "Very rarely", " Not at all", "Other", "Very"]
    got = df.select(*[SC.option_probability(F.col("a"), F.lit(o)).alias(str(i)) for i, o in enumerate(options)]).collect()
    want = [math.exp(-0.6), math.exp(-1.9), math.exp(-2.0), 0.0, math.exp(-0.1)]
    assert np.allclose(list(got[0]), want) and list(got[1]) == [None] * 5


def test_list_literal_and_favours(spark):
    texts = ["""["a", "b"]""", "['a', 'b c']", "plain", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(TX.list_literal(F.col("t"))).collect()]
    assert got[:3] == [["a", "b"], ["a", "b c"], ["plain"]]
    m = spark.createDataFrame([("bic", 1.0, 2.0), ("ari", 1.0, 2.0), ("x", 1.0, 1.0), ("y", None, 1.0)], "metric string, first double, second double")
    assert {r["metric"]: r["favours"] for r in ST.favours(m, ["ari"]).collect()} == {"bic": "first", "ari": "second", "x": "-", "y": "-"}


def test_k_means_and_bisecting_find_planted_groups(spark):
    rng = random.Random(5)
    rows = [(i, [10.0 * (i % 3) + rng.gauss(0, 0.5), rng.gauss(0, 0.5)]) for i in range(150)]
    v = spark.createDataFrame(rows, "id long, features array<double>")
    for bisecting in (False, True):
        labels = {r["id"]: r["label"] for r in CU.k_means_labels(v, 3, bisecting=bisecting).collect()}
        assert len({(i % 3, c) for i, c in labels.items()}) == 3 == len(set(labels.values()))


def test_demographic_profile_against_plain_python(spark):
    rng = random.Random(6)
    people = [(i, i % 2, rng.choice(["x", "y", "y", "No answer", None]), rng.choice(["p", "q"]), round(rng.uniform(0, 90), 1)) for i in range(120)]
    texts = [(i, label, c, v) for i, label, a, b, _ in people for c, v in (("first", a), ("second", b))]
    numbers = [(label, "balance", x) for _, label, _, _, x in people]
    got = {r["column_name"]: r for r in ST.demographic_profile(spark.createDataFrame(texts, "respondent_id long, label int, column_name string, code string"), spark.createDataFrame(numbers, "label int, column_name string, value double"), [0, 1], "missing|no answer").collect()}
    for c in ("first", "second"):
        share = {}
        for label in (0, 1):
            v = [x if x is not None else "Missing" for _, at, k, x in texts if at == label and k == c]
            share[label] = {x: v.count(x) / len(v) for x in set(v)}
            shown = [x for x in v if x not in ("Missing", "No answer")]
            top = min(set(shown), key=lambda x: (-shown.count(x), x))
            assert got[c][str(label)] == f"{top} ({100 * shown.count(top) / len(shown):.1f}%)"
        assert abs(got[c]["tvd"] - sum(abs(share[0].get(x, 0) - share[1].get(x, 0)) for x in {*share[0], *share[1]}) / 2) < 1e-9
    for label in (0, 1):
        v = [x for at, _, x in numbers if at == label]
        assert got["balance"][str(label)] == f"{np.mean(v):.2f} / {np.median(v):.2f}" and got["balance"]["tvd"] is None


def test_k_modes_starts_differ_and_repeat(spark):
    rng = random.Random(8)
    rows = [(i, f"c{j}", float((i % 3 + (rng.random() < 0.1)) % 3)) for i in range(90) for j in range(6)]
    r = spark.createDataFrame(rows, "respondent_id long, column_name string, code double")
    a, b = (sorted((x["respondent_id"], x["label"], x["cost"]) for x in CU.k_modes(r, 3, starts=3).collect()) for _ in range(2))
    assert a == b and len({(i % 3, c) for i, c, _ in a}) < 9 and sum(c for _, _, c in a) < 150


def plain_ward(x):
    """All pairs, the cheapest merge first."""
    clusters, out = {i: [i] for i in range(len(x))}, []
    while len(clusters) > 1:
        def cost(a, b):
            p, q = x[clusters[a]], x[clusters[b]]
            return len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()
        keys = sorted(clusters)
        c, a, b = min((cost(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        clusters[len(x) + len(out)] = clusters.pop(a) + clusters.pop(b)
        out.append((c, frozenset(clusters[len(x) + len(out)])))
    return out


def test_ward_equals_plain_linkage_where_each_row_is_a_feature(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) + 4 * (np.arange(60) % 4)[:, None]
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>").repartition(7)
    labels, tree = CU.ward(v, 4)
    order = np.lexsort(x.T[::-1])
    members, want = {i: {int(order[i])} for i in range(60)}, plain_ward(x)
    for r, (cost, group) in zip(tree.orderBy("step").collect(), want):
        members[60 + r["step"]] = members[r["a"]] | members[r["b"]]
        assert abs(r["cost"] - cost) < 1e-9 and members[60 + r["step"]] == set(group) and r["size"] == len(group)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert len({(i % 4, c) for i, c in got.items()}) == 4
    assert CU.ward(v.limit(0), 3)[0].count() == 0 and CU.ward(v.limit(1), 3)[0].first()["label"] == 0


def test_ward_over_condensed_features(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2)) / 4 + 5 * (np.arange(3000) % 3)[:, None]
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>").repartition(9)
    monkeypatch.setattr(CU, "CHUNK", 100)
    size, centre = CU.clustering_features(v, 40)
    assert len(size) == 40 and size.sum() == 3000 and np.allclose(size @ centre, x.sum(0))
    labels, tree = CU.ward(v, 3, 40)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert len({(i % 3, c) for i, c in got.items()}) == 3 and tree.agg(F.max("size")).first()[0] == 3000
    costs = [r["cost"] for r in tree.orderBy("step").collect()]
    assert costs == sorted(costs)


def replayed(x, size, tree):
    """The clusters left by rows (a, b, cost, size), each of which must be a cheapest merge of what is left."""
    n = len(x)
    centre, size, live = np.vstack([x, np.zeros((n - 1, x.shape[1]))]), np.append(size.astype(float), np.zeros(n - 1)), list(range(n))
    cost = np.full((2 * n - 1, 2 * n - 1), np.inf)

    def meet(i, others):
        cost[i, others] = cost[others, i] = size[i] * size[others] / (size[i] + size[others]) * ((centre[others] - centre[i]) ** 2).sum(1)

    for i in range(1, n):
        meet(i, np.arange(i))
    members, states = {i: {i} for i in range(n)}, []
    for step, (a, b, c, m) in enumerate(tree):
        new = n + step
        assert a < b and abs(cost[a, b] - c) < 1e-9 and c < cost[np.ix_(live, live)].min() + 1e-9
        size[new], members[new] = size[a] + size[b], members.pop(a) | members.pop(b)
        centre[new] = (size[a] * centre[a] + size[b] * centre[b]) / size[new]
        assert size[new] == m
        live = [i for i in live if i not in (a, b)]
        meet(new, np.array(live, int))
        live.append(new)
        states.append({min(v): v for v in members.values()})
    return states


def test_ward_leaves_no_merge_out(spark):
    """More vectors than the driver merges, without ties and with many: a merge for each but one, each the cheapest left."""
    rng = np.random.default_rng(6)
    apart = rng.normal(size=(700, 3)) + 4 * (np.arange(700) % 5)[:, None]
    tied = rng.permutation(np.stack(np.meshgrid(*[np.arange(9.0)] * 3), -1).reshape(-1, 3))[:640]
    for x in (apart, np.vstack([tied, tied[:100]])):
        v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>").repartition(5)
        nodes, size = np.unique(x, axis=0, return_counts=True)
        labels, tree = CU.ward(v, 4, 60)
        found = [(r["a"], r["b"], r["cost"], r["size"]) for r in tree.orderBy("step").collect()]
        assert len(found) == len(nodes) - 1 > 512
        want = {node: label for label, (_, group) in enumerate(sorted(replayed(nodes, size, found)[-4].items())) for node in group}
        at = {tuple(f): i for i, f in enumerate(nodes)}
        assert {r["id"]: r["label"] for r in labels.collect()} == {i: want[at[tuple(f)]] for i, f in enumerate(x)}
        # all at once on the driver: the same linkage, but for ties
        whole = [r["cost"] for r in CU.ward_tree(v).orderBy("step").collect()]
        assert len(whole) == len(found) and (x is not apart or np.allclose(whole, [c for _, _, c, _ in found]))


def test_merges_of_equal_cost_keep_their_order(spark):
    """Corners of a simplex: all merges cost the same but for rounding, which must not put a merge before its parts."""
    x = np.eye(60) / 3
    merges = CU.ward_merges(np.ones(60), x)
    assert [max(a, b) < 60 + i for i, (a, b, _) in enumerate(merges)] == [True] * 59
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>")
    tree = [(r["a"], r["b"], r["cost"], r["size"]) for r in CU.ward_tree(v, 5).orderBy("step").collect()]
    assert len(replayed(np.unique(x, axis=0), np.ones(60), tree)) == 59


def test_many_levels_by_block_steps(spark):
    """More levels than a block is wide: the largest inertias within 1e-6 of the decomposition."""
    rng = random.Random(7)
    rows = [(i, f"c{j}", float((i % 5) * 3 + rng.randrange(4) if rng.random() < 0.7 else rng.randrange(40))) for i in range(400) for j in range(6)]
    rows = [r for r in rows if not (r[0] == 3 and r[1] == "c2")]  # a respondent without a row for a question
    r = spark.createDataFrame(rows, "respondent_id long, column_name string, code double")
    full = {(i, c): v for i, c, v in rows} | {(3, "c2"): CU.MISSING}
    levels = sorted({(c, v) for (_, c), v in full.items()})
    z = np.zeros((400, len(levels)))
    for (i, c), v in full.items():
        z[i, levels.index((c, v))] = 1
    assert len(levels) > 8 + CU.SPARE
    p = z / z.sum()
    rm, cm = p.sum(1), p.sum(0)
    u, sv, _ = np.linalg.svd((p - np.outer(rm, cm)) / np.sqrt(np.outer(rm, cm)), full_matrices=False)
    place, kept, total = CU.correspondence(r, most=8, keep=0.99)
    assert np.abs(np.array(kept) - (sv**2)[: len(kept)]).max() < 1e-6 and abs(total - (sv**2).sum()) < 1e-9
    got = np.array([x["coordinates"] for x in place.orderBy("respondent_id").collect()])
    want = (u * sv / np.sqrt(rm)[:, None])[:, : len(kept)]
    assert np.allclose(got[:, :4] @ got[:, :4].T, want[:, :4] @ want[:, :4].T, atol=1e-4)
    x = (z - z.mean(0)) / z.std(0)
    _, shares = CU.one_hot_components(r, 4)
    sv = np.linalg.svd(x, full_matrices=False)[1]
    assert np.abs(np.array(shares) - (sv**2 / (sv**2).sum())[:4]).max() < 1e-6


def test_starts_run_side_by_side(spark):
    """Sums over many parts, and the best of several starts: K-Means costs by hand, latent starts against single ones."""
    from tessella.operators import arrays as AR

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) / 3 + 4 * np.stack([np.arange(300) % 3, np.arange(300) % 2], 1)
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>").repartition(40)
    total = AR.tree_sum(v, lambda bs: [(k, sum((AR.lists(b.column(1)).sum(0) for b in bs if b.num_rows), np.zeros(2)) * (k + 1)) for bs in [list(bs)] for k in (0, 1)])
    assert np.allclose(total[0], x.sum(0)) and np.allclose(total[1], 2 * x.sum(0))
    centres, cost, shift = CU.k_means_starts(v, 6, starts=4)
    gaps = ((x[:, None, None] - shift - centres[None]) ** 2).sum(-1).min(2).sum(0)
    assert np.allclose(gaps, cost, rtol=1e-3) and len(set(np.round(cost, 6))) > 1
    labels = {r["id"]: r["label"] for r in CU.k_means_labels(v, 6, starts=4).collect()}
    best = centres[CU._first_least(cost)]
    assert all(labels[i] == int(((x[i] - shift - best) ** 2).sum(1).argmin()) for i in range(300))
    _, r = planted(spark)
    apart = LA.fit_many(r.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(3)))), 3, ("start",))[2]
    together = LA.fit_latent_classes(r, 3, starts=3)[2]
    assert abs(max(apart.values()) - together) < 1e-9 * abs(together)
    u = AR.uniform(np.arange(20_000), 1, 2)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, AR.uniform(np.arange(20_000), 1, 3))[0, 1]) < 0.03


def test_every_cell_of_the_method_comparison(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(45, 4)) + 2 * (np.arange(45) % 3)[:, None]
    codes = rng.integers(0, 3, (45, 5))
    label = {i: (None if i % 11 == 0 else int(x[i, 0] > 2)) for i in range(45)}
    r = spark.createDataFrame([(i, f"c{j}", float(codes[i, j])) for i in range(45) for j in range(5)], "respondent_id long, column_name string, code double")
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>")
    frame = spark.createDataFrame(list(label.items()), "respondent_id long, label int")
    got = {c["metric"]: c["value"] for c in CU.compare_methods(r, v, {"m": frame}, {"m": 7.5}).collect()}
    known = [i for i, c in label.items() if c is not None]
    own = lambda c: [i for i in known if label[i] == c]
    widths = []
    for i in known:
        mean = {c: sum(((x[i] - x[j]) ** 2).sum() for j in own(c) if j != i) / max(1, len(own(c)) - (label[i] == c)) for c in (0, 1)}
        a, b = mean[label[i]], mean[1 - label[i]]
        widths.append((b - a) / max(a, b))
    share = [len(own(c)) / len(known) for c in (0, 1)]
    p = np.array([[[np.mean([codes[i, j] == v for i in own(c)]) for v in range(3)] for c in (0, 1)] for j in range(5)])
    entropy = -sum(q * math.log(q) for q in share) / math.log(2)
    assert abs(got["silhouette"] - np.mean(widths)) < 1e-9 and got["bic"] == 7.5 and abs(got["noise_share"] - 5 / 45) < 1e-9
    assert abs(got["size_entropy"] - entropy) < 1e-9 and abs(got["informativeness"] - np.mean(np.abs(p[:, 0] - p[:, 1]).sum(1) / 2)) < 1e-9
    assert 0 <= got["coherence"] <= 1
