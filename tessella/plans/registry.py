"""All registered queries of the core library and their SQL counterparts.

A query applies an operator to whole tables (or views derived from them, see views.py) and returns
flat rows; doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as TX
from tessella.functions.shared import stored
from tessella.operators import cleaning as CL
from tessella.operators import clusters as CU
from tessella.operators import components as CO
from tessella.operators import latent as LA
from tessella.operators import running as RU
from tessella.operators import scoring as SC
from tessella.operators import statistics as ST
from tessella.plans import views as V

FLAGSHIP = "A01_empirical_distribution"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


#: (column_name, root): every column reachable over V above a half, itself included.
LINKED = ", reach AS (SELECT column_name, column_name root FROM bat UNION SELECT r.column_name, s.partner FROM reach r JOIN sym s ON s.column_name=r.root WHERE s.v>0.5) "

#: The walk by rank that takes a column if neither its battery nor its root was taken.
WALK = LINKED + ", red AS (SELECT column_name, round(v,3) v FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY round(v,3) DESC, partner) k FROM sym) WHERE k=1), rk AS (SELECT column_name, battery, root, v, row_number() OVER (ORDER BY v DESC, column_name) rank FROM red JOIN bat USING (column_name) JOIN (SELECT column_name, min(root) root FROM reach GROUP BY 1) USING (column_name)), walk AS (SELECT 0::BIGINT i, []::INT[] bs, []::VARCHAR[] rs, NULL::VARCHAR picked UNION ALL SELECT i+1, CASE WHEN ok THEN list_append(bs, battery) ELSE bs END, CASE WHEN ok THEN list_append(rs, root) ELSE rs END, CASE WHEN ok THEN column_name END FROM (SELECT w.*, rk.*, NOT list_contains(w.bs, rk.battery) AND NOT list_contains(w.rs, rk.root) ok FROM walk w JOIN rk ON rk.rank=w.i+1)) "


def query(name: str, sql: str | None = None, views: bool = True):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = (V.ORACLE_VIEWS if views else "") + sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def labelled(s: SparkSession, d: str) -> DataFrame:
    return V.labelled(s, d, "cluster")


def pairs_v(s: SparkSession, d: str) -> DataFrame:
    return ST.cramers_v(ST.pair_cells(V.responses(s, d), V.batteries(s)))


def metrics(s: SparkSession, d: str) -> DataFrame:
    return SC.summary(V.eval_results(s, d), ["model", "subpopulation", "split", "prompt"])


# ------------------------------------------------------------------ projections and cleaning


@query("P01_prefix_strip", "SELECT o_orderkey, CASE WHEN o_custkey > 10 THEN o_custkey - 500 ELSE o_custkey END AS stripped FROM orders", False)
def _(s, d):
    return V.read(s, d, "orders").select("o_orderkey", CL.strip_prefix(F.col("o_custkey"), 500).alias("stripped"))


@query("P02_interview_id", "SELECT o_orderkey, CAST(o_orderkey - 554070000 AS VARCHAR) AS id FROM orders", False)
def _(s, d):
    return V.read(s, d, "orders").select("o_orderkey", CL.interview_id(F.col("o_orderkey")).alias("id"))


@query("P03_lenient_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders", False)
def _(s, d):
    raw = F.when(F.col("o_orderkey") % 10 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return V.read(s, d, "orders").select("o_orderkey", CL.lenient_date(raw).cast("string").alias("day"))


@query("P04_sentinel_recode", "SELECT respondent_id, column_name, CASE WHEN code IN (-2,-3,-99) THEN -5 ELSE code END AS code FROM raw")
def _(s, d):
    return V.raw_responses(s, d).withColumn("code", CL.recode_sentinels(F.col("code")))


@query("P05_recode_audit", "SELECT stage, code, count(*) AS cells FROM (SELECT 'before' stage, code FROM raw UNION ALL SELECT 'after', CASE WHEN code IN (-2,-3,-99) THEN -5 ELSE code END FROM raw) WHERE code IN (-2,-3,-99,-5) GROUP BY ALL")
def _(s, d):
    return CL.recode_audit(V.raw_responses(s, d))


@query("P08_mask_missing", "SELECT respondent_id, column_name, code FROM resp")
def _(s, d):
    return V.responses(s, d)


@query("P09_contiguous_codes", "SELECT column_name, code, CAST(row_number() OVER (PARTITION BY column_name ORDER BY code) - 1 AS INT) AS idx FROM (SELECT DISTINCT column_name, code FROM resp WHERE code IS NOT NULL)")
def _(s, d):
    return CL.category_codes(V.responses(s, d))


@query("P14_lenient_number", "SELECT event_id, TRY_CAST(replace(replace(props,'{\"k\": ',''),'}','') AS DOUBLE) AS k FROM events", False)
def _(s, d):
    return V.read(s, d, "events").select("event_id", F.regexp_replace("props", r"\{\"k\": |\}", "").try_cast("double").alias("k"))


@query("P15_age_band", "SELECT respondent_id, CASE WHEN a>17 AND a<=24 THEN '18-24' WHEN a>24 AND a<=34 THEN '25-34' WHEN a>34 AND a<=44 THEN '35-44' WHEN a>44 AND a<=54 THEN '45-54' WHEN a>54 AND a<=64 THEN '55-64' WHEN a>64 AND a<=100 THEN '65+' END AS band FROM (SELECT o_orderkey respondent_id, o_custkey % 110 a FROM orders)", False)
def _(s, d):
    return V.read(s, d, "orders").select(F.col("o_orderkey").alias("respondent_id"), CL.age_band(F.col("o_custkey") % 110).alias("band"))


@query("P20_one_hot_levels", "SELECT column_name, coalesce(CAST(CAST(code AS DECIMAL(9,1)) AS VARCHAR),'Missing') AS level, count(*) AS n FROM resp GROUP BY ALL")
def _(s, d):
    return CL.one_hot(V.responses(s, d)).groupBy("column_name", "level").agg(F.sum("one").alias("n"))


@query("A34_missing_fraction", "SELECT round(avg(m),6) AS missing_fraction FROM (SELECT column_name, avg(CASE WHEN code IS NULL THEN 1.0 ELSE 0 END) m FROM resp GROUP BY 1)")
def _(s, d):
    return CL.missing_fraction(V.responses(s, d))


# ------------------------------------------------------------------ distributions and association


@query("A01_empirical_distribution", "SELECT subpopulation, column_name, pos, code, n, round(CASE WHEN sum(n) OVER w > 0 THEN n/sum(n) OVER w ELSE 1.0/count(*) OVER w END, 6) AS p FROM (SELECT s.subpopulation, o.column_name, o.pos, o.code, count(r.code) n FROM (SELECT 'overall' subpopulation UNION SELECT CAST(cluster AS VARCHAR) FROM asg) s CROSS JOIN opt o LEFT JOIN (SELECT CAST(cluster AS VARCHAR) subpopulation, column_name, code FROM lab UNION ALL SELECT 'overall', column_name, code FROM lab) r ON r.subpopulation=s.subpopulation AND r.column_name=o.column_name AND r.code=o.code GROUP BY ALL) WINDOW w AS (PARTITION BY subpopulation, column_name)")
def _(s, d):
    return rounded(ST.empirical_distribution(ST.with_overall(labelled(s, d)), V.options(s)))


@query("A02_subpopulation_sizes", "SELECT coalesce(CAST(cluster AS VARCHAR),'overall') AS subpopulation, count(*) AS size, round(count(*)/(SELECT count(*) FROM asg), 6) AS weight FROM asg GROUP BY ROLLUP(cluster)")
def _(s, d):
    sizes = ST.with_overall(V.assignments(s, d)).groupBy("subpopulation").agg(F.count(F.lit(1)).alias("size"))
    return rounded(sizes.withColumn("weight", F.col("size") / F.max("size").over(Window.partitionBy())))


@query("A03_mode_index", "SELECT subpopulation, column_name, arg_min(pos, rk) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY subpopulation, column_name ORDER BY n DESC, pos) rk FROM (SELECT CAST(cluster AS VARCHAR) subpopulation, o.column_name, o.pos, count(r.code) n FROM (SELECT DISTINCT cluster FROM asg) s CROSS JOIN opt o LEFT JOIN lab r USING (cluster, column_name, code) GROUP BY ALL)) GROUP BY ALL")
def _(s, d):
    rows = labelled(s, d).withColumn("subpopulation", F.col("cluster").cast("string"))
    return ST.mode_of(ST.empirical_distribution(rows, V.options(s)))


@query("A04_posterior_distribution", "SELECT cluster, column_name, code, round(p,6) AS p FROM pp")
def _(s, d):
    return rounded(ST.posterior_distribution(V.labelled(s, d, "probs")))


@query("A05_nonresponse_rate", "SELECT cluster, column_name, round(sum(CASE WHEN code IS NULL THEN w ELSE 0 END)/greatest(sum(w),1e-12),6) AS rate FROM resp JOIN post USING (respondent_id) GROUP BY ALL")
def _(s, d):
    return rounded(ST.nonresponse(V.labelled(s, d, "probs")))


@query("A06_hard_distribution", "SELECT label, column_name, code, round(p,6) AS p FROM hp")
def _(s, d):
    return rounded(ST.hard_distribution(labelled(s, d).withColumnRenamed("cluster", "label")))


@query("A07_informativeness", "SELECT column_name, round(avg(tvd),6) AS informativeness FROM (SELECT x.column_name, x.cluster a, y.cluster b, sum(abs(x.p-y.p))/2 tvd FROM pp x JOIN pp y ON x.column_name=y.column_name AND x.code=y.code AND x.cluster<y.cluster GROUP BY ALL) GROUP BY 1")
def _(s, d):
    return rounded(ST.informativeness(ST.posterior_distribution(V.labelled(s, d, "probs")), "cluster"))


@query("A23_informativeness_summary", ", inf AS (SELECT column_name, sum(abs(x.p-y.p))/2 v FROM pp x JOIN pp y USING (column_name, code) WHERE x.cluster=0 AND y.cluster=1 GROUP BY 1) SELECT round(avg(v),6) AS mean, round(median(v),6) AS median, round(quantile_cont(v,0.75),6) AS p75, round(max(v),6) AS max, count(*) FILTER (v>=0.2) AS over_02, count(*) FILTER (v>=0.3) AS over_03 FROM inf")
def _(s, d):
    v = F.col("informativeness")
    i = ST.informativeness(ST.posterior_distribution(V.labelled(s, d, "probs")), "cluster")
    return rounded(i.agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.75)).alias("p75"), F.max(v).alias("max"), F.count_if(v >= 0.2).alias("over_02"), F.count_if(v >= 0.3).alias("over_03")))


@query("A09_cross_table", "SELECT x, y, n, round(100*n/sum(n) OVER (PARTITION BY y),6) AS percent, round(n/sum(n) OVER (),6) AS share FROM (SELECT cluster x, cluster3 y, count(*) n FROM asg GROUP BY ALL)")
def _(s, d):
    return rounded(ST.cross_table(V.assignments(s, d).select(F.col("cluster").alias("x"), F.col("cluster3").alias("y"))))


@query("A10_dominant_category", "SELECT label, column_name, code, n, round(percent,6) AS percent FROM (SELECT cluster AS label, column_name, code, count(*) n, 100.0*count(*)/sum(count(*)) OVER (PARTITION BY cluster, column_name) percent, row_number() OVER (PARTITION BY cluster, column_name ORDER BY count(*) DESC, code) k FROM lab WHERE code IS NOT NULL GROUP BY cluster, column_name, code) WHERE k=1")
def _(s, d):
    return rounded(ST.dominant_category(labelled(s, d).where("code is not null").withColumnRenamed("cluster", "label")))


@query("A11_numeric_profile", "SELECT cluster, round(avg(c_acctbal),6) AS mean, round(median(c_acctbal),6) AS median FROM wide JOIN asg USING (respondent_id) GROUP BY 1")
def _(s, d):
    w = V.survey_wide(s, d).join(V.assignments(s, d), F.col("o_orderkey") == F.col("respondent_id"))
    return rounded(ST.numeric_profile(w.select("cluster", F.col("c_acctbal").cast("double").alias("c_acctbal")), "cluster", "c_acctbal"))


@query("A13_composition", "SELECT label, column_name, code, n, round(share,6) AS share, round(sum(share) OVER (PARTITION BY label, column_name ORDER BY n DESC, code)-share,6) AS left_edge, share>=0.08 AS label_shown FROM (SELECT cluster AS label, column_name, code, count(*) n, count(*)/sum(count(*)) OVER (PARTITION BY cluster, column_name) share FROM lab WHERE code IS NOT NULL GROUP BY cluster, column_name, code)")
def _(s, d):
    return rounded(ST.composition(labelled(s, d).where("code is not null").withColumnRenamed("cluster", "label")))


@query("A14_cramers_v", "SELECT a, b, n, round(v,6) AS v FROM vs")
def _(s, d):
    return rounded(pairs_v(s, d))


@query("A15_redundancy", "SELECT column_name, partner, round(v,3) AS v FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY round(v,3) DESC, partner) k FROM sym) WHERE k=1")
def _(s, d):
    return ST.redundancy(pairs_v(s, d))


@query("W02_top_partners", "SELECT column_name, partner, v, k FROM (SELECT column_name, partner, round(v,6) AS v, CAST(row_number() OVER (PARTITION BY column_name ORDER BY round(v,6) DESC, partner) AS INT) k FROM sym) WHERE k<=3")
def _(s, d):
    return ST.top_partners(pairs_v(s, d))


@query("A16_cluster_sizes", "SELECT cluster, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS share FROM asg GROUP BY 1")
def _(s, d):
    return rounded(V.assignments(s, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("A16_all_clusters", "SELECT CAST(k AS INT) AS cluster, count(respondent_id) AS n, round(count(respondent_id)/(SELECT count(*) FROM asg WHERE cluster<>1),6) AS share FROM range(3) t(k) LEFT JOIN asg ON cluster=k AND cluster<>1 GROUP BY k")
def _(s, d):
    return rounded(ST.cluster_sizes(V.assignments(s, d).where("cluster <> 1"), 3))


@query("A17_certainty", "SELECT round(avg(t),6) AS mean, round(median(t),6) AS median, round(avg(CASE WHEN t>0.9 THEN 1.0 ELSE 0 END),6) AS above_09 FROM (SELECT greatest(p0,1-p0) t FROM asg)")
def _(s, d):
    return rounded(ST.certainty(V.assignments(s, d)))


@query("A18_relative_entropy", "SELECT round(1-sum(-p0*ln(p0+1e-12)-(1-p0)*ln(1-p0+1e-12))/(count(*)*ln(2)),6) AS relative_entropy FROM asg")
def _(s, d):
    return rounded(ST.relative_entropy(V.assignments(s, d)))


@query("A19_size_entropy", "SELECT round(-sum(p*ln(p))/ln(count(*)),6) AS size_entropy FROM (SELECT cluster3, count(*)/sum(count(*)) OVER () p FROM asg GROUP BY 1)")
def _(s, d):
    return rounded(ST.size_entropy(V.assignments(s, d).select(F.col("cluster3").alias("label"))))


@query("A20_coherence", ", lv AS (SELECT column_name, count(DISTINCT code) levels FROM resp WHERE code IS NOT NULL GROUP BY 1), h AS (SELECT column_name, label, -sum(CASE WHEN p>0 THEN p*ln(p) ELSE 0 END) h FROM hp GROUP BY ALL), sz AS (SELECT cluster AS label, count(DISTINCT respondent_id) size FROM lab GROUP BY 1) SELECT round(avg(c),6) AS coherence FROM (SELECT column_name, sum(size*(1-h/ln(levels)))/sum(size) c FROM h JOIN sz USING (label) JOIN lv USING (column_name) WHERE levels>=2 GROUP BY 1)")
def _(s, d):
    return rounded(ST.coherence(labelled(s, d).withColumnRenamed("cluster", "label")))


@query("A21_adjusted_rand", ", c AS (SELECT cluster x, cluster3 y, count(*) n FROM asg GROUP BY ALL), t AS (SELECT (SELECT sum(n*(n-1)/2) FROM c) cs, (SELECT sum(m*(m-1)/2) FROM (SELECT sum(n) m FROM c GROUP BY x)) rs, (SELECT sum(m*(m-1)/2) FROM (SELECT sum(n) m FROM c GROUP BY y)) ks, (SELECT sum(n) FROM c) n) SELECT round((cs-rs*ks/(n*(n-1)/2))/((rs+ks)/2-rs*ks/(n*(n-1)/2)),6) AS ari FROM t")
def _(s, d):
    return rounded(ST.adjusted_rand(V.assignments(s, d).select(F.col("cluster").alias("x"), F.col("cluster3").alias("y"))))


@query("A22_soft_hard_ablation", "SELECT column_name, round(avg(t),6) AS tvd FROM (SELECT coalesce(pp.column_name,hp.column_name) column_name, coalesce(pp.cluster,hp.label) k, sum(abs(coalesce(pp.p,0)-coalesce(hp.p,0)))/2 t FROM pp FULL JOIN hp ON pp.cluster=hp.label AND pp.column_name=hp.column_name AND pp.code=hp.code GROUP BY 1,2) GROUP BY 1")
def _(s, d):
    soft = ST.posterior_distribution(V.labelled(s, d, "probs")).withColumnRenamed("p", "soft")
    hard = ST.hard_distribution(labelled(s, d).withColumnRenamed("cluster", "label")).withColumnRenamed("label", "cluster").withColumnRenamed("p", "hard")
    both = soft.join(hard, ["cluster", "column_name", "code"], "full").na.fill(0.0, ["soft", "hard"])
    return rounded(both.groupBy("column_name", "cluster").agg((F.sum(F.abs(F.col("soft") - F.col("hard"))) / 2).alias("t")).groupBy("column_name").agg(F.avg("t").alias("tvd")))


def ablation(s: SparkSession, d: str) -> DataFrame:
    soft = ST.posterior_distribution(V.labelled(s, d, "probs"))
    hard = ST.hard_distribution(labelled(s, d).withColumnRenamed("cluster", "label")).withColumnRenamed("label", "cluster")
    return ST.distribution_ablation(soft, {"hard": hard})


_ABLATION = ", ab AS (SELECT column_name, si, tvd, hi FROM (SELECT column_name, avg(t) AS si FROM (SELECT x.column_name, sum(abs(x.p-y.p))/2 t FROM pp x JOIN pp y USING (column_name, code) WHERE x.cluster<y.cluster GROUP BY x.column_name, x.cluster, y.cluster) GROUP BY 1) JOIN (SELECT column_name, avg(t) AS hi FROM (SELECT x.column_name, sum(abs(x.p-y.p))/2 t FROM hp x JOIN hp y USING (column_name, code) WHERE x.label<y.label GROUP BY x.column_name, x.label, y.label) GROUP BY 1) USING (column_name) JOIN (SELECT column_name, avg(t) AS tvd FROM (SELECT coalesce(pp.column_name,hp.column_name) column_name, coalesce(pp.cluster,hp.label) k, sum(abs(coalesce(pp.p,0)-coalesce(hp.p,0)))/2 t FROM pp FULL JOIN hp ON pp.cluster=hp.label AND pp.column_name=hp.column_name AND pp.code=hp.code GROUP BY 1,2) GROUP BY 1) USING (column_name)) "


@query("A22_ablation_table", _ABLATION + "SELECT column_name, round(si,6) AS soft_informativeness, round(tvd,6) AS hard_tvd, round(hi,6) AS hard_informativeness FROM ab")
def _(s, d):
    return rounded(ablation(s, d))


@query("A22_ablation_summary", _ABLATION + "SELECT measure, round(avg(v),6) AS mean, round(median(v),6) AS median, round(quantile_cont(v,0.95),6) AS p95 FROM (SELECT unnest(['soft_informativeness','hard_tvd','hard_informativeness']) AS measure, unnest([si, tvd, hi]) AS v FROM ab) GROUP BY 1")
def _(s, d):
    return rounded(ST.ablation_summary(ablation(s, d)))


@query("A21_rand_matrix", ", m AS (SELECT respondent_id, 'by2' method, cluster l FROM asg UNION ALL SELECT respondent_id, 'by3', cluster3 FROM asg UNION ALL SELECT respondent_id, 'certain', CASE WHEN respondent_id%9<>0 THEN CAST(p0>=0.5 AS INT) END FROM asg), c AS (SELECT x.method a, y.method b, x.l lx, y.l ly, count(*) n FROM m x JOIN m y USING (respondent_id) WHERE x.l IS NOT NULL AND y.l IS NOT NULL GROUP BY ALL), t AS (SELECT a, b, sum(n*(n-1)/2) cs, sum(n) n FROM c GROUP BY ALL), r AS (SELECT a, b, sum(k*(k-1)/2) rs FROM (SELECT a, b, lx, sum(n) k FROM c GROUP BY ALL) GROUP BY ALL), q AS (SELECT a, b, sum(k*(k-1)/2) ks FROM (SELECT a, b, ly, sum(n) k FROM c GROUP BY ALL) GROUP BY ALL) SELECT a, b, round((cs-rs*ks/(n*(n-1)/2))/((rs+ks)/2-rs*ks/(n*(n-1)/2)),6) AS ari FROM t JOIN r USING (a, b) JOIN q USING (a, b)")
def _(s, d):
    a = V.assignments(s, d)
    certain = F.when(F.col("respondent_id") % 9 != 0, (F.col("probs")[0] >= 0.5).cast("int"))
    long = a.select("respondent_id", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), c.alias("label")) for n, c in (("by2", F.col("cluster")), ("by3", F.col("cluster3")), ("certain", certain))])))
    return rounded(ST.adjusted_rand_matrix(long))


@query("A24_correlation", "SELECT round(corr(Q6,Q7),6) AS r FROM wide")
def _(s, d):
    return rounded(V.survey_wide(s, d).agg(F.corr("Q6", "Q7").alias("r")))


@query("A39_certainty_histogram", "SELECT least(CAST(floor((greatest(p0,1-p0)-0.5)/0.05) AS INT),9) AS bin, count(*) AS n FROM asg GROUP BY 1")
def _(s, d):
    return RU.histogram(V.assignments(s, d).select(F.array_max("probs").alias("top")), "top", 0.5, 1.0, 10)


# ------------------------------------------------------------------ joins, picks, components


@query("J01_labelled_responses", "SELECT respondent_id, column_name, code, cluster FROM lab")
def _(s, d):
    return labelled(s, d)


@query("J04_items_by_prompts", "SELECT b.column_name, p.item_id, p.text AS prompt FROM bat b CROSS JOIN benchmark p")
def _(s, d):
    return V.batteries(s).select("column_name").crossJoin(V.read(s, d, "benchmark").select("item_id", F.col("text").alias("prompt")))


@query("J06_missing_jobs", "SELECT g.model, g.config, g.subpopulation FROM (SELECT DISTINCT model FROM ev) m CROSS JOIN (SELECT DISTINCT split config, subpopulation FROM ev) c0, LATERAL (SELECT m.model, c0.config, c0.subpopulation) g WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.prompt=0 AND e.event_id%3=0 AND e.model=g.model AND e.split=g.config AND e.subpopulation IS NOT DISTINCT FROM g.subpopulation AND g.config='train')")
def _(s, d):
    e = V.eval_results(s, d)
    grid = e.select("model").distinct().crossJoin(e.select(F.col("split").alias("config"), "subpopulation").distinct())
    done = e.where("prompt = 0 and event_id % 3 = 0 and split = 'train'").select("model", F.col("split").alias("config"), "subpopulation").distinct()
    return SC.missing_jobs(grid, done)


@query("J08_pair_cells", "SELECT a, b, ca, cb, n FROM cells")
def _(s, d):
    return ST.pair_cells(V.responses(s, d), V.batteries(s))


@query("M14_redundancy_components", LINKED + "SELECT column_name, min(root) AS root FROM reach GROUP BY 1")
def _(s, d):
    return CO.redundancy_components(V.batteries(s).select("column_name"), pairs_v(s, d))


@query("W04_greedy_pick", WALK + "SELECT column_name, battery, root, CAST(rank AS INT) AS rank FROM walk JOIN rk ON rk.column_name=walk.picked")
def _(s, d):
    p = stored(pairs_v(s, d), "pairs")
    roots = CO.redundancy_components(V.batteries(s).select("column_name"), p)
    ranked = ST.redundancy(p).join(V.batteries(s), "column_name").join(roots, "column_name")
    ranked = ranked.select("column_name", "battery", "root", F.row_number().over(Window.orderBy(F.desc("v"), "column_name")).alias("rank"))
    return CO.greedy_pick(ranked)


# ------------------------------------------------------------------ text


@query("T02_lettered_options", "SELECT user_id, pos, chr(CAST(65+pos AS INT))||'. '||event_type AS line FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type)-1 AS pos FROM (SELECT DISTINCT user_id, event_type FROM events))", False)
def _(s, d):
    listed = V.read(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("o"))
    return listed.select("user_id", F.posexplode(TX.lettered(F.col("o"))).alias("pos", "line"))


@query("T03_token_jaccard", ", tk AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text),'[a-z]+')) t FROM benchmark), sz AS (SELECT item_id, count(*) n FROM tk GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(count(*)/greatest(any_value(x.n)+any_value(y.n)-count(*),1),6) AS jaccard FROM tk a JOIN tk b USING (t) JOIN sz x ON x.item_id=a.item_id JOIN sz y ON y.item_id=b.item_id GROUP BY 1,2")
def _(s, d):
    return rounded(TX.token_jaccard(V.read(s, d, "benchmark").select(F.col("item_id").alias("name"), "text")))


@query("T05_chat_turns", "SELECT conv_id, count(*) AS turns, string_agg(role,',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1", False)
def _(s, d):
    m = TX.ordered_turns(V.read(s, d, "conversations"))
    return m.select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))


@query("T06_after_marker", r"SELECT conv_id, turn, nullif(regexp_replace(text,'^\s+|\s+$','','g'),'') AS answer FROM conversations", False)
def _(s, d):
    c = V.read(s, d, "conversations")
    return c.select("conv_id", "turn", SC.after_marker(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("so </think> "), F.col("text"))).otherwise(F.col("text"))).alias("answer"))


@query("T13_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text),'the')", False)
def _(s, d):
    return V.read(s, d, "documents").where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id")


# ------------------------------------------------------------------ evaluation


@query("A25_A26_divergences", "SELECT event_id, round(greatest(t0,1e-10)*ln(greatest(t0,1e-10)/greatest(m0,1e-10))+greatest(1-t0,1e-10)*ln(greatest(1-t0,1e-10)/greatest(1-m0,1e-10)),6) AS kl, round(-t0*ln(greatest(m0,1e-10))-(1-t0)*ln(greatest(1-m0,1e-10)),6) AS ce FROM ev")
def _(s, d):
    t, m = F.col("true_distribution"), F.col("model_distribution")
    return rounded(V.eval_results(s, d).select("event_id", SC.kl_divergence(t, m).alias("kl"), SC.cross_entropy(t, m).alias("ce")))


@query("A27_summary", "SELECT subpopulation, count(*) AS n, round(CASE WHEN count(is_correct)>0 THEN 100.0*count(*) FILTER (is_correct)/count(*) END,6) AS accuracy, round(avg(cross_entropy),6) AS cross_entropy, round(avg(kl_divergence),6) AS kl_divergence FROM ev GROUP BY 1")
def _(s, d):
    return rounded(SC.summary(V.eval_results(s, d), ["subpopulation"]))


@query("A28_metrics", "SELECT model, subpopulation, split, prompt, n, round(accuracy,6) AS accuracy, round(cross_entropy,6) AS cross_entropy, round(kl_divergence,6) AS kl_divergence FROM met")
def _(s, d):
    return rounded(metrics(s, d))


@query("A29_A30_prompt_means", "SELECT model, subpopulation, split, round(avg(accuracy),6) AS accuracy, round(avg(cross_entropy),6) AS cross_entropy, round(avg(kl_divergence),6) AS kl_divergence FROM met GROUP BY ALL UNION ALL SELECT model, subpopulation, 'overall', round(avg(a),6), round(avg(c),6), round(avg(k),6) FROM (SELECT model, subpopulation, prompt, sum(accuracy*n)/sum(n) a, sum(cross_entropy*n)/sum(n) c, sum(kl_divergence*n)/sum(n) k FROM met GROUP BY ALL) GROUP BY ALL")
def _(s, d):
    m = metrics(s, d)
    return rounded(SC.mean_over_prompts(m, ["model", "subpopulation", "split"]).unionByName(SC.overall_split(m, ["model", "subpopulation"])))


@query("A32_best_per_metric", ", t AS (SELECT model, avg(accuracy) accuracy, avg(cross_entropy) cross_entropy, avg(kl_divergence) kl_divergence FROM met GROUP BY 1) SELECT 'accuracy' AS metric, arg_max(model,accuracy) AS model, round(max(accuracy),6) AS value FROM t UNION ALL SELECT 'cross_entropy', arg_min(model,cross_entropy), round(min(cross_entropy),6) FROM t UNION ALL SELECT 'kl_divergence', arg_min(model,kl_divergence), round(min(kl_divergence),6) FROM t")
def _(s, d):
    return rounded(SC.best_per_metric(SC.mean_over_prompts(metrics(s, d), ["model"]), "model"))


@query("A33_mean_distribution", "SELECT model, subpopulation, 0 AS pos, round(avg(m0),6) AS p FROM ev GROUP BY ALL UNION ALL SELECT model, subpopulation, 1, round(avg(1-m0),6) FROM ev GROUP BY ALL")
def _(s, d):
    return rounded(V.eval_results(s, d).select("model", "subpopulation", F.posexplode("model_distribution").alias("pos", "x")).groupBy("model", "subpopulation", "pos").agg(F.avg("x").alias("p")))


@query("A36_resample_summary", "SELECT model, round(avg(cross_entropy),6) AS mean, round(median(cross_entropy),6) AS median, round(quantile_cont(cross_entropy,0.025),6) AS low, round(quantile_cont(cross_entropy,0.975),6) AS high, CASE WHEN avg(cross_entropy)>=0.7 THEN 'stable' ELSE 'unstable' END AS verdict FROM ev GROUP BY 1")
def _(s, d):
    return rounded(RU.resample_summary(V.eval_results(s, d), "model", "cross_entropy"))


@query("A37_exceedance", ", o AS (SELECT model, quantile_cont(cross_entropy, 0.99) x FROM ev WHERE prompt=0 GROUP BY 1) SELECT model, round((1+count(*) FILTER (cross_entropy>=x))/(1.0+count(cross_entropy)),6) AS p, (1+count(*) FILTER (cross_entropy>=x))/(1.0+count(cross_entropy))<0.05 AS rejected FROM ev JOIN o USING (model) GROUP BY 1")
def _(s, d):
    e = V.eval_results(s, d)
    observed = RU.exact_percentiles(e.where("prompt = 0"), "model", "cross_entropy", {"observed": 0.99})
    return rounded(RU.exceedance(e, observed, "model", "cross_entropy"))


@query("W01_newest_run", "SELECT model, run, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY timestamp DESC, run DESC) k FROM (SELECT event_type model, strftime(ts,'%Y-%m-%d') run, strftime(max(ts),'%Y-%m-%dT%H:%M:%S') AS timestamp FROM events WHERE user_id%4<>0 GROUP BY ALL)) WHERE k=1", False)
def _(s, d):
    e = V.read(s, d, "events").groupBy(F.col("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("run"), (F.col("user_id") % 4 == 0).alias("reasoning"))
    return SC.newest_run(e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))).select("model", "run", "timestamp")


@query("W06_running_metrics", "SELECT * FROM (SELECT model, CAST(row_number() OVER w AS INT) AS i, round(100.0*sum(CASE WHEN is_correct THEN 1 ELSE 0 END) OVER w/row_number() OVER w,6) AS accuracy, round(avg(cross_entropy) OVER w,6) AS cross_entropy, round(avg(kl_divergence) OVER w,6) AS kl_divergence FROM ev WINDOW w AS (PARTITION BY model ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE i%100=0")
def _(s, d):
    return rounded(SC.running_metrics(V.eval_results(s, d), "model", "event_id"))


@query("W07_failure_streaks", ", o AS (SELECT model, failed, row_number() OVER (PARTITION BY model ORDER BY event_id) i, row_number() OVER (PARTITION BY model, failed ORDER BY event_id) j FROM ev), r AS (SELECT model, i-j g, count(*) n, min(i) f FROM o WHERE failed GROUP BY ALL) SELECT m.model, coalesce(max(n),0) AS longest, CAST(min(CASE WHEN n>=10 THEN f+9 END) AS INT) AS abort_at, count(*) FILTER (n>=10)>0 AS aborted FROM (SELECT DISTINCT model FROM ev) m LEFT JOIN r USING (model) GROUP BY 1")
def _(s, d):
    return SC.failure_streaks(V.eval_results(s, d), "model", "event_id")


@query("W09_first_per_split", "SELECT split, event_id FROM (SELECT split, event_id, row_number() OVER (PARTITION BY split ORDER BY event_id) k FROM ev WHERE subpopulation='s1') WHERE k<=50")
def _(s, d):
    return SC.first_per_split(V.eval_results(s, d).where("subpopulation = 's1'").select("split", "event_id"), "event_id", 50)


@query("W12_top_items", "SELECT column_name, round(avg(tvd),6) AS informativeness FROM (SELECT x.column_name, sum(abs(x.p-y.p))/2 tvd FROM pp x JOIN pp y USING (column_name, code) WHERE x.cluster<y.cluster GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    i = ST.informativeness(ST.posterior_distribution(V.labelled(s, d, "probs")), "cluster")
    return rounded(i).orderBy(F.desc("informativeness"), "column_name").limit(5)


#: Runs of a base model and of models tuned from it: events dealt to two base models and to training methods.
VERSIONS = ", mv AS (SELECT 'b'||(prompt%2) AS base_model, ['base','first_token_distribution-cluster_0','modal_response-overall','modal_response-cluster_1','own-overall'][event_id%5+1] AS method, ['overall','cluster_0','cluster_1'][CAST(substr(subpopulation,2) AS INT)+1] AS pop, split, prompt, is_correct, cross_entropy, kl_divergence FROM ev), mm AS (SELECT base_model, method, pop, split, prompt, count(*) n, CASE WHEN count(is_correct)>0 THEN 100.0*count(*) FILTER (is_correct)/count(*) END accuracy, avg(cross_entropy) cross_entropy, avg(kl_divergence) kl_divergence FROM mv GROUP BY ALL), mo AS (SELECT base_model, method, pop, split, avg(accuracy) accuracy, avg(cross_entropy) cross_entropy, avg(kl_divergence) kl_divergence FROM mm GROUP BY ALL UNION ALL SELECT base_model, method, pop, 'overall', avg(a), avg(c), avg(k) FROM (SELECT base_model, method, pop, prompt, sum(accuracy*n)/sum(n) a, sum(cross_entropy*n)/sum(n) c, sum(kl_divergence*n)/sum(n) k FROM mm GROUP BY ALL) GROUP BY ALL) "


def versions(s: SparkSession, d: str) -> DataFrame:
    one_of = lambda i, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int") + 1)
    e = V.eval_results(s, d).withColumn("base_model", F.concat(F.lit("b"), (F.col("prompt") % 2).cast("string")))
    e = e.withColumn("method", one_of(F.col("event_id") % 5, ["base", "first_token_distribution-cluster_0", "modal_response-overall", "modal_response-cluster_1", "own-overall"]))
    return e.withColumn("subpopulation", one_of(F.substring("subpopulation", 2, 1), ["overall", "cluster_0", "cluster_1"]))


_A31 = "SELECT base_model, CAST(row_number() OVER (PARTITION BY base_model ORDER BY o) - 1 AS INT) AS place, label, " + ", ".join(f"round(max(CASE WHEN split='{x}' THEN {m} END),6) AS {m}_{x}" for x in ("train", "validation", "overall") for m in SC.METRICS) + " FROM mo JOIN (VALUES ('base','overall',0,'Base'),('modal_response-cluster_1','cluster_1',1,'Modal response (cluster 1)'),('modal_response-overall','overall',2,'Modal response (overall)'),('first_token_distribution-cluster_0','cluster_0',3,'First token (cluster 0)'),('own-overall','overall',4,'own (overall)')) t(method,pop,o,label) USING (method, pop) GROUP BY base_model, o, label"


def main_table(s: SparkSession, d: str) -> DataFrame:
    keys = ["base_model", "method", "subpopulation"]
    m = SC.summary(versions(s, d), [*keys, "split", "prompt"])
    return rounded(SC.main_table(SC.mean_over_prompts(m, [*keys, "split"]).unionByName(SC.overall_split(m, keys))))


@query("A31_main_table", VERSIONS + _A31)
def _(s, d):
    return main_table(s, d)


_CELLS = " UNION ALL ".join(f"SELECT base_model, place, label, '{m}' AS metric, '{x}' AS split, {m}_{x} AS v, '{f}' AS f, {'-' if m == 'accuracy' else ''}{m}_{x} AS w FROM mt" for m, f in SC.SHOWN.items() for x in ("train", "validation", "overall"))


@query("A32_table_cells", VERSIONS.rstrip() + f", mt AS ({_A31}), c AS ({_CELLS}), k AS (SELECT *, v IS NOT NULL AND row_number() OVER (PARTITION BY base_model, metric, split ORDER BY w NULLS LAST, place) = 1 AS best FROM c) SELECT base_model, place, label, metric, split, CASE WHEN v IS NULL THEN '--' WHEN best THEN '\\textbf{{'||printf(f, v)||'}}' ELSE printf(f, v) END AS text, best FROM k")
def _(s, d):
    return SC.table_cells(main_table(s, d))



@query("A40_completed_runs", "SELECT DISTINCT model, dataset, subpopulation FROM (SELECT model, strftime(ts,'%Y-%m-%d') run, 'd'||(prompt%2) dataset, CASE WHEN subpopulation<>'s0' THEN subpopulation END subpopulation, CASE WHEN prompt<>5 THEN prompt=4 END reasoning, bool_or(event_id%97=0) aborted, count(DISTINCT split) k, count(is_correct) rows FROM ev GROUP BY ALL) WHERE reasoning IS NOT TRUE AND NOT aborted AND k=2 AND rows>0")
def _(s, d):
    p = F.col("prompt")
    keys = ["model", F.date_format("ts", "yyyy-MM-dd").alias("run"), F.concat(F.lit("d"), (p % 2).cast("string")).alias("dataset"), F.when(F.col("subpopulation") != "s0", F.col("subpopulation")).alias("subpopulation"), F.when(p != 5, p == 4).alias("reasoning")]
    runs = V.eval_results(s, d).groupBy(*keys).agg(F.collect_set("split").alias("splits"), F.bool_or(F.col("event_id") % 97 == 0).alias("aborted"), F.nullif(F.count("is_correct"), F.lit(0)).alias("result_rows"))
    return SC.completed_runs(runs)


@query("A41_missing_work", "SELECT model, count(*) AS jobs, count(*)*3600 AS sequential_seconds, ceil(count(*)/4.0)*3600 AS wall_seconds FROM (SELECT DISTINCT m.model, c.subpopulation, c.prompt FROM (SELECT DISTINCT model FROM ev) m CROSS JOIN (SELECT DISTINCT subpopulation, prompt FROM ev) c) g WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.model=g.model AND e.subpopulation=g.subpopulation AND e.prompt=g.prompt AND e.event_id%40=0) GROUP BY 1")
def _(s, d):
    e = V.eval_results(s, d)
    grid = e.select("model").distinct().crossJoin(e.select("subpopulation", F.col("prompt").alias("config")).distinct())
    done = e.where("event_id % 40 = 0").select("model", "subpopulation", F.col("prompt").alias("config")).distinct()
    return SC.work_estimate(SC.missing_jobs(grid, done), workers=4)


@query("A43_component_members", LINKED + "SELECT root, count(*) AS size, string_agg(column_name, ',' ORDER BY column_name) AS members FROM (SELECT column_name, min(root) root FROM reach GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    roots = CO.redundancy_components(V.batteries(s).select("column_name"), pairs_v(s, d))
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_list("column_name")), ",").alias("members")).where("size >= 2")


# ------------------------------------------------------------------ splits, draws, models


@query("X04_split_routing", "SELECT column_name, item_id, CASE WHEN column_name IN (SELECT column_name FROM bat WHERE battery=2) OR item_id IN (SELECT item_id FROM benchmark WHERE length(text)%6=0) THEN 'validation' ELSE 'train' END AS split FROM bat CROSS JOIN benchmark")
def _(s, d):
    prompts = V.read(s, d, "benchmark")
    rows = V.batteries(s).select("column_name").crossJoin(prompts.select("item_id"))
    return SC.route_splits(rows, V.batteries(s).where("battery = 2"), prompts.where(F.char_length("text") % 6 == 0), ["column_name"], "item_id").select("column_name", "item_id", "split")


@query("X05_categorical_draw", "SELECT event_id, CASE WHEN m0 > CAST(('0x'||substr(md5('1|'||event_id),1,8)) AS BIGINT)/4294967296.0::DOUBLE THEN 0 ELSE 1 END AS pick FROM ev")
def _(s, d):
    return V.eval_results(s, d).select("event_id", TX.inverse_cdf(F.col("model_distribution"), TX.keyed_uniform(F.col("event_id"))).alias("pick"))


@query("R06_category_expansion", "SELECT event_id, 0 AS pos, round(t0,6) AS q FROM ev UNION ALL SELECT event_id, 1, round(1-t0,6) FROM ev")
def _(s, d):
    return rounded(SC.category_expansion(V.eval_results(s, d).select("event_id", "true_distribution"), "true_distribution"))


@query("R07_soft_cross_entropy", "SELECT round(avg(ln(exp(cross_entropy)+exp(kl_divergence))-t0*cross_entropy-(1-t0)*kl_divergence),6) AS loss FROM ev")
def _(s, d):
    e = V.eval_results(s, d).select(F.col("event_id").alias("row_id"), F.inline(F.arrays_zip(F.col("true_distribution").alias("q"), F.array("cross_entropy", "kl_divergence").alias("logprob"))))
    return rounded(SC.soft_cross_entropy(e.toDF("row_id", "q", "logprob")))


@query("M01_M03_latent_classes")
def _(s, d):
    r = V.responses(s, d)
    parameters, priors, _ = LA.fit_latent_classes(r, 2, starts=10)
    return rounded(LA.posteriors(r, parameters, priors))


@query("M10_kmeans")
def _(s, d):
    place, _, _ = CU.correspondence(V.responses(s, d))
    return CU.k_means_labels(place.select(F.col("respondent_id").alias("id"), F.col("coordinates").alias("features")), 3)


@query("M02_model_selection")
def _(s, d):
    return rounded(LA.model_selection(V.responses(s, d)))


@query("M04_M05_certainty_curve")
def _(s, d):
    r = V.responses(s, d)
    parameters, priors, _ = LA.fit_latent_classes(r, 2, starts=10)
    value = two_solutions(s, d)[0].select("column_name", F.round("value", 9).alias("value"))
    opened = V.read(s, d, "conversations").groupBy(F.concat(F.lit("Q"), F.col("conv_id")).alias("column_name")).agg(F.min_by("text", "turn").alias("question"))
    sub = F.when(F.col("column_name").isin("Q5", "Q7"), "About Abortion")
    asked = V.batteries(s).join(opened, "column_name", "left").select("column_name", "question", sub.alias("sub_question"))
    ranked = stored(LA.question_pools(value, asked), "pools")
    return rounded(LA.certainty_curve(r, parameters, priors, ranked))


@query("M06_bootstrap_stability")
def _(s, d):
    r = V.responses(s, d)
    parameters, priors, _ = LA.fit_latent_classes(r, 2, starts=10)
    original = LA.hard_labels(LA.posteriors(r, parameters, priors))
    return rounded(LA.bootstrap_stability(r, original, 2))


@query("M07_bootstrap_ratio_test")
def _(s, d):
    found = LA.bootstrap_ratio_test(V.responses(s, d), 2)
    return s.createDataFrame([(float(found["ratio"]), float(found["p"]))], "ratio double, p double")


@query("M08_k_modes")
def _(s, d):
    return CU.k_modes(V.responses(s, d), 3)


@query("M09_correspondence")
def _(s, d):
    place, _, _ = CU.correspondence(V.responses(s, d))
    return rounded(place.select("respondent_id", F.posexplode("coordinates").alias("d", "x")))


@query("M13_one_hot_components")
def _(s, d):
    place, _ = CU.one_hot_components(V.responses(s, d))
    return rounded(place.select("respondent_id", F.posexplode("coordinates").alias("d", "x")))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return V.read(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


@query("M11_diagonal_mixture")
def _(s, d):
    return CU.diagonal_mixture(vectors(s, d).drop("label"), 3)[0]


@query("M12_bisecting_kmeans")
def _(s, d):
    return CU.k_means_labels(vectors(s, d).drop("label"), 3, bisecting=True)


def shared_space(s: SparkSession, d: str) -> DataFrame:
    """(id, features): respondents in the space of the correspondence analysis, in which all methods are compared."""
    place, _, _ = CU.correspondence(V.responses(s, d))
    return stored(place.select(F.col("respondent_id").alias("id"), F.col("coordinates").alias("features")), "space")


def methods(s: SparkSession, d: str, k: int = 3) -> tuple[DataFrame, dict[str, DataFrame], dict[str, float]]:
    """The shared space, each method's (respondent_id, label) and the BIC of those with a likelihood."""
    r, space = V.responses(s, d), shared_space(s, d)
    parameters, priors, loglik = LA.fit_latent_classes(r, k, starts=10)
    named = lambda x: x.select(F.col("id").alias("respondent_id"), "label")
    alike = CU.counted(space)
    mixture, _, bic = CU.diagonal_mixture(space, k, alike=alike)
    labels = {
        "latent": LA.hard_labels(LA.posteriors(r, parameters, priors)).select("respondent_id", "label"),
        "k_modes": CU.k_modes(r, k).select("respondent_id", "label"),
        "k_means": named(CU.k_means_labels(space, k, alike=alike)),
        "mixture": named(mixture),
        "ward": named(CU.ward(space, k, alike=alike)[0]),
    }
    return space, {m: stored(x, m) for m, x in labels.items()}, {"latent": LA.information_criteria(r, k, loglik)["bic"], "mixture": bic}


@query("M15_M18_shared_space")
def _(s, d):
    """All methods side by side, with the agreement of each with the latent classes."""
    space, labels, bics = methods(s, d)
    table = CU.compare_methods(V.responses(s, d), space, labels, bics)
    agreement = None
    for m, x in labels.items():
        pair = labels["latent"].withColumnRenamed("label", "x").join(x.withColumnRenamed("label", "y"), "respondent_id")
        one = ST.adjusted_rand(pair).select(F.lit("agreement_with_latent").alias("metric"), F.col("ari").alias("value"), F.lit(m).alias("method"))
        agreement = one if agreement is None else agreement.unionByName(one)
    return rounded(table.unionByName(agreement))


@query("M12_ward")
def _(s, d):
    return CU.ward(shared_space(s, d), 3)[0]


@query("M12_ward_tree")
def _(s, d):
    return rounded(CU.ward_tree(shared_space(s, d)))


VECTORS = "WITH v AS (SELECT vec_id id, CAST(embedding AS DOUBLE[]) f, label FROM embeddings), e AS (SELECT id, label, unnest(range(len(f))) d, unnest(f) x FROM v), "


@query("M16_noise_reassignment", VECTORS + "c AS (SELECT label, d, avg(x) m FROM e WHERE id%7<>0 GROUP BY ALL), g AS (SELECT e.label, e.id, round(sum((x-m)*(x-m)),9) gap FROM e JOIN c USING (label, d) WHERE e.id%7<>0 GROUP BY ALL), r AS (SELECT label, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gap, id) k FROM g) WHERE k=1), n AS (SELECT e.id, r.label, round(sum((e.x-y.x)*(e.x-y.x)),9) gap FROM e JOIN e y USING (d) JOIN r ON r.id=y.id WHERE e.id%7=0 GROUP BY ALL) SELECT id, label, false AS was_noise FROM v WHERE id%7<>0 UNION ALL SELECT id, label, true FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, label) k FROM n) WHERE k=1", False)
def _(s, d):
    return CU.reassign_noise(vectors(s, d).withColumn("label", F.when(F.col("id") % 7 != 0, F.col("label"))))


@query("M17_merge_single_members", VECTORS + "l AS (SELECT *, CASE WHEN id=(SELECT min(id) FROM v) THEN -1 ELSE label END g FROM v), x AS (SELECT g, id, unnest(range(len(f))) d, unnest(f) x FROM l), c AS (SELECT g, d, avg(x) m FROM x WHERE g<>-1 GROUP BY ALL), n AS (SELECT c.g, sum((x-m)*(x-m)) gap FROM x JOIN c USING (d) WHERE x.g=-1 GROUP BY ALL) SELECT id, CASE WHEN g=-1 THEN (SELECT arg_min(g, gap) FROM n) ELSE g END AS label FROM l", False)
def _(s, d):
    v = vectors(s, d)
    return CU.merge_single_members(v.join(v.agg(F.min("id").alias("lone"))).withColumn("label", F.when(F.col("id") == F.col("lone"), -1).otherwise(F.col("label")))).select("id", "label")


@query("M15_M18_method_comparison")
def _(s, d):
    a, r = V.assignments(s, d), V.responses(s, d)
    place = V.survey_wide(s, d).select(F.col("o_orderkey").alias("id"), F.array("Q3", "Q6", "Q7").alias("features"))
    labels = {f"by_{c}": a.select("respondent_id", F.when(F.col("respondent_id") % 50 != 0, F.col(c)).alias("label")) for c in ("cluster", "cluster3")}
    parameters, priors, loglik = LA.fit_latent_classes(r, 2, starts=10)
    labels["latent"] = stored(LA.hard_labels(LA.posteriors(r, parameters, priors)).select("respondent_id", "label"))
    return rounded(CU.compare_methods(r, place, labels, {"latent": LA.information_criteria(r, 2, loglik)["bic"]}))


# ------------------------------------------------------------------ reports


INF = "inf AS (SELECT column_name, sum(abs(x.p-y.p))/2 value FROM pp x JOIN pp y USING (column_name, code) WHERE x.cluster<y.cluster GROUP BY 1), hinf AS (SELECT column_name, sum(abs(x.p-y.p))/2 value FROM hp x JOIN hp y USING (column_name, code) WHERE x.label<y.label GROUP BY 1)"


def two_solutions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    soft = ST.informativeness(ST.posterior_distribution(V.labelled(s, d, "probs")), "cluster")
    hard = ST.informativeness(ST.hard_distribution(labelled(s, d).withColumnRenamed("cluster", "label")), "label")
    return soft.withColumnRenamed("informativeness", "value"), hard.withColumnRenamed("informativeness", "value")


TEXTS = ", tx AS (SELECT respondent_id, cluster label, 'segment' column_name, CASE WHEN o_custkey%20<>0 THEN c_mktsegment END code FROM wide JOIN asg USING (respondent_id) UNION ALL SELECT respondent_id, cluster, 'nation', CAST(c_nationkey AS VARCHAR) FROM wide JOIN asg USING (respondent_id)), tn AS (SELECT label, column_name, coalesce(code,'Missing') code, count(*) n FROM tx GROUP BY ALL), tg AS (SELECT l.label, g.column_name, g.code, coalesce(n,0) n FROM (SELECT DISTINCT label FROM tn) l CROSS JOIN (SELECT DISTINCT column_name, code FROM tn) g LEFT JOIN tn USING (label, column_name, code)), tp AS (SELECT *, n/sum(n) OVER (PARTITION BY label, column_name) p FROM tg), tvd AS (SELECT column_name, sum(abs(x.p-y.p))/2 tvd FROM tp x JOIN tp y USING (column_name, code) WHERE x.label<y.label GROUP BY 1) "


def demographics(s: SparkSession, d: str) -> DataFrame:
    w = V.survey_wide(s, d).join(V.assignments(s, d), F.col("o_orderkey") == F.col("respondent_id"))
    w = w.select("respondent_id", F.col("cluster").alias("label"), F.when(F.col("o_custkey") % 20 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"))
    return w


@query("A08_demographic_tvd", TEXTS + "SELECT column_name, round(tvd,6) AS tvd FROM tvd")
def _(s, d):
    return rounded(ST.demographic_tvd(demographics(s, d).unpivot(["respondent_id", "label"], ["segment", "nation"], "column_name", "code")))


_PROFILE = """, dp_people AS (SELECT respondent_id, cluster AS label, CASE WHEN o_custkey%20<>0 THEN c_mktsegment END AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_acctbal AS DOUBLE) AS balance FROM wide JOIN asg USING (respondent_id)),
dp_words AS (SELECT label, 'segment' AS column_name, segment AS code FROM dp_people UNION ALL SELECT label, 'nation', nation FROM dp_people),
dp_cnt AS (SELECT label, column_name, code, count(*) AS n FROM dp_words WHERE code IS NOT NULL AND NOT regexp_matches(lower(code), 'missing|no answer') GROUP BY ALL),
dp_top AS (SELECT label, column_name, printf('%s (%.1f%%)', code, percent) AS shown FROM (SELECT *, 100.0*n/sum(n) OVER w AS percent, row_number() OVER (PARTITION BY label, column_name ORDER BY n DESC, code) AS k FROM dp_cnt WINDOW w AS (PARTITION BY label, column_name)) WHERE k=1),
dp_told AS (SELECT * FROM dp_top UNION ALL SELECT label, 'balance', printf('%.2f / %.2f', avg(balance), median(balance)) FROM dp_people GROUP BY label),
dp_share AS (SELECT label, column_name, coalesce(code, 'Missing') AS code, count(*)/sum(count(*)) OVER (PARTITION BY label, column_name) AS p FROM dp_words GROUP BY label, column_name, coalesce(code, 'Missing')),
dp_gap AS (SELECT coalesce(a.column_name, b.column_name) AS column_name, sum(abs(coalesce(a.p,0)-coalesce(b.p,0)))/2 AS tvd FROM (SELECT * FROM dp_share WHERE label=0) a FULL JOIN (SELECT * FROM dp_share WHERE label=1) b ON a.column_name=b.column_name AND a.code=b.code GROUP BY 1)
SELECT c.column_name, max(CASE WHEN label=0 THEN shown END) AS "0", max(CASE WHEN label=1 THEN shown END) AS "1", round(any_value(tvd),6) AS tvd FROM dp_told c LEFT JOIN dp_gap USING (column_name) GROUP BY 1"""


@query("A12_demographic_profile", _PROFILE)
def _(s, d):
    w = demographics(s, d)
    texts = w.unpivot(["respondent_id", "label"], ["segment", "nation"], "column_name", "code")
    numbers = w.select("label", F.lit("balance").alias("column_name"), F.col("balance").alias("value"))
    return rounded(ST.demographic_profile(texts, numbers, [0, 1], "missing|no answer"))


@query("A38_solution_comparison", ", " + INF + " SELECT metric, round(f,6) AS first, round(s,6) AS second, CASE WHEN abs(f-s)<1e-9 THEN '-' WHEN f>s THEN 'first' ELSE 'second' END AS favours FROM (SELECT 'mean' metric, (SELECT avg(value) FROM inf) f, (SELECT avg(value) FROM hinf) s UNION ALL SELECT 'max', (SELECT max(value) FROM inf), (SELECT max(value) FROM hinf))")
def _(s, d):
    one = [x.agg(F.avg("value").alias("mean"), F.max("value").alias("max")).unpivot([], ["mean", "max"], "metric", n) for x, n in zip(two_solutions(s, d), ("first", "second"))]
    return ST.favours(rounded(one[0].join(one[1], "metric")), ["mean", "max"])


@query("A44_largest_differences", ", " + INF + " SELECT column_name, round(inf.value,6) AS first, round(hinf.value,6) AS second, round(hinf.value-inf.value,6) AS difference FROM inf JOIN hinf USING (column_name) ORDER BY round(abs(hinf.value-inf.value),9) DESC, 1 LIMIT 3")
def _(s, d):
    return rounded(ST.largest_differences(*two_solutions(s, d)))


@query("A42_question_groups", ", " + INF + ", rk AS (SELECT battery, column_name, row_number() OVER (ORDER BY round(value,9) DESC, column_name) k FROM inf JOIN bat USING (column_name)) SELECT battery, CAST(min(k) AS INT) AS best, string_agg(column_name, ',' ORDER BY k) AS members FROM rk WHERE k<=5 GROUP BY 1")
def _(s, d):
    ranked = two_solutions(s, d)[0].join(V.batteries(s), "column_name").withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("value", 9)), "column_name")))
    return ST.question_groups(ranked, 5).withColumn("members", F.array_join("members", ","))


@query("A45_side_by_side", ", x AS (SELECT model, subpopulation, avg(m0) p, avg(1-m0) p1, avg(t0) t, avg(1-t0) t1 FROM ev GROUP BY ALL), y AS (SELECT model, subpopulation, 0 pos, p, t FROM x UNION ALL SELECT model, subpopulation, 1, p1, t1 FROM x) SELECT a.model, 'q' AS question_id, a.subpopulation, a.pos, 'Opt '||(a.pos+1) AS label, round(b.p,6) AS base, round(a.p,6) AS tuned, round(a.t,6) AS truth FROM y a LEFT JOIN y b ON b.model=(SELECT min(model) FROM ev) AND b.subpopulation=a.subpopulation AND b.pos=a.pos WHERE a.model<>(SELECT min(model) FROM ev)")
def _(s, d):
    e = V.eval_results(s, d)
    rows = e.join(e.agg(F.min("model").alias("base_model"))).select("model", "base_model", F.lit("q").alias("question_id"), "subpopulation", F.posexplode(F.arrays_zip(F.col("model_distribution").alias("p"), F.col("true_distribution").alias("truth"))).alias("pos", "x"))
    return rounded(SC.side_by_side(rows.select("model", "base_model", "question_id", "subpopulation", "pos", F.lit(None).cast("string").alias("label"), "x.*")))


@query("T08_list_literal", "SELECT conv_id, turn, pos, item FROM (SELECT conv_id, turn, unnest([0,1]) pos, unnest([role, CAST(turn AS VARCHAR)]) item FROM conversations)", False)
def _(s, d):
    c = V.read(s, d, "conversations")
    written = F.concat(F.lit("['"), F.col("role"), F.lit("', '"), F.col("turn").cast("string"), F.lit("']"))
    return c.select("conv_id", "turn", F.posexplode(TX.list_literal(written)).alias("pos", "item"))


@query("T11_similar_questions", ", k AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY round(v,3) DESC, partner) k FROM sym WHERE column_name IN ('Q3','Q6') AND partner NOT IN ('Q3','Q6')) SELECT column_name, 'Question '||column_name AS text, CAST(k AS INT) AS k, partner, 'Question '||partner AS partner_text, round(v,3) AS v FROM k WHERE k<=3")
def _(s, d):
    names = V.batteries(s).select("column_name", F.concat(F.lit("Question "), F.col("column_name")).alias("text"))
    held = names.where(F.col("column_name").isin("Q3", "Q6")).select("column_name")
    return ST.similar_questions(pairs_v(s, d), held, held, names, 3)


@query("R02_option_probability", "SELECT event_id, round(exp(-(value/97)-(value/47)),6) AS p_first, round(exp(-(value/97)-3),6) AS p_second FROM events", False)
def _(s, d):
    token = lambda t, lp: F.struct(F.lit(t).alias("token"), lp.cast("double").alias("logprob"))
    e = V.eval_results(s, d)
    a, b = -F.col("kl_divergence"), -F.col("cross_entropy")
    answer = F.array(F.struct(F.lit("Very").alias("token"), F.array(token("Very", a)).alias("top")), F.struct(F.lit(" often").alias("token"), F.array(token(" often", b), token(" rarely", F.lit(-3.0))).alias("top")))
    return rounded(e.select("event_id", SC.option_probability(answer, F.lit("Very often")).alias("p_first"), SC.option_probability(answer, F.lit("Very rarely")).alias("p_second")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


from tessella.plans import items_and_runs  # noqa: E402, F401  (registers its queries)
