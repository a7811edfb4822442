"""Registered queries on question items, prompts, stored runs, files and the live monitor, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as TX
from tessella.functions.shared import new_path, stored, tasks_for
from tessella.operators import cleaning as CL
from tessella.operators import components as CO
from tessella.operators import latent as LA
from tessella.operators import scoring as SC
from tessella.operators import statistics as ST
from tessella.plans import registry as R
from tessella.plans import views as V
from tessella.plans.registry import query, rounded
from tessella.sources import files, ranges, versions
from tessella.streaming import monitor


def folder(s: SparkSession) -> str:
    """A new place in the folder that all executors share."""
    return new_path(s, "files")


# ------------------------------------------------------------------ question items

#: A conversation stands for a mapping entry, a turn for a column; a third has no sub-questions, a third too few.
MAPPING = """WITH it AS (SELECT conv_id AS id, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS INT) AS pos, 'Q'||(conv_id*10+turn) AS column_name, CASE WHEN conv_id%3=2 THEN text END AS sub_question,
 CASE conv_id%4 WHEN 0 THEN 'value survey' WHEN 1 THEN 'respondent information' WHEN 2 THEN 'other' END AS question_type FROM conversations) """


def mapping(s: SparkSession, d: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    c = V.read(s, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("t"))
    texts, i = F.transform("t", lambda x: x["text"]), F.col("id")
    subs = F.when(i % 3 == 2, texts).when(i % 3 == 1, F.slice(texts, F.lit(1), F.size("t") - 1)).otherwise(F.array(F.lit("")))
    kind = F.when(i % 4 == 0, "value survey").when(i % 4 == 1, "respondent information").when(i % 4 == 2, "other")
    return c.select("id", texts[0].alias("question"), F.transform("t", lambda x: F.concat(F.lit("Q"), (i * 10 + x["turn"]).cast("string"))).alias("column_names"), subs.alias("sub_questions"), kind.alias("question_type"))


@query("P10_item_expansion", MAPPING + "SELECT id, question, pos, column_name, sub_question FROM it", False)
def _(s, d):
    return CL.expand_items(mapping(s, d))


@query("P11_question_types", MAPPING + ", m AS (SELECT DISTINCT id, question_type FROM it) SELECT id, 'value' AS form FROM m WHERE question_type='value survey' UNION ALL SELECT id, 'asked' FROM m WHERE question_type IS DISTINCT FROM 'respondent information'", False)
def _(s, d):
    m = mapping(s, d)
    return CL.value_questions(m).select("id", F.lit("value").alias("form")).unionByName(CL.asked_questions(m).select("id", F.lit("asked").alias("form")))


@query("P12_column_kind", "SELECT kind, count(*) AS cells FROM (SELECT 'value' AS kind FROM resp UNION ALL SELECT 'demographic' FROM wide, (VALUES (1),(2)) t) GROUP BY 1")
def _(s, d):
    w = V.survey_wide(s, d).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    names = w.unpivot("id", ["segment", "nation"], "column_name", "value").select("column_name").unionByName(V.responses(s, d).select("column_name"))
    return names.groupBy(CL.column_kind(F.col("column_name")).alias("kind")).agg(F.count(F.lit(1)).alias("cells"))


@query("P13_junk_categories", "SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE turn%4 WHEN 0 THEN role WHEN 1 THEN 'No Answer: '||role WHEN 2 THEN 'Unknown' END c FROM conversations) WHERE c IS NULL OR NOT regexp_matches(lower(c), 'missing|no answer|don''t know|don´t know|not applicable|other missing|unknown|none of these')", False)
def _(s, d):
    t = F.col("turn") % 4
    category = F.when(t == 0, F.col("role")).when(t == 1, F.concat(F.lit("No Answer: "), F.col("role"))).when(t == 2, "Unknown")
    return V.read(s, d, "conversations").where(~CL.is_junk(category)).select("conv_id", "turn")


@query("P16_short_labels", "SELECT o_orderkey, CASE o_custkey%4 WHEN 0 THEN coalesce(['≤$10K','$10-15K','$15-20K','$20-25K','$25-30K','$30-40K','$40-50K','$50-70K','$70-100K','$100K+'][o_orderkey%12+1], 'Step{'||(o_orderkey%12+1)||'}') WHEN 1 THEN CASE o_orderkey%3 WHEN 0 THEN 'Upper middle' WHEN 1 THEN 'Lower middle' ELSE 'Working class' END WHEN 2 THEN CASE o_orderkey%2 WHEN 0 THEN 'No schooling' ELSE 'Abroad{x}' END ELSE '25-34' END AS label FROM orders", False)
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    column = F.when(c == 0, "income_scale").when(c == 1, "social_class").when(c == 2, "education_respondent_cs").otherwise("age")
    klass = F.when(k % 3 == 0, "Upper middle class").when(k % 3 == 1, "Lower middle class").otherwise("Working class")
    category = F.when(c == 0, F.concat(F.lit("Step{"), (k % 12 + 1).cast("string"), F.lit("}"))).when(c == 1, klass).when(c == 2, F.when(k % 2 == 0, "NZ: No formal schooling").otherwise("Abroad{x}")).otherwise("25-34")
    return V.read(s, d, "orders").select("o_orderkey", CL.short_label(column, category).alias("label"))


@query("P17_sensitive_questions", MAPPING + "SELECT column_name, pos, regexp_matches(lower(question||' '||coalesce(sub_question,'')||CASE WHEN pos=1 THEN ' About Abortion' ELSE '' END), 'homosexual|immig|abortion|prostitution|divorce|sex before marriage|casual sex|wife|husband|women|gender') OR column_name IN ('Q189','Q190','Q22','Q36','Q119','Q263','Q264','Q265') AS sensitive FROM it", False)
def _(s, d):
    asked = F.concat(F.coalesce("sub_question", F.lit("")), F.when(F.col("pos") == 1, " About Abortion").otherwise(""))
    return CL.expand_items(mapping(s, d)).select("column_name", "pos", CL.is_sensitive(F.col("question"), asked, F.col("column_name")).alias("sensitive"))


@query("P18_item_lookup", MAPPING + "SELECT l.respondent_id, it.column_name, it.question, it.sub_question FROM (SELECT o_orderkey respondent_id, 'Q'||(o_custkey%100*10) column_name FROM orders) l JOIN it USING (column_name) WHERE pos=0", False)
def _(s, d):
    asked = V.read(s, d, "orders").select(F.col("o_orderkey").alias("respondent_id"), F.concat(F.lit("Q"), (F.col("o_custkey") % 100 * 10).cast("string")).alias("column_name"))
    return asked.join(CL.expand_items(mapping(s, d)).where("pos = 0").select("column_name", "question", "sub_question"), "column_name")


@query("P19_code_labels", "SELECT r.respondent_id, r.column_name, r.code, 'Opt '||o.pos AS label FROM resp r LEFT JOIN opt o ON o.column_name=r.column_name AND o.code=r.code AND o.code>=0")
def _(s, d):
    listed = V.options(s).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("o"))
    items = listed.select("column_name", F.transform("o", lambda x: x["code"]).alias("codes"), F.transform("o", lambda x: F.concat(F.lit("Opt "), x["pos"].cast("string"))).alias("labels"))
    return V.responses(s, d).join(CL.code_labels(items), ["column_name", "code"], "left").select("respondent_id", "column_name", "code", "label")


@query("P21_complete_rows", "SELECT g AS subpopulation, count(*) AS n FROM (SELECT CASE WHEN user_id%3<>0 THEN 's'||(user_id%3) END g FROM events WHERE event_id%13<>0 AND event_id%7<>0) GROUP BY 1", False)
def _(s, d):
    i = F.col("event_id")
    e = V.read(s, d, "events").select(F.when(i % 13 == 0, "").when(i % 7 != 0, "q").alias("question_id"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))).alias("subpopulation"))
    return e.where("question_id <> ''").groupBy("subpopulation").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ joins and sets


@query("J02_two_partitions", "SELECT respondent_id, cluster AS cluster_k2, cluster3 AS cluster_k3 FROM asg")
def _(s, d):
    a = V.assignments(s, d)
    return a.select("respondent_id", F.col("cluster").alias("cluster_k2")).join(a.select("respondent_id", F.col("cluster3").alias("cluster_k3")), "respondent_id")


@query("J03_aligned_tables", ", " + R.INF + " SELECT column_name, round(inf.value,6) AS first, round(hinf.value,6) AS second FROM inf JOIN hinf USING (column_name)")
def _(s, d):
    soft, hard = R.two_solutions(s, d)
    return rounded(soft.withColumnRenamed("value", "first").join(hard.withColumnRenamed("value", "second"), "column_name"))


_A01 = R.oracles()[R.FLAGSHIP].removeprefix(V.ORACLE_VIEWS)


@query("J05_item_distributions", f"SELECT battery, column_name, subpopulation, pos, p FROM bat JOIN ({_A01}) USING (column_name)")
def _(s, d):
    dist = ST.empirical_distribution(ST.with_overall(R.labelled(s, d)), V.options(s))
    return rounded(dist.join(V.batteries(s), "column_name").select("battery", "column_name", "subpopulation", "pos", "p"))


@query("J07_membership", R.LINKED + "SELECT respondent_id, column_name, code FROM resp WHERE column_name IN (SELECT column_name FROM reach GROUP BY 1 HAVING count(*)>1) AND column_name NOT IN ('Q3','Q6')")
def _(s, d):
    roots = CO.redundancy_components(V.batteries(s).select("column_name"), R.pairs_v(s, d))
    linked = roots.join(roots.groupBy("root").count().where("count > 1"), "root", "left_semi")
    held = V.batteries(s).where(F.col("column_name").isin("Q3", "Q6")).select("column_name")
    return V.responses(s, d).join(linked.select("column_name"), "column_name", "left_semi").join(held, "column_name", "left_anti").select("respondent_id", "column_name", "code")


NAMED = "WITH ev AS (SELECT event_id, event_type base_model, event_type||CASE WHEN user_id%2=1 THEN '-nz-wvs-modal_response-overall' ELSE '' END model, user_id%5 question_id, 's'||(user_id%3) subpopulation, user_id%7 prompt, value FROM events) "


def named_results(s: SparkSession, d: str) -> DataFrame:
    e, u = V.read(s, d, "events"), F.col("user_id")
    model = F.concat("event_type", F.when(u % 2 == 1, "-nz-wvs-modal_response-overall").otherwise(""))
    return e.select("event_id", TX.base_model(model).alias("base_model"), model.alias("model"), (u % 5).alias("question_id"), F.concat(F.lit("s"), (u % 3).cast("string")).alias("subpopulation"), (u % 7).alias("prompt"), "value")


@query("J09_tuned_pairs", NAMED + ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, question_id, subpopulation, prompt ORDER BY event_id) k FROM ev) WHERE k=1) SELECT t.model, t.base_model, t.question_id, t.subpopulation, t.prompt, round(t.value,6) AS tuned_value, round(b.value,6) AS base_value FROM f t LEFT JOIN f b ON b.model=t.base_model AND b.question_id=t.question_id AND b.subpopulation=t.subpopulation AND b.prompt=t.prompt WHERE t.model<>t.base_model", False)
def _(s, d):
    return rounded(SC.tuned_pairs(named_results(s, d), ["question_id", "subpopulation", "prompt"], "event_id", ["value"]))


@query("X01_union_of_splits", "SELECT 'events' AS pool, event_id AS id, value FROM events UNION ALL SELECT 'orders', o_orderkey, NULL FROM orders", False)
def _(s, d):
    pools = V.read(s, d, "events").select(F.lit("events").alias("pool"), F.col("event_id").alias("id"), "value"), V.read(s, d, "orders").select(F.lit("orders").alias("pool"), F.col("o_orderkey").alias("id"))
    return pools[0].unionByName(pools[1], allowMissingColumns=True)


@query("X02_train_keys", "SELECT DISTINCT o_custkey AS id, 'Q'||(o_orderkey%8+1) AS column_name FROM orders EXCEPT SELECT o_custkey, 'Q'||(o_orderkey%8+1) FROM orders WHERE o_orderkey%5=0", False)
def _(s, d):
    o = V.read(s, d, "orders")
    keys = lambda x: x.select(F.col("o_custkey").alias("id"), F.concat(F.lit("Q"), (F.col("o_orderkey") % 8 + 1).cast("string")).alias("column_name"))
    return keys(o).subtract(keys(o.where("o_orderkey % 5 = 0")))


@query("X03_held_out_prompts", "SELECT 'p'||item_id||x AS name FROM benchmark, (VALUES (''),('_letter')) t(x) WHERE item_id%6=0", False)
def _(s, d):
    b = V.read(s, d, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("name"), "item_id")
    both = b.select(F.explode(F.array("name", F.concat("name", F.lit("_letter")))).alias("name"))
    return TX.held_out_prompts(both, b.where("item_id % 6 = 0"))


U = "CAST(('0x'||substr(md5({}),1,8)) AS BIGINT)/4294967296.0::DOUBLE"
#: Running sums of the Poisson(1) chances, as the draw adds them up.
_POISSON = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, i+1), lambda j: exp(-1.0::DOUBLE)/factorial(CAST(j AS INT))::DOUBLE)), lambda a, b: a + b)"


@query("X06_bootstrap_weights", "WITH u AS (SELECT r AS replicate, o_orderkey AS respondent_id, " + U.format("'1|'||r||'|'||o_orderkey") + f" u FROM orders, range(1, 4) t(r)), c AS (SELECT i, {_POISSON} s FROM range(0, 12) t(i)) SELECT CAST(replicate AS INT) AS replicate, respondent_id, CAST(least(count(*) FILTER (s<=u), 11) AS DOUBLE) AS weight FROM u, c GROUP BY ALL", False)
def _(s, d):
    r = V.read(s, d, "orders").select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("replicate"), F.col("o_orderkey").alias("respondent_id"))
    return r.select("replicate", "respondent_id", LA.poisson_one(F.col("replicate"), F.col("respondent_id")).alias("weight"))


@query("X07_simulated_responses")
def _(s, d):
    r = V.responses(s, d)
    parameters, priors, _ = LA.fit_latent_classes(r, 2, starts=10)
    return LA.simulate(parameters, priors, r.select("respondent_id").distinct())


@query("X08_dataset_configs", f", a AS ({_A01}), g AS (SELECT subpopulation, column_name, string_agg(CAST(p AS DECIMAL(9,6)), ',' ORDER BY pos) AS distribution, arg_min(pos, (-n, pos)) m, list(n ORDER BY pos) ns, {U.format(chr(39) + '1|' + chr(39) + '||subpopulation||' + chr(39) + '|' + chr(39) + '||column_name')} u FROM a GROUP BY ALL), w AS (SELECT *, len(list_filter(list_transform(range(1, len(ns)+1), lambda i: list_sum(ns[1:i])/list_sum(ns)), lambda c: c <= u)) dr FROM g), r AS (SELECT subpopulation, column_name, distribution, unnest(['modal_response','sampled_response','first_token_distribution','full_string_distribution']) AS config, unnest(['Opt '||m, 'Opt '||least(dr, len(ns)-1), NULL, NULL]) AS expected_text, unnest([NULL, NULL, array_to_string(list_transform(range(0, len(ns)), lambda i: chr(CAST(65+i AS INT))), ''), NULL]) AS letters FROM w) SELECT config, subpopulation, column_name, item_id AS prompt, expected_text, letters, distribution FROM r CROSS JOIN benchmark")
def _(s, d):
    dist = ST.empirical_distribution(ST.with_overall(R.labelled(s, d)), V.options(s))
    rows = dist.groupBy("subpopulation", "column_name").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("o"))
    p = F.transform("o", lambda x: x["p"])
    text = lambda i: F.concat(F.lit("Opt "), i.cast("string"))
    a = rows.select("subpopulation", "column_name", p.alias("p"), F.array_join(F.transform(p, lambda x: F.format_string("%.6f", x)), ",").alias("distribution"))
    modal, drawn = text(F.array_position("p", F.array_max("p")) - 1), text(TX.inverse_cdf(F.col("p"), TX.keyed_uniform(F.col("subpopulation"), F.col("column_name"))))
    letters, none = F.array_join(TX.letters(F.col("p")), ""), F.lit(None).cast("string")
    kinds = [("modal_response", modal, none), ("sampled_response", drawn, none), ("first_token_distribution", none, letters), ("full_string_distribution", none, none)]
    configs = F.array(*[F.struct(F.lit(c).alias("config"), e.alias("expected_text"), x.alias("letters")) for c, e, x in kinds])
    prompts = V.read(s, d, "benchmark").select(F.col("item_id").alias("prompt"))
    return a.select("subpopulation", "column_name", "distribution", F.inline(configs)).crossJoin(prompts)


# ------------------------------------------------------------------ text


@query("T01_user_prompt", MAPPING + "SELECT column_name, pos, CASE WHEN id%2=0 AND sub_question IS NOT NULL THEN 'About: '||question ELSE question END || chr(10)||chr(10)||'Options:'||chr(10)||'Yes'||chr(10)||'No' || CASE WHEN id%2=0 AND sub_question IS NOT NULL THEN chr(10)||chr(10)||sub_question||':' ELSE '' END AS prompt FROM it", False)
def _(s, d):
    template = F.when(F.col("id") % 2 == 0, F.concat(F.lit("About: "), F.col("question")))
    return CL.expand_items(mapping(s, d)).select("column_name", "pos", TX.user_prompt(template, F.col("question"), F.col("sub_question"), F.array(F.lit("Yes"), F.lit("No"))).alias("prompt"))


@query("T04_least_similar", "WITH tk AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text),'[a-z]+')) t FROM benchmark), sz AS (SELECT item_id, count(*) n FROM tk GROUP BY 1), j AS (SELECT a.item_id a, b.item_id b, count(*)/greatest(any_value(x.n)+any_value(y.n)-count(*),1) v FROM tk a JOIN tk b USING (t) JOIN sz x ON x.item_id=a.item_id JOIN sz y ON y.item_id=b.item_id GROUP BY 1,2) SELECT item_id AS name, round(coalesce(v,0)/(SELECT count(*) FROM benchmark),6) AS similarity FROM benchmark LEFT JOIN (SELECT a item_id, sum(v) v FROM j GROUP BY 1) USING (item_id) ORDER BY round(coalesce(v,0)/(SELECT count(*) FROM benchmark),9), item_id LIMIT 1", False)
def _(s, d):
    return rounded(TX.least_similar(V.read(s, d, "benchmark").select(F.col("item_id").alias("name"), "text")))


@query("T07_answer_match", "SELECT event_id, upper(left(event_type,1))=upper(left(['click','view'][event_id%2+1],1)) AS letter_match, event_type=['click','view'][event_id%2+1] AND event_id%3<>0 AS text_match FROM events", False)
def _(s, d):
    e = V.read(s, d, "events").withColumn("want", F.when(F.col("event_id") % 2 == 0, "click").otherwise("view"))
    letter = F.concat(F.lit(" "), F.upper(F.left("event_type", F.lit(1))), F.lit(".. \n"))
    text = F.concat(F.lit("\t"), F.upper("event_type"), F.when(F.col("event_id") % 3 == 0, ".").otherwise(" "))
    return e.select("event_id", SC.answer_matches(letter, F.left("want", F.lit(1)), True).alias("letter_match"), SC.answer_matches(text, F.col("want")).alias("text_match"))


METHOD = "['modal_response','sampled_response','other'][user_id%3+1]"
POP = "['cluster_0','overall','all'][user_id%3+1]"


def adapters(s: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (u % 3 + 1).cast("int"))
    tuned = F.concat("event_type", F.lit("-nz-wvs-"), pick("modal_response", "sampled_response", "other"), F.lit("-"), pick("cluster_0", "overall", "all"))
    return V.read(s, d, "events").select("event_id", "event_type", u, F.when(u % 4 == 0, F.col("event_type")).otherwise(tuned).alias("model"))


@query("T09_model_names", f"SELECT event_id, event_type AS base, CASE WHEN user_id%4=0 THEN 'base' ELSE {METHOD}||'-'||{POP} END AS adapter, CASE WHEN user_id%4=0 THEN 'base' ELSE {METHOD} END AS method, CASE WHEN user_id%4=0 THEN 'base' ELSE {POP} END AS population FROM events", False)
def _(s, d):
    m = F.col("model")
    return adapters(s, d).select("event_id", TX.base_model(m).alias("base"), TX.adapter(m).alias("adapter"), TX.adapter_method(m).alias("method"), TX.adapter_population(m).alias("population"))


@query("T10_run_subpopulation", f"SELECT event_id, CASE WHEN user_id%3=2 THEN 'unknown' ELSE {POP} END AS subpopulation, left(repeat(props, 20), 200) AS answer FROM events", False)
def _(s, d):
    run = F.concat(F.lit("modal-"), TX.adapter_population(F.col("m")), F.lit("-20260101"))
    e = adapters(s, d).withColumn("m", F.element_at(F.array(F.lit("a-cluster_0"), F.lit("a-overall"), F.lit("a-all")), (F.col("user_id") % 3 + 1).cast("int")).alias("m")).withColumn("m", F.concat(F.lit("x-nz-wvs-"), "m"))
    return e.select("event_id", TX.run_subpopulation(run).alias("subpopulation")).join(V.read(s, d, "events").select("event_id", F.left(F.repeat("props", 20), F.lit(200)).alias("answer")), "event_id")


@query("T12_display_labels", MAPPING + "SELECT column_name, pos, 'Q'||id||': '||coalesce(nullif(sub_question,''), left(question,50)) AS label, ['Modal response (cluster 0)','First token (overall)','other (all)'][id%3+1] AS adapter FROM it", False)
def _(s, d):
    name = F.element_at(F.array(F.lit("m-nz-wvs-modal_response-cluster_0"), F.lit("m-nz-wvs-first_token_distribution-overall"), F.lit("m-nz-wvs-other-all")), (F.col("id") % 3 + 1).cast("int"))
    return CL.expand_items(mapping(s, d)).select("column_name", "pos", TX.question_label(F.col("id"), F.col("question"), F.col("sub_question")).alias("label"), TX.adapter_label(name).alias("adapter"))


# ------------------------------------------------------------------ ranks and runs


@query("A35_fit_table")
def _(s, d):
    return rounded(LA.fit_table(LA.model_selection(V.responses(s, d), starts=2)))


@query("W03_pick_order", R.WALK + "SELECT column_name, battery, v, CAST(row_number() OVER (ORDER BY rank) AS INT) AS pick, row_number() OVER (ORDER BY rank)<=2 AS held_out FROM walk JOIN rk ON rk.column_name=walk.picked")
def _(s, d):
    p = stored(R.pairs_v(s, d), "pairs")
    red = ST.redundancy(p)
    roots = CO.redundancy_components(V.batteries(s).select("column_name"), p)
    ranked = red.join(V.batteries(s), "column_name").join(roots, "column_name")
    ranked = ranked.select("column_name", "battery", "root", F.row_number().over(Window.orderBy(F.desc("v"), "column_name")).alias("rank"))
    pick = F.row_number().over(Window.orderBy("rank"))
    return CO.greedy_pick(ranked).join(red.select("column_name", "v"), "column_name").select("column_name", "battery", "v", pick.alias("pick"), (pick <= 2).alias("held_out"))


@query("W05_joint_ranking", R.TEXTS + ", " + R.INF + " SELECT kind, column_name, round(v,6) AS value, CAST(row_number() OVER (ORDER BY round(v,9) DESC, kind DESC, column_name) AS INT) AS rank FROM (SELECT 'value' AS kind, column_name, value v FROM inf UNION ALL SELECT 'demographic', column_name, tvd FROM tvd)")
def _(s, d):
    value = R.two_solutions(s, d)[0].select(F.lit("value").alias("kind"), "column_name", "value")
    tvd = ST.demographic_tvd(R.demographics(s, d).unpivot(["respondent_id", "label"], ["segment", "nation"], "column_name", "code"))
    every = value.unionByName(tvd.select(F.lit("demographic").alias("kind"), "column_name", F.col("tvd").alias("value")))
    return rounded(every.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("value", 9)), F.desc("kind"), "column_name"))))


@query("W08_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events) WHERE k=1", False)
def _(s, d):
    return TX.first_in_order(V.read(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("W10_run_choice", "WITH r AS (SELECT event_type||(user_id%10) model, event_id ordinal, user_id%4=0 reasoning FROM events) SELECT mode, model, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY mode, model ORDER BY ordinal) k FROM r, (VALUES ('all'),('with_reasoning'),('without_reasoning')) m(mode) WHERE mode='all' OR reasoning=(mode='with_reasoning')) WHERE k=1", False)
def _(s, d):
    runs = V.read(s, d, "events").select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("model"), F.col("event_id").alias("ordinal"), (F.col("user_id") % 4 == 0).alias("reasoning"))
    picked = [SC.pick_run(runs, m) for m in ("all", "with_reasoning", "without_reasoning")]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).select("mode", "model", "ordinal")


@query("W11_throughput", "SELECT event_type, i, round(i/e,6) AS rate, round((n-i)/(i/e),6) AS eta FROM (SELECT event_type, CAST(row_number() OVER w AS INT) i, nullif((epoch_us(ts)-min(epoch_us(ts)) OVER (PARTITION BY event_type))/1e6,0) e, count(*) OVER (PARTITION BY event_type) n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE i%10=0", False)
def _(s, d):
    e = V.read(s, d, "events")
    e = e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("o", F.struct("at", "event_id"))
    return rounded(SC.throughput(e, "event_type", "o", "at"))


# ------------------------------------------------------------------ scores of stored responses


def offered(*pairs) -> F.Column:
    return F.array(*[F.struct(F.lit(t).alias("token"), lp.cast("double").alias("logprob")) for t, lp in pairs])


@query("R01_first_token", "SELECT event_id, round(exp(-value/97),6) AS a, round(exp(-value/47),6) AS b, round(exp(-3.0),6) AS c, 0.0::DOUBLE AS d FROM events", False)
def _(s, d):
    top = offered(("A", -F.col("kl_divergence")), (" B", -F.col("cross_entropy")), (" Cat", F.lit(-3.0)))
    return rounded(V.eval_results(s, d).select("event_id", *[SC.first_token_probability(top, F.lit(x)).alias(x.lower()) for x in "ABCD"]))


@query("R03_renormalized", "SELECT event_id, CASE WHEN event_id%7=0 THEN 0.0 ELSE 1.0 END::DOUBLE AS first, 0.0::DOUBLE AS second, round(CASE WHEN t0>0 THEN t0/(t0+t0/2) ELSE 0 END,6) AS third FROM ev")
def _(s, d):
    m, t = F.col("model_distribution")[0], F.col("true_distribution")[0]
    lone, both = SC.renormalized(F.array(m, F.lit(0.0))), SC.renormalized(F.array(t, t / 2))
    return rounded(V.eval_results(s, d).select("event_id", lone[0].alias("first"), lone[1].alias("second"), both[0].alias("third")))


@query("R04_modal_letter", "SELECT event_id, CASE WHEN t0>=1-t0 THEN 'A' ELSE 'B' END AS expected, (CASE WHEN t0>=1-t0 THEN 'A' ELSE 'B' END)=['A','B'][prompt%2+1] AS is_correct FROM ev")
def _(s, d):
    letter = SC.modal_letter(F.col("true_distribution"))
    said = F.concat(F.when(F.col("prompt") % 2 == 0, " a").otherwise("B"), F.lit(". "))
    return V.eval_results(s, d).select("event_id", letter.alias("expected"), SC.answer_matches(said, letter, True).alias("is_correct"))


@query("R05_category_fallback", "SELECT e.event_id, CASE WHEN e.event_id%4=0 THEN o.n ELSE 2 END AS n_categories FROM (SELECT *, 'Q'||(event_id%9+1) column_name FROM ev) e LEFT JOIN (SELECT column_name, CAST(count(*) AS INT) n FROM opt GROUP BY 1) o USING (column_name)")
def _(s, d):
    listed = V.options(s).groupBy("column_name").agg(F.collect_list(F.col("code").cast("string")).alias("listed"))
    own = F.when(F.col("event_id") % 4 != 0, F.array(F.lit("yes"), F.lit("no")))
    e = V.eval_results(s, d).withColumn("column_name", F.concat(F.lit("Q"), (F.col("event_id") % 9 + 1).cast("string")))
    found = F.coalesce(own, "listed")
    return e.join(listed, "column_name", "left").select("event_id", F.when(found.isNotNull(), F.size(found)).alias("n_categories"))


@query("R08_option_loss", "SELECT event_id, round(t0*(l-cross_entropy)+(1-t0)*(l-kl_divergence),6) AS loss FROM (SELECT *, ln(exp(cross_entropy)+exp(kl_divergence)) l FROM ev)")
def _(s, d):
    q = F.concat("true_distribution", F.array(F.lit(0.0)))
    logits = F.array(F.col("cross_entropy"), F.col("kl_divergence"), F.lit(99.0))
    return rounded(V.eval_results(s, d).select("event_id", SC.option_loss(q, logits, F.array(F.lit(True), F.lit(True), F.lit(False))).alias("loss")))


@query("R09_completion_logprob", "SELECT event_id, round(-cross_entropy-CASE WHEN event_id%3=0 THEN 0 ELSE kl_divergence END,6) AS logprob FROM ev")
def _(s, d):
    valid = F.array(F.lit(True), F.col("event_id") % 3 != 0, F.lit(False))
    return rounded(V.eval_results(s, d).select("event_id", SC.completion_logprob(F.array(-F.col("cross_entropy"), -F.col("kl_divergence"), F.lit(-9.0)), valid).alias("logprob")))


@query("R10_label_cross_entropy", "SELECT event_id, round(-t0*ln(greatest(a/(a+b),1e-10))-(1-t0)*ln(greatest(b/(a+b),1e-10)),6) AS ce FROM (SELECT *, exp(-kl_divergence) a, CASE WHEN event_id%2=0 THEN exp(-cross_entropy) ELSE exp(-100.0) END b FROM ev)")
def _(s, d):
    second = F.when(F.col("event_id") % 2 == 0, "Not at").otherwise("zzz")
    top = F.array(F.struct(F.lit("Very").alias("token"), (-F.col("kl_divergence")).alias("logprob")), F.struct(second.alias("token"), (-F.col("cross_entropy")).alias("logprob")))
    return rounded(V.eval_results(s, d).select("event_id", SC.label_cross_entropy(F.col("true_distribution"), F.array(F.lit("Very"), F.lit("Not at all")), top).alias("ce")))


@query("R11_one_subpopulation", "SELECT event_id, split FROM ev WHERE subpopulation='s1'")
def _(s, d):
    return V.eval_results(s, d).where("subpopulation = 's1'").select("event_id", "split")


@query("R12_bad_letters", "SELECT event_id FROM events WHERE event_id%17 IN (0,1)", False)
def _(s, d):
    i = F.col("event_id") % 17
    letters = F.array(F.lit("A"), F.when(i == 0, "BC").when(i == 1, "A").otherwise("B"))
    return SC.bad_letters(V.read(s, d, "events").select("event_id", letters.alias("answer_tokens"))).select("event_id")


# ------------------------------------------------------------------ files and the live monitor


@query("S05_S08_csv_round_trip", "SELECT event_id, model, true AS whole, round(cross_entropy,6) AS cross_entropy FROM ev")
def _(s, d):
    path = folder(s)
    files.write_csv(V.eval_results(s, d).select("event_id", "model", "true_distribution", "cross_entropy"), path)
    back = s.read.csv(path, header=True, schema="event_id long, model string, true_distribution string, cross_entropy double", escape='"')
    return rounded(back.select("event_id", "model", (F.size(F.from_json("true_distribution", "array<double>")) == 2).alias("whole"), "cross_entropy"))


@query("S09_nested_json", f"SELECT subpopulation, size, round(size/(SELECT count(*) FROM asg),6) AS weight, column_name, pos, code, 'Opt '||(pos+1) AS label, p FROM ({_A01}) JOIN (SELECT CAST(cluster AS VARCHAR) subpopulation, count(*) size FROM asg GROUP BY 1) USING (subpopulation)")
def _(s, d):
    path = folder(s)
    sizes = ST.with_overall(V.assignments(s, d)).groupBy("subpopulation").agg(F.count(F.lit(1)).alias("size"))
    labels = V.options(s).select("column_name", "code", F.concat(F.lit("Opt "), (F.col("pos") + 1).cast("string")).alias("label"))
    files.write_distributions(ST.empirical_distribution(ST.with_overall(R.labelled(s, d)), V.options(s)), sizes, labels, path)
    back = s.read.json(path, schema="subpopulation string, size long, weight double, items map<string, struct<numeric_codes: array<double>, word_labels: array<string>, distribution: array<double>>>")
    flat = back.select("subpopulation", "size", "weight", F.explode("items").alias("column_name", "x"))
    zipped = F.arrays_zip(F.col("x.numeric_codes").alias("code"), F.col("x.word_labels").alias("label"), F.col("x.distribution").alias("p"))
    return rounded(flat.select("subpopulation", "size", "weight", "column_name", F.posexplode(zipped).alias("pos", "y")).select("subpopulation", "size", "weight", "column_name", "pos", "y.*"))


@query("S07_S10_S11_manifest", "SELECT model AS config, split, subpopulation, count(*) AS rows FROM ev GROUP BY ROLLUP (model, split, subpopulation)")
def _(s, d):
    root, e = folder(s), V.eval_results(s, d).withColumnRenamed("model", "config")
    files.write_dataset(e.withColumn("config", F.concat(F.lit("old-"), "config")), root, "old")
    files.write_dataset(e, root, "new")
    return files.manifest(s, files.dataset_path(s, root)).select("config", "split", "subpopulation", "rows")


@query("S13_keyed_cache", "SELECT version, model, n FROM (SELECT model, count(*) AS n FROM ev GROUP BY 1), (VALUES ('first'), ('again'), ('changed')) v(version) WHERE version <> 'changed' UNION ALL SELECT 'changed', model, count(*) FROM ev WHERE split = 'train' GROUP BY ALL")
def _(s, d):
    """A table kept by its inputs' fingerprint: asked twice, then once more after the input has changed."""
    root, where, e = folder(s), folder(s), V.eval_results(s, d).select("model", "split")

    def counts(version: str) -> DataFrame:
        key = ranges.fingerprint(s, f"{where}/part-*")
        table = versions.keyed(s, root, key, lambda: s.read.parquet(where).groupBy("model").agg(F.count(F.lit(1)).alias("n")))
        return table.select(F.lit(version).alias("version"), "model", "n")

    e.write.parquet(where)
    out = counts("first").unionAll(counts("again"))
    e.where("split = 'train'").write.mode("overwrite").parquet(where)
    return out.unionAll(counts("changed"))


@query("ST1_live_monitor", "SELECT model, subpopulation, count(*) FILTER (NOT failed) AS n, round(CASE WHEN count(is_correct) FILTER (NOT failed)>0 THEN 100.0*count(*) FILTER (is_correct AND NOT failed)/count(*) FILTER (NOT failed) END,6) AS accuracy, round(avg(cross_entropy) FILTER (NOT failed),6) AS cross_entropy, round(avg(kl_divergence) FILTER (NOT failed),6) AS kl_divergence, count(*) FILTER (failed) AS failures FROM ev GROUP BY ALL")
def _(s, d):
    path, out = folder(s), folder(s)
    V.eval_results(s, d).select("event_id", "model", "subpopulation", "is_correct", "cross_entropy", "kl_divergence", "failed").write.parquet(path)
    monitor.start(monitor.live_summary(s, path), out, folder(s)).awaitTermination()
    return rounded(monitor.newest(s, out))


_LIVE = """SELECT model, kind, i, round(accuracy,6) AS accuracy, round(cross_entropy,6) AS cross_entropy, round(kl_divergence,6) AS kl_divergence, round(rate,6) AS rate, longest, abort_at, aborted FROM (
SELECT model, 'means' AS kind, i, 100.0*good/i AS accuracy, ce AS cross_entropy, kl AS kl_divergence, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS BIGINT) AS longest, CAST(NULL AS BIGINT) AS abort_at, CAST(NULL AS BOOLEAN) AS aborted FROM up WHERE i%100=0
UNION ALL SELECT model, 'speed', i, NULL, NULL, NULL, i/nullif(e,0), NULL, NULL, NULL FROM up WHERE i%10=0
UNION ALL SELECT u.model, 'run', n, NULL, NULL, NULL, NULL, coalesce(longest,0), abort_at, abort_at IS NOT NULL FROM (SELECT model, count(*) AS n FROM up GROUP BY 1) u LEFT JOIN (SELECT model, CAST(max(n) AS BIGINT) AS longest, CAST(min(CASE WHEN n>=10 THEN f+9 END) AS BIGINT) AS abort_at FROM (SELECT model, i-j AS g, count(*) AS n, min(i) AS f FROM up WHERE failed GROUP BY ALL) GROUP BY 1) s USING (model))"""


@query("ST1_live_runs", ", tm AS (SELECT e.*, epoch_us(x.ts) AS us FROM ev e JOIN events x USING (event_id)), up AS (SELECT model, failed, row_number() OVER w AS i, row_number() OVER (PARTITION BY model, failed ORDER BY event_id) AS j, sum(CASE WHEN is_correct THEN 1 ELSE 0 END) OVER w AS good, avg(cross_entropy) OVER w AS ce, avg(kl_divergence) OVER w AS kl, (us-min(us) OVER w)/1e6 AS e FROM tm WINDOW w AS (PARTITION BY model ORDER BY event_id ROWS UNBOUNDED PRECEDING)) " + _LIVE)
def _(s, d):
    """Results of all runs arrive in three lots of files; what the state by run tells is the same as from all at once."""
    path, out, state = folder(s), folder(s), folder(s)
    at = V.read(s, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = V.eval_results(s, d).join(at, "event_id").select(*[c.split(" ")[0] for c in monitor.RUN_RESULT.split(", ")])
    cuts = rows.approxQuantile("event_id", [0.3, 0.65], 0.0)
    lots = [F.col("event_id") <= cuts[0], (F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1]), F.col("event_id") > cuts[1]]
    for lot in lots:
        rows.where(lot).write.mode("append").parquet(path)
        monitor.start_runs(monitor.live_runs(s, path), out, state).awaitTermination()
    found = [monitor.run_events(s, out, k).withColumn("kind", F.lit(k)) for k in ("means", "speed", "run")]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]).select("model", "kind", "i", "accuracy", "cross_entropy", "kl_divergence", "rate", "longest", "abort_at", "aborted"))


@query("S01_coded_scan", "SELECT CAST(respondent_id AS DOUBLE) AS id, Q1, Q2, Q6 FROM wide")
def _(s, d):
    path = folder(s)
    V.survey_wide(s, d).select(F.col("o_orderkey").alias("id"), *[F.col(q).cast("int").alias(q) for q in ("Q1", "Q2", "Q6")]).write.csv(path, sep=";", header=True)
    return files.read_coded(s, path, ["id", "Q1", "Q2", "Q6"])


@query("S02_label_scan", "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(turn AS VARCHAR) AS turn, role||';\"'||chr(10)||text AS answer FROM conversations", False)
def _(s, d):
    path = folder(s)
    rows = V.read(s, d, "conversations").select(F.col("conv_id").alias("id the interview"), F.col("turn"), F.concat("role", F.lit(';"\n'), "text").alias("answer in words"))
    rows.write.csv(path, sep=";", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_labels(s, path)


def by_bucket(rows: DataFrame, one: F.Column, path: str) -> None:
    """One text file per bucket, so that each is a JSON document of its own."""
    rows.select("bucket", one.alias("value")).write.partitionBy("bucket").text(path)


@query("S03_mapping_scan", MAPPING + "SELECT CAST(id AS BIGINT) AS id, any_value(question) AS question, count(*) AS n_columns, string_agg(column_name, ',' ORDER BY pos) AS columns FROM it GROUP BY 1", False)
def _(s, d):
    path = folder(s)
    entries = mapping(s, d).select((F.col("id") % 4).alias("bucket"), F.to_json(F.struct("id", "question", "column_names")).alias("j"))
    by_bucket(entries.groupBy("bucket").agg(F.collect_list("j").alias("j")), F.concat(F.lit("["), F.array_join("j", ", "), F.lit("]")), path)
    back = files.read_mapping(s, path)
    return back.select("id", "question", F.size("column_names").cast("long").alias("n_columns"), F.array_join("column_names", ",").alias("columns"))


@query("S04_template_scan", "SELECT CASE WHEN item_id%2=0 THEN 'system_prompts' ELSE 'question_templates' END AS kind, 't'||item_id AS name, text FROM benchmark", False)
def _(s, d):
    path = folder(s)
    entry = F.struct(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("name"), "text")
    pick = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("item_id") % 2 == k, entry))))
    maps = V.read(s, d, "benchmark").groupBy((F.col("item_id") % 4).alias("bucket")).agg(pick(0).alias("system_prompts"), pick(1).alias("question_templates"))
    by_bucket(maps, F.to_json(F.struct("system_prompts", "question_templates")), path)
    return files.read_templates(s, path)


def by_run(rows: DataFrame, key: F.Column) -> DataFrame:
    """rows of a run together, those of a large table's runs cut by key into a file for every some millions of the table's rows."""
    width = tasks_for(rows)
    return rows.repartition(width, "model", "run", F.pmod(F.xxhash64(key), F.lit(1 + width // 16)))


def stored_runs(s: SparkSession, d: str) -> tuple[str, str]:
    """Runs as folders of files: configs and results below <model>/<run>."""
    configs, results = folder(s), folder(s)
    e = V.eval_results(s, d).withColumn("run", F.concat(F.lit("r-"), F.when(F.col("prompt") % 2 == 0, "cluster_0").otherwise("own"), F.lit("-"), F.col("prompt").cast("string")))
    runs = e.groupBy("model", "run").agg(F.collect_set("split").alias("splits"), F.max("prompt").alias("p"))
    runs = runs.select("model", "run", F.to_json(F.struct(F.col("model").alias("target"), F.lit("d").alias("dataset"), F.sort_array("splits").alias("splits"), (F.col("p") == 3).alias("reasoning"), F.col("run").alias("run_name"))).alias("value"))
    runs.write.partitionBy("model", "run").text(configs)
    rows = e.select("event_id", "model", "run", F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("q"), F.col("event_id").cast("string"))).alias("question_id"), F.when(F.col("event_id") % 3 != 0, F.col("subpopulation")).alias("subpopulation"), F.repeat(F.lit("ab,\n"), (F.col("event_id") % 100).cast("int")).alias("model_answer"), F.round("cross_entropy", 6).cast("string").alias("cross_entropy"))
    by_run(rows, F.col("event_id")).drop("event_id").write.partitionBy("model", "run").csv(results, header=True, quoteAll=True, escape='"', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return configs, results


RESULTS = "question_id string, subpopulation string, model_answer string, cross_entropy string"


@query("S06_run_scan", "SELECT model, 'r-'||CASE WHEN prompt%2=0 THEN 'cluster_0' ELSE 'own' END||'-'||prompt AS run, prompt=3 AS reasoning, count(DISTINCT split) AS splits, count(*) AS rows FROM ev GROUP BY ALL")
def _(s, d):
    configs, results = stored_runs(s, d)
    counts = files.read_results(s, results, RESULTS, "part-*").groupBy("model", "run").agg(F.count(F.lit(1)).alias("rows"))
    return files.read_runs(s, configs, "part-*").select("model", "run", "reasoning", F.size("splits").cast("long").alias("splits")).join(counts, ["model", "run"])


@query("S14_evaluation_publish", "SELECT model, 'r-'||CASE WHEN prompt%2=0 THEN 'cluster_0' ELSE 'own' END||'-'||prompt AS run_name, prompt=3 AS reasoning, 'q'||event_id AS question_id, CASE WHEN event_id%3<>0 THEN subpopulation WHEN prompt%2=0 THEN 'cluster_0' ELSE 'unknown' END AS subpopulation, least(200, 4*(event_id%100)) AS answer_signs, CAST(round(cross_entropy,6) AS DOUBLE) AS cross_entropy FROM ev WHERE event_id%8<>0")
def _(s, d):
    configs, results = stored_runs(s, d)
    rows = files.read_results(s, results, RESULTS, "part-*")
    for c in ("question", "sub_question", "column_name", "question_format", "system_prompt_id", "model_reasoning", "categories", "model_distribution", "true_distribution", "kl_divergence", "expected_text"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    nested = SC.published(files.read_runs(s, configs, "part-*").withColumn("model_sha", F.lit(None).cast("string")), rows)
    path = folder(s)
    nested.write.json(path)
    back = s.read.json(path, schema=nested.schema)
    flat = back.select("model", "config.run_name", "config.reasoning", F.inline("results"))
    return rounded(flat.select("model", "run_name", "reasoning", "question_id", "subpopulation", F.char_length("model_answer").cast("long").alias("answer_signs"), F.col("cross_entropy").cast("double").alias("cross_entropy")))


def differing_runs(s: SparkSession, d: str) -> tuple[str, str]:
    """Three runs a model: the newest on another dataset, the next one (with reasoning for some models), and the oldest, whose results lack two columns."""
    configs, results = folder(s), folder(s)
    e = V.eval_results(s, d).withColumn("run", F.concat(F.lit("r"), (F.col("prompt") % 3).cast("string")))
    run, long = F.col("run"), F.length("model") % 2 == 0
    config = F.struct(F.when(run == "r0", "sampled_response").otherwise("modal_response").alias("dataset"), (long & (run == "r1")).alias("reasoning"), F.concat(F.lit("2026-01-0"), (F.lit(3) - F.right("run", F.lit(1)).cast("int")).cast("string")).alias("timestamp"))
    e.select("model", "run").distinct().select("model", "run", F.to_json(config).alias("value")).write.partitionBy("model", "run").text(configs)
    expected = F.when(F.col("event_id") % 2 == 0, "Yes; \nindeed ").otherwise("no")
    answer = F.when(F.col("is_correct"), F.concat(F.lit("  "), F.upper(expected), F.lit("\n"))).when(~F.col("is_correct"), "other")
    rows = e.select("event_id", "model", "run", expected.alias("expected_text"), answer.alias("model_answer"), F.col("prompt").alias("system_prompt_id"), "cross_entropy", "kl_divergence", F.when(F.col("event_id") % 5 != 0, F.col("subpopulation")).alias("subpopulation"), "split")
    for some, gone in ((run != "r2", ()), (run == "r2", ("subpopulation", "split"))):
        part = rows.where(some).drop(*gone)
        by_run(part, F.col("event_id")).drop("event_id").write.mode("append").partitionBy("model", "run").csv(results, header=True, quoteAll=True, escape='"', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return configs, results


@query("A28_W01_run_metrics", ", c AS (SELECT *, length(model)%2=0 AS l FROM ev WHERE prompt%3=CASE WHEN length(model)%2=0 THEN 2 ELSE 1 END), k AS (SELECT model, CASE WHEN l THEN 'overall' WHEN event_id%5<>0 THEN subpopulation END AS subpopulation, CASE WHEN l THEN 'validation' ELSE split END AS split, CAST(prompt AS VARCHAR) AS system_prompt_id, is_correct, cross_entropy, kl_divergence FROM c) SELECT model, model AS base_model, 'base' AS method, subpopulation, split, system_prompt_id, count(*) AS n, round(100.0*count(*) FILTER (is_correct)/count(*),6) AS accuracy, round(avg(cross_entropy),6) AS cross_entropy, round(avg(kl_divergence),6) AS kl_divergence FROM k GROUP BY ALL")
def _(s, d):
    configs, results = differing_runs(s, d)
    runs = files.read_runs(s, configs, "part-*").select("model", "run", "dataset", "reasoning", "timestamp")
    return rounded(SC.run_metrics(runs, files.read_run_results(s, results, "part-*")))


@query("X08_training_rows", f", a AS ({_A01}), g AS (SELECT subpopulation, column_name, string_agg(CAST(p AS DECIMAL(9,6)), ',' ORDER BY pos) AS expected_distribution, arg_min(pos, (-n, pos)) m, count(*) AS k FROM a GROUP BY ALL) SELECT subpopulation, column_name, 'p'||b.item_id AS system_prompt_id, b.text AS system_prompt, 'Which holds for '||column_name||'?'||chr(10)||chr(10)||'Options:'||chr(10)||array_to_string(list_transform(range(k), lambda i: 'Opt '||(i+1)), chr(10)) AS user_prompt, 'Opt '||(m+1) AS expected_text, expected_distribution FROM g, benchmark b")
def _(s, d):
    """The rows of the modal config, each with its prompts: every question of a subpopulation under every system prompt."""
    dist = ST.empirical_distribution(ST.with_overall(R.labelled(s, d)), V.options(s))
    rows = dist.groupBy("subpopulation", "column_name").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("o"))
    options = F.transform("o", lambda x: F.concat(F.lit("Opt "), (x["pos"] + 1).cast("string")))
    p = F.transform("o", lambda x: x["p"])
    items = rows.select("subpopulation", "column_name", F.concat(F.lit("Which holds for "), "column_name", F.lit("?")).alias("question"), options.alias("categories"), p.alias("p"))
    made = SC.training_rows(items, V.read(s, d, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("system_prompt_id"), F.col("text").alias("system_prompt")))
    return made.select("subpopulation", "column_name", "system_prompt_id", "system_prompt", "user_prompt", "expected_text", F.array_join(F.transform("expected_distribution", lambda x: F.format_string("%.6f", x)), ",").alias("expected_distribution"))


@query("S07_split_scan", "SELECT id, split FROM (SELECT event_id id, split, row_number() OVER (PARTITION BY split ORDER BY event_id) k FROM ev WHERE model=(SELECT min(model) FROM ev) AND subpopulation='s2') WHERE k<=20")
def _(s, d):
    path, e = folder(s), V.eval_results(s, d)
    path = files.write_dataset(e.select(F.col("event_id").alias("id"), F.col("model").alias("config"), "split", "subpopulation"), path)
    return files.read_splits(s, path, e.agg(F.min("model")).first()[0], subpopulation="s2", most=20).select("id", "split")


@query("S12_fingerprint")
def _(s, d):
    path = folder(s)
    V.eval_results(s, d).select("event_id", "model").repartition(4, "event_id").sortWithinPartitions("event_id").write.csv(path)
    every = ranges.fingerprint(s, f"{path}/part-*")
    return ranges.file_digests(s, f"{path}/part-*").select(F.substring("name", 1, 10).alias("name"), "digest", F.lit(every).alias("fingerprint"))


@query("P07_attach_by_place", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, user_id % 7 AS code, 'u'||user_id||';\"'||chr(10)||'t' AS label FROM events", False)
def _(s, d):
    """Codes and quoted labels in two tables of several files each, cut at different rows; nothing but their order joins them."""
    codes, labels, e = folder(s), folder(s), V.read(s, d, "events").orderBy("event_id")
    e.select("event_id", (F.col("user_id") % 7).alias("code")).write.csv(codes, sep=";", header=True)
    label = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(';"\nt')).alias("label shown")
    ordered = e.repartitionByRange(3, F.pow(F.col("event_id").cast("double"), 3)).sortWithinPartitions("event_id")
    ordered.select(label).write.csv(labels, sep=";", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False)
    left = s.read.csv(codes, sep=";", header=True, schema="event_id long, code long")
    return ranges.placed(left).join(files.read_labels(s, labels, place=True), "place", "left")


@query("P06_P07_value_survey", "SELECT respondent_id AS id, Q3, Q6, c_mktsegment AS social_class, CAST(c_nationkey AS VARCHAR) AS religion FROM wide")
def _(s, d):
    w = V.survey_wide(s, d).withColumn("id", F.col("o_orderkey"))
    codes, labels = w.select("id", "Q3", "Q4", "Q6"), w.select("id", F.col("c_mktsegment").alias("Q287"), F.col("c_nationkey").cast("string").alias("Q289"))
    asked = V.batteries(s).where("column_name in ('Q3', 'Q6')").select(F.lit("value survey").alias("question_type"), F.array("column_name").alias("column_names"))
    return CL.value_survey(codes, labels, asked, "id")


@query("T14_duration", "SELECT event_id, CASE WHEN n>=3600 THEN printf('%dh %02dm %02ds', n//3600, n%3600//60, n%60) WHEN n>=60 THEN printf('%dm %02ds', n//60, n%60) ELSE printf('%ds', n) END AS elapsed FROM (SELECT event_id, CAST(floor(value*event_id%9000) AS BIGINT) n FROM events)", False)
def _(s, d):
    return V.read(s, d, "events").select("event_id", TX.duration(F.floor(F.col("value") * F.col("event_id") % 9000)).alias("elapsed"))
