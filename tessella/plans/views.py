"""The survey and evaluation tables that the registered queries read, derived from the base tables.

Each view is made by Spark from whole tables; the SQL counterparts in ORACLE_VIEWS define the same
rows. A respondent is an order; a run's results are events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Battery of each question.
BATTERIES = {"Q1": 1, "Q2": 1, "Q3": 2, "Q4": 2, "Q5": 3, "Q6": 3, "Q7": 4, "Q8": 4}
#: Number of listed options (codes 1..n) of each question; -1 is listed for Q1 only.
OPTIONS = {"Q1": 3, "Q2": 5, "Q3": 4, "Q4": 7, "Q5": 12, "Q6": 4, "Q7": 8, "Q8": 5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _codes() -> dict[str, Column]:
    status, segment = F.col("o_orderstatus"), F.col("c_mktsegment")
    place = lambda c, xs: F.array_position(F.array(*[F.lit(x) for x in xs]), c)
    return {
        "Q1": F.when(F.col("o_orderkey") % 89 == 0, F.lit(-1)).otherwise(place(status, "FOP")),
        "Q2": F.when(F.col("o_orderkey") % 97 == 0, F.lit(-2)).otherwise(F.substring("o_orderpriority", 1, 1).cast("int")),
        "Q3": F.quarter("o_orderdate"),
        "Q4": F.year("o_orderdate") - 1994,
        "Q5": F.month("o_orderdate"),
        "Q6": F.least(F.floor(F.col("o_totalprice") / 125000), F.lit(3)) + 1,
        "Q7": F.least(F.floor(F.col("o_totalprice") / 62500), F.lit(7)) + 1,
        "Q8": place(segment, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    }


def met(left: DataFrame, left_key: str, right: DataFrame, right_key: str, most: int = 250_000, widest: int = 200, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by their keys among so many tasks that one joins about `most` rows, whatever the table's size and the session's settings.

    The number of tasks is fixed here, no fewer than a shuffle of the session has, since Spark merges the partitions of its
    own joins into a few large ones. Above `widest` tasks each joins up to four times as many rows first: to write a wider
    shuffle a task sorts all that it has read in memory. rows: how many rows the larger table has, where that is known.
    """
    rows = max(left.count(), right.count()) if rows is None else rows
    if rows <= most:
        return left, right
    fewest = max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = max(fewest, min(-(-rows // most), widest), -(-rows // (4 * most)))
    return left.repartition(width, left_key), right.repartition(width, right_key)


def survey_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = met(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer"), "c_custkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey", "c_mktsegment", "c_acctbal", *[c.cast("double").alias(q) for q, c in _codes().items()])


def labelled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Responses with columns of the respondents' assignments.

    A respondent's row meets its assignment once, before its answers become rows, so the join moves
    one row for each respondent and not one for each answer, dealt among tasks of bounded size.
    """
    from tessella.operators.cleaning import mask_missing, recode_sentinels

    given = assignments(spark, sf_dir).select(F.col("respondent_id").alias("_who"), *columns)
    answers, given = met(survey_wide(spark, sf_dir).select("o_orderkey", *BATTERIES), "o_orderkey", given, "_who", rows=given.count())
    wide = answers.join(given, F.col("o_orderkey") == F.col("_who"))
    rows = wide.select(F.col("o_orderkey").alias("respondent_id"), *columns, *BATTERIES).unpivot(["respondent_id", *columns], list(BATTERIES), "column_name", "code")
    return rows.select("respondent_id", "column_name", mask_missing(recode_sentinels(F.col("code"))).alias("code"), *columns)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.cleaning import to_long

    return to_long(survey_wide(spark, sf_dir), "o_orderkey", list(BATTERIES))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoded and masked: missing answers are null."""
    from tessella.operators.cleaning import mask_missing, recode_sentinels

    return raw_responses(spark, sf_dir).withColumn("code", mask_missing(recode_sentinels(F.col("code"))))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("o_orderkey") % 100) / 100.0
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("respondent_id"), (F.col("o_custkey") % 2).cast("int").alias("cluster"), (F.col("o_custkey") % 3).cast("int").alias("cluster3"), F.array(p, 1 - p).alias("probs"))


def batteries(spark: SparkSession) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in BATTERIES.items() for x in kv])
    return spark.range(1).select(F.explode(m).alias("column_name", "battery"))


def options(spark: SparkSession) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    rows = spark.range(1).select(F.explode(m).alias("column_name", "n"))
    codes = F.when(F.col("column_name") == "Q1", F.concat(F.array(F.lit(-1)), F.sequence(F.lit(1), F.col("n")))).otherwise(F.sequence(F.lit(1), F.col("n")))
    return rows.select("column_name", F.posexplode(codes).alias("pos", "code")).withColumn("code", F.col("code").cast("double"))


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id",
        F.col("event_type").alias("model"),
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("subpopulation"),
        F.when(i % 5 == 0, "validation").otherwise("train").alias("split"),
        (F.col("user_id") % 6).cast("int").alias("prompt"),
        F.when(i % 11 != 0, F.col("value") > 50).alias("is_correct"),
        (F.col("value") / 47).alias("cross_entropy"),
        (F.col("value") / 97).alias("kl_divergence"),
        (F.floor(i / 13) % 3 == 0).alias("failed"),
        F.array((i % 10 + 1) / 20.0, 1 - (i % 10 + 1) / 20.0).alias("true_distribution"),
        F.array((i % 7) / 7.0, 1 - (i % 7) / 7.0).alias("model_distribution"),
        "ts",
    )


ORACLE_VIEWS = """WITH RECURSIVE wide AS (SELECT o_orderkey AS respondent_id, o_custkey, o_orderdate, c_nationkey, c_mktsegment, c_acctbal,
 CAST(CASE WHEN o_orderkey % 89 = 0 THEN -1 ELSE list_position(['F','O','P'], o_orderstatus) END AS DOUBLE) Q1,
 CAST(CASE WHEN o_orderkey % 97 = 0 THEN -2 ELSE CAST(substr(o_orderpriority,1,1) AS INT) END AS DOUBLE) Q2,
 CAST(quarter(o_orderdate) AS DOUBLE) Q3, CAST(year(o_orderdate)-1994 AS DOUBLE) Q4, CAST(month(o_orderdate) AS DOUBLE) Q5,
 CAST(least(floor(o_totalprice/125000),3)+1 AS DOUBLE) Q6, CAST(least(floor(o_totalprice/62500),7)+1 AS DOUBLE) Q7,
 CAST(list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) AS DOUBLE) Q8
 FROM orders JOIN customer ON o_custkey = c_custkey),
raw AS (SELECT respondent_id, unnest(['Q1','Q2','Q3','Q4','Q5','Q6','Q7','Q8']) column_name, unnest([Q1,Q2,Q3,Q4,Q5,Q6,Q7,Q8]) code FROM wide),
resp AS (SELECT respondent_id, column_name, CASE WHEN code IN (-2,-3,-99,-5) THEN NULL ELSE code END code FROM raw),
asg AS (SELECT o_orderkey respondent_id, CAST(o_custkey % 2 AS INT) cluster, CAST(o_custkey % 3 AS INT) cluster3, (o_orderkey % 100)/100.0::DOUBLE p0 FROM orders),
post AS (SELECT respondent_id, 0 cluster, p0 w FROM asg UNION ALL SELECT respondent_id, 1, 1-p0 FROM asg),
bat AS (SELECT unnest(['Q1','Q2','Q3','Q4','Q5','Q6','Q7','Q8']) column_name, unnest([1,1,2,2,3,3,4,4]) battery),
opt0 AS (SELECT unnest(['Q1','Q2','Q3','Q4','Q5','Q6','Q7','Q8']) column_name, unnest([3,5,4,7,12,4,8,5]) n),
opt AS (SELECT column_name, unnest(range(len(c))) pos, CAST(unnest(c) AS DOUBLE) code FROM (SELECT column_name, CASE WHEN column_name='Q1' THEN [-1]||range(1,n+1) ELSE range(1,n+1) END c FROM opt0)),
ev AS (SELECT event_id, event_type model, 's'||(user_id % 3) subpopulation, CASE WHEN event_id % 5 = 0 THEN 'validation' ELSE 'train' END split, CAST(user_id % 6 AS INT) prompt,
 CASE WHEN event_id % 11 <> 0 THEN value > 50 END is_correct, value/47 cross_entropy, value/97 kl_divergence, (event_id // 13) % 3 = 0 failed,
 (event_id % 10 + 1)/20.0::DOUBLE t0, (event_id % 7)/7.0::DOUBLE m0, ts FROM events),
lab AS (SELECT r.respondent_id, column_name, code, cluster FROM resp r JOIN asg USING (respondent_id)),
hard AS (SELECT l.cluster label, g.column_name, g.code, count(r.code) n FROM (SELECT DISTINCT cluster FROM asg) l CROSS JOIN (SELECT DISTINCT column_name, code FROM resp WHERE code IS NOT NULL) g LEFT JOIN lab r ON r.cluster=l.cluster AND r.column_name=g.column_name AND r.code=g.code GROUP BY ALL),
hp AS (SELECT label, column_name, code, n/sum(n) OVER (PARTITION BY label, column_name) p FROM hard),
pp AS (SELECT cluster, column_name, code, sum(w)/sum(sum(w)) OVER (PARTITION BY cluster, column_name) p FROM resp JOIN post USING (respondent_id) WHERE code IS NOT NULL GROUP BY 1,2,3),
cells AS (SELECT x.column_name a, y.column_name b, x.code ca, y.code cb, count(*) n FROM resp x JOIN bat bx ON bx.column_name=x.column_name JOIN resp y ON x.respondent_id=y.respondent_id AND x.column_name<y.column_name JOIN bat by_ ON by_.column_name=y.column_name WHERE x.code IS NOT NULL AND y.code IS NOT NULL AND bx.battery<>by_.battery GROUP BY ALL),
rw AS (SELECT a,b,ca,sum(n) nr FROM cells GROUP BY ALL), cl AS (SELECT a,b,cb,sum(n) nc FROM cells GROUP BY ALL),
dims AS (SELECT a,b,sum(nr) total,count(*) r,(SELECT count(*) FROM cl WHERE cl.a=rw.a AND cl.b=rw.b) c FROM rw GROUP BY a,b),
gap AS (SELECT a,b,total,r,c,nr*nc/total::DOUBLE e, abs(coalesce(n,0)-nr*nc/total::DOUBLE) d FROM rw JOIN cl USING (a,b) LEFT JOIN cells USING (a,b,ca,cb) JOIN dims USING (a,b)),
vs AS (SELECT a,b,CAST(max(total) AS BIGINT) n, CASE WHEN max(total)>=50 AND least(max(r),max(c))>1 THEN sqrt(sum(pow(CASE WHEN r=2 AND c=2 THEN d-least(0.5,d) ELSE d END,2)/e)/(max(total)*(least(max(r),max(c))-1))) END v FROM gap GROUP BY a,b),
sym AS (SELECT a column_name,b partner,v FROM vs WHERE v IS NOT NULL UNION ALL SELECT b,a,v FROM vs WHERE v IS NOT NULL),
met AS (SELECT model,subpopulation,split,prompt,count(*) n,CASE WHEN count(is_correct)>0 THEN 100.0*count(*) FILTER (is_correct)/count(*) END accuracy,avg(cross_entropy) cross_entropy,avg(kl_divergence) kl_divergence FROM ev GROUP BY ALL)
"""
