"""Readers and writers of the survey's files, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.scoring import first_per_split
from tessella.sources.ranges import quoted_records, read_by_name, read_quoted
from tessella.sources.versions import current, publish

MAPPING = "id long, question string, sub_questions array<string>, column_names array<string>, word_response_types array<string>, numeric_response_types array<string>, survey_section string, question_type string, question_format string"
RUN = "target string, dataset string, split string, splits array<string>, subpopulation string, reasoning boolean, aborted boolean, run_name string, timestamp string, elapsed_seconds double"


def read_coded(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numeric codes, one column each, fields parted by semicolons."""
    return spark.read.csv(path, sep=";", header=True, schema=", ".join(f"`{c}` double" for c in columns))


def read_labels(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Label text with quoted separators and line breaks, read in parallel; see ranges.read_quoted."""
    return read_quoted(spark, path, ";", place)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=MAPPING, multiLine=True)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, text): each map of the file, one row per entry."""
    kinds = ("system_prompts", "system_prompts_first_token", "question_templates")
    df = spark.read.json(path, schema=", ".join(f"{k} map<string,string>" for k in kinds), multiLine=True)
    rows = None
    for k in kinds:
        part = df.select(F.lit(k).alias("kind"), F.explode(k).alias("name", "text"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _from_path(at: Column) -> dict[str, Column]:
    """model and run from the two folders above a file; a folder called key=value gives its value."""
    return {"model": F.regexp_extract(at, r"(?:[^/=]+=)?([^/]+)/[^/]+/[^/]+$", 1), "run": F.regexp_extract(at, r"[^/]+/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)}


def read_runs(spark: SparkSession, root: str, name: str = "config.json") -> DataFrame:
    """Every <model>/<run>/<name> under root, with model and run from the path."""
    rows = spark.read.json(f"{root}/*/*/{name}", schema=RUN, multiLine=True)
    return rows.select("*", *[c.alias(k) for k, c in _from_path(F.col("_metadata.file_path")).items()])


def read_results(spark: SparkSession, root: str, schema: str, name: str = "per_question_results.csv") -> DataFrame:
    """Every run's results below a header, columns by place as schema says, with model and run from the path; see ranges.quoted_records."""
    records = quoted_records(spark, f"{root}/*/*/{name}", origin=_from_path(F.col("file"))).where("record > 0")
    parsed = records.select(F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("x"), "model", "run")
    return parsed.select("x.*", "model", "run")


#: What stands for a column that a run's results lack.
ABSENT = {"subpopulation": "overall", "split": "validation"}
METRIC_COLUMNS = ("subpopulation", "split", "system_prompt_id", "expected_text", "model_answer", "cross_entropy", "kl_divergence")


def read_run_results(spark: SparkSession, root: str, name: str = "per_question_results.csv", columns: tuple[str, ...] = METRIC_COLUMNS) -> DataFrame:
    """model, run and the columns, as text, of every run's results, whichever of them a run has; absent ones as ABSENT says."""
    rows = read_by_name(spark, f"{root}/*/*/{name}", columns, absent=ABSENT, origin=_from_path(F.col("file")))
    return rows.select("model", "run", *columns)


def read_splits(spark: SparkSession, path: str, config: str, splits: tuple[str, ...] = ("train", "validation"), subpopulation: str | None = None, most: int | None = None, order: str = "id") -> DataFrame:
    """Rows of a dataset's splits with their `split`; of one population and the first `most` per split only, where asked."""
    rows = spark.read.parquet(path).where((F.col("config") == config) & F.col("split").isin(*splits))
    rows = rows if subpopulation is None else rows.where(F.col("subpopulation") == subpopulation)
    return rows if most is None else first_per_split(rows, order, most)


def write_dataset(rows: DataFrame, root: str, key: str = "dataset") -> str:
    """Publish rows as Parquet by config, split and subpopulation and return where they are.

    A new version replaces the one before at once; stale partitions go with old versions.
    """
    return publish(rows, root, key, ("config", "split", "subpopulation"))


def dataset_path(spark: SparkSession, root: str) -> str:
    """Where the current version of a published dataset is."""
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no dataset is published in {root}")
    return found[1]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes per config, split and subpopulation, with totals (null keys)."""
    rows = spark.read.parquet(path).select("config", "split", "subpopulation", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = rows.groupBy("config", "split", "subpopulation", "file").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("bytes"))
    return files.rollup("config", "split", "subpopulation").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and maps as JSON text, blanks at the ends of texts kept."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_distributions(dist: DataFrame, sizes: DataFrame, labels: DataFrame, path: str) -> None:
    """One JSON object per cluster: size, weight, and column -> numeric codes, word labels and distribution, in order.

    dist: (subpopulation, column_name, pos, code, p); sizes: (subpopulation, size) with a row for
    'overall', which sets the weights and is not exported itself; labels: (column_name, code, label).
    """
    named = dist.where("subpopulation <> 'overall'").join(labels, ["column_name", "code"], "left")
    items = named.groupBy("subpopulation", "column_name").agg(F.sort_array(F.collect_list(F.struct("pos", "code", "label", "p"))).alias("o"))
    part = lambda c, to: F.transform("o", lambda x: x[c]).alias(to)
    entry = F.struct("column_name", F.struct(part("code", "numeric_codes"), part("label", "word_labels"), part("p", "distribution")))
    every = items.groupBy("subpopulation").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("items"))
    total = sizes.where("subpopulation = 'overall'").select(F.col("size").alias("total"))
    shares = sizes.where("subpopulation <> 'overall'").crossJoin(total).select("subpopulation", "size", (F.col("size") / F.col("total")).alias("weight"))
    shares.join(every, "subpopulation").write.mode("overwrite").json(path)
