"""Cleaning and reshaping of coded survey responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.ranges import attach_by_place

MISSING = -5.0
#: Codes that fold to "missing".
SENTINELS = (-2.0, -3.0, -99.0)
#: Bounds of the age bands, each closed at its upper end, and their names.
AGE_BANDS = (17, 24, 34, 44, 54, 64, 100)
AGE_NAMES = ("18-24", "25-34", "35-44", "45-54", "55-64", "65+")
#: The label columns that describe a respondent, and their new names.
RESPONDENT_COLUMNS = {
    "N_REGION_WVS": "region",
    "G_TOWNSIZE": "townsize",
    "H_SETTLEMENT": "settlement",
    "H_URBRURAL": "settlement_type",
    "Q260": "sex",
    "Q261": "birth_year",
    "Q262": "age",
    "Q263": "immigrant",
    "Q264": "mother_immigrant",
    "Q265": "father_immigrant",
    "Q266": "birth_country",
    "Q267": "mother_birth_country",
    "Q268": "father_birth_country",
    "Q269": "citizen",
    "Q270": "household_size",
    "Q271": "live_with_parents",
    "Q272": "home_language",
    "Q273": "marital_status",
    "Q274": "children",
    "Q275": "education_respondent",
    "Q276": "education_spouse",
    "Q277": "education_mother",
    "Q278": "education_father",
    "Q275A": "education_respondent_cs",
    "Q276A": "education_spouse_cs",
    "Q277A": "education_mother_cs",
    "Q278A": "education_father_cs",
    "Q279": "employment_respondent",
    "Q280": "employment_spouse",
    "Q281": "occupation_respondent",
    "Q282": "occupation_spouse",
    "Q283": "occupation_father",
    "Q284": "employment_sector",
    "Q285": "chief_wage_earner",
    "Q286": "savings",
    "Q287": "social_class",
    "Q288": "income_scale",
    "Q289": "religion",
}


#: Categories that are no answers.
JUNK = "missing|no answer|don't know|don´t know|not applicable|other missing|unknown|none of these"
#: Words and columns of sensitive questions.
SENSITIVE_WORDS = ("homosexual", "immig", "abortion", "prostitution", "divorce", "sex before marriage", "casual sex", "wife", "husband", "women", "gender")
SENSITIVE_COLUMNS = ("Q189", "Q190", "Q22", "Q36", "Q119", "Q263", "Q264", "Q265")
#: Short forms of long category labels, per column.
SHORT_LABELS = {
    "education_respondent_cs": {
        "NZ: Completed university or polytechnic degree": "University degree",
        "NZ: Some university, wananga, polytechnic or other tertiary": "Some tertiary",
        "NZ: Secondary school for 4 years or more": "Sec. school 4+ yrs",
        "NZ: Secondary school for up to 3 years": "Sec. school ≤3 yrs",
        "NZ: Kura kaupapa/primary school (including intermediate)": "Primary school",
        "NZ: No formal schooling": "No schooling",
    },
    "social_class": {"Upper middle class": "Upper middle", "Lower middle class": "Lower middle"},
    "income_scale": {"1": "≤$10K", "2": "$10-15K", "3": "$15-20K", "4": "$20-25K", "5": "$25-30K", "6": "$30-40K", "7": "$40-50K", "8": "$50-70K", "9": "$70-100K", "10": "$100K+"},
    "religion": {
        "Do not belong to a denomination{No religion}": "No religion",
        "Other Christian (Jehova withness...){Other Christian}": "Other Christian",
        "Catholic (Roman/Greek/etc)": "Catholic",
    },
}


def strip_prefix(code: Column, prefix: float = 554000, guard: float = 10) -> Column:
    """Codes above guard lose the country prefix; others stay."""
    return F.when(code > guard, code - prefix).otherwise(code)


def interview_id(code: Column, offset: int = 554070000) -> Column:
    return (code - offset).cast("long").cast("string")


def lenient_date(text: Column) -> Column:
    """Date from yyyyMMdd; anything else is null."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).cast("date")


def recode_sentinels(code: Column) -> Column:
    """-2, -3 and -99 become the missing code; -1 (don't know) is an answer of its own."""
    return F.when(code.isin(*SENTINELS), F.lit(MISSING)).otherwise(code)


def mask_missing(code: Column) -> Column:
    return F.nullif(code, F.lit(MISSING))


def recode_audit(responses: DataFrame) -> DataFrame:
    """Cells per sentinel before and after the recode, in one pass."""
    after = recode_sentinels(F.col("code"))
    both = responses.select(F.explode(F.array(F.struct(F.lit("before").alias("stage"), F.col("code").alias("code")), F.struct(F.lit("after").alias("stage"), after.alias("code")))).alias("c")).select("c.*")
    return both.where(F.col("code").isin(*SENTINELS, MISSING)).groupBy("stage", "code").agg(F.count(F.lit(1)).alias("cells"))


def category_codes(responses: DataFrame) -> DataFrame:
    """(column_name, code, idx): codes of each column numbered from 0 in order; missing ones get none."""
    codes = responses.where("code is not null").select("column_name", "code").distinct()
    return codes.withColumn("idx", (F.row_number().over(Window.partitionBy("column_name").orderBy("code")) - 1).cast("int"))


def contiguous(responses: DataFrame) -> DataFrame:
    return responses.join(category_codes(responses), ["column_name", "code"], "left")


def to_long(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return wide.select(F.col(key).alias("respondent_id"), *columns).unpivot("respondent_id", columns, "column_name", "code")


def one_hot(responses: DataFrame) -> DataFrame:
    """Sparse indicators, with 'Missing' as a level of its own."""
    return responses.select("respondent_id", "column_name", F.coalesce(F.col("code").cast("string"), F.lit("Missing")).alias("level"), F.lit(1).alias("one"))


def expand_items(mapping: DataFrame) -> DataFrame:
    """One row per column of each mapping entry; the sub-question only where one is not empty and both lists have one length."""
    fits = (F.size("sub_questions") == F.size("column_names")) & F.exists("sub_questions", lambda x: x != "")
    return mapping.select("id", "question", F.posexplode("column_names").alias("pos", "column_name"), F.when(fits, F.col("sub_questions")).alias("subs")).select("id", "question", "pos", "column_name", F.get("subs", F.col("pos")).alias("sub_question"))


def value_questions(mapping: DataFrame) -> DataFrame:
    return mapping.where("question_type = 'value survey'")


def asked_questions(mapping: DataFrame) -> DataFrame:
    """All but respondent information; a missing type passes."""
    return mapping.where(~F.col("question_type").eqNullSafe("respondent information"))


def column_kind(name: Column) -> Column:
    """'value' for question columns, null for id and date, else 'demographic'."""
    return F.when(F.startswith(name, F.lit("Q")), "value").when(~name.isin("id", "date"), "demographic")


def is_junk(category: Column) -> Column:
    """Whether a category is no answer; null is none of these phrases."""
    return F.coalesce(F.lower(category).rlike(JUNK), F.lit(False))


def short_label(column: Column, category: Column) -> Column:
    """Short form of a category's label; incomes by the step in braces; others stay."""
    step = F.when(F.instr(category, "{") > 0, F.regexp_replace(F.get(F.split(category, r"\{"), F.lit(1)), r"\}+$", "")).otherwise(category)
    out = None
    for name, short in SHORT_LABELS.items():
        known = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])[step if name == "income_scale" else category]
        out = F.when(column == name, known) if out is None else out.when(column == name, known)
    return F.coalesce(out, category)


def is_sensitive(question: Column, sub_question: Column, column: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(sub_question, F.lit(""))))
    return both.rlike("|".join(SENSITIVE_WORDS)) | column.isin(*SENSITIVE_COLUMNS)


def code_labels(items: DataFrame) -> DataFrame:
    """(column_name, code, label) from (column_name, codes, labels); codes below 0 are left out."""
    rows = items.select("column_name", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("labels").alias("label"))))
    return rows.where("code >= 0")


def age_band(age: Column) -> Column:
    """Band label; outside all bands null."""
    out = F.lit(None).cast("string")
    for lo, hi, name in list(zip(AGE_BANDS, AGE_BANDS[1:], AGE_NAMES))[::-1]:
        out = F.when((age > lo) & (age <= hi), F.lit(name)).otherwise(out)
    return out


def value_survey(codes: DataFrame, labels: DataFrame, mapping: DataFrame, key: str | None = None, names: dict[str, str] = RESPONDENT_COLUMNS, metadata: tuple[str, ...] = ("id", "date")) -> DataFrame:
    """The metadata, the columns of value questions as codes, and the respondent's columns as labels under their new names.

    mapping: (question_type, column_names); its few columns of value questions are read by the
    driver. Labels are attached by the key both tables have; where there is none, by the place of the
    row in file order, for which both tables must be read from files or hold a column `place`.
    Columns that a table lacks are left out.
    """
    asked = [r[0] for r in value_questions(mapping).select(F.explode("column_names")).distinct().collect()]
    chosen = [c for c in codes.columns if c in metadata or c in asked]
    shown = [F.col(c).alias(n) for c, n in names.items() if c in labels.columns]
    if key is not None:
        right = labels.select(F.col(key).alias("_key"), *shown)
        return codes.select(F.col(key).alias("_left"), *chosen).join(right, F.col("_left") == F.col("_key"), "left").drop("_left", "_key")
    at = lambda t: [c for c in ("place",) if c in t.columns]
    return attach_by_place(codes.select(*chosen, *at(codes)), labels.select(*shown, *at(labels)))


def missing_fraction(responses: DataFrame) -> DataFrame:
    """Mean over columns of each column's share of missing cells."""
    return responses.groupBy("column_name").agg(F.avg(F.col("code").isNull().cast("double")).alias("m")).agg(F.round(F.avg("m"), 6).alias("missing_fraction"))
