"""Every operator as a query over the driver's tables, with the same answer in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import analytics as A
from ..operators import clean, extract, load, standardize, typing
from ..sources import buckets, records
from ..sources.shared import folder, written
from ..streaming.ingest import ingest
from ..streaming.ingest import pull as stream_pull
from . import pull as plan
from .fixtures import APPLICANTS, RAW_ENTRIES, READ, applicants, raw_entries, survey_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TERM, LAST_TERM = "Fall 1996", "Fall 1995"
APPS = f"WITH applicants AS ({APPLICANTS})\n"
RAW = f"WITH raw_entries AS ({RAW_ENTRIES})\n"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


# Applicants: questions

ACCEPTED_AT = (
    "term = '{term}' AND status LIKE 'Accepted%' AND degree = 'PhD' AND {p} ILIKE '%computer science%' AND ({u} ILIKE '%georgetown%' OR {u} ILIKE '%stanford%'"
    " OR {u} ILIKE '%massachusetts institute of technology%' OR regexp_matches({u}, '\\bmit\\b', 'i') OR {u} ILIKE '%carnegie mellon%' OR regexp_matches({u}, '\\bcmu\\b', 'i'))"
)
RAW_MATCH = ACCEPTED_AT.format(term=TERM, p="program", u="program")
STD_MATCH = ACCEPTED_AT.format(term=TERM, p="llm_generated_program", u="llm_generated_university")
HOPKINS = "degree = 'Masters' AND program ILIKE '%computer science%' AND (program ILIKE '%hopkins%' OR program ILIKE '%jhu%')"
INTERNATIONAL = "CAST(round(100.0 * count(*) FILTER (WHERE us_or_international = 'International') / nullif(count(*) FILTER (WHERE trim(us_or_international) <> ''), 0), 2) AS DOUBLE)"
ACCEPTANCE = f"CAST(round(100.0 * count(*) FILTER (WHERE term = '{LAST_TERM}' AND status LIKE 'Accepted%') / nullif(count(*) FILTER (WHERE term = '{LAST_TERM}'), 0), 2) AS DOUBLE)"


@query(APPS + f"SELECT count(*) AS n FROM applicants WHERE term = '{TERM}'")
def q1_term_count(spark, sf_dir):
    return A.term_count(applicants(spark, sf_dir), TERM)


@query(APPS + f"SELECT {INTERNATIONAL} AS pct FROM applicants")
def q2_pct_international(spark, sf_dir):
    return A.pct_international(applicants(spark, sf_dir))


@query(APPS + "SELECT " + ", ".join(f"round(avg({c}), 2) AS avg_{c}" for c in A.SCORES) + " FROM applicants")
def q3_avg_scores(spark, sf_dir):
    return A.avg_scores(applicants(spark, sf_dir))


@query(APPS + f"SELECT round(avg(gpa), 2) AS avg_gpa FROM applicants WHERE us_or_international = 'American' AND term = '{TERM}'")
def q4_avg_gpa_filtered(spark, sf_dir):
    return A.avg_gpa(applicants(spark, sf_dir), (F.col("us_or_international") == "American") & (F.col("term") == TERM))


@query(APPS + f"SELECT {ACCEPTANCE} AS pct FROM applicants")
def q5_acceptance_pct(spark, sf_dir):
    return A.acceptance_pct(applicants(spark, sf_dir), LAST_TERM)


@query(APPS + f"SELECT round(avg(gpa), 2) AS avg_gpa FROM applicants WHERE term = '{LAST_TERM}' AND status LIKE 'Accepted%'")
def q6_avg_gpa_accepted(spark, sf_dir):
    return A.avg_gpa(applicants(spark, sf_dir), (F.col("term") == LAST_TERM) & A.accepted())


@query(APPS + f"SELECT count(*) AS n FROM applicants WHERE {HOPKINS}")
def q7_program_school_count(spark, sf_dir):
    return A.count_where(applicants(spark, sf_dir), A.at_hopkins())


@query(APPS + f"SELECT count(*) AS n FROM applicants WHERE {RAW_MATCH}")
def q8_school_match_raw(spark, sf_dir):
    return A.count_where(applicants(spark, sf_dir), A.accepted_at("program", "program", TERM))


@query(APPS + f"SELECT count(*) AS n FROM applicants WHERE {STD_MATCH}")
def q9_school_match_std(spark, sf_dir):
    return A.count_where(applicants(spark, sf_dir), A.accepted_at("llm_generated_program", "llm_generated_university", TERM))


SIGNED = "CASE WHEN {d} < 0 THEN '-' ELSE '+' END || format('{{:,}}', abs({d}))"


@query(
    APPS + f", n AS (SELECT count(*) FILTER (WHERE {RAW_MATCH}) AS original, count(*) FILTER (WHERE {STD_MATCH}) AS standardized FROM applicants) "
    f"SELECT original, standardized, standardized - original AS difference, {SIGNED.format(d='(standardized - original)')} AS difference_text FROM n"
)
def q9_field_difference(spark, sf_dir):
    return A.field_difference(applicants(spark, sf_dir), TERM)


@query(
    APPS + "SELECT CASE WHEN gpa < 1 THEN '0-0.9' WHEN gpa < 2 THEN '1-1.9' WHEN gpa < 3 THEN '2.0-2.9' WHEN gpa < 4 THEN '3.0-3.9' ELSE '4.0-4.9' END AS gpa_bucket, "
    "count(*) AS total, CAST(round(100.0 * count(*) FILTER (WHERE status LIKE 'Accepted%') / nullif(count(*), 0), 2) AS DOUBLE) AS acceptance_pct "
    "FROM applicants WHERE gpa IS NOT NULL GROUP BY 1 ORDER BY min(gpa)"
)
def aq1_gpa_buckets(spark, sf_dir):
    return A.gpa_buckets(applicants(spark, sf_dir))


COUNTS = ", counts AS (SELECT term, count(*) AS n FROM applicants WHERE term IS NOT NULL GROUP BY term)"
PLACED = COUNTS + (
    ", placed AS (SELECT term, n, row_number() OVER (ORDER BY try_cast(nullif(regexp_extract(term, '\\d{4}'), '') AS INT) ASC NULLS LAST, "
    "CASE WHEN term LIKE '%Spring%' THEN 0 WHEN term LIKE '%Summer%' THEN 1 WHEN term LIKE '%Fall%' THEN 2 WHEN term LIKE '%Winter%' THEN 3 ELSE 4 END, term) AS place FROM counts)"
)


@query(APPS + PLACED + " SELECT term, n FROM placed ORDER BY place")
def aq2_term_counts(spark, sf_dir):
    return A.term_counts(applicants(spark, sf_dir))


@query(
    APPS + PLACED + ", ends AS (SELECT count(*) AS terms, min_by(n, place) AS first, max_by(n, place) AS last FROM placed) SELECT terms, first, last, "
    "CASE WHEN terms < 2 THEN 'no data' WHEN last > first THEN 'trending up' WHEN last < first THEN 'trending down' ELSE 'no clear trend' END AS trend FROM ends"
)
def term_trend(spark, sf_dir):
    return A.trend(applicants(spark, sf_dir))


@query(APPS + COUNTS + " SELECT term, n, printf('%.2f', n / (SELECT max(n) FROM counts) * 100) AS pct_of_max FROM counts")
def term_pct_of_max(spark, sf_dir):
    return A.share_of_max(applicants(spark, sf_dir))


@query(APPS + "SELECT * EXCLUDE (p_id) FROM applicants WHERE url = 'https://example.org/result/77'")
def lookup_by_url(spark, sf_dir):
    return A.lookup(applicants(spark, sf_dir), "https://example.org/result/77")


@query(APPS + "SELECT count(*) AS n FROM applicants")
def table_count(spark, sf_dir):
    return applicants(spark, sf_dir).agg(F.count("*").alias("n"))


def _sql_report() -> str:
    text2 = lambda x: f"coalesce(printf('%.2f', {x}), 'None')"
    pct = lambda x: f"coalesce(printf('%.2f', {x}), '0.00') || '%'"
    whole = lambda x: f"format('{{:,}}', {x})"
    answers = [
        f"(SELECT {whole('count(*)')} FROM applicants WHERE term = '{TERM}')", f"(SELECT {pct(INTERNATIONAL)} FROM applicants)",
        "(SELECT " + " || ' | ' || ".join(f"'{c}: ' || " + text2(f"round(avg({c}), 2)") for c in A.SCORES) + " FROM applicants)",
        f"(SELECT {text2('round(avg(gpa), 2)')} FROM applicants WHERE us_or_international = 'American' AND term = '{TERM}')",
        f"(SELECT {pct(ACCEPTANCE)} FROM applicants)", f"(SELECT {text2('round(avg(gpa), 2)')} FROM applicants WHERE term = '{LAST_TERM}' AND status LIKE 'Accepted%')",
        f"(SELECT {whole('count(*)')} FROM applicants WHERE {HOPKINS})", f"(SELECT {whole('count(*)')} FROM applicants WHERE {RAW_MATCH})",
        f"(SELECT {whole('s')} || ' (original ' || {whole('r')} || ', difference ' || {SIGNED.format(d='(s - r)')} || ')' FROM "
        f"(SELECT count(*) FILTER (WHERE {RAW_MATCH}) AS r, count(*) FILTER (WHERE {STD_MATCH}) AS s FROM applicants))",
    ]
    return APPS + " UNION ALL ".join(f"SELECT {k} AS number, {a} AS answer" for k, a in enumerate(answers, 1))


@query(_sql_report())
def analysis_report(spark, sf_dir):
    return A.report(applicants(spark, sf_dir), TERM, LAST_TERM)


_BUCKET = "CASE WHEN gpa < 1 THEN '0-0.9' WHEN gpa < 2 THEN '1-1.9' WHEN gpa < 3 THEN '2.0-2.9' WHEN gpa < 4 THEN '3.0-3.9' ELSE '4.0-4.9' END"


@query(
    _sql_report().replace(APPS, APPS + PLACED + ", answers AS (", 1)
    + f"), g AS (SELECT {_BUCKET} AS label, count(*) AS total, min(gpa) AS low, round(100.0 * count(*) FILTER (WHERE status LIKE 'Accepted%') / count(*), 2) AS pct FROM applicants WHERE gpa IS NOT NULL GROUP BY 1), "
    "ends AS (SELECT count(*) AS terms, min_by(n, place) AS first, max_by(n, place) AS last FROM placed) "
    "SELECT 'answer' AS section, CAST(number AS INT) AS place, 'Q' || number AS label, CAST(NULL AS BIGINT) AS total, answer AS value FROM answers "
    "UNION ALL SELECT 'gpa', CAST(row_number() OVER (ORDER BY low) AS INT), label, total, printf('%.2f', pct) FROM g "
    "UNION ALL SELECT 'term', CAST(place AS INT), term, n, printf('%.2f', n / (SELECT max(n) FROM placed) * 100) FROM placed "
    "UNION ALL SELECT 'trend', 1, NULL, terms, CASE WHEN terms < 2 THEN 'no data' WHEN last > first THEN 'trending up' WHEN last < first THEN 'trending down' ELSE 'no clear trend' END FROM ends"
)
def whole_report(spark, sf_dir):
    """Answers, buckets, terms and trend from one scan of the applicants."""
    return A.whole_report(written(A.cube(applicants(spark, sf_dir)), "cube"), TERM, LAST_TERM)


@query(APPS + "SELECT p_id, coalesce(printf('%.2f', gpa), '0.00') AS shown FROM applicants")
def fmt_pct(spark, sf_dir):
    return applicants(spark, sf_dir).select("p_id", X.format_percent(F.col("gpa")).alias("shown"))


# Raw entries: cleaning


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\r\\f\\v ]+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


DEGREE = r"\s*\b(" + "|".join(X.DEGREE_TOKENS).replace("'", "''") + r")\s*$"
PROGRAM_TEXT = squeeze("raw_program_text")
META, COMMENT, ADDED = squeeze("raw_meta_text"), squeeze("raw_comment_text"), squeeze("raw_added_on_text")
NAME = f"trim(regexp_replace({PROGRAM_TEXT}, '{DEGREE}', '', 'i'))"
TOKEN = f"trim(regexp_extract({PROGRAM_TEXT}, '{DEGREE}', 1, 'i'))"
COMPOSED = f"concat_ws(', ', nullif({NAME}, ''), nullif({squeeze('raw_school_text')}, ''))"
PREFIX = X.COMMENT_PREFIX.removeprefix("(?i)")
FREE = squeeze(f"regexp_replace({COMMENT}, '{PREFIX}', '', 'i')")
ADDED_ON = f"CASE WHEN starts_with(lower({ADDED}), 'added on') THEN {ADDED} WHEN {ADDED} <> '' THEN 'Added on ' || {ADDED} ELSE '' END"
_SEASON = "\\b(Spring|Summer|Fall|Winter)\\s+(\\d{4})\\b"
_season = f"regexp_extract({META}, '{_SEASON}', 1, 'i')"
TERM_SQL = f"CASE WHEN {_season} <> '' THEN upper(left({_season}, 1)) || lower(substr({_season}, 2)) || ' ' || regexp_extract({META}, '{_SEASON}', 2, 'i') ELSE '' END"
KIND = f"CASE WHEN regexp_matches({META}, '\\bInternational\\b', 'i') THEN 'International' WHEN regexp_matches({META}, '\\bAmerican\\b', 'i') THEN 'American' ELSE '' END"


def labelled(pattern: str, label: str) -> str:
    found = f"regexp_extract({META}, '{pattern.removeprefix('(?i)')}', 1, 'i')"
    return f"CASE WHEN {found} <> '' THEN '{label} ' || {found} ELSE '' END"


@query(RAW + f"SELECT entry_id, {NAME} AS program_name, nullif({TOKEN}, '') AS degree FROM raw_entries")
def split_degree(spark, sf_dir):
    c = X.clean_text(F.col("raw_program_text"))
    return raw_entries(spark, sf_dir).select("entry_id", X.program_without_degree(c).alias("program_name"), X.none_if_empty(X.degree_token(c)).alias("degree"))


@query(RAW + f"SELECT entry_id, nullif({COMPOSED}, '') AS program FROM raw_entries")
def compose_program(spark, sf_dir):
    name = X.program_without_degree(X.clean_text(F.col("raw_program_text")))
    return raw_entries(spark, sf_dir).select("entry_id", X.none_if_empty(X.compose_program(name, X.clean_text(F.col("raw_school_text")))).alias("program"))


@query(RAW + f"SELECT entry_id, {FREE} AS comment FROM raw_entries")
def extract_comment(spark, sf_dir):
    return raw_entries(spark, sf_dir).select("entry_id", X.free_comment(X.clean_text(F.col("raw_comment_text"))).alias("comment"))


@query(RAW + f"SELECT entry_id, {ADDED_ON} AS date_added FROM raw_entries")
def date_added_text(spark, sf_dir):
    return raw_entries(spark, sf_dir).select("entry_id", X.with_added_on(X.clean_text(F.col("raw_added_on_text"))).alias("date_added"))


@query(RAW + f"SELECT entry_id, {TERM_SQL} AS term FROM raw_entries")
def parse_term(spark, sf_dir):
    return raw_entries(spark, sf_dir).select("entry_id", X.term(X.clean_text(F.col("raw_meta_text"))).alias("term"))


@query(RAW + f"SELECT entry_id, {KIND} AS kind FROM raw_entries")
def parse_student_type(spark, sf_dir):
    return raw_entries(spark, sf_dir).select("entry_id", X.student_type(X.clean_text(F.col("raw_meta_text"))).alias("kind"))


@query(RAW + f"SELECT entry_id, {labelled(X.GPA, 'GPA')} AS gpa FROM raw_entries")
def parse_gpa_text(spark, sf_dir):
    return raw_entries(spark, sf_dir).select("entry_id", X.labelled_number(X.clean_text(F.col("raw_meta_text")), X.GPA, "GPA").alias("gpa"))


@query(RAW + f"SELECT entry_id, {labelled(X.GRE, 'GRE')} AS gre, {labelled(X.GRE_V, 'GRE V')} AS gre_v, {labelled(X.GRE_AW, 'GRE AW')} AS gre_aw FROM raw_entries")
def parse_gre(spark, sf_dir):
    meta = X.clean_text(F.col("raw_meta_text"))
    return raw_entries(spark, sf_dir).select(
        "entry_id", X.labelled_number(meta, X.GRE, "GRE").alias("gre"), X.labelled_number(meta, X.GRE_V, "GRE V").alias("gre_v"), X.labelled_number(meta, X.GRE_AW, "GRE AW").alias("gre_aw")
    )


CLEANED = (
    f"SELECT nullif({COMPOSED}, '') AS program, {FREE} AS comments, nullif({ADDED_ON}, '') AS date_added, nullif({squeeze('url')}, '') AS url, "
    f"nullif({squeeze('raw_decision_text')}, '') AS status, nullif({TERM_SQL}, '') AS term, nullif({KIND}, '') AS \"US/International\", "
    f"nullif({labelled(X.GRE, 'GRE')}, '') AS \"GRE\", nullif({labelled(X.GRE_V, 'GRE V')}, '') AS \"GRE V\", nullif({labelled(X.GRE_AW, 'GRE AW')}, '') AS \"GRE AW\", "
    f"nullif({labelled(X.GPA, 'GPA')}, '') AS \"GPA\", nullif({TOKEN}, '') AS \"Degree\" FROM raw_entries"
)
CLEAN = RAW + f", cleaned AS ({CLEANED})\n"


@query(CLEAN + "SELECT * FROM cleaned")
def clean_records(spark, sf_dir):
    return clean.clean_records(raw_entries(spark, sf_dir))


def cleaned(spark, sf_dir):
    return clean.clean_records(raw_entries(spark, sf_dir))


# Standardizing


def sql_title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|\\P{{L}}+)', 1), lambda x: upper(x[1]) || lower(x[2:])), '')"


def sql_rules(c: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p.removeprefix('(?i)')}', 'i') THEN '{full}'" for p, full in rules) + f" ELSE {c} END"


def sql_map(mapping: dict[str, str], c: str, default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


PARTS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(" + squeeze("{c}") + ", '^,+|,+$', '', 'g'), ',| at | @ '), lambda x: trim(x)), lambda x: x <> '')"
PROGRAM_SQL = f"coalesce({sql_title('parts[1]')}, '')"
UNIVERSITY_SQL = f"CASE WHEN parts[2] IS NULL THEN 'Unknown' ELSE regexp_replace({sql_title('(' + sql_rules('parts[2]', X.SPLIT_ABBREVIATIONS) + ')')}, '\\bOf\\b', 'of', 'g') END"
SPLIT = CLEAN + f", split AS (SELECT *, {PARTS.format(c='program')} AS parts FROM cleaned)\n"


@query(SPLIT + f"SELECT program, CASE WHEN program IS NULL THEN '' ELSE {PROGRAM_SQL} END AS program_name, CASE WHEN program IS NULL THEN '' ELSE {UNIVERSITY_SQL} END AS university FROM split")
def standardize_distinct(spark, sf_dir):
    found = standardize.by_distinct_key(cleaned(spark, sf_dir), "program", lambda k: standardize.split_keys(k, "program"), ("program_name", "university"))
    return found.select("program", "program_name", "university")


@query(SPLIT + f"SELECT program, {PROGRAM_SQL} AS program_name, {UNIVERSITY_SQL} AS university FROM split")
def split_program(spark, sf_dir):
    return standardize.split_keys(cleaned(spark, sf_dir).select("program"), "program")


SCHOOL = "trim(raw_school_text)"


@query(RAW + f"SELECT entry_id, {sql_rules(SCHOOL, X.UNIVERSITY_ABBREVIATIONS)} AS school FROM raw_entries")
def expand_abbrev(spark, sf_dir):
    return raw_entries(spark, sf_dir).select("entry_id", X.expand(F.trim("raw_school_text"), X.UNIVERSITY_ABBREVIATIONS).alias("school"))


@query(RAW + f"SELECT entry_id, {sql_map(X.PROGRAM_FIXES, NAME, NAME)} AS program FROM raw_entries")
def apply_fixes(spark, sf_dir):
    name = X.program_without_degree(X.clean_text(F.col("raw_program_text")))
    return raw_entries(spark, sf_dir).select("entry_id", X.look_up(X.PROGRAM_FIXES, name, name).alias("program"))


@query(APPS + f"SELECT p_id, regexp_replace({sql_title('program')}, '\\bOf\\b', 'of', 'g') AS titled FROM applicants")
def title_case(spark, sf_dir):
    return applicants(spark, sf_dir).select("p_id", X.university_case(F.col("program")).alias("titled"))


@query(APPS + ", canon AS (SELECT DISTINCT llm_generated_university AS name FROM applicants WHERE llm_generated_university IS NOT NULL) "
       "SELECT p_id, c.name IS NOT NULL AS known FROM applicants a LEFT JOIN canon c ON trim(regexp_extract(a.program, ',(.*)$', 1)) = c.name")  # fmt: skip
def canon_exact(spark, sf_dir):
    a = applicants(spark, sf_dir)
    canon = a.select(F.col("llm_generated_university").alias("name")).filter("name is not null").distinct().withColumn("known", F.lit(True))
    school = a.select("p_id", F.trim(F.regexp_extract("program", ",(.*)$", 1)).alias("name"))
    return school.join(canon, "name", "left").select("p_id", F.coalesce("known", F.lit(False)).alias("known"))


#: A made-up school name for each customer, so that the dictionary grows with the tables, and one with a letter left out.
NAMES = """
SELECT upper(substring(name, 1, 1)) || substring(name, 2) AS truth, upper(substring(name, 1, 1)) || substring(name, 2, k) || substring(name, k + 3) AS name
FROM (SELECT substring(translate(md5(c_name), '0123456789', 'ghijklmnop'), 1, CAST(14 + c_custkey % 9 AS INT)) AS name, CAST(c_custkey % 12 AS INT) AS k FROM customer)
"""


def names(spark, sf_dir) -> DataFrame:
    """name, a dictionary entry with one letter left out, and truth, the entry."""
    table(spark, sf_dir, "customer").select("c_name", "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(NAMES)


def dictionary(spark, sf_dir) -> DataFrame:
    return names(spark, sf_dir).select(F.col("truth").alias("name")).distinct()


@query(f"SELECT name, min(truth) AS match FROM ({NAMES}) GROUP BY name")
def fuzzy_match(spark, sf_dir):
    return standardize.fuzzy_match(names(spark, sf_dir).select("name"), dictionary(spark, sf_dir), 0.86)


#: Names that share most of their letters, each an entry without its last letter.
COMMON_NAMES = """
SELECT 'University of ' || name AS truth, 'University of ' || substring(name, 1, length(name) - 1) AS name
FROM (SELECT substring(translate(md5(c_name), '0123456789', 'ghijklmnop'), 1, CAST(9 + c_custkey % 4 AS INT)) AS name FROM customer)
"""


@query(f"SELECT name, min(truth) AS match FROM ({COMMON_NAMES}) GROUP BY name")
def fuzzy_match_common(spark, sf_dir):
    """Names whose common parts are no reason to compare them."""
    table(spark, sf_dir, "customer").select("c_name", "c_custkey").createOrReplaceTempView("customer")
    both = written(spark.sql(COMMON_NAMES), "names")
    return standardize.fuzzy_match(both.select("name"), both.select(F.col("truth").alias("name")), 0.86, shortened=True)


@query(f"SELECT name, min(truth) AS standard FROM ({NAMES}) GROUP BY name")
def standardize_university(spark, sf_dir):
    return standardize.standardized_names(names(spark, sf_dir).select("name"), dictionary(spark, sf_dir), "university")


@query(f"WITH n AS ({NAMES}) SELECT name, min(truth) AS standard FROM (SELECT name, truth FROM n UNION ALL SELECT truth, truth FROM n) GROUP BY name")
def standardize_program(spark, sf_dir):
    known = dictionary(spark, sf_dir)
    return standardize.standardized_names(names(spark, sf_dir).select("name").unionByName(known), known, "program")


def model_replies(spark, sf_dir) -> DataFrame:
    e = raw_entries(spark, sf_dir)
    good = F.concat(F.lit('Sure!\n{"standardized_program": "'), F.trim("raw_program_text"), F.lit('", "standardized_university": "X"} ok {}'))
    bad = F.concat(F.lit("Sorry { no"), F.trim("raw_program_text"))
    return e.select("entry_id", F.when(F.col("entry_id").cast("long") % 10 == 0, bad).otherwise(good).alias("reply"), F.concat(F.trim("raw_program_text"), F.lit(" at MIT")).alias("original"))


@query(RAW + ", r AS (SELECT *, CAST(entry_id AS BIGINT) % 10 = 0 AS bad, " + PARTS.format(c="(trim(raw_program_text) || ' at MIT')") + " AS parts FROM raw_entries) "
       f"SELECT entry_id, CASE WHEN bad THEN {PROGRAM_SQL} ELSE trim(raw_program_text) END AS program_name, CASE WHEN bad THEN {UNIVERSITY_SQL} ELSE 'X' END AS university FROM r")  # fmt: skip
def parse_model_reply(spark, sf_dir):
    return standardize.parse_reply(model_replies(spark, sf_dir)).select("entry_id", "program_name", "university")


def rule_scorer() -> Callable[[str], dict[str, str]]:
    """A stand-in for a model: the longer words of the key. It fails for keys with 'Drama'."""

    def score(key: str) -> dict[str, str]:
        if "Drama" in key:
            raise ValueError("no drama")
        return {"long": " ".join(w for w in key.split() if len(w) > 3)}

    return score


@query(CLEAN + "SELECT DISTINCT program, CASE WHEN program LIKE '%Drama%' THEN NULL ELSE array_to_string(list_filter(string_split(program, ' '), lambda x: length(x) > 3), ' ') END AS long, "
       "CASE WHEN program LIKE '%Drama%' THEN 'ValueError: no drama' END AS error FROM cleaned WHERE program IS NOT NULL")  # fmt: skip
def batch_score(spark, sf_dir):
    return standardize.batch_score(cleaned(spark, sf_dir).select("program").filter("program is not null").distinct(), "program", rule_scorer, ("long",))


@query(CLEAN + "SELECT DISTINCT program, CASE WHEN program LIKE '%Drama%' THEN NULL ELSE array_to_string(list_filter(string_split(program, ' '), lambda x: length(x) > 3), ' ') END AS long, "
       "CASE WHEN program LIKE '%Drama%' THEN 'ValueError: no drama' END AS error FROM cleaned WHERE program IS NOT NULL")  # fmt: skip
def scored_keys(spark, sf_dir):
    """Two runs of a scorer that keeps what it found: the second takes over the first one's keys and scores the others."""
    keys, at = written(cleaned(spark, sf_dir).select("program"), "keys"), folder(spark)
    for part in (keys.filter("length(program) % 2 = 0"), keys):
        found = standardize.scored_keys(part, at, "program", rule_scorer, ("long",), keep="rules")
    return found


#: A rule for each customer, and a last one for what they leave; names as they are written in the orders.
RULE_TABLE = """
SELECT CAST(c_custkey AS BIGINT) AS ord, '(?i)^clerk[. ]*0*' || CAST(c_custkey AS STRING) || '$' AS pattern, c_name AS full, CAST(c_custkey AS STRING) AS fragment FROM customer
UNION ALL SELECT CAST(1000000000000 AS BIGINT), '(?i)^clerk', 'Another clerk', 'clerk'
"""
WRITTEN_NAMES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Clark ' || CAST(o_custkey AS STRING) WHEN o_orderkey % 7 = 0 THEN 'clerk of nobody'
 WHEN o_orderkey % 3 = 0 THEN 'CLERK. 00' || CAST(o_custkey AS STRING) ELSE 'Clerk ' || CAST(o_custkey AS STRING) END AS name FROM orders
"""


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Clark ' || CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 7 = 0 THEN 'Another clerk' "
       "ELSE coalesce(c_name, 'Another clerk') END AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")  # fmt: skip
def expand_rule_table(spark, sf_dir):
    for t in ("customer", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return standardize.expand_by_table(spark.sql(WRITTEN_NAMES), "name", spark.sql(RULE_TABLE))


# Typing and mapping

DATE_SQL = "CAST(try_strptime(nullif(regexp_extract(date_added, '^Added on (.+)$', 1), ''), '%b %d, %Y') AS DATE)"
STATUS_SQL, WHEN_SQL = (f"nullif(regexp_extract(status, '^(Accepted|Rejected|Interview|Wait listed) on (.+)$', {k}), '')" for k in (1, 2))
GPA_SQL = "TRY_CAST(nullif(regexp_extract(trim(\"GPA\"), '^GPA\\s+([\\d.]+)$', 1), '') AS FLOAT)"


def score_sql(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(trim(\"{c}\"), '(\\d+(?:\\.\\d+)?)\\s*$', 1), '') AS FLOAT)"


@query(CLEAN + f"SELECT date_added, {DATE_SQL} AS day FROM cleaned")
def parse_date_added(spark, sf_dir):
    return cleaned(spark, sf_dir).select("date_added", X.date_added(F.col("date_added")).alias("day"))


@query(CLEAN + f"SELECT status, {STATUS_SQL} AS kind, {WHEN_SQL} AS told, CASE WHEN {STATUS_SQL} = 'Accepted' THEN {WHEN_SQL} END AS accepted_date, "
       f"CASE WHEN {STATUS_SQL} = 'Rejected' THEN {WHEN_SQL} END AS rejected_date FROM cleaned")  # fmt: skip
def parse_status(spark, sf_dir):
    kind, told = X.status_type(F.col("status")), X.status_date(F.col("status"))
    return cleaned(spark, sf_dir).select("status", kind.alias("kind"), told.alias("told"), F.when(kind == "Accepted", told).alias("accepted_date"), F.when(kind == "Rejected", told).alias("rejected_date"))


@query(CLEAN + f"SELECT \"GPA\" AS label, CAST({GPA_SQL} AS DOUBLE) AS gpa FROM cleaned")
def parse_gpa(spark, sf_dir):
    return cleaned(spark, sf_dir).select(F.col("GPA").alias("label"), X.gpa_number(F.col("GPA")).cast("double").alias("gpa"))


@query(CLEAN + f"SELECT \"GRE\" AS label, CAST({score_sql('GRE')} AS DOUBLE) AS gre, CAST({score_sql('GRE AW')} AS DOUBLE) AS gre_aw FROM cleaned")
def parse_score(spark, sf_dir):
    return cleaned(spark, sf_dir).select(F.col("GRE").alias("label"), X.trailing_number(F.col("GRE")).cast("double").alias("gre"), X.trailing_number(F.col("`GRE AW`")).cast("double").alias("gre_aw"))


@query(APPS + "SELECT p_id, nullif(regexp_replace(us_or_international, '^\\s+|\\s+$', '', 'g'), '') AS kind FROM applicants")
def blank_to_null(spark, sf_dir):
    return applicants(spark, sf_dir).select("p_id", X.blank_to_null(F.col("us_or_international")).alias("kind"))


DEGREE_SQL = "CASE WHEN coalesce({c}, '') <> '' THEN " + sql_map(X.DEGREES, "replace(lower(trim({c})), '’', '''')", "trim({c})") + " END"


@query(CLEAN + "SELECT \"Degree\" AS degree, " + DEGREE_SQL.replace("{c}", '"Degree"') + " AS name FROM cleaned")
def normalize_degree(spark, sf_dir):
    return cleaned(spark, sf_dir).select(F.col("Degree").alias("degree"), X.degree_name(F.col("Degree")).alias("name"))


TYPED = SPLIT + (
    f", typed AS (SELECT program, nullif(comments, '') AS comments, url, term, CASE WHEN program IS NULL THEN '' ELSE {PROGRAM_SQL} END AS program_name, "
    f"CASE WHEN program IS NULL THEN '' ELSE {UNIVERSITY_SQL} END AS university, date_added AS date_added_raw, {DATE_SQL} AS date_added, status AS status_raw, {STATUS_SQL} AS status, "
    f"CASE WHEN {STATUS_SQL} = 'Accepted' THEN {WHEN_SQL} END AS accepted_date, CASE WHEN {STATUS_SQL} = 'Rejected' THEN {WHEN_SQL} END AS rejected_date, "
    f"\"US/International\" AS us_or_international, \"Degree\" AS degree, {GPA_SQL} AS gpa, {score_sql('GRE')} AS gre, {score_sql('GRE V')} AS gre_v, {score_sql('GRE AW')} AS gre_aw FROM split)\n"
)


def typed(spark, sf_dir) -> DataFrame:
    found = standardize.by_distinct_key(cleaned(spark, sf_dir), "program", lambda k: standardize.split_keys(k, "program"), ("program_name", "university"))
    return typing.type_records(found)


@query(TYPED + "SELECT * FROM typed")
def type_records(spark, sf_dir):
    return typed(spark, sf_dir)


@query(SPLIT + f"SELECT nullif(trim(program), '') AS program, nullif(trim(comments), '') AS comments, {DATE_SQL} AS date_added, url, status, term, \"US/International\" AS us_or_international, "
       f"{GPA_SQL} AS gpa, {score_sql('GRE')} AS gre, {score_sql('GRE V')} AS gre_v, {score_sql('GRE AW')} AS gre_aw, \"Degree\" AS degree, "
       f"nullif(CASE WHEN program IS NULL THEN '' ELSE {PROGRAM_SQL} END, '') AS llm_generated_program, nullif(CASE WHEN program IS NULL THEN '' ELSE {UNIVERSITY_SQL} END, '') AS llm_generated_university FROM split")  # fmt: skip
def to_applicants_bulk(spark, sf_dir):
    names = ("llm-generated-program", "llm-generated-university")
    keys = cleaned(spark, sf_dir)
    split = standardize.split_keys(keys.select("program").filter("program is not null").distinct(), "program").withColumnsRenamed({"program_name": names[0], "university": names[1]})
    found = keys.join(split, "program", "left")
    return typing.to_applicants_bulk(found)


@query(TYPED + f"SELECT trim(program) AS program, nullif(comments, '') AS comments, date_added, trim(url) AS url, status, term, us_or_international, gpa, gre, gre_v, gre_aw, "
       f"{DEGREE_SQL.replace('{c}', 'degree')} AS degree, nullif(program_name, '') AS llm_generated_program, nullif(university, '') AS llm_generated_university "
       "FROM typed WHERE coalesce(trim(url), '') <> '' AND coalesce(trim(program), '') <> ''")  # fmt: skip
def to_applicants_incremental(spark, sf_dir):
    rows = typed(spark, sf_dir).withColumns({"date_added": F.col("date_added").cast("string"), "llm_generated_program": F.col("program_name"), "llm_generated_university": F.col("university")})
    return typing.to_applicants_incremental(rows)


# Loading

INCOMING = APPS + (
    ", existing AS (SELECT * FROM applicants WHERE p_id % 2 = 0), incoming AS (SELECT * REPLACE ('Interview on 9 Jan' AS status), p_id AS pos FROM applicants WHERE p_id % 3 = 0 "
    "UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS status), p_id + 1000000000 AS pos FROM applicants WHERE p_id % 30 = 0)\n"
)


def batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = applicants(spark, sf_dir)
    one = a.filter("p_id % 3 = 0").withColumn("status", F.lit("Interview on 9 Jan")).withColumn("pos", F.col("p_id"))
    two = a.filter("p_id % 30 = 0").withColumn("status", F.lit(None).cast("string")).withColumn("pos", F.col("p_id") + 1_000_000_000)
    return a.filter("p_id % 2 = 0"), one.unionByName(two)


FIRST = "SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1"
LAST = "SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos DESC) = 1"


@query(INCOMING + "SELECT url, trim(coalesce(url, '')) <> '' AND trim(coalesce(program, '')) <> '' AND p_id % 7 <> 0 AS usable FROM applicants")
def required_fields(spark, sf_dir):
    a = applicants(spark, sf_dir)
    blanked = a.withColumn("shown", F.when(F.col("p_id") % 7 == 0, "  ").otherwise(F.col("program")))
    return blanked.select("url", typing.has_required(("url", "shown")).alias("usable"))


@query(INCOMING + f"SELECT * FROM existing UNION ALL SELECT * EXCLUDE (pos) FROM ({FIRST}) f WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.url = f.url)")
def load_insert_ignore(spark, sf_dir):
    return load.insert_ignore(*batches(spark, sf_dir))


_others = [c for c in ("program", "comments", "date_added", "status", "term", "us_or_international", "gpa", "gre", "gre_v", "gre_aw", "degree", "llm_generated_program", "llm_generated_university")]


@query(INCOMING + f", l AS ({LAST}) SELECT e.p_id, coalesce(l.url, e.url) AS url, " + ", ".join(f"CASE WHEN l.url IS NOT NULL THEN l.{c} ELSE e.{c} END AS {c}" for c in _others)
       + " FROM existing e FULL JOIN l ON e.url = l.url")
def load_upsert(spark, sf_dir):
    return load.upsert(*batches(spark, sf_dir))


@query(INCOMING + "SELECT count(*) FILTER (WHERE url IS NULL) AS null_url, count(*) FILTER (WHERE program IS NULL) AS null_program, count(url) - count(DISTINCT url) AS duplicates FROM incoming")
def batch_constraints(spark, sf_dir):
    return load.check_constraints(batches(spark, sf_dir)[1])


@query(INCOMING + f", f AS (SELECT url, pos FROM ({FIRST}) f WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.url = f.url)) "
       "SELECT url, (SELECT max(p_id) FROM existing) + row_number() OVER (ORDER BY pos) AS p_id FROM f")  # fmt: skip
def surrogate_key(spark, sf_dir):
    existing, incoming = batches(spark, sf_dir)
    return load.with_surrogate(existing, load.new_rows(existing, incoming).drop("p_id"), "pos").select("url", "p_id")


@query(INCOMING + ", n AS (SELECT (SELECT count(*) FROM incoming) AS raw, (SELECT count(*) FROM incoming WHERE p_id % 7 <> 0) AS usable, "
       "(SELECT count(DISTINCT url) FROM incoming i WHERE p_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.url = i.url)) AS inserted) SELECT *, usable - inserted AS duplicates FROM n")  # fmt: skip
def load_summary(spark, sf_dir):
    existing, incoming = batches(spark, sf_dir)
    return load.counted_new_rows(existing, incoming, F.expr("p_id % 7 <> 0"))[1].drop("skipped")


@query(INCOMING + ", n AS (SELECT (SELECT count(*) FROM incoming) AS raw, (SELECT count(*) FROM incoming WHERE p_id % 7 <> 0) AS usable, "
       "(SELECT count(DISTINCT url) FROM incoming i WHERE p_id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.url = i.url)) AS inserted) "
       "SELECT '{\"raw\":' || raw || ',\"usable\":' || usable || ',\"inserted\":' || inserted || ',\"duplicates\":' || (usable - inserted) || '}' AS line, "
       "format('{:,}', inserted) || ' rows are new, ' || format('{:,}', usable - inserted) || ' were there before; ' || format('{:,}', usable) || ' of ' || format('{:,}', raw) || ' entries were usable, ' "
       "|| format('{:,}', raw - usable) || ' lacked a URL or program.' AS sentence FROM n")  # fmt: skip
def load_told(spark, sf_dir):
    """The summary of a load as a line of JSON and a sentence; rows whose program is blank are skipped."""
    existing, incoming = batches(spark, sf_dir)
    blanked = incoming.withColumn("program", F.when(F.col("p_id") % 7 == 0, "  ").otherwise(F.col("program")))
    return load.told(load.counted_new_rows(existing, blanked, typing.has_required())[1])


@query(RAW + "SELECT entry_id, url FROM raw_entries WHERE url IS NULL OR CAST(entry_id AS BIGINT) % 2 = 1")
def resume_pending(spark, sf_dir):
    e = raw_entries(spark, sf_dir)
    return load.pending(e, e.filter("cast(entry_id as bigint) % 2 = 0")).select("entry_id", "url")


# Pages


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(coalesce(html, '')), 'captcha|access denied|are you a robot|unusual traffic')")
def page_block_filter(spark, sf_dir):
    return extract.unblocked(table(spark, sf_dir, "pages")).select("page_id", "url")


PAGE = "CAST(entry_id AS BIGINT) // 20"
ENTRY = (
    f"{PAGE} AS page_no, entry_id, {squeeze('raw_school_text')} AS raw_school_text, {PROGRAM_TEXT} AS raw_program_text, {ADDED} AS raw_added_on_text, {squeeze('raw_decision_text')} AS raw_decision_text, "
    f"{META} || ' ' || {COMMENT} AS raw_meta_text, {META} || ' ' || {COMMENT} AS raw_comment_text, 'https://example.org/result/' || entry_id AS url"
)


@query(RAW + f"SELECT {ENTRY} FROM raw_entries WHERE {PAGE} % 97 <> 96")
def survey_rows(spark, sf_dir):
    return extract.survey_rows(extract.unblocked(survey_pages(spark, sf_dir))).drop("pos", "link")


@query(RAW + f"SELECT {ENTRY.replace(squeeze('raw_school_text'), squeeze(f"(raw_school_text || '{READ}')"))} FROM raw_entries WHERE {PAGE} % 97 <> 96")
def survey_rows_loose(spark, sf_dir):
    """The same entries from pages that close nothing, quote nothing and are full of references, comments and scripts."""
    return extract.survey_rows(extract.unblocked(survey_pages(spark, sf_dir, loose=True))).drop("pos", "link")


@query(RAW + f"SELECT entry_id, {META} || ' ' || {COMMENT} AS told FROM raw_entries")
def survey_trailing_text(spark, sf_dir):
    return extract.survey_rows(survey_pages(spark, sf_dir)).select("entry_id", F.col("raw_meta_text").alias("told"))


@query(RAW + f"SELECT DISTINCT {PAGE} AS page_no, 'https://example.org/survey?page=' || CAST({PAGE} + 1 AS VARCHAR) AS next_url FROM raw_entries")
def next_links(spark, sf_dir):
    return extract.next_links(survey_pages(spark, sf_dir)).select("page_no", "next_url")


@query("SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def dedupe_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.col("user_id").cast("string"))
    return extract.first_by_id(e, "key", ("event_id",)).select("event_id", "user_id")


@query(RAW + f", p AS (SELECT DISTINCT {PAGE} AS n FROM raw_entries), w AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS place, count(*) OVER () AS all_pages FROM p) "
       "SELECT CAST(n + 1 AS INT) AS step, 'https://example.org/survey?page=' || CAST(n AS VARCHAR) AS url FROM w WHERE n = place AND n < greatest(2, all_pages * 3 // 4) - 1")  # fmt: skip
def pagination_walk(spark, sf_dir):
    """From the first page to the first blocked one, three quarters of the pages on."""
    numbers = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 20").alias("n")).distinct()
    found = survey_pages(spark, sf_dir, blocked_every=max(2, numbers.count() * 3 // 4))
    pages = extract.next_links(found).select("url", "next_url", (~X.looks_blocked(F.col("html"))).alias("ok"))
    return extract.walk(pages, "https://example.org/survey?page=0", 1 << 30)


RULES = [("*", 1, "/result/1", False), ("*", 2, "/result/15", True), ("*", 3, "/result/2", False), ("bot", 1, "/", False)]


@query("SELECT DISTINCT url, coalesce((SELECT min_by(allow, ord) FROM (VALUES " + ", ".join(f"({o}, '{p}', {str(a).lower()})" for g, o, p, a in RULES if g == "*")
       + ") r(ord, prefix, allow) WHERE starts_with(regexp_extract(url, '^[a-z]+://[^/]*(/.*)?$', 1), prefix)), true) AS allowed FROM (SELECT 'https://example.org/result/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders)")
def url_policy_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "agent string, ord int, prefix string, allow boolean")
    urls = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://example.org/result/"), F.col("o_orderkey").cast("string")).alias("url"))
    return extract.allowed(urls, rules, "*")


SITE_STATUS = [("a.example.org", 200), ("b.example.org", 403), ("c.example.org", 404), ("d.example.org", 503)]
SITE_URL = "'https://' || CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'E' END || '.example.org/result/' || CAST(o_orderkey AS STRING)"


@query("WITH u AS (SELECT o_orderkey % 5 AS site, '/result/' || CAST(o_orderkey AS VARCHAR) AS path, " + SITE_URL + " AS url FROM orders) "
       "SELECT url, CASE site WHEN 0 THEN coalesce((SELECT min_by(allow, ord) FROM (VALUES " + ", ".join(f"({o}, '{p}', {str(a).lower()})" for g, o, p, a in RULES if g == "*")
       + ") r(ord, prefix, allow) WHERE starts_with(path, prefix)), true) WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS allowed FROM u")
def url_policy_sites(spark, sf_dir):
    """URLs of five sites whose rules were answered with different statuses, or never asked for."""
    rules = spark.createDataFrame([(h, *r) for h, _ in SITE_STATUS for r in RULES], "host string, agent string, ord int, prefix string, allow boolean")
    urls = table(spark, sf_dir, "orders").select(F.expr(SITE_URL).alias("url"))
    return extract.allowed_by_site(urls, rules, spark.createDataFrame(SITE_STATUS, "host string, status int"), "crawler")


# Sources and sinks

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entry_id", "raw_program_text", "url")])


@query(RAW + "SELECT entry_id, raw_program_text, url FROM raw_entries")
def json_roundtrip(spark, sf_dir):
    path = folder(spark)
    records.write_json(raw_entries(spark, sf_dir).select(*RECORD.fieldNames()), path)
    return records.read_json(spark, path, RECORD)


@query(RAW + "SELECT entry_id, raw_program_text, url FROM raw_entries")
def json_rows_wrapper(spark, sf_dir):
    """Half of the entries as arrays, half as objects with "rows", one file content for each thousand."""
    e = raw_entries(spark, sf_dir).select(*RECORD.fieldNames())
    path = folder(spark)
    group = F.floor(F.col("entry_id").cast("long") / 1000)
    some = e.groupBy(group.alias("g")).agg(F.to_json(F.collect_list(F.struct(*RECORD.fieldNames()))).alias("rows"))
    text = F.when(F.col("g") % 2 == 0, F.col("rows")).otherwise(F.concat(F.lit('{"rows": '), F.col("rows"), F.lit("}")))
    some.repartition(F.col("g")).select(text.alias("value"), F.col("g").alias("part")).write.partitionBy("part").text(path)
    return records.read_json(spark, path, RECORD)


@query(f"SELECT DISTINCT truth AS name FROM ({NAMES})")
def dictionary_load(spark, sf_dir):
    path = folder(spark)
    dictionary(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit("  "), "name", F.lit(" ")), F.lit("  "))).alias("value")).write.text(path)
    return records.read_dictionary(spark, path)


APPLICANT = T.StructType([
    T.StructField("p_id", T.LongType()), T.StructField("program", T.StringType()), T.StructField("comments", T.StringType()), T.StructField("date_added", T.DateType()),
    T.StructField("url", T.StringType()), T.StructField("status", T.StringType()), T.StructField("term", T.StringType()), T.StructField("us_or_international", T.StringType()),
    *(T.StructField(c, T.FloatType()) for c in A.SCORES), T.StructField("degree", T.StringType()),
    T.StructField("llm_generated_program", T.StringType()), T.StructField("llm_generated_university", T.StringType()),
])

PULLED = (
    "SELECT 'https://example.org/result/' || entry_id AS url, row_number() OVER (ORDER BY CAST(entry_id AS BIGINT)) AS p_id FROM raw_entries "
    f"WHERE {PAGE} % 97 <> 96"
)


@query(RAW + PULLED)
def incremental_pull(spark, sf_dir):
    """Two pulls of the same landed pages into an empty table: the second adds nothing."""
    at, pages = folder(spark), written(survey_pages(spark, sf_dir), "pages")
    for k in range(2):
        added = plan.pull(records.read_table(spark, at, APPLICANT), pages)
        records.append_batch(added.select(*APPLICANT.fieldNames()), at, f"pull-{k}")
    return records.read_table(spark, at, APPLICANT).select("url", "p_id")


@query(INCOMING + f", l AS ({LAST}), placed AS (SELECT url, row_number() OVER (ORDER BY p_id) AS p_id FROM existing UNION ALL "
       "SELECT url, (SELECT count(*) FROM existing) + row_number() OVER (ORDER BY pos) FROM l WHERE url NOT IN (SELECT url FROM existing)) "
       "SELECT placed.p_id, placed.url, " + ", ".join(f"CASE WHEN l.url IS NOT NULL THEN l.{c} ELSE e.{c} END AS {c}" for c in _others)
       + " FROM placed LEFT JOIN existing e ON placed.url = e.url LEFT JOIN l ON placed.url = l.url")
def stored_upsert(spark, sf_dir):
    """Two upserts stored one after the other into a table kept by buckets of the url, the second one twice, and the table read back."""
    at = folder(spark)
    existing, incoming = batches(spark, sf_dir)
    for batch in (existing.withColumn("pos", F.col("p_id")), incoming, incoming):
        buckets.merge(batch, at, APPLICANT)
    return buckets.read_buckets(spark, at, APPLICANT)


@query(APPS + f"SELECT p_id, term, degree, status FROM applicants WHERE term = '{TERM}' AND degree = 'PhD'")
def clustered_table(spark, sf_dir):
    """The applicants as a written table, clustered by term and degree, and a filter that skips most of its files."""
    at = folder(spark)
    records.append_batch(applicants(spark, sf_dir).select(*APPLICANT.fieldNames()), at, "all")
    return records.read_table(spark, at, APPLICANT).filter(F.col("term") == TERM).filter("degree = 'PhD'").select("p_id", "term", "degree", "status")


INDEXED = ("term", "degree", "llm_generated_university", "llm_generated_program")


@query(APPS + f"SELECT p_id, 'university' AS found_by FROM applicants WHERE llm_generated_university = 'Stanford University' UNION ALL SELECT p_id, 'program' FROM applicants WHERE llm_generated_program = 'Physics' "
       f"UNION ALL SELECT p_id, 'term' FROM applicants WHERE term = '{TERM}' UNION ALL SELECT p_id, 'degree' FROM applicants WHERE degree = 'Other' UNION ALL SELECT p_id, 'url' FROM applicants WHERE url = 'https://example.org/result/77'")  # fmt: skip
def indexed_table(spark, sf_dir):
    """The applicants as a written table in Z-order of four columns, and a filter on each of them and on a URL."""
    at = folder(spark)
    records.append_batch(written(applicants(spark, sf_dir).select(*APPLICANT.fieldNames())), at, "all", INDEXED, interleave=True)
    found = {"university": "llm_generated_university = 'Stanford University'", "program": "llm_generated_program = 'Physics'", "term": f"term = '{TERM}'", "degree": "degree = 'Other'", "url": "url = 'https://example.org/result/77'"}
    parts = [records.read_table(spark, at, APPLICANT).filter(c).select("p_id", F.lit(k).alias("found_by")) for k, c in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def landed_stream(spark, source: DataFrame) -> DataFrame:
    """source as a stream of written files, a few at a time; a file of many row groups is read by more than one task."""
    landed = folder(spark)
    source.repartition(8).write.option("parquet.block.size", 8 << 20).parquet(landed)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(landed)


@query("SELECT 'https://example.org/user/' || CAST(user_id AS VARCHAR) AS url, count(*) AS copies FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def streaming_ingest(spark, sf_dir):
    """The events table as a stream of records of users: each URL comes in once."""

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.select(F.concat(F.lit("https://example.org/user/"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("program"), F.col("event_id").alias("pos"))

    at = folder(spark)
    stream = landed_stream(spark, table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    ingest(stream, at, APPLICANT, prepare, folder(spark)).awaitTermination()
    return records.read_table(spark, at, APPLICANT).groupBy("url").agg(F.count("*").alias("copies"))


@query(_sql_report())
def streaming_report(spark, sf_dir):
    """The report after the last batch of a stream of the applicants."""
    at, reports = folder(spark), folder(spark)
    stream = landed_stream(spark, applicants(spark, sf_dir).withColumn("pos", F.col("p_id")))
    ingest(stream, at, APPLICANT, lambda rows: rows, folder(spark), report_to=reports, terms=(TERM, LAST_TERM)).awaitTermination()
    found = spark.read.parquet(reports)
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select("number", "answer")  # one row


@query(RAW + f"SELECT url, CAST(1 AS BIGINT) AS copies, CAST(count(*) OVER () AS BIGINT) AS numbers, CAST(1 AS BIGINT) AS first_number FROM ({PULLED})")
def streaming_pull(spark, sf_dir):
    """Landed pages as a stream, each page landed twice, through all steps of the pull: every URL once, numbered without gaps."""
    at, pages = folder(spark), survey_pages(spark, sf_dir)
    stream_pull(landed_stream(spark, pages.unionByName(pages)), at, APPLICANT, folder(spark)).awaitTermination()
    rows = records.read_table(spark, at, APPLICANT)
    numbers = rows.agg((F.max("p_id") - F.min("p_id") + 1).alias("numbers"), F.min("p_id").alias("first_number"))
    return rows.groupBy("url").agg(F.count("*").alias("copies")).crossJoin(F.broadcast(numbers))  # one row
