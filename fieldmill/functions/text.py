"""Column functions on the text fields of self-reported records: cleaning, parsing, standardizing, formatting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers and patterns that records are written with.
BLOCK_MARKERS = ["captcha", "access denied", "are you a robot", "unusual traffic"]
DEGREE_TOKENS = ["Master'?s", "Masters", "MS", "MSc", "MA", "MBA", "MEng", "MFA", "PsyD", r"Ph\.?D\.?", "Doctorate", "EdD", "MPH", "JD", "Other"]
SEASONS = ["Spring", "Summer", "Fall", "Winter"]
STATUSES = ["Accepted", "Rejected", "Interview", "Wait listed"]
GRE = r"(?i)\bGRE\s*[:\-]?\s*(\d{2,3})\b"
GRE_V = r"(?i)\bGRE\s*V\s*[:\-]?\s*(\d{2,3})\b"
GRE_AW = r"(?i)\bGRE\s*AW\s*[:\-]?\s*(\d(?:\.\d{1,2})?)\b"
GPA = r"(?i)\bGPA\s*[:\-]?\s*([0-4](?:\.\d{1,3})?)\b"
COMMENT_PREFIX = (
    r"(?i)^\s*(?:Accepted|Rejected|Wait\s*listed|Interview)(?:\s+on\s+[A-Za-z]{3,9}\s+\d{1,2})?(?:\s+(?:Spring|Summer|Fall|Winter)\s+\d{4})?"
    r"(?:\s+(?:International|American|Other|0))?(?:\s+GRE\s*[:\-]?\s*\d{2,3})?(?:\s+GRE\s*V\s*[:\-]?\s*\d{2,3})?"
    r"(?:\s+GRE\s*AW\s*[:\-]?\s*\d(?:\.\d{1,2})?)?(?:\s+GPA\s*[:\-]?\s*[0-4](?:\.\d{1,3})?)?\s*"
)  # a status, and after it in this order, each at most once, what may follow
DEGREES = {
    "master's": "Masters", "masters": "Masters", "ms": "Masters", "msc": "Masters", "ma": "Masters",
    "mba": "Masters", "meng": "Masters", "mfa": "Masters", "mph": "Masters",
    "phd": "PhD", "ph.d": "PhD", "ph.d.": "PhD", "doctorate": "PhD", "psyd": "PhD", "edd": "PhD",
}
UNIVERSITY_ABBREVIATIONS = [
    (r"(?i)^mcg(\.|ill)?$", "McGill University"),
    (r"(?i)^(ubc|u\.?b\.?c\.?)$", "University of British Columbia"),
    (r"(?i)^uoft$", "University of Toronto"),
]
SPLIT_ABBREVIATIONS = [
    (r"(?i)^mcg(ill)?(\.)?$", "McGill University"),
    (r"(?i)^(ubc|u\.?b\.?c\.?|university of british columbia)$", "University of British Columbia"),
]
UNIVERSITY_FIXES = {
    "McGiill University": "McGill University",
    "Mcgill University": "McGill University",
    "University Of British Columbia": "University of British Columbia",
}
PROGRAM_FIXES = {"Mathematic": "Mathematics", "Info Studies": "Information Studies"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """White space runs as one space, none at the ends; null becomes empty. A single space is no match, so most text has none."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U) \s+|[^\S ]\s*", " "))


def blank_to_null(c: Column) -> Column:
    return none_if_empty(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def looks_blocked(html: Column) -> Column:
    """Whether a page has one of BLOCK_MARKERS. A pattern of fixed text is found by leaps, which contains() doesn't make."""
    return let(F.lower(F.coalesce(html, F.lit(""))), lambda low: reduce(Column.__or__, (low.rlike(m) for m in BLOCK_MARKERS)))


def block_reason(html: Column) -> Column:
    """The first marker in the order of BLOCK_MARKERS, null where there is none."""
    lowered = F.lower(html)
    return F.coalesce(*(F.when(lowered.contains(m), F.lit(m)) for m in BLOCK_MARKERS))


def _degree_pattern() -> str:
    return rf"(?i)\s*\b({'|'.join(DEGREE_TOKENS)})\s*$"


def program_without_degree(c: Column) -> Column:
    return clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), _degree_pattern(), ""))


def degree_token(c: Column) -> Column:
    return clean_text(F.regexp_extract(F.coalesce(c, F.lit("")), _degree_pattern(), 1))


def compose_program(program: Column, school: Column) -> Column:
    return F.concat_ws(", ", none_if_empty(program), none_if_empty(school))


def free_comment(c: Column) -> Column:
    return clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), COMMENT_PREFIX, ""))


def with_added_on(c: Column) -> Column:
    return F.when(F.lower(c).startswith("added on"), c).when(c != "", F.concat(F.lit("Added on "), c)).otherwise(F.lit(""))


def term(c: Column) -> Column:
    """The first "Fall 2026" in any case and spacing; empty without one."""
    return F.initcap(clean_text(F.regexp_extract(c, rf"(?i)\b({'|'.join(SEASONS)})\s+(\d{{4}})\b", 0)))


def student_type(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)\bInternational\b"), "International").when(c.rlike(r"(?i)\bAmerican\b"), "American").otherwise("")


def labelled_number(c: Column, pattern: str, label: str) -> Column:
    return F.coalesce(F.concat(F.lit(f"{label} "), none_if_empty(F.regexp_extract(c, pattern, 1))), F.lit(""))


def date_added(c: Column) -> Column:
    """The date of "Added on Feb 7, 2026"; null for other forms and dates that don't exist."""
    return F.try_to_date(F.regexp_extract(c, "^Added on (.+)$", 1), "MMM d, yyyy")


_STATUS = rf"^({'|'.join(STATUSES)}) on (.+)$"


def status_type(c: Column) -> Column:
    return none_if_empty(F.regexp_extract(c, _STATUS, 1))


def status_date(c: Column) -> Column:
    return none_if_empty(F.regexp_extract(c, _STATUS, 2))


def gpa_number(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^GPA\s+([\d.]+)$", 1).try_cast("float")


def trailing_number(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"(\d+(?:\.\d+)?)\s*$", 1).try_cast("float")


def look_up(mapping: dict[str, str], key: Column, default: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), default)


def degree_name(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(F.coalesce(c, F.lit("")) != "", look_up(DEGREES, F.replace(F.lower(trimmed), F.lit("’"), F.lit("'")), trimmed))


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter, as in "O'Brien School-Of"."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def university_case(c: Column) -> Column:
    return F.regexp_replace(title_case(c), r"\bOf\b", "of")


def expand(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The replacement of the first rule that matches, else c."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(full)) for p, full in rules), c)


def split_parts(c: Column) -> Column:
    """The parts of "Program, University" or "Program at University", without blanks."""
    plain = F.regexp_replace(clean_text(c), "^,+|,+$", "")
    return F.filter(F.transform(F.split(plain, ",| at | @ "), lambda x: F.trim(x)), lambda x: x != "")


def split_program(c: Column) -> Column:
    return F.coalesce(title_case(F.get(split_parts(c), F.lit(0))), F.lit(""))


def split_university(c: Column) -> Column:
    return F.coalesce(university_case(expand(F.get(split_parts(c), F.lit(1)), SPLIT_ABBREVIATIONS)), F.lit("Unknown"))


def program_before_lookup(c: Column) -> Column:
    p = F.trim(F.coalesce(c, F.lit("")))
    return title_case(look_up(PROGRAM_FIXES, p, p))


def university_before_lookup(c: Column) -> Column:
    u = expand(F.trim(F.coalesce(c, F.lit(""))), UNIVERSITY_ABBREVIATIONS)
    return university_case(look_up(UNIVERSITY_FIXES, u, u))


def reply_json(c: Column) -> Column:
    """The first {...} in a model's reply."""
    return F.regexp_extract(c, r"(?s)\{.*?\}", 0)


def round2(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def percent(part: Column, whole: Column) -> Column:
    return round2(F.lit(100.0) * part / F.nullif(whole, F.lit(0)))


def two_decimals(c: Column, if_null: str) -> Column:
    return F.when(c.isNull(), if_null).otherwise(F.format_string("%.2f", c))


def format_percent(c: Column) -> Column:
    return two_decimals(c, "0.00")
