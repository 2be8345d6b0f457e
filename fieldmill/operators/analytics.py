"""Questions about the applicants table, as parameterised filters and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEASONS, format_percent, percent, round2, two_decimals

SCHOOLS = ["georgetown", "stanford", "massachusetts institute of technology", "carnegie mellon"]
SCHOOL_WORDS = ["mit", "cmu"]
SCORES = ("gpa", "gre", "gre_v", "gre_aw")


def accepted(status: str = "status") -> Column:
    return F.col(status).startswith("Accepted")


def of_schools(column: str) -> Column:
    found = F.lit(False)
    for s in SCHOOLS:
        found = found | F.col(column).ilike(f"%{s}%")
    for w in SCHOOL_WORDS:
        found = found | F.col(column).rlike(rf"(?i)\b{w}\b")
    return found


def accepted_to(program: str, school: str, degree: str = "PhD", subject: str = "computer science") -> Column:
    return accepted() & (F.col("degree") == degree) & F.col(program).ilike(f"%{subject}%") & of_schools(school)


def accepted_at(program: str, school: str, term: str, degree: str = "PhD", subject: str = "computer science") -> Column:
    return (F.col("term") == term) & accepted_to(program, school, degree, subject)


def international_share() -> Column:
    kind = F.col("us_or_international")
    return percent(F.count_if(kind == "International"), F.count_if(F.trim(kind) != ""))


def acceptance_share(condition: Column) -> Column:
    return percent(F.count_if(condition & accepted()), F.count_if(condition))


def term_count(df: DataFrame, term: str) -> DataFrame:
    return df.filter(F.col("term") == term).agg(F.count("*").alias("n"))


def pct_international(df: DataFrame) -> DataFrame:
    return df.agg(international_share().alias("pct"))


def avg_scores(df: DataFrame) -> DataFrame:
    return df.agg(*(round2(F.avg(c)).alias(f"avg_{c}") for c in SCORES))


def avg_gpa(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition).agg(round2(F.avg("gpa")).alias("avg_gpa"))


def acceptance_pct(df: DataFrame, term: str) -> DataFrame:
    return df.agg(acceptance_share(F.col("term") == term).alias("pct"))


def at_hopkins() -> Column:
    program = F.col("program")
    return (F.col("degree") == "Masters") & program.ilike("%computer science%") & (program.ilike("%hopkins%") | program.ilike("%jhu%"))


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition).agg(F.count("*").alias("n"))


def field_difference(df: DataFrame, term: str) -> DataFrame:
    """original, standardized, difference and its signed text, in one pass."""
    raw = F.count_if(accepted_at("program", "program", term)).alias("original")
    standard = F.count_if(accepted_at("llm_generated_program", "llm_generated_university", term)).alias("standardized")
    both = df.agg(raw, standard).withColumn("difference", F.col("standardized") - F.col("original"))
    return both.withColumn("difference_text", F.format_string("%+,d", "difference"))


def gpa_buckets(df: DataFrame) -> DataFrame:
    gpa = F.col("gpa")
    bucket = F.when(gpa < 1, "0-0.9").when(gpa < 2, "1-1.9").when(gpa < 3, "2.0-2.9").when(gpa < 4, "3.0-3.9").otherwise("4.0-4.9")
    grouped = df.filter(gpa.isNotNull()).groupBy(bucket.alias("gpa_bucket")).agg(
        F.count("*").alias("total"), percent(F.count_if(accepted()), F.count("*")).alias("acceptance_pct"), F.min("gpa").alias("_low")
    )
    return grouped.orderBy("_low").drop("_low")


def term_order(term: str = "term") -> list[Column]:
    season = F.coalesce(*(F.when(F.col(term).contains(s), F.lit(k)) for k, s in enumerate(SEASONS)), F.lit(len(SEASONS)))
    return [F.regexp_substr(term, F.lit(r"\d{4}")).try_cast("int").alias("year"), season.alias("season")]


def term_counts(df: DataFrame) -> DataFrame:
    """term and n in calendar order, terms without a year last."""
    counts = df.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    year, season = term_order()
    return counts.orderBy(year.asc_nulls_last(), season.asc(), "term")


def trend(df: DataFrame) -> DataFrame:
    """One row: trend of the last term's count against the first's, 'no data' below two terms."""
    year, season = term_order()
    place = F.struct(year.isNull(), year, season, F.col("term"))
    counts = df.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    ends = counts.agg(F.count("*").alias("terms"), F.min_by("n", place).alias("first"), F.max_by("n", place).alias("last"))
    return ends.select("terms", "first", "last", _trend_word().alias("trend"))


def _trend_word() -> Column:
    first, last = F.col("first"), F.col("last")
    return F.when(F.col("terms") < 2, "no data").when(last > first, "trending up").when(last < first, "trending down").otherwise("no clear trend")


def share_of_max(df: DataFrame) -> DataFrame:
    """term, n and pct_of_max as text. The largest count is an aggregate of its own, so terms stay spread over tasks."""
    counts = df.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("term", "n", F.format_string("%.2f", F.col("n") / F.col("most") * 100).alias("pct_of_max"))  # one row


def lookup(df: DataFrame, url: str) -> DataFrame:
    """The row with this url; a second one is an error when the result is read."""
    found = df.filter(F.col("url") == url).drop("p_id")
    several = F.raise_error(F.lit(f"more than one row has the url {url}"))
    one = found.groupBy("url").agg(F.count("*").alias("_n"), F.any_value(F.struct(*found.columns)).alias("_row"))  # one group at most
    return one.filter(F.when(F.col("_n") > 1, several.cast("boolean")).otherwise(True)).select("_row.*")


def report(df: DataFrame, term: str, last_term: str) -> DataFrame:
    """number and answer of the nine questions, all from one scan."""
    this, last = F.col("term") == term, F.col("term") == last_term
    when_avg = lambda c: round2(F.avg(F.when(c, F.col("gpa"))))
    one = df.agg(
        F.count_if(this).alias("q1"), international_share().alias("q2"), *(round2(F.avg(c)).alias(f"q3_{c}") for c in SCORES),
        when_avg(this & (F.col("us_or_international") == "American")).alias("q4"), acceptance_share(last).alias("q5"), when_avg(last & accepted()).alias("q6"),
        F.count_if(at_hopkins()).alias("q7"), F.count_if(accepted_at("program", "program", term)).alias("q8"),
        F.count_if(accepted_at("llm_generated_program", "llm_generated_university", term)).alias("q9"),
    )
    return _answers(one)


def _answers(one: DataFrame) -> DataFrame:
    """number and answer from the row of figures q1 to q9."""
    whole = lambda c: F.format_number(F.col(c), 0)
    number = lambda c: two_decimals(F.col(c), "None")
    answers = [
        whole("q1"), F.concat(format_percent(F.col("q2")), F.lit("%")),
        F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), number(f"q3_{c}")) for c in SCORES)), number("q4"),
        F.concat(format_percent(F.col("q5")), F.lit("%")), number("q6"), whole("q7"), whole("q8"),
        F.concat(whole("q9"), F.lit(" (original "), whole("q8"), F.lit(", difference "), F.format_string("%+,d", F.col("q9") - F.col("q8")), F.lit(")")),
    ]
    return one.select(F.posexplode(F.array(*answers)).alias("number", "answer")).select((F.col("number") + 1).alias("number"), "answer")


def _bucket() -> Column:
    gpa = F.col("gpa")
    return F.when(gpa < 1, "0-0.9").when(gpa < 2, "1-1.9").when(gpa < 3, "2.0-2.9").when(gpa < 4, "3.0-3.9").when(gpa.isNotNull(), "4.0-4.9")


def cube(df: DataFrame) -> DataFrame:
    """Counts and sums for each term and GPA bucket, from one scan: all that the whole report needs.

    Every column but low, a minimum, adds up, so cubes of parts of a table, written one by one, give the report of it all.
    """
    kind, gpa = F.col("us_or_international"), F.col("gpa")
    total = lambda c, where=None: F.coalesce(F.sum((F.when(where, F.col(c)) if where is not None else F.col(c)).cast("double")), F.lit(0.0))
    return df.groupBy("term", _bucket().alias("gpa_bucket")).agg(
        F.count("*").alias("n"), F.count_if(accepted()).alias("accepted"), F.count_if(kind == "International").alias("international"), F.count_if(F.trim(kind) != "").alias("classified"),
        *(total(c).alias(f"sum_{c}") for c in SCORES), *(F.count(c).alias(f"n_{c}") for c in SCORES), F.min("gpa").alias("low"),
        total("gpa", kind == "American").alias("sum_american"), F.count_if((kind == "American") & gpa.isNotNull()).alias("n_american"),
        total("gpa", accepted()).alias("sum_accepted"), F.count_if(accepted() & gpa.isNotNull()).alias("n_accepted"),
        F.count_if(at_hopkins()).alias("hopkins"), F.count_if(accepted_to("program", "program")).alias("raw_match"), F.count_if(accepted_to("llm_generated_program", "llm_generated_university")).alias("std_match"),
    )


def report_of(cubes: DataFrame, term: str, last_term: str) -> DataFrame:
    """number and answer of the nine questions, as report() gives them, from cubes."""
    this, last = F.col("term") == term, F.col("term") == last_term
    add = lambda c, where=None: F.coalesce(F.sum(F.when(where, F.col(c)) if where is not None else F.col(c)), F.lit(0))
    mean = lambda s, n, where=None: round2(add(s, where) / F.nullif(add(n, where), F.lit(0)))
    one = cubes.agg(
        add("n", this).alias("q1"), percent(add("international"), add("classified")).alias("q2"), *(mean(f"sum_{c}", f"n_{c}").alias(f"q3_{c}") for c in SCORES),
        mean("sum_american", "n_american", this).alias("q4"), percent(add("accepted", last), add("n", last)).alias("q5"), mean("sum_accepted", "n_accepted", last).alias("q6"),
        add("hopkins").alias("q7"), add("raw_match", this).alias("q8"), add("std_match", this).alias("q9"),
    )
    return _answers(one)


def whole_report(cubes: DataFrame, term: str, last_term: str) -> DataFrame:
    """All that the report shows, as section, place, label, total and value, from cubes.

    Sections: 'answer' (the nine questions), 'gpa' (share accepted of each bucket, lowest first), 'term' (share of the largest
    count, in calendar order) and 'trend'. cubes are small and read several times: write them first.
    """
    of = lambda by: cubes.filter(F.col(by).isNotNull()).groupBy(by).agg(F.sum("n").alias("total"), F.sum("accepted").alias("accepted"), F.min("low").alias("low"))
    shown = lambda section, place, label, total, value: [F.lit(section).alias("section"), place.cast("int").alias("place"), label.alias("label"), total.alias("total"), value.alias("value")]
    none = F.lit(None).cast("string")
    answers = report_of(cubes, term, last_term).select(*shown("answer", F.col("number"), F.concat(F.lit("Q"), F.col("number")), F.lit(None).cast("long"), F.col("answer")))
    buckets, terms, all_rows = of("gpa_bucket"), of("term"), Window.partitionBy(F.lit(1))  # a row for each bucket and term
    year, season = term_order()
    in_order = all_rows.orderBy(year.asc_nulls_last(), season, "term")
    share = format_percent(percent(F.col("accepted"), F.col("total")))
    gpa = buckets.select(*shown("gpa", F.row_number().over(all_rows.orderBy("low")), F.col("gpa_bucket"), F.col("total"), share))
    size = F.format_string("%.2f", F.col("total") / F.max("total").over(all_rows) * 100)
    by_term = terms.select(*shown("term", F.row_number().over(in_order), F.col("term"), F.col("total"), size))
    ends = by_term.agg(F.count("*").alias("terms"), F.min_by("total", "place").alias("first"), F.max_by("total", "place").alias("last"))
    return answers.unionByName(gpa).unionByName(by_term).unionByName(ends.select(*shown("trend", F.lit(1), none, F.col("terms"), _trend_word())))
