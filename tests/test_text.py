"""Column functions on tables of inputs and expected results."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import text as T
from fieldmill.operators import analytics, clean, extract, load, standardize, typing


def results(spark, function, values):
    rows = [(k, v) for k, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "k int, v string").orderBy("k").select(function(F.col("v"))).collect()]


META = "Rejected on 12 Mar spring 2019 American GRE: 151 GRE V 149 GRE AW 3.5 GPA 2.75"

CASES = [
    (T.clean_text, [(None, ""), ("  a \n b ", "a b"), ("a  b", "a b"), ("", "")]),
    (T.term, [("fall 2026 American", "Fall 2026"), ("no term", ""), (META, "Spring 2019"), ("in WINTER \t2020", "Winter 2020")]),
    (T.student_type, [("International American", "International"), ("american", "American"), ("Other", "")]),
    (lambda c: T.program_without_degree(c), [("Marine Rope Work Masters", "Marine Rope Work"), ("Optics PhD", "Optics"), ("Panorama", "Panorama"), ("Optics Ph.D.", "Optics"), ("Soma MA", "Soma")]),
    (T.degree_token, [("Speech Masters", "Masters"), ("Physics", ""), ("Art mfa", "mfa")]),
    (T.free_comment, [("Interview on Oct 30 Winter 2021 Other GPA 2.25 fingers crossed", "fingers crossed"), ("nothing in front", "nothing in front"), (META.replace("12 Mar", "Mar 12") + " what a week", "what a week"), (None, "")]),
    (T.with_added_on, [("Feb 7, 2026", "Added on Feb 7, 2026"), ("added on Feb 7, 2026", "added on Feb 7, 2026"), ("", "")]),
    (T.date_added, [("Added on Nov 5, 2019", datetime.date(2019, 11, 5)), ("Added on Jun 31, 2019", None), ("Nov 5, 2019", None), ("", None), (None, None), ("Added on November 5, 2019", None)]),
    (T.gpa_number, [("GPA 4.9", pytest.approx(4.9)), ("GPA 3.8.5", None), ("3.85", None), (None, None)]),
    (T.trailing_number, [("GRE 166", 166.0), ("GRE AW 4.5", 4.5), ("GRE", None)]),
    (T.status_type, [("Wait listed on 3 Mar", "Wait listed"), ("Pending", None)]),
    (T.status_date, [("Wait listed on 3 Mar", "3 Mar"), ("Pending", None)]),
    (T.degree_name, [("Master’s", "Masters"), (" PhD ", "PhD"), ("JD", "JD"), ("", None), (None, None)]),
    (T.split_program, [("rope work, McGill.", "Rope Work"), ("knots @ ubc", "Knots"), ("Optics", "Optics"), (None, "")]),
    (T.split_university, [("rope work, McGill.", "Mcgill University"), ("knots @ ubc", "University of British Columbia"), ("Optics", "Unknown"), (None, "Unknown")]),
    (T.title_case, [("o'brien school-of", "O'Brien School-Of"), ("", ""), (None, None)]),
    (lambda c: T.labelled_number(c, T.GPA, "GPA"), [("GPA 3.8512", "GPA 3"), ("GPA 5.0", ""), ("gpa: 3.7", "GPA 3.7")]),
    (lambda c: T.labelled_number(c, T.GRE, "GRE"), [(META, "GRE 151"), ("GRE V 160", "")]),
    (T.block_reason, [("Please solve the CAPTCHA", "captcha"), ("fine", None), (None, None)]),
    (T.blank_to_null, [("  ", None), (" x ", "x"), (None, None)]),
    (lambda c: T.format_percent(c.cast("double")), [("42", "42.00"), ("33.3", "33.30"), (None, "0.00")]),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_column_function(spark, number):
    function, cases = CASES[number]
    assert results(spark, function, [v for v, _ in cases]) == [e for _, e in cases]


def test_clean_records(spark):
    raw = spark.createDataFrame(
        [("Elm\tCollege  of Arts", " Marine  Biology   phd ", "Mar 9, 2019", "Rejected on 12 Mar", META, META.replace("12 Mar", "Mar 12") + "  what a week ", " u1"), (None,) * 7],
        "raw_school_text string, raw_program_text string, raw_added_on_text string, raw_decision_text string, raw_meta_text string, raw_comment_text string, url string",
    )
    full, empty = sorted((r.asDict() for r in clean.clean_records(raw).collect()), key=lambda r: r["url"] is None)
    assert full == {
        "program": "Marine Biology, Elm College of Arts", "comments": "what a week", "date_added": "Added on Mar 9, 2019", "url": "u1", "status": "Rejected on 12 Mar",
        "term": "Spring 2019", "US/International": "American", "GRE": "GRE 151", "GRE V": "GRE V 149", "GRE AW": "GRE AW 3.5", "GPA": "GPA 2.75", "Degree": "phd",
    }
    assert {k: v for k, v in empty.items() if v is not None} == {"comments": ""}


PAGE = """<table>
<tr><td> Elm </td><td>Ropes &amp; Knots</td><td>Feb 1</td><td>Accepted</td><td><a href="/result/1">x</a></td></tr>
<tr><td>Winter 2021</td></tr><tr><td> </td></tr><tr><td>they wrote by hand</td></tr><tr><td>too far</td></tr>
<tr><td>Oak</td><td><a href="https://e.org/result/2?a=1">y</a></td></tr><tr><td>Spring 2020</td></tr>
<tr><td><a href='/result/3'>z</a></td></tr></table><a href="/result/9">orphan</a>
<a href="/survey?c=1">Previous</a><a class="n" href="/survey?from=q7"> Next </a>"""


def test_survey_rows_and_next_link(spark):
    pages = spark.createDataFrame([(1, "https://e.org/survey", PAGE), (2, "https://e.org/x", None), (3, "https://e.org/y", "")], "page_no int, url string, html string")
    rows = {r.entry_id: r for r in extract.survey_rows(pages).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert rows["1"].raw_school_text == "Elm" and rows["1"].raw_program_text == "Ropes & Knots"
    assert [rows[k].raw_meta_text for k in "123"] == ["Winter 2021 they wrote by hand", "Spring 2020", ""]
    assert rows["3"].raw_decision_text == ""
    assert {r.page_no: r.next_url for r in extract.next_links(pages).collect()} == {1: "https://e.org/survey?from=q7", 2: None, 3: None}


def test_walk_stops_at_blocked_missing_and_cap(spark):
    pages = spark.createDataFrame([(f"p{k}", f"p{k + 1}", k != 7) for k in range(10)] + [("loop", "loop", True)], "url string, next_url string, ok boolean")
    walk = lambda start, cap: sorted((r.step, r.url) for r in extract.walk(pages, start, cap).collect())
    assert walk("p0", 3) == [(1, "p0"), (2, "p1"), (3, "p2")]
    assert walk("p0", 50) == [(k + 1, f"p{k}") for k in range(7)]
    assert walk("p8", 50) == [(1, "p8"), (2, "p9")]
    assert walk("loop", 5) == [(1, "loop")]
    with pytest.raises(ValueError):
        extract.walk(pages, "p0", 0)


def test_first_by_id_keeps_rows_without_id(spark):
    e = spark.createDataFrame([("a", 1, 0, "x"), ("a", 0, 5, "y"), ("", 0, 1, "p"), ("", 0, 2, "q"), (None, 0, 3, "r")], "entry_id string, page_no int, pos int, v string")
    assert sorted(r.v for r in extract.first_by_id(e).collect()) == ["p", "q", "r", "y"]


def test_fuzzy_match_agrees_with_difflib(spark):
    import difflib

    entries = ["Stanford University", "McGill University", "University of Toronto", "Tufts", "Tuft", "Drexel University", "Duke University"]
    names = ["Stanford Univrsty", "Mc Gill University", "qqqq", "Tuftss", "Drxel Universty", "", "Duke Univercity"]
    d = spark.createDataFrame([(x,) for x in entries], "name string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    expected = {x: (difflib.get_close_matches(x, entries, 1, 0.86) or [None])[0] if x else None for x in names}
    assert {r.name: r.match for r in standardize.fuzzy_match(n, d, 0.86).collect()} == expected


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.86, 1.0])
def test_fuzzy_match_loses_no_pair(spark, cutoff):
    import difflib
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randint(1, 14)))
    edited = lambda w: "".join(r.choice(["", c, c, c, c, c, c, c + "b"]) for c in w)
    entries = sorted({word() for _ in range(120)})
    names = sorted({edited(w) for w in entries} | {word() for _ in range(60)})
    expected = {x: max(((m.ratio(), e) for e in entries if (m := difflib.SequenceMatcher(None, e, x)).ratio() >= cutoff), default=(0, None))[1] if x else None for x in names}
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "name string")
    assert {x.name: x.match for x in standardize.fuzzy_match(frame(names), frame(entries), cutoff).collect()} == expected


def test_standardized_names(spark):
    d = spark.createDataFrame([("McGill University",), ("University of British Columbia",)], "name string")
    n = spark.createDataFrame([("Mc Gill University",), ("UBC",), ("",), (None,), ("Other Place",)], "name string")
    found = {r.name: r.standard for r in standardize.standardized_names(n, d, "university").collect()}
    assert found["Mc Gill University"] == "McGill University" and found["UBC"] == "University of British Columbia"
    assert found[""] == "Unknown" and found["Other Place"] == "Other Place"


def test_parse_reply_falls_back(spark):
    rows = [("Sure {\"standardized_program\": \"A\"} ok", "B at C"), ("no json", "b at c"), (None, "x"), ("{broken", "y")]
    df = spark.createDataFrame(rows, "reply string, original string")
    got = {r.original: (r.program_name, r.university) for r in standardize.parse_reply(df).collect()}
    assert got == {"B at C": ("A", ""), "b at c": ("B", "C"), "x": ("X", "Unknown"), "y": ("Y", "Unknown")}


ROW = "p_id long, url string, program string, status string"


def test_insert_ignore_twice_adds_once(spark):
    existing = spark.createDataFrame([(1, "u1", "p", "s")], ROW)
    batch = spark.createDataFrame([("u1", "new", 0), ("u2", "first", 1), ("u2", "second", 2), (None, "x", 3)], "url string, program string, pos int")
    once = load.insert_ignore(existing, batch)
    assert sorted((r.url, r.program) for r in once.collect()) == [("u1", "p"), ("u2", "first")]
    assert load.new_rows(once, batch).count() == 0


def test_upsert_takes_nulls_and_keeps_ids(spark):
    existing = spark.createDataFrame([(1, "u1", "p", "s"), (2, "u2", "q", "t")], ROW)
    batch = spark.createDataFrame([("u1", "a", "x", 0), ("u1", "b", None, 1), ("u3", "c", "z", 2)], "url string, program string, status string, pos int")
    rows = sorted((r.url, r.p_id, r.program, r.status) for r in load.upsert(existing, batch).collect())
    assert rows == [("u1", 1, "b", None), ("u2", 2, "q", "t"), ("u3", None, "c", "z")]


def test_constraints_fail_the_whole_batch(spark):
    with pytest.raises(load.ConstraintError):
        load.require(spark.createDataFrame([("u", "p"), ("v", None)], "url string, program string"))
    with pytest.raises(load.ConstraintError):
        load.require(spark.createDataFrame([("u", "p"), ("u", "q")], "url string, program string"))


def test_surrogate_keys_follow_without_gaps(spark):
    existing = spark.createDataFrame([(7, "u", "p", "s")], ROW)
    added = spark.createDataFrame([(f"n{k}", k * k) for k in range(50)], "url string, pos long")
    rows = load.with_surrogate(existing, added, "pos", parts=5).orderBy("pos").collect()
    assert [r.p_id for r in rows] == list(range(8, 58))


def test_trend_words(spark):
    df = lambda rows: spark.createDataFrame(rows, "term string")
    word = lambda rows: analytics.trend(df(rows)).first().trend
    assert word([("Fall 2024",), ("Spring 2025",), ("Spring 2025",)]) == "trending up"
    assert word([("Fall 2024",), ("Fall 2024",), ("Spring 2025",)]) == "trending down"
    assert word([("Fall 2024",), ("Spring 2025",)]) == "no clear trend"
    assert word([("Fall 2024",)]) == "no data" and word([]) == "no data"


def test_incremental_mapping_drops_rows_without_key(spark):
    schema = "url string, program string, comments string, date_added string, status string, term string, us_or_international string, gpa double, gre double, gre_v double, gre_aw double, degree string, llm_generated_program string, llm_generated_university string"
    rows = [(" u ", " p ", "", "2026-02-30", "", None, "", 3.5, None, None, None, "Ph.D.", "", "x"), (" ", "p", *[None] * 12), ("u", None, *[None] * 12)]
    got = typing.to_applicants_incremental(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].url == "u" and got[0].date_added is None and got[0].comments is None and got[0].degree == "PhD"
