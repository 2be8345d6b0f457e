"""Steps whose cost must grow no faster than their input."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import clean, extract, load, standardize
from fieldmill.plans import pull as plan
from fieldmill.plans.queries import APPLICANT
from fieldmill.sources import buckets, records
from fieldmill.sources.shared import folder, written
from fieldmill.streaming.ingest import pull


def frame(spark, values, column="name"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_names_one_letter_from_an_entry_meet_no_others(spark, monkeypatch):
    entries = [f"University of {a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijkl"] + ["aaab", "ab", "Ünïversity"]
    names = [e[:-1] for e in entries[:64:3]] + [e + "x" for e in entries[:8]] + ["aab", "Ünïversty", "University of aei", "aaaab", ""]
    expected = {n: max(((m.ratio(), e) for e in entries if (m := difflib.SequenceMatcher(None, e, n)).ratio() >= 0.84), default=(0, None))[1] if n else None for n in names}

    def refused(*_, **__):
        raise AssertionError("names that have an entry one letter apart were compared with all others")

    monkeypatch.setattr(standardize, "near_names", refused)
    assert {r.name: r.match for r in standardize.fuzzy_match(frame(spark, names), frame(spark, entries), 0.84).collect()} == expected


@pytest.mark.parametrize("longest", [1, 5, 100])
def test_names_of_any_length_find_their_best_entry(spark, longest):
    entries, names = ["a", "ab", "abc", "abcd", "abcdef", "bcdefg", "abcdefgh"], ["a", "b", "ac", "abd", "acd", "abcdeg", "abcdefg", "xyz", "", None]
    expected = {n: max(((m.ratio(), e) for e in entries if (m := difflib.SequenceMatcher(None, e, n)).ratio() >= 0.5), default=(0, None))[1] if n else None for n in names}
    assert {r.name: r.match for r in standardize.fuzzy_match(frame(spark, names), frame(spark, entries), 0.5, longest=longest).collect()} == expected


def test_rows_without_an_id_are_no_reason_to_read_the_entries_twice(spark):
    entries = spark.range(20).selectExpr("if(id % 4 = 0, null, if(id % 4 = 1, '', cast(id div 8 as string))) as entry_id", "id as page_no", "0 as pos")
    first = extract.first_by_id(entries)
    assert first._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert sorted((r.entry_id or "", r.page_no) for r in first.collect()) == [*(("", k) for k in range(0, 20) if k % 4 < 2), ("0", 2), ("1", 10), ("2", 18)]


def test_pull_keeps_the_urls_seen_in_a_built_in_state(spark):
    row = lambda i, school: f'<tr><td>{school}</td><td>Physics PhD</td><td>Feb 1, 2026</td><td>Accepted on 1 Feb</td><td><a href="/result/{i}">x</a></td></tr>'
    page = lambda k, *rows: (k, f"https://example.org/?page={k}", f"<table>{''.join(rows)}</table>")
    at, landed = folder(spark), folder(spark)
    spark.createDataFrame([page(2, row(1, "Later")), page(1, row(1, "First"), row(1, "Again"), row(2, "Other")), page(3, row(2, "Late"))], "page_no long, url string, html string").repartition(3).write.parquet(landed)
    query = pull(spark.readStream.schema("page_no long, url string, html string").parquet(landed), at, APPLICANT, folder(spark))
    query.awaitTermination()
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"dedupe"}
    assert sorted((r.p_id, r.llm_generated_university) for r in records.read_table(spark, at, APPLICANT).collect()) == [(1, "First"), (2, "Other")]


def test_walk_sends_no_pages_through_the_driver(spark, monkeypatch):
    plans, write = [], extract.written

    def kept(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *name)

    monkeypatch.setattr(extract, "written", kept)
    pages = spark.createDataFrame([(f"p{k}", f"p{k + 1}", k != 3) for k in range(6)], "url string, next_url string, ok boolean")
    assert sorted((r.step, r.url) for r in extract.walk(pages, "p0", 100).collect()) == [(1, "p0"), (2, "p1"), (3, "p2")]
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)


def test_keys_of_a_table_are_sent_to_no_task_whole(spark):
    existing = written(spark.range(50).selectExpr("cast(id as string) as url", "id as p_id"))
    found = load.new_rows(existing, spark.range(40, 60).selectExpr("cast(id as string) as url", "id as pos"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r.url for r in found.collect()) == [str(k) for k in range(50, 60)]


def test_a_common_value_is_not_sorted_row_by_row(spark):
    rows = spark.range(9000).selectExpr("if(id % 9 < 7, 'common', cast(id % 9 as string)) as v")
    firsts = records.range_firsts(rows, "v", 64)
    assert sorted(r.first for r in firsts.collect()) == ["7", "8", "common"]
    top_down = firsts._jdf.queryExecution().executedPlan().toString().split("rangepartitioning")[0]
    assert "HashAggregate(keys=[v" in top_down[top_down.rindex("Sort ["):]  # values are told apart below the sort


def test_texts_of_a_common_piece_are_dealt_out(spark):
    names = [f"Clerk {k}" for k in range(40)] + ["clerk", "Clark 7", None]
    rules = [(k, rf"(?i)^clerk 0*{k}$", f"C{k}", str(k)) for k in range(0, 40, 3)] + [(99, "(?i)^clerk", "another", "clerk")]
    found = standardize.expand_by_table(frame(spark, names), "name", spark.createDataFrame(rules, "ord long, pattern string, full string, fragment string"), common=4)
    expected = [f"C{k}" if k % 3 == 0 else "another" for k in range(40)] + ["another", "Clark 7", None]
    assert sorted(map(str, (r.name for r in found.collect()))) == sorted(map(str, expected))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[piece#\d+, _part#\d+\]", plan) and "wanted" in plan


def test_stored_batch_is_computed_once(spark):
    seen, at = spark.sparkContext.accumulator(0), folder(spark)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    batch = spark.range(30).selectExpr("concat('u', id) as url", "'p' as program", "id as pos").mapInPandas(counted, "url string, program string, pos long")
    first = buckets.merge(batch, at, APPLICANT, buckets=4).first()
    assert (first.stored, first.added, seen.value) == (30, 30, 30)


def test_pages_whose_entries_are_known_are_not_parsed(spark, monkeypatch):
    row = lambda i, school, program="Physics PhD": f'<tr><td>{school}</td><td>{program}</td><td>Feb 1, 2026</td><td>Accepted on 1 Feb</td><td><A HREF=/RESULT/{i}>x</a></td></tr>'
    rows = [(1, row(1, "First") + row(2, "Second")), (2, row(2, "Late") + row(1, "Late")), (3, "<p>captcha</p>" + row(9, "Blocked"))]
    pages = lambda *more: written(spark.createDataFrame([(k, "u", f"<table>{h}</table>") for k, h in [*rows, *more]], "page_no long, url string, html string"))
    at = folder(spark)
    table = lambda: records.read_table(spark, at, APPLICANT)
    add = lambda p, name: records.append_batch(plan.pull(table(), p).select(*APPLICANT.fieldNames()), at, name)
    add(pages(), "one")
    parsed, parse = [], extract.survey_rows

    def seen(df, *a, **k):
        parsed.append(sorted(str(r.page_no) for r in df.collect()))
        return parse(df, *a, **k)

    monkeypatch.setattr(extract, "survey_rows", seen)
    add(pages(), "two")
    assert sorted((r.p_id, r.llm_generated_university) for r in table().collect()) == [(1, "First"), (2, "Second")] and not any(parsed)
    add(pages((4, row(2, "Known") + row(3, "New")), (5, '<a href="/result/77">no row</a>'), (None, row(4, "No number"))), "three")
    assert sorted((r.p_id, r.llm_generated_university) for r in table().collect()) == [(1, "First"), (2, "Second"), (3, "New"), (4, "No Number")] and len(parsed) == 2


def test_code_of_a_cleaned_row_is_small_enough_to_be_compiled(spark):
    """The JVM compiles no method of more than 8000 bytes."""
    raw = spark.range(3).select("id", *(F.concat(F.col("id").cast("string"), F.lit("  x\t")).alias(c) for c in (*(f"raw_{c}_text" for c in ("school", "program", "added_on", "decision", "meta", "comment")), "url")))
    stages = clean.clean_records(raw, ("id",))._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000


def test_entries_of_a_batch_are_written_once_before_they_are_cleaned(spark, monkeypatch):
    from fieldmill.streaming import ingest

    names, write = [], ingest.written

    def seen(df, name="table"):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(ingest, "written", seen)
    row = lambda i: f'<tr><td>School</td><td>Physics PhD</td><td>Feb 1, 2026</td><td>Accepted on 1 Feb</td><td><a href="/result/{i}">x</a></td></tr>'
    at, landed = folder(spark), folder(spark)
    kind = "page_no long, url string, html string"
    spark.createDataFrame([(k, "u", f"<table>{row(k % 3)}{row(k % 2)}</table>") for k in range(6)], kind).coalesce(1).write.parquet(landed)
    pull(spark.readStream.schema(kind).parquet(landed), at, APPLICANT, folder(spark)).awaitTermination()
    assert names == ["entries", "added"]
    assert [(r.entries, r.inserted, r.after) for r in spark.read.parquet(f"{at}.batches").collect()] == [(3, 3, 0)]
