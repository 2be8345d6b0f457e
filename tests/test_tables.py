"""Stored upserts, claims, the stream of pages and the report from parts."""

import os

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import analytics, load
from fieldmill.plans import queries as Q
from fieldmill.sources import buckets, claims, records
from fieldmill.sources.shared import folder, written
from fieldmill.streaming import ingest as S

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
BATCH = "url string, program string, status string, pos long"


def files(path):
    """Every data file below a local path with its time."""
    root = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def stored(spark, at):
    return {r.url: (r.p_id, r.program, r.status) for r in buckets.read_buckets(spark, at, Q.APPLICANT).collect()}


def batch(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], BATCH)


# A table kept by key


def test_stored_upsert(spark):
    at = folder(spark)
    assert stored(spark, at) == {} and buckets.lookup(spark, at, Q.APPLICANT, "u").count() == 0
    first = buckets.merge(batch(spark, ("u", "p", "s"), ("v", "q", "t"), ("u", "p2", "s2")), at, Q.APPLICANT, buckets=8).first()
    assert (first.stored, first.added) == (2, 2) and stored(spark, at) == {"v": (1, "q", "t"), "u": (2, "p2", "s2")}
    second = buckets.merge(batch(spark, ("w", "x", None), ("v", "q2", None)), at, Q.APPLICANT, buckets=8).first()
    assert (second.stored, second.added) == (2, 1)
    expected = {"v": (1, "q2", None), "u": (2, "p2", "s2"), "w": (3, "x", None)}
    assert stored(spark, at) == expected
    buckets.merge(batch(spark, ("w", "x", None), ("v", "q2", None)), at, Q.APPLICANT, buckets=8)
    assert stored(spark, at) == expected


def test_stored_insert_ignore(spark):
    at = folder(spark)
    buckets.merge(batch(spark, ("u", "p", "s")), at, Q.APPLICANT, update=False)
    counts = buckets.merge(batch(spark, ("u", "new", "new"), ("v", "first", "a"), ("v", "second", "b")), at, Q.APPLICANT, update=False).first()
    assert counts.added == 1 and stored(spark, at) == {"u": (1, "p", "s"), "v": (2, "first", "a")}


def test_untouched_buckets_keep_their_files(spark):
    at = folder(spark)
    buckets.merge(batch(spark, *((f"u{k}", "p", "s") for k in range(60))), at, Q.APPLICANT, buckets=16)
    before = files(at)
    assert len({os.path.dirname(f) for f in before}) > 8
    buckets.merge(batch(spark, ("u7", "changed", None)), at, Q.APPLICANT, buckets=16)
    after = files(at)
    changed = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert len(changed) == 1 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in changed)
    assert stored(spark, at)["u7"] == (8, "changed", None) and len(stored(spark, at)) == 60
    found = buckets.lookup(spark, at, Q.APPLICANT, "u9")
    assert [r.p_id for r in found.collect()] == [10]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(url,u9)" in plan


def test_batch_that_breaks_a_constraint_leaves_all_buckets(spark):
    at = folder(spark)
    buckets.merge(batch(spark, ("u", "p", "s"), ("v", "q", "t")), at, Q.APPLICANT)
    before = files(at)
    for broken in (("w", None, "s"), (None, "p", "s")):
        with pytest.raises(load.ConstraintError):
            buckets.merge(batch(spark, ("u", "changed", "s"), broken), at, Q.APPLICANT)
    assert files(at) == before
    with pytest.raises(ValueError, match="64 buckets, not 8"):
        buckets.merge(batch(spark, ("u", "p", "s")), at, Q.APPLICANT, buckets=8)


def test_empty_batch_changes_nothing(spark):
    at = folder(spark)
    assert buckets.merge(batch(spark), at, Q.APPLICANT).first().stored == 0 and stored(spark, at) == {}
    buckets.merge(batch(spark, ("u", "p", "s")), at, Q.APPLICANT)
    before = files(at)
    assert buckets.merge(batch(spark), at, Q.APPLICANT).first().buckets == 0 and files(at) == before


def test_firsts_and_upserts_need_no_sort_aggregate(spark):
    for df in (load.one_per_key(batch(spark, ("u", "p", "s")), "url", "pos", last=True),):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_batch_written_empty_takes_its_rows_back(spark):
    at = folder(spark)
    rows = lambda *urls: spark.createDataFrame([], Q.APPLICANT).unionByName(spark.createDataFrame([(u,) for u in urls], "url string"), allowMissingColumns=True)
    urls = lambda: sorted(r.url for r in records.read_table(spark, at, Q.APPLICANT).collect())
    records.append_batch(rows("u"), at, "a")
    records.append_batch(rows("v", "w"), at, "b")
    records.append_batch(rows(), at, "b")
    assert urls() == ["u"]
    records.append_batch(rows(), at, "a")
    assert urls() == []


# Claims


def test_claims(spark):
    at = folder(spark)
    assert claims.owner(spark, at) is None
    claims.claim(spark, at, "one")
    claims.claim(spark, at, "one")
    with pytest.raises(claims.ClaimedError, match="held by writer one"):
        claims.claim(spark, at, "two")
    with pytest.raises(claims.ClaimedError), claims.held(spark, at, "two", patience=0.3):
        pass
    claims.release(spark, at, "two")
    assert claims.owner(spark, at) == "one"
    claims.release(spark, at, "one")
    with claims.held(spark, at, "two"):
        assert claims.owner(spark, at) == "two"
    assert claims.owner(spark, at) is None


# Streams

PAGE = "page_no long, url string, html string"


def page(number, *ids, blocked=False):
    rows = "".join(f'<tr><td>School {i}</td><td>Physics PhD</td><td>Feb {i}, 2026</td><td>Accepted on 1 Feb</td><td><a href="/result/{i}">x</a></td></tr>' for i in ids)
    return number, f"https://example.org/?page={number}", ("captcha " if blocked else "") + f"<table>{rows}</table>"


def land(spark, path, *pages):
    spark.createDataFrame(pages, PAGE).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(PAGE).parquet(path)


def table_of(spark, at):
    return sorted((r.p_id, r.url.rsplit("/", 1)[1], r.program) for r in records.read_table(spark, at, Q.APPLICANT).collect())


def uncommit(spark, checkpoint, number):
    """As if a stream had failed after the batch was written and before that was noted."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in (f"{number}", f".{number}.crc"):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{name}"), False)


def test_stream_of_pages(spark):
    at, landed, checkpoint = folder(spark), folder(spark), folder(spark)
    run = lambda pages: S.pull(land(spark, landed, *pages), at, Q.APPLICANT, checkpoint).awaitTermination()
    run([page(1, 3, 4), page(2, 4, 5), page(3, 9, blocked=True)])
    first = [(1, "3", "Physics, School 3"), (2, "4", "Physics, School 4"), (3, "5", "Physics, School 5")]
    assert table_of(spark, at) == first
    run([page(4, 5, 6)])
    assert table_of(spark, at) == [*first, (4, "6", "Physics, School 6")]
    run([page(5, 3)])  # nothing new
    assert table_of(spark, at) == [*first, (4, "6", "Physics, School 6")]
    row = records.read_table(spark, at, Q.APPLICANT).filter("p_id = 1").first()
    assert (row.status, row.degree, str(row.date_added), row.llm_generated_university) == ("Accepted", "PhD", "2026-02-03", "School 3")
    uncommit(spark, checkpoint, 1)
    run([page(6, 7)])  # the batch of page 4 again, and then page 6
    assert table_of(spark, at) == [*first, (4, "6", "Physics, School 6"), (5, "7", "Physics, School 7")]


def test_two_streams_of_pages_at_once_are_refused(spark):
    at, mine = folder(spark), folder(spark)
    S.pull(land(spark, folder(spark), page(1, 3)), at, Q.APPLICANT, mine).awaitTermination()
    with pytest.raises(Exception, match="held by writer"):
        S.pull(land(spark, folder(spark), page(1, 3, 4)), at, Q.APPLICANT, folder(spark)).awaitTermination()
    assert [r[1] for r in table_of(spark, at)] == ["3"]


def test_two_ingests_at_once_add_each_url_once(spark):
    at, schema = folder(spark), "url string, program string, pos long"

    def stream(*urls):
        path = folder(spark)
        for k, u in enumerate(urls):
            spark.createDataFrame([(u, "p", k)], schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    running = [S.ingest(stream(*urls), at, Q.APPLICANT, lambda rows: rows, folder(spark)) for urls in (["a", "b", "c"], ["c", "b", "d"])]
    for q in running:
        q.awaitTermination()
    rows = sorted((r.url, r.p_id) for r in records.read_table(spark, at, Q.APPLICANT).collect())
    assert [u for u, _ in rows] == ["a", "b", "c", "d"] and sorted(n for _, n in rows) == [1, 2, 3, 4]
    assert claims.owner(spark, at) is None


def test_replay_whose_rows_another_stream_has_added(spark):
    """The replayed batch finds its rows elsewhere and takes its own back."""
    at, landed, checkpoint, schema = folder(spark), folder(spark), folder(spark), "url string, program string, pos long"

    def run(check, path, *urls):
        spark.createDataFrame([(u, "p", k) for k, u in enumerate(urls)], schema).coalesce(1).write.mode("append").parquet(path)
        S.ingest(spark.readStream.schema(schema).parquet(path), at, Q.APPLICANT, lambda rows: rows, check).awaitTermination()

    run(checkpoint, landed, "v", "w")
    own = [r.batch for r in spark.read.parquet(at).select("batch").distinct().collect()][0]
    records.append_batch(spark.createDataFrame([], Q.APPLICANT), at, own)  # lost with the failure
    uncommit(spark, checkpoint, 0)
    run(folder(spark), folder(spark), "v", "w")
    run(checkpoint, landed, "x")
    assert sorted(r.url for r in records.read_table(spark, at, Q.APPLICANT).collect()) == ["v", "w", "x"]


# Report


@needs_tables
def test_report_of_parts_is_the_report_of_the_whole(spark):
    rows = Q.applicants(spark, SMALL)
    parts = [written(analytics.cube(rows.filter(f"p_id % 3 = {k}"))) for k in range(3)]
    cubes = parts[0].unionByName(parts[1]).unionByName(parts[2])
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(analytics.report_of(cubes, Q.TERM, Q.LAST_TERM)) == plain(analytics.report(rows, Q.TERM, Q.LAST_TERM))
    assert plain(analytics.whole_report(cubes, Q.TERM, Q.LAST_TERM)) == plain(analytics.whole_report(written(analytics.cube(rows)), Q.TERM, Q.LAST_TERM))


@needs_tables
def test_cube_takes_one_scan(spark):
    plan = analytics.cube(Q.applicants(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 4 and "Expand" not in plan  # orders, customer, nation, region once each


def test_report_of_nothing(spark):
    empty = analytics.cube(spark.createDataFrame([], Q.APPLICANT))
    rows = {(r.section, r.place): r.value for r in analytics.whole_report(empty, "a", "b").collect()}
    assert rows[("answer", 1)] == "0" and rows[("answer", 2)] == "0.00%" and rows[("answer", 4)] == "None" and rows[("trend", 1)] == "no data" and len(rows) == 10


@needs_tables
def test_report_after_a_batch_reads_no_table(spark):
    """Its share comes from the batch, the rest from the shares of earlier ones."""
    at, reports, landed = folder(spark), folder(spark), folder(spark)
    rows = Q.applicants(spark, SMALL).withColumn("pos", F.col("p_id"))
    for k in range(2):
        rows.filter(f"p_id % 2 = {k}").coalesce(1).write.mode("append").parquet(landed)
    S.ingest(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed), at, Q.APPLICANT, lambda r: r, folder(spark), report_to=reports, terms=(Q.TERM, Q.LAST_TERM)).awaitTermination()
    got = {(r.batch, r.number): r.answer for r in spark.read.parquet(reports).collect()}
    for r in analytics.report(rows, Q.TERM, Q.LAST_TERM).collect():
        assert got[(1, r.number)] == r.answer
    assert got[(0, 1)] != got[(1, 1)]


# Z-order


@needs_tables
def test_filter_on_any_indexed_column_skips_files(spark):
    import duckdb

    at, rows = folder(spark), written(Q.applicants(spark, SMALL).select(*Q.APPLICANT.fieldNames()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        records.append_batch(rows, at, "all", Q.INDEXED, interleave=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert records.read_table(spark, at, Q.APPLICANT).count() == rows.count()
    for column, value in zip(Q.INDEXED, (Q.TERM, "Other", "Stanford University", "Physics")):
        spans = duckdb.sql(f"SELECT file_name, min(stats_min_value) lo, max(stats_max_value) hi FROM parquet_metadata('{at.removeprefix('file://')}/*/*.parquet') WHERE path_in_schema = '{column}' GROUP BY file_name").fetchall()
        hit = sum(lo is not None and lo <= value <= hi for _, lo, hi in spans)
        assert len(spans) > 20 and 0 < hit <= 0.75 * len(spans), (column, hit, len(spans))
