"""Queries against their SQL on the smallest tables, the table that batches are added to, and the stream."""

import os

import duckdb
import pytest

from fieldmill.operators import analytics, load
from fieldmill.plans import queries as Q
from fieldmill.sources import records
from fieldmill.sources.shared import folder
from fieldmill.streaming.ingest import ingest

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "orders", "events", "documents", "pages"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: None if v is None or v != v else f"{float(v):.5g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return [names[k] for k in order], sorted([tuple(value(r[k]) for k in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_agrees_with_sql(spark, sql, name):
    df = Q.QUERIES[name](spark, SMALL)
    expected = sql.sql(Q.SQL[name])
    assert plain(df.columns, df.collect()) == plain(expected.columns, expected.fetchall())


def rows_of(spark, *urls, program="p"):
    rows = spark.createDataFrame([(u, program, k) for k, u in enumerate(urls)], "url string, program string, pos long")
    return spark.createDataFrame([], Q.APPLICANT).unionByName(rows.drop("pos"), allowMissingColumns=True)


def test_batch_written_again_takes_its_own_place(spark):
    at = folder(spark)
    urls = lambda: sorted(r.url for r in records.read_table(spark, at, Q.APPLICANT).collect())
    assert urls() == []
    records.append_batch(rows_of(spark, "u"), at, "b1")
    records.append_batch(rows_of(spark, "v", "w"), at, "b2")
    records.append_batch(rows_of(spark, "v", "w"), at, "b2")
    assert urls() == ["u", "v", "w"]
    assert [r.url for r in records.read_table(spark, at, Q.APPLICANT, without="b2").collect()] == ["u"]


def stream_of(spark, path, *urls, program="p"):
    spark.createDataFrame([(u, program, k) for k, u in enumerate(urls)], "url string, program string, pos long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("url string, program string, pos long").parquet(path)


def test_two_streams_and_a_replay_into_one_table(spark):
    at, landed, checkpoint = folder(spark), folder(spark), folder(spark)
    urls = lambda: sorted((r.url, r.p_id) for r in records.read_table(spark, at, Q.APPLICANT).collect())
    run = lambda stream, check: ingest(stream, at, Q.APPLICANT, lambda rows: rows, check).awaitTermination()
    run(stream_of(spark, landed, "u0"), checkpoint)
    run(stream_of(spark, folder(spark), "u1"), folder(spark))
    assert urls() == [("u0", 1), ("u1", 2)]
    run(stream_of(spark, landed, "u2", "u0"), checkpoint)
    assert urls() == [("u0", 1), ("u1", 2), ("u2", 3)]
    fs = spark._jvm.org.apache.hadoop.fs.Path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("1", ".1.crc"):  # as if the stream had failed after the last batch was written, before it was committed
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{name}"), False)
    run(stream_of(spark, landed, "u3"), checkpoint)
    assert [u for u, _ in urls()] == ["u0", "u1", "u2", "u3"]


def test_batch_that_breaks_a_constraint_leaves_the_table(spark):
    at, landed, checkpoint = folder(spark), folder(spark), folder(spark)
    ingest(stream_of(spark, landed, "u0"), at, Q.APPLICANT, lambda rows: rows, checkpoint).awaitTermination()
    with pytest.raises(Exception, match="breaks constraints"):
        ingest(stream_of(spark, landed, "u1", program=None), at, Q.APPLICANT, lambda rows: rows, checkpoint).awaitTermination()
    assert [r.url for r in records.read_table(spark, at, Q.APPLICANT).collect()] == ["u0"]


def test_filter_on_a_clustered_table_skips_files(spark):
    at = folder(spark)
    rows = Q.applicants(spark, SMALL).select(*[f.name for f in Q.APPLICANT.fields])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    records.append_batch(rows, at, "all")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = duckdb.sql(f"SELECT file_name, min(stats_min_value) lo, max(stats_max_value) hi FROM parquet_metadata('{at.removeprefix('file://')}/*/*.parquet') WHERE path_in_schema = 'term' GROUP BY file_name").fetchall()
    assert len(spans) > 2 and sum(lo <= Q.TERM <= hi for _, lo, hi in spans if lo) < len(spans)
    plan = records.read_table(spark, at, Q.APPLICANT).filter(f"term = '{Q.TERM}'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term" in plan


def test_lookup_of_a_repeated_url_is_an_error(spark):
    rows = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "p_id long, url string")
    assert [r.url for r in analytics.lookup(rows, "v").collect()] == ["v"] and analytics.lookup(rows, "w").count() == 0
    with pytest.raises(Exception, match="more than one row"):
        analytics.lookup(rows, "u").collect()


def test_numbers_and_firsts_with_null_order(spark):
    none = spark.createDataFrame([], "p_id long, url string")
    rows = spark.createDataFrame([("a", None), ("a", 5), ("b", None), ("c", 10**12), ("d", 1)], "url string, pos long")
    first = load.one_per_key(rows, "url", "pos", last=False)
    assert sorted(first.collect(), key=str) == sorted([("a", 5), ("b", None), ("c", 10**12), ("d", 1)], key=str)
    numbers = {r.url: r.p_id for r in load.with_surrogate(none, first, "pos").collect()}
    assert numbers == {"d": 1, "a": 2, "c": 3, "b": 4}


def test_cleaning_does_each_pattern_once(spark):
    plan = Q.QUERIES["clean_records"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 13 and plan.count("regexp_extract(") <= 10
    assert "Window" not in Q.QUERIES["survey_rows"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_missing_dictionary_is_empty(spark):
    assert records.read_dictionary(spark, folder(spark)).count() == 0


def test_nothing_is_written_for_an_empty_table(spark):
    assert not records.write_json(spark.createDataFrame([], "a string"), folder(spark))


def test_one_scan_for_the_report(spark):
    plan = Q.QUERIES["analysis_report"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey") and plan.count("Relation") == 4  # orders, customer, nation, region once each
