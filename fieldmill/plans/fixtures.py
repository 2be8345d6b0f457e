"""Views that derive application records from the driver's order tables; the text runs on Spark and on DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One application for each order, as a row of the applicants table.
APPLICANTS = r"""
SELECT o_orderkey + 1 AS p_id,
 CASE o_orderkey % 7 WHEN 0 THEN 'Computer Science, MIT' WHEN 1 THEN 'computer science, Summit College'
   WHEN 2 THEN 'Computer Science, Stanford University' WHEN 3 THEN 'Physics, Carnegie Mellon University'
   WHEN 4 THEN 'Computer Science, Johns Hopkins University' WHEN 5 THEN 'Computer Science, CMU'
   ELSE 'History, Georgetown University' END AS program,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'note ' || o_orderpriority END AS comments,
 CAST(o_orderdate AS DATE) AS date_added,
 'https://example.org/result/' || CAST(o_orderkey AS STRING) AS url,
 CASE o_orderstatus WHEN 'F' THEN 'Accepted on 1 Feb' WHEN 'O' THEN 'Rejected on 3 Mar' ELSE 'Wait listed' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'TBD' ELSE
   CASE WHEN EXTRACT(MONTH FROM o_orderdate) <= 3 THEN 'Spring ' WHEN EXTRACT(MONTH FROM o_orderdate) <= 6 THEN 'Summer '
        WHEN EXTRACT(MONTH FROM o_orderdate) <= 9 THEN 'Fall ' ELSE 'Winter ' END
   || CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) END AS term,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '   ' WHEN r_name = 'AMERICA' THEN 'American'
   ELSE 'International' END AS us_or_international,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(((o_orderkey * 37) % 490) / 100.0 AS FLOAT) END AS gpa,
 CASE WHEN o_orderkey % 10 = 0 THEN CAST(130 + o_orderkey % 41 AS FLOAT) END AS gre,
 CASE WHEN o_orderkey % 15 = 0 THEN CAST(130 + o_orderkey % 37 AS FLOAT) END AS gre_v,
 CASE WHEN o_orderkey % 20 = 0 THEN CAST((o_orderkey % 13) / 2.0 AS FLOAT) END AS gre_aw,
 CASE o_orderkey % 5 WHEN 0 THEN 'Masters' WHEN 1 THEN 'PhD' WHEN 2 THEN 'PhD' WHEN 3 THEN 'Masters' ELSE 'Other' END AS degree,
 CASE o_orderkey % 7 WHEN 3 THEN 'Physics' WHEN 6 THEN 'History' ELSE 'Computer Science' END AS llm_generated_program,
 CASE o_orderkey % 7 WHEN 0 THEN 'Massachusetts Institute of Technology' WHEN 1 THEN 'Summit College'
   WHEN 2 THEN 'Stanford University' WHEN 3 THEN 'Carnegie Mellon University' WHEN 4 THEN 'Johns Hopkins University'
   WHEN 5 THEN NULL ELSE 'Georgetown University' END AS llm_generated_university
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
"""

#: One raw entry for each order, as pages give them.
RAW_ENTRIES = r"""
SELECT CAST(o_orderkey AS STRING) AS entry_id,
 '  ' || CASE o_orderkey % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Stanford   University' ELSE 'McG' END || ' ' AS raw_school_text,
 CASE o_orderkey % 4 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Drama' WHEN 2 THEN 'Info Studies' ELSE '' END || ' ' ||
   CASE o_orderkey % 6 WHEN 0 THEN 'Masters' WHEN 1 THEN 'PhD' WHEN 2 THEN 'Ph.D.' WHEN 3 THEN 'msc' WHEN 4 THEN '' ELSE 'Other' END AS raw_program_text,
 CASE WHEN o_orderkey % 9 = 0 THEN 'added on ' WHEN o_orderkey % 9 = 1 THEN 'Added on ' ELSE '' END ||
   SUBSTRING('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * EXTRACT(MONTH FROM o_orderdate) - 2 AS INT), 3) || ' ' ||
   CASE WHEN o_orderkey % 50 = 7 THEN '31' ELSE CAST(EXTRACT(DAY FROM o_orderdate) AS STRING) END || ', ' ||
   CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) AS raw_added_on_text,
 CASE o_orderstatus WHEN 'F' THEN 'Accepted on 1 Feb' WHEN 'O' THEN 'Rejected on 3 Mar' ELSE 'Wait listed' END AS raw_decision_text,
 CASE o_orderstatus WHEN 'F' THEN 'Accepted on Feb 1' WHEN 'O' THEN 'Rejected on Mar 3' ELSE 'Wait listed' END || '  fall ' ||
   CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN ' International' WHEN 1 THEN ' american' ELSE ' Other' END ||
   CASE WHEN o_orderkey % 4 = 0 THEN ' GRE ' || CAST(130 + o_orderkey % 41 AS STRING) ELSE '' END ||
   CASE WHEN o_orderkey % 8 = 0 THEN ' GRE V ' || CAST(130 + o_orderkey % 37 AS STRING) || ' GRE AW 4.5' ELSE '' END ||
   CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' GPA ' || CAST(o_orderkey % 6 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) END AS raw_meta_text,
 CASE WHEN o_orderkey % 3 = 2 THEN 'just a comment' ELSE
   CASE o_orderstatus WHEN 'F' THEN 'Accepted on Feb 1' WHEN 'O' THEN 'Rejected on Mar 3' ELSE 'Wait listed' END || ' Fall ' ||
   CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) || ' International GPA 3.5  So   happy' END AS raw_comment_text,
 CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE 'https://example.org/result/' || CAST(o_orderkey AS STRING) END AS url
FROM orders
"""


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out where it comes in fewer parts than there are cores, as a small file of one row group does; worth it before text work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "customer", "nation", "region")
    return spark.sql(APPLICANTS)


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("o_orderkey", "o_orderdate", "o_orderstatus")
    spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*columns)).createOrReplaceTempView("orders")
    return spark.sql(RAW_ENTRIES)


#: What loose pages add to each school, as written and as read.
WRITTEN, READ = " &Eacute;cole&nbsp;&#233;&#x2019;s &eacute &amp;amp; &nosuch;", " École é’s é &amp; &nosuch;"


def survey_pages(spark: SparkSession, sf_dir: str, per_page: int = 20, blocked_every: int = 97, *, loose: bool = False) -> DataFrame:
    """page_no, url, html: the raw entries as survey pages, each with a link to the next; some pages are blocked.

    Loose pages close neither rows nor cells, leave out quotes, have references, and rows and links in comments and scripts.
    """
    e = raw_entries(spark, sf_dir).withColumn("n", F.col("entry_id").cast("long"))
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c), F.lit("</td>"))
    row = lambda *c: F.concat(F.lit("<tr>"), *c, F.lit("</tr>"))
    link = F.concat(F.lit('<td><a href="/result/'), F.col("entry_id"), F.lit('">See</a></td>'))
    main = row(*(cell(f"raw_{c}_text") for c in ("school", "program", "added_on", "decision")), link)
    if loose:
        cell, row = (lambda c: F.concat(F.lit("<TD class='a>b' id=c>"), F.col(c))), (lambda *c: F.concat(F.lit("<tr style=x>"), *c))
        link = F.concat(F.lit("<td><a class=more href=/result/"), F.col("entry_id"), F.lit('>See</a><!-- <tr><td><a href="/result/0">old</a></td></tr> --><script>"<tr><a href=/result/1>"</script>'))
        main = row(F.concat(cell("raw_school_text"), F.lit(WRITTEN)), *(cell(f"raw_{c}_text") for c in ("program", "added_on", "decision")), link)
    html = F.concat(main, row(cell("raw_meta_text")), row(F.lit("<td> </td>")), row(cell("raw_comment_text")), row(F.lit("<td>too far down</td>")))
    page = F.floor(F.col("n") / per_page)
    grouped = e.groupBy(page.alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", html.alias("h")))), lambda x: x["h"]), "\n").alias("rows"))
    blocked = F.when(F.col("page_no") % blocked_every == blocked_every - 1, "<p>Please solve this CAPTCHA</p>").otherwise("")
    body = F.concat(
        F.lit("<html><body>"), blocked, F.lit("<table>"), "rows", F.lit('</table><a href="/survey">Previous</a> <a href="?page='),
        (F.col("page_no") + 1).cast("string"), F.lit('">Next</a></body></html>'),
    )
    return grouped.select("page_no", F.concat(F.lit("https://example.org/survey?page="), F.col("page_no").cast("string")).alias("url"), body.alias("html"))
