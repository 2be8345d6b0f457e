"""A Parquet table kept by key: rows lie in folders by a hash of their key, so that a batch rewrites only the folders it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import load
from .shared import listed, written

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def layout(spark: SparkSession, path: str) -> int | None:
    """How many buckets the table at path has; None before its first row."""
    found = [n.removeprefix("of=") for n in listed(spark, path) if n.startswith("of=")]
    return int(found[0]) if found else None


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    """The rows of the table, or of some of its buckets; none before the first."""
    if layout(spark, path) is None:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("of", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(path)
    return (rows if only is None else rows.filter(F.col("bucket").isin(only))).select(*schema.fieldNames())


def lookup(spark: SparkSession, path: str, schema: T.StructType, value: str, key: str = "url") -> DataFrame:
    """The row of a key: one bucket is read, and of that the row groups whose range holds the key."""
    buckets = layout(spark, path)
    if buckets is None:
        return spark.createDataFrame([], schema)
    own = spark.range(1).select(bucket_of(F.lit(value), buckets)).first()[0]
    return read_buckets(spark, path, schema, [own]).filter(F.col(key) == value)


def merge(
    batch: DataFrame, path: str, schema: T.StructType, *, update: bool = True, key: str = "url", order: str = "pos", number: str = "p_id",
    not_null: tuple[str, ...] = ("url", "program"), buckets: int = BUCKETS,
) -> DataFrame:
    """Stores a batch by upsert (of equal keys the last row by order counts, nulls overwrite), or without update by insert-ignore (the first).

    Rows that are there keep their number; new ones are numbered in the order given after the largest. Returns one row:
    stored (keys of the batch), added (new ones), buckets (rewritten).

    Constraints are checked and all rows that will be written are complete before a folder is touched; then Spark's
    dynamic overwrite replaces the folders of the batch's buckets, all others keep their files. A batch that is stored again
    after a failure in between leaves the same rows. One writer at a time; see claims.
    """
    spark = batch.sparkSession
    had = layout(spark, path)
    if had not in (None, buckets):
        raise ValueError(f"the table has {had} buckets, not {buckets}")
    nulls, new = Observation(), Observation()
    checked = batch.observe(nulls, *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null)) if not_null else batch
    rows = written(load.one_per_key(checked, key, order, last=update).withColumn("bucket", bucket_of(F.col(key), buckets)), "incoming")
    load.refuse(nulls.get if not_null else {})
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # a number for each bucket
    old = read_buckets(spark, path, schema, touched)
    fresh = rows.join(old.select(key).hint("merge"), key, "left_anti").drop("bucket", number)  # files' sizes say little about compressed keys
    added = load.with_surrogate(read_buckets(spark, path, schema).select(number), fresh, order).drop(order).observe(new, F.count(F.lit(1)).alias("n"))
    kept = load.replaced(old, rows.drop("bucket", order), key, keep=(number,)) if update else old
    both = kept.unionByName(spark.createDataFrame([], schema).unionByName(added, allowMissingColumns=True).select(*schema.fieldNames()))
    placed = both.withColumns({"of": F.lit(buckets), "bucket": bucket_of(F.col(key), buckets)}).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    if not touched:
        return spark.createDataFrame([(0, 0, 0)], "stored long, added long, buckets int")
    written(placed, "merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)
    return rows.agg(F.count("*").alias("stored")).select("stored", F.lit(new.get["n"]).cast("long").alias("added"), F.lit(len(touched)).alias("buckets"))
