"""Request sources: JSON bodies (POST form), query-only (GET form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.functions.paper import effective_amount, effective_threshold
from litsearch.schemas import REQUEST_BODY
from litsearch.session import scratch_path


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, schema given (no inference)."""
    return spark.read.schema(REQUEST_BODY).json(path)


def _numbered(rows: DataFrame, name: str, number: str) -> DataFrame:
    """``rows`` with a number of their own, stored, so that it stays when they are read again."""
    path = scratch_path(rows.sparkSession, name)
    numbered = rows.withColumn(number, F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)


def with_ids(requests: DataFrame) -> DataFrame:
    """Give a ``query_id`` to requests that come without one.

    The id is a hash of the content plus the row's number in a stored table, so
    equal requests never meet in one task and the id is the same whenever the
    returned frame is computed again.
    """
    content = F.hex(F.xxhash64("query", "amount", "threshold", "remote_addr"))
    lacking = _numbered(requests.where(F.col("query_id").isNull()), "requests-without-id", "_number")
    lacking = lacking.withColumn("query_id", F.concat(
        F.lit("r"), content, F.lit("-"), F.col("_number").cast("string"))).drop("_number")
    return requests.where(F.col("query_id").isNotNull()).unionByName(lacking)


def requests_to_queries(requests: DataFrame) -> DataFrame:
    """Body columns renamed to the ``queries`` layout; missing ids are assigned."""
    return with_ids(requests).select(
        F.col("query_id"), F.col("query").alias("user_query"),
        F.coalesce(F.col("remote_addr"), F.lit("")).alias("remote_addr"),
        F.col("amount").cast("int").alias("amount"),
        F.col("threshold").cast("float").alias("threshold"))


def get_requests(paths: DataFrame) -> DataFrame:
    """A question taken from the path only; amount and threshold are 0.

    Input: query_id, user_query, remote_addr.
    """
    return paths.select("query_id", "user_query", "remote_addr",
                        F.lit(0).cast("int").alias("amount"),
                        F.lit(0.0).cast("float").alias("threshold"))


def validate_requests(queries: DataFrame) -> DataFrame:
    """adds ``status`` (accepted / rejected) and ``reason``.

    The question is required and at least one character long. A negative
    amount is rejected too (it would fail later), and so are all but one of
    the requests that bring the same id. Requests without an id share none.
    """
    q = F.col("user_query")
    content = F.xxhash64(*[c for c in queries.columns if c != "query_id"])
    own = F.struct(content.alias("content"), F.col("_number").alias("number"))
    queries = _numbered(queries, "requests", "_number").withColumn("_own", own)
    first = (queries.where(F.col("query_id").isNotNull()).groupBy("query_id")
             .agg(F.min("_own").alias("_first")))
    queries = queries.join(first, "query_id", "left").select(*queries.columns, "_first")
    reason = (F.when(q.isNull(), F.lit("query is required"))
              .when(F.length(q) < 1, F.lit("query is empty"))
              .when(F.coalesce(F.col("amount"), F.lit(0)) < 0, F.lit("amount is negative"))
              .when(F.col("_own") != F.col("_first"), F.lit("query_id is taken"))
              .otherwise(F.lit("")))
    return (queries.withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason") == "", F.lit("accepted"))
                        .otherwise(F.lit("rejected"))).drop("_number", "_own", "_first"))


def accepted(queries: DataFrame) -> DataFrame:
    return validate_requests(queries).where(F.col("status") == "accepted") \
        .drop("status", "reason")


def apply_defaults(queries: DataFrame) -> DataFrame:
    """Amount 0 -> 3, threshold 0 -> 0.3 (FLOAT)."""
    return (queries.withColumn("amount", effective_amount("amount"))
            .withColumn("threshold", effective_threshold("threshold")))
