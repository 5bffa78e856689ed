"""Conversation per address (C1): first request of an address names it.

Batch: the id of an address's first request (by time, then id) is found by
one aggregation (``min_by`` with partial aggregation, so an address with a
third of all requests is still reduced map-side) and joined back.
Stream: a table of known addresses; see ``start_conversation_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.session import few, materialize

NAMES_SENT = 10_000   # addresses of a micro-batch up to which its requests meet them without a shuffle


def assign_conversations(requests: DataFrame, key: str = "addr", order=("ts", "request_id"),
                         request_id: str = "request_id") -> DataFrame:
    """Adds ``conversation_id`` = id of the first request of the same key."""
    first = requests.groupBy(key).agg(
        F.min_by(F.col(request_id), F.struct(*[F.col(c) for c in order])).alias("conversation_id"))
    return requests.join(first, key).select(request_id, key, "conversation_id")


def unsent(names: DataFrame, small: bool) -> DataFrame:
    """``names`` for a join, by a shuffle unless ``small``, whatever size Spark takes them for."""
    return names if small else names.hint("merge")


def start_conversation_stream(stream: DataFrame, sink_dir: str, state_dir: str, checkpoint_dir: str,
                              available_now: bool = True, buckets: int = 64):
    """C1 on a stream of (request_id, addr, ts): the first request of an address ever seen names it.

    Ids and addresses are of any type. Per micro-batch the first request of each address
    is found by one partial aggregation, so an address with a third of all rows is no
    task of its own; these few rows meet the table of known addresses, of which a
    batch reads the buckets that it needs, and the rest joins back. Only up to ``NAMES_SENT`` addresses
    go through the driver for that, so what it is sent in all does not grow with the addresses of a batch. New addresses are
    appended under the batch's number, and so is the output: a batch that is run
    again reads only what earlier batches left and overwrites its own rows. An address
    keeps its conversation for good (the service's cache has no expiry either).
    Null addresses are one address.
    """
    spark = stream.sparkSession
    key = stream.schema["addr"].dataType.simpleString()
    named = stream.schema["request_id"].dataType.simpleString()
    state_schema = f"addr {key}, conversation_id {named}, batch_id bigint, bucket int"
    spark.createDataFrame([], state_schema).write.mode("append").partitionBy("batch_id", "bucket").parquet(state_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("request_id", "addr", "ts")
        first = batch.groupBy("addr").agg(
            F.min_by("request_id", F.struct("ts", "request_id")).alias("first_id"))
        first, small = few(first.withColumn("bucket", F.pmod(F.xxhash64("addr"), F.lit(buckets)).cast("int")), "first-seen", NAMES_SENT)
        known = (spark.read.schema(state_schema).parquet(state_dir).where(F.col("batch_id") < int(batch_id))
                 .select("bucket", F.col("addr").alias("_addr"), "conversation_id"))
        first = first.withColumnRenamed("bucket", "_bucket").where("_bucket >= 0")
        same = (F.col("_bucket") == F.col("bucket")) & F.col("addr").eqNullSafe(F.col("_addr"))
        # few addresses go to the known ones, of which only theirs come back
        known = known.join(first.select("_bucket", "addr"), same, "left_semi") if small else known
        now = first.join(unsent(known, small), same, "left")
        now = materialize(now.select("addr", "first_id", "conversation_id", F.col("_bucket").alias("bucket")), "conversations")
        (now.where("conversation_id is null").select("addr", F.col("first_id").alias("conversation_id"), "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/batch_id={int(batch_id)}"))
        names = now.select(F.col("addr").alias("_addr"), F.coalesce("conversation_id", "first_id").alias("conversation_id"))
        (batch.join(unsent(names, small), F.col("addr").eqNullSafe(F.col("_addr"))).select("request_id", "addr", "conversation_id")
         .write.mode("overwrite").parquet(f"{sink_dir}/batch_id={int(batch_id)}"))

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
