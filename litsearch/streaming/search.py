"""Questions arriving continuously (W1) and the index log as a stream.

W1: request files are read with ``readStream`` and every micro-batch runs
the whole batch search (``foreachBatch``); ranked rows are appended to a
parquet sink keyed by the micro-batch id, so a replayed batch overwrites
its own output (idempotent sink). The corpus is prepared once, before the
stream starts.

S7: index items arrive as a stream and are appended to a log partitioned by
micro-batch; "latest version per object" is computed when the log is read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.operators.index import latest_per_object
from litsearch.plans.search import Corpus, SearchConfig, search
from litsearch.schemas import REQUEST_BODY
from litsearch.sources.fixtures import query_terms_from_queries
from litsearch.sources.requests import accepted, requests_to_queries


def start_search_stream(spark: SparkSession, requests_dir: str, sink_dir: str,
                        checkpoint_dir: str, corpus: Corpus, config: SearchConfig | None = None,
                        available_now: bool = True, terms_fn=query_terms_from_queries):
    """Stream of JSON requests -> ranked results (parquet, by batch id)."""
    cfg = config or SearchConfig()
    stream = spark.readStream.schema(REQUEST_BODY).json(requests_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        queries = accepted(requests_to_queries(batch))
        if queries.isEmpty():
            return
        out = search(queries, terms_fn(queries), corpus=corpus, config=cfg)
        (out.ranked.withColumn("batch_id", F.lit(int(batch_id)))
         .write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={int(batch_id)}")))

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()


def start_index_stream(spark: SparkSession, items_dir: str, schema, log_dir: str,
                       checkpoint_dir: str, available_now: bool = True, max_files: int = 1):
    """S7 stream: index items appended to a log, partitioned by batch id."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .parquet(items_dir))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(int(batch_id)))
         .write.mode("overwrite").parquet(os.path.join(log_dir, f"batch_id={int(batch_id)}")))

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()


def read_latest_index(spark: SparkSession, log_dir: str) -> DataFrame:
    """Latest row per object id; later batches win, then higher versions."""
    log = spark.read.parquet(log_dir)
    return latest_per_object(log, key="object_id", version_cols=("batch_id", "version"))
