"""Article dumps that arrive over time, one repeat for records that do not decode, then a reject.

Every micro-batch decodes its records once and writes, by batch id, one row per
delivered record to ``papers`` (without text where it did not decode) and the narrow part of it, which decides, to
``attempts``; a batch that is run again overwrites its own rows. A record is named by its
article id, or by file and offset where none can be read. Its first two
deliveries decide: the first that decodes stands (``accepted``, or ``recovered`` on the
second); if the first fails, the record waits for one more delivery (``waiting``);
if that fails too, it is ``rejected`` for good, with the error's line and column. Later deliveries of
a decided record change nothing; versions of index rows are the matter of ``streaming/search.py``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.schemas import ID_TYPE_PMC, PAPER_COLUMNS
from litsearch.sources.dumps import register
from litsearch.sources.xml import decode, flatten

MOST_ATTEMPTS = 2
AT = ["arrived", "file", "offset"]  # the order of deliveries, whatever micro-batches they come in


def record_name():
    """Names a record: its id as far as it can be read in the raw text, or else where it was."""
    raw = F.regexp_extract("article_xml", f'pub-id-type="{ID_TYPE_PMC}"[^>]*>([^<]*)<', 1)
    return F.when(raw != "", raw).otherwise(F.concat_ws(":", "file", "offset"))


def start_ingest_stream(spark: SparkSession, dumps_dir: str, log_dir: str, checkpoint_dir: str,
                        available_now: bool = True, **options):
    """Stream of dump files -> ``log_dir``/attempts and ``log_dir``/papers, by batch id."""
    register(spark)
    stream = spark.readStream.format("article_dumps").options(**options).load(dumps_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        named = decode(batch.withColumn("record", record_name()))
        found = ["record", *AT, "ok", "error", "line", "column"]
        rows = flatten(named.select("*", "a.ok", "a.error", F.col("a.error_line").alias("line"),
                                    F.col("a.error_column").alias("column")), *found)
        papers, attempts = (os.path.join(log_dir, n, f"batch_id={int(batch_id)}") for n in ("papers", "attempts"))
        rows.write.mode("overwrite").parquet(papers)
        spark.read.schema(rows.schema).parquet(papers).select(*found).write.mode("overwrite").parquet(attempts)

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def outcomes(spark: SparkSession, log_dir: str) -> DataFrame:
    """record, outcome, attempts (at most two), error, line, column (of the last failure), ``at`` (the one that stands).

    Two partial aggregations; a record that is delivered over and over is never gathered.
    """
    log = spark.read.parquet(os.path.join(log_dir, "attempts"))
    at = F.struct(*AT, "batch_id").alias("at")
    row = F.struct(at, "ok", "error", "line", "column")
    first = log.groupBy("record").agg(F.min_by(row, at).alias("first"))
    again = (log.join(first.where("not first.ok").select("record", F.struct(*[F.col(f"first.at.{c}") for c in AT]).alias("_first")), "record")
             .where(F.struct(*AT) > F.col("_first")).groupBy("record").agg(F.min_by(row, at).alias("second")))
    both = first.join(again, "record", "left")
    failed = F.when(F.col("second").isNotNull() & ~F.col("second.ok"), F.col("second")).when(
        ~F.col("first.ok"), F.col("first"))
    outcome = (F.when(F.col("first.ok"), "accepted").when(F.col("second").isNull(), "waiting")
               .when(F.col("second.ok"), "recovered").otherwise("rejected"))
    return both.select(
        "record", outcome.alias("outcome"), F.when(F.col("second").isNull(), 1).otherwise(MOST_ATTEMPTS).alias("attempts"),
        failed["error"].alias("error"), failed["line"].alias("line"), failed["column"].alias("column"),
        F.when(F.col("first.ok"), F.col("first.at")).when(F.col("second.ok"), F.col("second.at")).alias("at"))


def read_papers(spark: SparkSession, log_dir: str) -> DataFrame:
    """The papers of the deliveries that stand."""
    stands = outcomes(spark, log_dir).where("at is not null").select("record", "at.*")
    rows = spark.read.parquet(os.path.join(log_dir, "papers")).where("ok")
    return rows.join(stands, ["record", *AT, "batch_id"]).select("search_score", *PAPER_COLUMNS)
