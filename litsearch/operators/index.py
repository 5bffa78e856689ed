"""Index sink and upsert.

The reference writes one index item per paper and call; here one round's
items for all questions are one DataFrame, appended as a batch. Repeated
object ids are resolved as "latest version wins" by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.functions.paper import index_text
from litsearch.functions.text import token_count
from litsearch.schemas import INDEX_CATEGORY, MAX_INDEX_TOKENS


def indexable(papers: DataFrame, max_tokens: int = MAX_INDEX_TOKENS,
              n_tokens_col: str | None = "n_tokens") -> DataFrame:
    """F2 + F3: non-empty abstract with at most ``max_tokens`` tokens.

    When ``n_tokens`` was computed at ingest, the filter is a plain column
    predicate that reaches the parquet scan.
    """
    n = F.col(n_tokens_col) if n_tokens_col and n_tokens_col in papers.columns \
        else token_count("abstract")
    return papers.where((F.col("abstract") != F.lit("")) & (n <= F.lit(int(max_tokens))))


def index_rows(papers_for_question: DataFrame, max_tokens: int = MAX_INDEX_TOKENS, count=token_count) -> DataFrame:
    """Index items for (question, paper) rows.

    Input: query_id, user_query, pmc_id, abstract (+ optional n_tokens). ``count``
    gives an abstract's number of tokens where the rows do not bring it (P12).
    Output: query_id, object_id, data, properties, category, n_tokens.
    """
    rows = papers_for_question
    if "n_tokens" not in rows.columns:
        rows = rows.withColumn("n_tokens", count("abstract"))
    rows = indexable(rows, max_tokens)
    return rows.select(
        "query_id",
        F.col("pmc_id").alias("object_id"),
        index_text("user_query", "abstract").alias("data"),
        F.lit("").alias("properties"),
        F.lit(INDEX_CATEGORY).alias("category"),
        F.col("n_tokens").cast("int").alias("n_tokens"),
    )


def latest_per_object(log: DataFrame, key: str = "object_id",
                      version_cols=("version",)) -> DataFrame:
    """The latest row per key of an append-only index log.

    ``max_by`` over a struct keeps one row per key in a hash aggregate with
    partial aggregation before the shuffle; a key written many times costs
    one partial row per partition, not one row per write.
    """
    others = [c for c in log.columns if c != key]
    order = F.struct(*[F.col(c) for c in version_cols])
    payload = F.struct(*[F.col(c) for c in others])
    agg = log.groupBy(key).agg(F.max_by(payload, order).alias("_row"))
    return agg.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])
