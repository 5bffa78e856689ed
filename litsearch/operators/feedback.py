"""Keyword feedback: weights, top keywords, next search string."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsearch.functions.paper import search_string
from litsearch.schemas import TOP_KEYWORDS


def keyword_weights(papers: DataFrame) -> DataFrame:
    """A2: sum of ``search_score`` over the papers carrying a keyword.

    A keyword listed twice in one paper counts twice; papers with score 0
    keep their keywords at weight 0. Partial aggregation before the shuffle
    on (query_id, keyword) keeps a hot keyword to one row per partition.
    """
    kw = papers.select("query_id", "search_score", F.explode("keywords").alias("keyword"))
    return kw.groupBy("query_id", "keyword").agg(
        F.sum(F.col("search_score").cast("double")).alias("weight"))


def top_keywords(weights: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """The ``k`` heaviest keywords per question; ties by keyword."""
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), F.asc("keyword"))
    return (weights.withColumn("kw_rank", F.row_number().over(w))
            .where(F.col("kw_rank") <= F.lit(int(k))))


def feedback_query(top: DataFrame) -> DataFrame:
    """A3 + P11: distinct keywords in rank order joined by one space."""
    ordered = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("kw_rank", "keyword"))).alias("_kw"))
    kws = F.array_distinct(F.transform("_kw", lambda x: x["keyword"]))
    return ordered.select("query_id", kws.alias("keywords"), search_string(kws).alias("next_query"))
