"""Merging similarity hits into a round's papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, keys=("query_id", "pmc_id"), position: str = "rk") -> DataFrame:
    """One row per key, the last by ``position`` wins (papers map)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(position))
    return df.withColumn("_last", F.row_number().over(w)).where(F.col("_last") == 1).drop("_last")


def score_papers(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """J1 + F5: hits joined to this round's papers on (query_id, pmc_id).

    ``papers`` must already be de-duplicated (J3). A hit on a paper that is
    not in the round is dropped by the inner join.
    """
    h = hits.select("query_id", "pmc_id", "hit_rank", "search_score")
    p = papers.drop("search_score") if "search_score" in papers.columns else papers
    return p.join(h, ["query_id", "pmc_id"], "inner")


def score_papers_left(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """Every paper of the round, with its hit score or 0."""
    h = hits.select("query_id", "pmc_id", "hit_rank", "search_score")
    p = papers.drop("search_score") if "search_score" in papers.columns else papers
    return (p.join(h, ["query_id", "pmc_id"], "left")
            .withColumn("search_score", F.coalesce(F.col("search_score"), F.lit(0.0).cast("float"))))


def above_threshold(scored: DataFrame, threshold_col: str = "threshold") -> DataFrame:
    """strict ``>`` with both sides FLOAT (as the reference compares)."""
    return scored.where(F.col("search_score").cast("float") > F.col(threshold_col).cast("float"))


def all_abstracts_empty(active: DataFrame, papers: DataFrame) -> DataFrame:
    """A1 per question: true when every abstract is empty or there is no paper.

    Aggregates the round's papers per question, then a left join from the
    active questions supplies ``true`` for questions without any paper.
    """
    empty = F.col("empty_abstract") if "empty_abstract" in papers.columns \
        else (F.col("abstract") == F.lit(""))
    per_q = papers.groupBy("query_id").agg(
        F.bool_and(empty).alias("_all_empty"),
        F.count(F.lit(1)).alias("n_papers"))
    return (active.select("query_id").join(per_q, "query_id", "left")
            .select("query_id",
                    F.coalesce(F.col("_all_empty"), F.lit(True)).alias("all_empty"),
                    F.coalesce(F.col("n_papers"), F.lit(0)).cast("long").alias("n_papers")))


def result_counts(active: DataFrame, rows: DataFrame) -> DataFrame:
    """A4: accumulated result rows per question (0 when none)."""
    per_q = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return (active.select("query_id").join(per_q, "query_id", "left")
            .select("query_id", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_results")))


def first_per_paper(rows: DataFrame) -> DataFrame:
    """Optional distinct-papers mode: keep the first row per (question, paper)."""
    w = Window.partitionBy("query_id", "pmc_id").orderBy("round", "hit_rank")
    return rows.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")
