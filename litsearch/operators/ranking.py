"""Final ranking of a question's accumulated results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_results(rows: DataFrame, params: DataFrame) -> DataFrame:
    """T4 + F6 per question.

    ``rows``: query_id, round, hit_rank, pmc_id, search_score, ... (bag).
    ``params``: query_id, amount (effective).
    If ``amount`` exceeds the number of rows ``n`` all rows stay in append
    order (round, hit rank) and ``paper_count = n``; otherwise the rows are
    sorted by score (desc) and the first ``amount`` kept, ``paper_count =
    amount``. Ties, undefined in the reference, are broken by append order.
    """
    r = rows.join(params.select("query_id", "amount"), "query_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    r = r.withColumn("n_found", n)
    keep_all = F.col("amount") > F.col("n_found")
    sort_key = F.when(keep_all, F.lit(0.0)).otherwise(-F.col("search_score").cast("double"))
    w = Window.partitionBy("query_id").orderBy(sort_key, "round", "hit_rank", "pmc_id")
    r = r.withColumn("rk", F.row_number().over(w))
    r = r.where(keep_all | (F.col("rk") <= F.col("amount")))
    return r.withColumn("paper_count", F.least(F.col("amount"), F.col("n_found")).cast("int")) \
        .drop("n_found")
