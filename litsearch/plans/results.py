"""Result documents (A5, S5): one nested row / JSON document per question.

Layout of the document (field names and order fixed by the service):
``{"ts": <epoch ms>, "data": {"query", "papers": [Paper...], "keywords":
[attempted search strings], "threshold", "paper_count"}}``; the GET form
nests the result under ``"resq"``. Lists that the service leaves unset are
written as ``null`` (no papers, a paper without keywords).

Per question the lists are bounded: at most ``amount`` papers (and never
more than rounds x hits) and at most 12 attempted strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsearch.schemas import PAPER_FIELDS

PAPER_ORDER = [f.name for f in PAPER_FIELDS]


def _null_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def result_rows(ranked: DataFrame, attempts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id + the ``SearchResult`` struct columns (nested, not JSON)."""
    paper = F.struct(F.col("rk"), F.struct(
        *[(F.col(n) if n != "keywords" else _null_if_empty(F.col(n))).alias(n)
          for n in PAPER_ORDER]).alias("p"))
    papers = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(paper)).alias("_papers"),
        F.max("paper_count").alias("paper_count"))
    tried = attempts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("round", "query_text"))).alias("_tried"))
    q = queries.select("query_id", "user_query", "threshold")
    out = q.join(papers, "query_id", "left").join(tried, "query_id", "left")
    return out.select(
        "query_id",
        F.col("user_query").alias("query"),
        _null_if_empty(F.transform("_papers", lambda x: x["p"])).alias("papers"),
        _null_if_empty(F.transform("_tried", lambda x: x["query_text"])).alias("keywords"),
        F.col("threshold").cast("float").alias("threshold"),
        F.coalesce(F.col("paper_count"), F.lit(0)).cast("int").alias("paper_count"),
    )


def go_json_escape(c: Column) -> Column:
    """HTML-safe escaping as the service's JSON encoder does it."""
    c = F.replace(c, F.lit("&"), F.lit("\\u0026"))
    c = F.replace(c, F.lit("<"), F.lit("\\u003c"))
    c = F.replace(c, F.lit(">"), F.lit("\\u003e"))
    c = F.replace(c, F.lit("\u2028"), F.lit("\\u2028"))
    return F.replace(c, F.lit("\u2029"), F.lit("\\u2029"))


def result_documents(results: DataFrame, ts: int, wrap: str | None = None) -> DataFrame:
    """(query_id, document) with the envelope; ``wrap='resq'`` for GET."""
    data = F.struct(*[F.col(c) for c in ("query", "papers", "keywords", "threshold",
                                         "paper_count")])
    if wrap:
        data = F.struct(data.alias(wrap))
    env = F.struct(F.lit(int(ts)).cast("long").alias("ts"), data.alias("data"))
    doc = F.to_json(env, {"ignoreNullFields": "false"})
    return results.select("query_id", go_json_escape(doc).alias("document"))
