"""Connected components of links as Spark jobs (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
    return tuple(r)


def _pointed(edges: DataFrame, at: str, to: str) -> DataFrame:
    """Edges with ``root``: the least of ``at`` and all that it has an edge to."""
    least = stored(edges.groupBy(at).agg(F.min(to).alias("_m"))
                   .select(at, F.least(at, "_m").alias("root")), "least")
    return edges.join(least, at)  # both sides are exchanged, so a hub's rows can be split


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that it is connected with, for every node of ``links`` (a, b).

    Each step points neighbours at the least node around; it ends when nothing
    changes, after about a logarithm of the longest chain. Every step is stored
    in the shared folder. Self links and repeated links do no harm; null ends
    are ignored; without links there are no rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
                   .distinct(), "edges")
    before, now = None, _mark(edges)
    while now != before:
        both = edges.union(edges.select("low", "high")).toDF("u", "v")
        large = (_pointed(both, "u", "v").where("v > u")
                 .select(F.col("v").alias("high"), F.col("root").alias("low")).where("high <> low").distinct())
        large = stored(large, "large-star")
        small = _pointed(large, "high", "low")
        edges = stored(small.select(F.explode(F.array(F.struct("high", "root"), F.struct(F.col("low").alias("high"), "root")))
                                    .alias("e")).select("e.high", F.col("e.root").alias("low"))
                       .where("high <> low").distinct(), "small-star")
        before, now = now, _mark(edges)
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return stars.union(stars.select("root", "root")).distinct().toDF("node", "root")
