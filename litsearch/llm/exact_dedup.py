"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. The distinct blocks
are sorted and numbered: equal blocks get one integer, different blocks never
share one. Then adjacent names are paired, the distinct pairs are sorted and
numbered in turn, and so on, until every document has a single name. Two
documents have the same name (at the same level) exactly when their texts are
equal; no step trusts a hash.

Blocks travel once: they are made distinct by (64-bit hash, block), partially
aggregated before the shuffle, so thousands of copies send one row per task.
Documents are matched with names by the hash alone; only where two different
blocks share a hash are the blocks themselves compared again.

Everything is DataFrame operations. Nulls: a null text counts as empty, a null
``doc_id`` sorts below every other. Repeated rows (same id and text) are all
returned, the first of them at most is kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litsearch.llm.common import narrow, stored

BLOCK_CHARS = 4096


def text_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: doc_id, sha (of the whole text), n_blocks, pos, h, block."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    rows = (narrow(docs)
            .select("doc_id", F.sha2("text", 256).alias("sha"), cut.alias("blocks"))
            .select("doc_id", "sha", F.greatest(F.size("blocks"), F.lit(1)).alias("n_blocks"),
                    F.posexplode_outer("blocks").alias("pos", "block")))
    block = F.coalesce("block", F.lit(""))
    return rows.select("doc_id", "sha", "n_blocks", F.coalesce("pos", F.lit(0)).alias("pos"),
                       F.xxhash64(block).alias("h"), block.alias("block"))


def numbered(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct ``keys`` in sorted order with an increasing integer ``name``, as a stored table."""
    ordered = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.select(*by, F.monotonically_increasing_id().alias("name")), "names")


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, sha, copies (rows with this id and text), level, name: the identity is (level, name)."""
    blocks = text_blocks(docs, block_chars)
    distinct = blocks.select("h", "block").distinct()
    per_hash = stored(distinct.groupBy("h").agg(F.count("*").alias("n")), "block-hashes")
    rows = stored(blocks.groupBy("doc_id", "sha", "n_blocks", "pos", "h")
                  .agg(F.count("*").alias("copies")).withColumn("rank", F.lit(1)), "blocks")
    keys = per_hash.select("h", F.lit(1).alias("rank"))
    clashes = per_hash.where("n > 1").select("h")
    if not clashes.isEmpty():  # different blocks under one hash: tell them apart by content
        ranked = stored(distinct.join(clashes, "h", "left_semi").select(
            "h", "block", F.row_number().over(Window.partitionBy("h").orderBy("block")).alias("rank")), "clashes")
        again = (blocks.join(ranked, ["h", "block"])
                 .groupBy("doc_id", "sha", "n_blocks", "pos", "h", "rank").agg(F.count("*").alias("copies")))
        rows = rows.join(clashes, "h", "left_anti").unionByName(again)
        keys = keys.join(clashes, "h", "left_anti").unionByName(ranked.select("h", "rank"))
    named = stored(rows.join(numbered(keys, "h", "rank"), ["h", "rank"])
                   .select("doc_id", "sha", "n_blocks", "pos", "copies", "name"), "level-0")
    done = [named.where("n_blocks = 1").select("doc_id", "sha", "copies", F.lit(0).alias("level"), "name")]
    longest = named.agg(F.max("n_blocks")).first()[0] or 1
    level, width = 0, 1
    rest = named.where("n_blocks > 1")
    while width < longest:
        level, width = level + 1, width * 2
        pairs = rest.groupBy("doc_id", "sha", "n_blocks", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("copies").alias("copies"))
        names = numbered(pairs.select("left", "right").distinct(), "left", "right")
        named = stored(pairs.join(names, ["left", "right"])
                       .select("doc_id", "sha", "n_blocks", "pos", "copies", "name"), f"level-{level}")
        done.append(named.where(F.col("n_blocks") <= width)
                    .select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))
        rest = named.where(F.col("n_blocks") > width)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal texts the row with the largest ``doc_id`` stays.
    """
    named = name_documents(docs, block_chars)
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"),
                                                F.sum("copies").alias("group_size"))
    rows = named.join(groups, ["level", "name"]).select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       F.col("sha").alias("text_sha256"), "level", "name")
