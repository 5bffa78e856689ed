"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Every source has a weight; the sources share all words by weight.
   A target stops at ``max_epochs`` times its source's size, and what is left
   over is shared again by weight among the others until none is above.
2. Blocks. A source's documents fall into blocks by a hash, in hash order, about
   ``BLOCKS_PER_SHARD`` for each shard that its words would fill, so a block holds
   like many words in a small source and in a large one. Its quota is whole passes over
   all its blocks, then so many further blocks that the words reach the target; inside
   the last block the documents are taken in hash order up to the target. The
   place is found by refining the hash range level by level, each level one
   aggregation into ``FANOUT`` ranges per source: no ordered task beyond these ranges.
3. Splitting tree. The block quotas of all sources are dealt to the output
   shards: at each node of a binary tree the left half's share of every source
   is drawn from the multivariate hypergeometric distribution. A leaf has an
   exact quota per source, and the leaves sum to the quotas. The driver deals the
   first ``TOP_NODES`` nodes, tasks the trees below them.
4. Drawing. The (pass, block) slots of a source are permuted by a keyed Feistel
   network, and a shard takes its quota as the next slice of the permutation: shards
   are disjoint and together hold every slot once. Slots find their slice by an
   equi-join on buckets of the permutation, documents their slots by block. Inside a
   shard, rows get a hashed position.

Everything random comes from ``seed`` and the rows' content, so reruns and
recomputed tasks agree. The driver holds one row per source, and a number per source
for each of the first nodes of the tree.

Null text has no words; null sources form a source of their own; rows that
equal each other in id, source and text share their fate. An empty table, or
one without words, gives no rows in the mix. Other columns are left alone, whatever
their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsearch.llm.common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
WORDS_PER_SHARD = 4_000_000
BROADCAST_SOURCES = 20_000  # rows per source are broadcast up to so many sources
BROADCAST_BLOCKS = 100_000  # rows of slots per block are broadcast up to so many
BLOCKS_PER_SHARD = 64
MOST_SLOTS = 1 << 28  # blocks get larger rather than more beyond it: a draw takes below 10^9
TOP_NODES = 1024  # nodes of the tree that the driver deals, fewer if there are many sources
TOP_NUMBERS = 1 << 21  # numbers in them
CHUNK = 1 << 16  # slots that are permuted at once
ROUNDS = 6  # of the Feistel network
PLACE_BITS = 40
FANOUT = 1024
LEVELS = 4  # 1024^4 ranges: finer than any block of documents


@dataclass
class Plan:
    """One source: its words, target, whole passes and the hash bound of the partial pass."""
    source: str | None
    words: int
    target: float
    passes: int
    bound: int  # documents with a smaller hash are in the last, partial pass


def water_fill(sizes: list[int], weights: list[float], max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Targets that sum to all words, by weight, none above ``max_epochs`` times its size."""
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > max_epochs * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = float(max_epochs * sizes[i])
            left -= target[i]
        open_ -= full
    return target


def _left(quota: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """What the left half of the node (``first`` shard, ``count`` shards) gets of its quota per source."""
    total = int(quota.sum())
    if not total:
        return np.zeros_like(quota)
    rng = np.random.default_rng([seed, first, count])
    return rng.multivariate_hypergeometric(quota, total * (count // 2) // count, method="marginals")


def tree_nodes(quota, start, first: int, count: int, seed: int, most: int = 1):
    """Yields (first, count, quota, start) of the nodes of at most ``most`` shards below a node, left to right.

    ``start`` is what shards further left have of each source.
    """
    todo = [(first, count, np.asarray(quota, np.int64), np.asarray(start, np.int64))]
    while todo:
        first, count, quota, start = todo.pop()
        if count <= most:
            yield first, count, quota, start
            continue
        left, half = _left(quota, first, count, seed), count // 2
        todo.append((first + half, count - half, quota - left, start + left))
        todo.append((first, half, left, start))


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Quota per shard and source, drawn down a binary tree; columns sum to ``quotas``."""
    return np.array([quota for _, _, quota, _ in tree_nodes(quotas, np.zeros(len(quotas)), 0, shards, seed)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(slots: np.ndarray, n: int, seed: int, source: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. n - 1 puts ``slots``: Feistel rounds, repeated while beyond n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng([seed, source, n]).integers(0, 2 ** 63, ROUNDS, dtype=np.uint64)

    def once(x):
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & mask)
        return (left << half) | right

    out = once(slots.astype(np.uint64))
    beyond = np.flatnonzero(out >= n)
    while len(beyond):
        out[beyond] = once(out[beyond])
        beyond = beyond[out[beyond] >= n]
    return out.astype(np.int64)


def _place(seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")), 64 - PLACE_BITS)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, words and ``place``: the hash order, 40 bits."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    return docs.select("doc_id", "source", words.alias("words"), _place(seed).alias("place"))


def plan_sources(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> list[Plan]:
    """Targets and quotas. ``rows``: source, words, place, as :func:`sized` gives."""
    sizes = sorted(((r.source, r.w or 0) for r in rows.groupBy("source").agg(F.sum("words").alias("w")).collect()),
                   key=lambda x: (x[0] is None, x[0] or ""))
    targets = water_fill([w for _, w in sizes], [weights[i % len(weights)] for i in range(len(sizes))], max_epochs)
    plans = []
    for (source, words), target in zip(sizes, targets):
        passes = min(int(target // words), max_epochs) if words else 0
        plans.append(Plan(source, words, target, passes, 0))
    # refine the hash bound of each partial pass: words below it come nearest to what is missing
    low = {i: 0 for i, p in enumerate(plans) if p.words and p.passes < max_epochs}
    missing = {i: plans[i].target - plans[i].passes * plans[i].words for i in low}
    width = 2 ** PLACE_BITS
    for _ in range(LEVELS if low else 0):
        step = width // FANOUT
        at = _per_source(rows, [(plans[i].source, i, v, missing[i]) for i, v in low.items()],
                         "_source string, _i int, _low long, _missing double")
        inside = (rows.join(at, F.col("source").eqNullSafe(F.col("_source")))
                  .where((F.col("place") >= F.col("_low")) & (F.col("place") < F.col("_low") + width)))
        bins = inside.groupBy("_i", "_missing", F.floor((F.col("place") - F.col("_low")) / step).alias("_bin")).agg(
            F.sum("words").alias("_w"))
        upto = F.sum("_w").over(Window.partitionBy("_i").orderBy("_bin"))  # at most FANOUT rows of a source
        first = (bins.withColumn("_upto", upto).where("_upto > _missing").groupBy("_i")
                 .agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_w")).alias("_before"))).alias("at")))
        for r in first.collect():
            low[r["_i"]] += r["at"]["_bin"] * step
            missing[r["_i"]] -= r["at"]["_before"]
        width = step
    for i, v in low.items():
        plans[i].bound = v
    return plans


def block_bits(plans: list[Plan], shards: int) -> list[int]:
    """Per source the logarithm of its number of blocks."""
    words = sum(p.words for p in plans)
    number = min(BLOCKS_PER_SHARD * shards, MOST_SLOTS)
    return [min(PLACE_BITS, max(0, math.ceil(math.log2(p.words * number / words)))) if p.words else 0 for p in plans]


def slots_of(plans: list[Plan], bits: list[int]) -> list[int]:
    """Per source the (pass, block) slots of its quota."""
    return [(p.passes << b) + -(-p.bound >> (PLACE_BITS - b)) for p, b in zip(plans, bits)]


def shard_slices(spark, slots: list[int], shards: int, seed: int) -> DataFrame:
    """i (source), shard, start, end: the slice of a source's permuted slots that a shard takes, if any."""
    nodes = max(1, min(TOP_NODES, TOP_NUMBERS // max(1, len(slots))))
    top = tree_nodes(slots, np.zeros(len(slots)), 0, shards, seed, -(-shards // nodes))
    frame = spark.createDataFrame([(f, c, q.tolist(), s.tolist()) for f, c, q, s in top],
                                  "first int, count int, quota array<long>, start array<long>")

    def leaves(batches):
        for batch in batches:
            for first, count, quota, start in batch.itertuples(index=False):
                for shard, _, q, s in tree_nodes(quota, start, first, count, seed):
                    some = np.flatnonzero(q)
                    yield pd.DataFrame({"i": some.astype(np.int32), "shard": np.int32(shard), "start": s[some],
                                        "end": s[some] + q[some]})

    return frame.repartition("first").mapInPandas(leaves, "i int, shard int, start long, end long")


def block_draws(spark, plans: list[Plan], shards: int, seed: int) -> DataFrame:
    """_i (source), _block, _draws: the (copy, shard) of every pass over the block that is in the mix."""
    bits = block_bits(plans, shards)
    slots = slots_of(plans, bits)
    sources = spark.createDataFrame([(i, n, bits[i], -(-n // shards)) for i, n in enumerate(slots) if n],
                                    "i int, n long, bits int, width long")
    chunks = sources.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
                            .alias("first")).repartition("i", "first")

    def expand(batches):
        for batch in batches:
            for i, n, bits, width, first in batch.astype(object).itertuples(index=False):
                slot = np.arange(first, min(first + CHUNK, n), dtype=np.int64)
                at = permuted(slot, n, seed, i)
                yield pd.DataFrame({"i": np.int32(i), "block": slot & ((1 << bits) - 1),
                                    "copy": (slot >> bits).astype(np.int32), "at": at, "bucket": at // width})

    placed = chunks.mapInPandas(expand, "i int, block long, copy int, at long, bucket long")
    slices = shard_slices(spark, slots, shards, seed).join(sources.select("i", "width"), "i").select(
        "i", "shard", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")),
                                                           F.floor((F.col("end") - 1) / F.col("width")))).alias("bucket"))
    dealt = placed.join(slices, ["i", "bucket"]).where("at >= start and at < end")
    return dealt.groupBy(F.col("i").alias("_i"), F.col("block").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("_draws"))


def draw(rows: DataFrame, plans: list[Plan], shards: int, seed: int) -> DataFrame:
    """Add ``draws`` to rows with ``source`` and ``place``: one (copy, shard, position) per copy in the mix.

    Which copies a row has and where they go follows from its block's slots and its
    own hash, so the rows are not shuffled while the table of blocks is small.
    """
    bits = block_bits(plans, shards)
    blocks = stored(block_draws(rows.sparkSession, plans, shards, seed), "mix-blocks")
    if sum(min(n, 1 << b) for n, b in zip(slots_of(plans, bits), bits)) <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    table = [(p.source, i, p.passes, p.bound, PLACE_BITS - bits[i]) for i, p in enumerate(plans)]
    plan = _per_source(rows, table, "_source string, _i int, _passes int, _bound long, _shift int")
    known = (rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
             .withColumn("_block", F.floor(F.col("place") / F.pow(F.lit(2.0), F.col("_shift")))))
    own = F.filter("_draws", lambda d: (d["copy"] < F.col("_passes")) | (F.col("place") < F.col("_bound")))
    draws = F.transform(own, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.xxhash64(
        F.lit(seed), "place", d["copy"]).alias("position")))
    none = F.array().cast("array<struct<copy:int,shard:int,position:bigint>>")
    return known.join(blocks, ["_i", "_block"], "left").select(
        *rows.columns, F.coalesce(draws, none).alias("draws"))


def _per_source(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """The driver's rows per source as a frame, broadcast while they are few."""
    frame = rows.sparkSession.createDataFrame(table, schema)
    return F.broadcast(frame) if len(table) <= BROADCAST_SOURCES else frame


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, words_per_shard: int = WORDS_PER_SHARD,
        seed: int = 7) -> tuple[DataFrame, list[Plan], int]:
    """Per input row doc_id, source, words, place and ``draws``; the plan per source; the number of shards."""
    rows = stored(sized(docs, seed), "mix-sizes")
    plans = plan_sources(rows, weights, max_epochs)
    shards = max(1, math.ceil(sum(p.words for p in plans) / words_per_shard))
    return draw(rows, plans, shards, seed), plans, shards


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                    words_per_shard: int = WORDS_PER_SHARD, seed: int = 7) -> DataFrame:
    """The mix as documents: every column of ``docs``, one row per copy, dealt by shard and shuffled in it."""
    _, plans, shards = mix(docs, weights, max_epochs, words_per_shard, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source",
                       _place(seed).alias("place"))
    drawn = draw(rows, plans, shards, seed).select("row", F.explode("draws").alias("d"))
    return drawn.repartition("d.shard").sortWithinPartitions("d.shard", "d.position").select("row.*")


def taken(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """Per input row: doc_id, size, source_size, target (its source's), the words that the mix takes of it, and
    the shard and the position in it of every copy."""
    rows, plans, _ = mix(docs, weights, max_epochs, seed=seed)
    plan = _per_source(rows, [(p.source, p.words, p.target) for p in plans],
                       "_source string, source_size long, target double")
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", F.col("words").alias("size"), "source_size", "target",
                    (F.col("words") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"),
                    F.col("draws.position").alias("positions")))
