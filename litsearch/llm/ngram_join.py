"""Similarity self-join of documents on word n-gram sets, size-aware.

Sets are split by size at a boundary. Small sets enumerate fixed-size subsets:
every subset of each overlap size by which they could link, so linked sets share
a subset. Large sets are cut into segments of the universe, a few more than
linked sets can differ in; an inverted list per segment holds the sets that have
the same elements there, so linked sets meet in at least one list. For lower
thresholds, where that takes too many segments, the lists are those of a set's
first elements in hash order (a prefix that linked sets must share). The boundary
is where, for the sizes that the table really has, the estimated cost of
enumeration passes that of scanning lists.

Who meets whom is settled by counting: a key is kept if different sets have it,
and its least set is its centre. All that share a key with a centre form a
cluster; pairs are found inside clusters by scanning the clusters' own inverted
lists of elements, with exact overlap counts. A cluster with more than
``block_tokens`` elements is not handled whole: first its members are compared
with the centre, in blocks; only members that did not link with it are then
compared, block by block, with all the others (pairs of which both link with
the centre are already connected).

Equal sets are one node from the start, so copies never meet as pairs. Hashes of
64 bits stand for shingles and for sets; no partner or candidate is capped.

Null and empty texts have the empty set, which links with nothing. Repeated
rows are returned as often as they come. Null ids are never the least of a
component unless it has no other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import WORD, narrow, stored
from litsearch.llm.components import components
from litsearch.llm.shingles import Shingler, keys_of, links_between, segments_of, subset_count, uses_segments

LEAST_BOUNDARY, MOST_BOUNDARY = 9, 40
MOST_KEYS = 600  # of one small set: a batch of texts holds them all in memory
BLOCK_TOKENS = 1_500_000
SCAN_COST = 4.0  # of a set met by chance in a list, against writing one key
CHANCE = 1 / 64  # that a set of about the same size has a given element too


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The size up to which enumerating subsets is cheaper than segment lists, for these numbers of sets."""
    best, least, total = LEAST_BOUNDARY, 0.0, 0.0
    everyone = sum(sizes.values())
    for n in range(LEAST_BOUNDARY + 1, MOST_BOUNDARY + 1):
        if max(subset_count(n, n, percent), subset_count(n * 100 // percent, n, percent)) > MOST_KEYS:
            break
        count = segments_of(max(n + 1, math.ceil(n * 1.5)), percent)[0]
        met = everyone * CHANCE ** (n / count)
        if not uses_segments(percent):
            count, met = n - percent * n // 100, everyone * CHANCE ** 3
        total += sizes.get(n, 0) * (subset_count(n, n, percent) - count * (1 + SCAN_COST * met))
        if total < least:
            best, least = n, total
    return best


def size_histogram(docs: DataFrame) -> dict[int, int]:
    """How many texts have how many words, up to the largest possible boundary."""
    text = F.col("text")
    short = narrow(docs).where(F.length(text) <= 100 * MOST_BOUNDARY)  # an estimate: it only moves the boundary
    n = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return {r.n: r["count"] for r in short.select(n.alias("n")).where(F.col("n") <= MOST_BOUNDARY + 2)
            .groupBy("n").count().collect()}


def signed(docs: DataFrame, words: int, percent: int, boundary: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node (hash of the set; null if empty) and keys."""

    @F.pandas_udf("n_shingles long, node long, keys array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for texts in batches:
            rows = []
            for t in texts:
                u = shingler.shingles(t)
                node = int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((len(u), node if len(u) else None, keys_of(u, boundary, percent).view(np.int64)))
            yield pd.DataFrame(rows, columns=["n_shingles", "node", "keys"]).astype({"node": "Int64"})

    return narrow(docs).select("doc_id", F.xxhash64("text").alias("th"), run("text").alias("_s")).select(
        "doc_id", "th", "_s.*")


def clusters_of(sets: DataFrame) -> DataFrame:
    """cluster, node: everyone that shares a key with a centre (the centre itself too)."""
    posted = sets.where("node is not null").select("node", F.explode("keys").alias("key"))
    shared = stored(posted.groupBy("key").agg(F.min("node").alias("cluster"), F.max("node").alias("_last"))
                    .where("cluster <> _last").select("key", "cluster"), "shared-keys")
    return stored(posted.join(shared, "key").select("cluster", "node").distinct(), "clusters")


def _scan(tasks: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of every task: cluster, left, right (block numbers), side (0 left, 1 right, 2 both), node, text.

    Only as many links as connect what is connected leave a task.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler(words)
        frame = frame.drop_duplicates(["side", "node"])
        sides = {s: f for s, f in frame.groupby("side")}
        sets = {s: [shingler.shingles(t) for t in f["text"]] for s, f in sides.items()}
        if 2 in sides:
            left = right = sides[2]["node"].tolist()
            pairs = links_between(sets[2], None, percent)
        else:
            left, right = (sides[s]["node"].tolist() if s in sides else [] for s in (0, 1))
            pairs = links_between(sets.get(0, []), sets.get(1, []), percent)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in pairs:
            a, b = top(left[i]), top(right[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((left[i], right[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tasks.groupBy("cluster", "left", "right").applyInPandas(run, "a long, b long")


def _crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tasks for all block pairs: both sides have cluster, node, text, blocks (own side's) and others (the other's)."""
    number = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    a = left.select("cluster", own.alias("left"), number(F.col("others")).alias("right"), F.lit(0).alias("side"),
                    "node", "text")
    b = right.select("cluster", number(F.col("others")).alias("left"), own.alias("right"), F.lit(1).alias("side"),
                     "node", "text")
    return a.unionByName(b)


def find_links(docs: DataFrame, sets: DataFrame, words: int, percent: int,
               block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes that connect all that is linked; and per node its least doc_id."""
    clusters = clusters_of(sets)
    nodes = stored(sets.where("node is not null").groupBy("node", "n_shingles")
                   .agg(F.min(F.struct("doc_id", "th")).alias("r"), F.min("doc_id").alias("least_id"))
                   .select("node", "n_shingles", F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"),
                           "least_id"), "nodes")
    wanted = nodes.join(clusters.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "th")
    rows = narrow(docs).withColumn("th", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["th"] == wanted["th"])
    texts = rows.join(wanted, same).groupBy("node").agg(F.first("text").alias("text"))
    sizes = nodes.select("node", "n_shingles")
    members = clusters.join(sizes, "node")
    spans = stored(members.groupBy("cluster").agg(F.sum("n_shingles").alias("tokens"))
                   .withColumn("blocks", F.ceil(F.col("tokens") / block_tokens)), "cluster-sizes")
    full = stored(clusters.join(texts, "node").join(spans, "cluster"), "members")
    whole = full.where("blocks = 1").select("cluster", F.lit(0).alias("left"), F.lit(0).alias("right"),
                                            F.lit(2).alias("side"), "node", "text")
    links = stored(_scan(whole, words, percent), "links")
    large = full.where("blocks > 1")
    if not large.isEmpty():
        centre = large.where("node = cluster").select("cluster", "node", "text", F.lit(1).alias("blocks"),
                                                      F.col("blocks").alias("others"))
        others = large.select("cluster", "node", "text", "blocks", F.lit(1).alias("others"))
        near = stored(_scan(_crossed(centre, others.where("node <> cluster")), words, percent), "centre-links")
        rest = large.join(near.select(F.col("a").alias("cluster"), F.col("b").alias("node")),
                          ["cluster", "node"], "left_anti").where("node <> cluster")
        left_sizes = stored(rest.join(sizes, "node").groupBy("cluster").agg(
            F.ceil(F.sum("n_shingles") / block_tokens).alias("left_blocks")), "rest-sizes")
        left = rest.join(left_sizes, "cluster").select(
            "cluster", "node", "text", F.col("left_blocks").alias("blocks"), F.col("blocks").alias("others"))
        right = large.join(left_sizes, "cluster").select("cluster", "node", "text", "blocks",
                                                         F.col("left_blocks").alias("others"))
        far = stored(_scan(_crossed(left, right), words, percent), "far-links")
        links = links.unionByName(near).unionByName(far)
    return links, nodes.select("node", "least_id")


def similar_groups(docs: DataFrame, words: int = 3, percent: int = 90, boundary: int | None = None,
                   block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, th, n_shingles, component_id (least doc_id reachable by links) and root,
    which names the group (null without words; two groups may have the same least id if an id is repeated)."""
    if boundary is None:
        boundary = choose_boundary(size_histogram(docs), percent)
    sets = stored(signed(docs, words, percent, boundary), "signed")
    links, nodes = find_links(docs, sets, words, percent, block_tokens)
    found = nodes.join(components(links), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "least_id")
    least = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stored(found.join(least, "root").select("node", "root", "component_id"), "component-ids")
    linked = sets.where("node is not null").select("doc_id", "th", "n_shingles", "node").join(named, "node")
    alone = sets.where("node is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "th", "n_shingles", "component_id", "root").unionByName(
        alone.withColumn("root", F.lit(None).cast(linked.schema["root"].dataType)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which each group keeps one: the row with the least doc_id.

    Null ids come last, and of rows that are equal in id one stays, whatever their texts;
    documents without words all stay, as they are linked with nothing.
    """
    groups = similar_groups(docs, words, percent).where("root is not null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    stays = stored(groups.groupBy("root").agg(F.min(first).alias("f")).select(
        _row_key("f.doc_id", F.col("f.th")).alias("key")).distinct(), "stays")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    worded = F.coalesce("text", F.lit("")).rlike(WORD)
    # equal rows become one before they meet, so none of them pile up in a task
    rows = (docs.where(worded).select(row, _row_key("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("key"))
            .groupBy("key").agg(F.first("row").alias("row")))
    return rows.join(stays, "key", "left_semi").select("row.*").unionByName(docs.where(~worded))


def _row_key(doc_id, text_hash):
    return F.xxhash64(doc_id, text_hash)
