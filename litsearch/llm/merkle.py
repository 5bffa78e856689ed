"""Merkle dataset manifest by nested-interval labels.

Every row is a leaf; the leaves of one language make a tree, the roots of these
trees, in order of language, one more. Two consecutive nodes become their hash,
the last one alone if it has no partner, until one is left.

A node is labelled with the interval of leaf ranks that it covers, so the tree
needs no pointers. Ranks come from a range sort and per-partition counts, with no
window over a language. ``STRATUM`` levels are built at a time: a stratum cuts a
tree into buckets of ``2 ** STRATUM`` neighbouring nodes, and a bucket is small
whatever the sizes of the languages. Within a bucket a node's ancestors are the
nodes whose intervals contain its own (a join on the bucket, then containment), and
its sibling at each step covers what is left of the parent's interval without
the child's. Proofs go down from stratum to stratum: a bucket's top node hands
its own proof to all that it covers. No text is shuffled.

Defined cases: a null field is hashed as ``-``; a null language is a tree of its
own and comes first. Null ids come first; rows of equal id go by their hash, so
repeated rows are leaves of their own whose order changes nothing. An empty table
gives no rows; other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsearch.llm.common import crc32_sql, stored

STRATUM = 8
STEP = "level int, side string, digest string"


def sha(text) -> Column:
    return F.sha2(text, 256)


def encoded(value) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(n_chars) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return sha(F.concat(*[encoded(f) for f in fields]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and the ``found`` leaf after tampering: one more character where 7 divides crc32(doc_id)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text", F.coalesce(tampered, F.lit(False)).alias("bad"))
    return rows.select("doc_id", "lang", leaf_of(F.col("n_chars")).alias("leaf"),
                       F.when(F.col("bad"), leaf_of(one_more)).alias("found")).select(
        "doc_id", "lang", "leaf", F.coalesce("found", "leaf").alias("found"))


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 within each ``tree`` (null is one) by ``order``: a range sort, then counts."""
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    at = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)  # of the sort, not of the file
    runs = at.groupBy(tree, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(F.col(tree).alias("_tree"), "_part", "_first", "_before")
    return (at.join(runs, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_tree", "_part", "_first", "_before"))


def bucket_of(first, level: int) -> Column:
    return F.shiftright(first, level)


def pair_at(nodes: Column):
    """The i-th pair of neighbours of an array of nodes."""
    return lambda i: F.struct(F.get(nodes, i * 2).alias("one"), F.get(nodes, i * 2 + 1).alias("other"))


def parent(pair: Column) -> Column:
    one, other = pair["one"], pair["other"]
    return F.struct(one["lo"].alias("lo"), F.coalesce(other["hi"], one["hi"]).alias("hi"),
                    sha(F.concat(one["digest"], F.coalesce(other["digest"], F.lit("")))).alias("digest"))


def stratum(nodes: DataFrame, level: int) -> DataFrame:
    """The next ``STRATUM`` levels over ``nodes`` (tree, size, lo, hi, digest) of one ``level``.

    tree, size, bucket, levels: per bucket and level an array of nodes (lo, hi, digest). ``size`` is the
    number of leaves of the tree; building stops where one node covers them all.
    """
    node = F.struct("lo", "hi", "digest")
    rows = nodes.groupBy("tree", "size", bucket_of("lo", level + STRATUM).alias("bucket")).agg(
        F.array_sort(F.collect_list(node)).alias("l0"))  # at most 2 ** STRATUM nodes
    for k in range(STRATUM):
        below = F.col(f"l{k}")
        pairs = F.sequence(F.lit(0), F.expr(f"(size(l{k}) + 1) div 2").cast("int") - 1)
        grown = F.transform(F.transform(pairs, pair_at(below)), parent)
        whole = F.col("size") <= F.lit(1 << level + k)  # one node is left in the whole tree
        rows = rows.withColumn(f"l{k + 1}", F.when(whole, below).otherwise(grown))
    return rows.select("tree", "size", "bucket", F.array(*[f"l{k}" for k in range(STRATUM + 1)]).alias("levels"))


def steps_of(built: DataFrame, level: int) -> DataFrame:
    """tree, bucket, level, lo, hi, step: how each node goes on to its parent.

    The sibling is what the parent's interval has besides the node's: left of it, right of it, or nothing.
    """
    rows = built.select("tree", "size", "bucket", F.posexplode("levels").alias("k", "nodes"))
    rows = rows.where((F.col("k") < STRATUM) & (F.col("size") > F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") + level)))
    rows = rows.select("tree", "bucket", (F.col("k") + level).alias("level"), F.posexplode("nodes").alias("i", "node"),
                       "nodes")
    width = F.call_function("shiftleft", F.lit(2).cast("long"), F.col("level"))  # leaves below a full parent
    low = F.col("node.lo") - F.pmod(F.col("node.lo"), width)
    right = F.get("nodes", F.col("i") + 1)
    left = F.get("nodes", F.col("i") - 1)
    inside = right["hi"] < low + width
    side = F.when(F.col("node.lo") > low, "left").when(inside, "right").otherwise("none")
    digest = F.when(F.col("node.lo") > low, left["digest"]).when(inside, right["digest"])
    return rows.select("tree", "bucket", F.col("node.lo").alias("lo"), F.col("node.hi").alias("hi"),
                       F.struct("level", side.alias("side"), digest.alias("digest")).alias("step"))


def proofs(items: DataFrame) -> DataFrame:
    """Per item of ``items`` (tree, rank, digest; no nulls, ranks from 0 in each tree) tree, rank, root, path.

    ``path``: from the leaf upwards, for every level its side (left, right, none) and the sibling's digest.
    """
    sizes = items.groupBy("tree").agg(F.count("*").alias("size"))
    nodes = items.join(sizes, "tree").select("tree", "size", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    largest = sizes.agg(F.max("size")).first()[0] or 0
    level, floors = 0, []
    nodes = stored(nodes, "level-0")
    while True:
        built = stored(stratum(nodes, level), f"stratum-{level}")
        floors.append((level, nodes, built))
        top = F.get(F.col("levels")[STRATUM], F.lit(0))
        level += STRATUM
        if 1 << level >= largest:
            break
        # a tree that one node covers already stays as it is: its node meets nothing further up
        nodes = stored(built.select("tree", "size", top["lo"].alias("lo"), top["hi"].alias("hi"),
                                    top["digest"].alias("digest")), f"level-{level}")
    above = stored(built.select("tree", F.col("bucket").alias("up"), top["digest"].alias("root"),
                                F.array().cast(f"array<struct<{STEP.replace(' ', ':')}>>".replace(",:", ",")).alias("rest")), "roots")
    for level, nodes, built in reversed(floors):
        item = nodes.select("tree", bucket_of("lo", level + STRATUM).alias("bucket"), F.col("lo").alias("item_lo"),
                            F.col("hi").alias("item_hi"))
        step = steps_of(built, level)
        # the item and its ancestors: intervals that contain its own, within the bucket
        held = item.join(step, ["tree", "bucket"], "left").where(
            F.col("lo").isNull() | (F.col("lo") <= F.col("item_lo")) & (F.col("item_hi") <= F.col("hi")))
        paths = held.groupBy("tree", "bucket", "item_lo").agg(F.array_sort(F.collect_list("step")).alias("path"))
        paths = paths.join(above, (paths["tree"] == above["tree"]) & (paths["bucket"] == above["up"])).select(
            paths["tree"], F.col("item_lo").alias("up"), "root", F.concat("path", "rest").alias("rest"))
        above = paths if not level else stored(paths.withColumn("up", bucket_of("up", level)), f"proofs-{level}")
    return above.select("tree", F.col("up").alias("rank"), "root", F.col("rest").alias("path"))


def folded(leaf, path) -> Column:
    """The root that a leaf and its siblings give."""
    def up(digest, step):
        return sha(F.when(step["side"] == "left", F.concat(step["digest"], digest))
                   .when(step["side"] == "right", F.concat(digest, step["digest"])).otherwise(digest))
    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and ``path``."""
    rows = stored(ranked(stored(leaves(docs), "leaves"), "lang", "doc_id", "leaf"), "ranked")
    # trees by name: 1 and the language, or 0 for none, so that no name is null
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    rows = rows.withColumn("tree", tree)
    low = stored(proofs(rows.select("tree", "rank", F.col("leaf").alias("digest"))), "language-proofs")
    roots = stored(low.where("rank = 0").select("tree", F.col("root").alias("digest")), "subroots")
    roots = stored(ranked(roots.withColumn("all", F.lit("")), "all", "tree"), "ranked-subroots")
    high = proofs(roots.select(F.col("all").alias("tree"), "rank", "digest"))
    high = high.select("rank", F.col("root").alias("top"), F.col("path").alias("over"))
    high = stored(roots.select("rank", "tree", F.col("digest").alias("subroot")).join(high, "rank").drop("rank"), "over")
    done = (rows.join(low.select("tree", "rank", "path"), ["tree", "rank"]).join(high, "tree")
            .withColumn("path", F.concat("path", "over")))
    siblings = F.array_join(F.transform(F.filter("path", lambda s: s["side"] != "none"), lambda s: s["digest"]), "")
    done = done.select("doc_id", "leaf", "subroot", F.col("top").alias("root"), sha(siblings).alias("proof_sha256"),
                       folded(F.col("found"), F.col("path")).alias("folded_root"), "path")
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql() -> str:
    """DuckDB SQL of the manifest: levels by recursion, siblings by rank."""
    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"

    def forest(name: str, source: str) -> str:
        """{name}_levels and {name}_proofs of ``source`` (tree, rank, digest), with a height for each tree."""
        return f"""
{name}_heights AS (SELECT tree, CAST(ceil(log2(count(*))) AS BIGINT) AS height FROM {source} GROUP BY tree),
{name}_levels AS (
  SELECT tree, 0::BIGINT AS level, rank, digest FROM {source}
  UNION ALL
  SELECT l.tree, l.level + 1, l.rank // 2, sha256(string_agg(l.digest, '' ORDER BY l.rank))
  FROM {name}_levels l JOIN {name}_heights h ON h.tree = l.tree AND l.level < h.height GROUP BY l.tree, l.level, l.rank // 2
), {name}_steps AS (
  SELECT s.tree, s.rank, k.level, (s.rank >> k.level) % 2 = 1 AS on_left, n.digest
  FROM {source} s JOIN {name}_heights h USING (tree), LATERAL (SELECT unnest(range(h.height)) AS level) k
  LEFT JOIN {name}_levels n ON n.tree = s.tree AND n.level = k.level AND n.rank = xor(s.rank >> k.level, 1)
)"""
    leaf = "sha256({})"
    fields = [field("doc_id"), field("source"), field("lang"), field("n_chars"), field("text")]
    bad = [*fields[:3], field("CAST(n_chars AS HUGEINT) + 1"), fields[4]]
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, coalesce('1' || lang, '0') AS tree, {leaf.format(' || '.join(fields))} AS digest,
         CASE WHEN doc_id IS NOT NULL AND {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), ' ')")} % 7 = 0
              THEN {leaf.format(' || '.join(bad))} END AS tampered
  FROM documents
), items AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank FROM leaves
), {forest("low", "items")}, tops AS (
  SELECT '' AS tree, l.tree AS name, l.digest, row_number() OVER (ORDER BY l.tree) - 1 AS rank
  FROM low_levels l JOIN low_heights h ON h.tree = l.tree AND h.height = l.level
), {forest("high", "tops")}, root AS (
  SELECT l.digest FROM high_levels l JOIN high_heights h ON h.tree = l.tree AND h.height = l.level
), steps AS (
  SELECT i.tree, i.rank, s.level, s.on_left, s.digest FROM items i JOIN low_steps s USING (tree, rank)
  UNION ALL
  SELECT i.tree, i.rank, h.height + s.level, s.on_left, s.digest
  FROM items i JOIN low_heights h USING (tree) JOIN tops t ON t.name = i.tree JOIN high_steps s ON s.rank = t.rank
), paths AS (
  SELECT tree, rank, list(struct_pack(on_left := on_left, digest := digest) ORDER BY level) AS path,
         string_agg(digest, '' ORDER BY level) AS siblings
  FROM steps GROUP BY tree, rank
), folds AS (
  SELECT i.tree, i.rank, 0::BIGINT AS n, coalesce(i.tampered, i.digest) AS digest FROM items i
  UNION ALL
  SELECT f.tree, f.rank, f.n + 1, sha256(CASE WHEN p.path[f.n + 1].digest IS NULL THEN f.digest
         WHEN p.path[f.n + 1].on_left THEN p.path[f.n + 1].digest || f.digest ELSE f.digest || p.path[f.n + 1].digest END)
  FROM folds f JOIN paths p ON p.tree = f.tree AND p.rank = f.rank AND f.n < len(p.path)
)
SELECT i.doc_id, i.digest AS leaf, t.digest AS subroot, r.digest AS root,
       sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM items i JOIN tops t ON t.name = i.tree CROSS JOIN root r LEFT JOIN paths p ON p.tree = i.tree AND p.rank = i.rank
JOIN folds f ON f.tree = i.tree AND f.rank = i.rank AND f.n = coalesce(len(p.path), 0)"""
