import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from litsearch.llm.merkle import manifest, proofs, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    return sha("".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def climb(nodes):
    """The root, and for every leaf its siblings as (side, digest), by building level after level."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i:i + 2]
            for k in range(len(pair)):
                other = ("none", "") if len(pair) == 1 else ("right", pair[1]) if k == 0 else ("left", pair[0])
                for item in groups[i + k]:
                    paths[item].append(other)
            above.append(sha("".join(pair)))
            over.append(sum(groups[i:i + 2], []))
        nodes, groups = above, over
    return nodes[0], paths


def brute(rows):
    """Sorted tuples (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, over = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), upper in zip(trees, over):
        for row, path in zip(own, paths):
            path = path + upper
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            now = leaf(row, 1 if bad else 0)
            for side, digest in path:
                now = sha(digest + now if side == "left" else now + digest)
            out.append((str(row[0]), leaf(row), subroot, root, sha("".join(d for _, d in path)), now, now == root))
    return sorted(out)


def rows_of(*sizes, ids=None):
    out, at = [], 0
    for k, size in enumerate(sizes):
        for i in range(size):
            lang = None if k == 0 else ["de", "ä", "zz", ""][k % 4] + "x" * (k // 4)
            out.append((at, f"text {i % 7} é\n" * (i % 3), lang, f"s{i % 2}", None if i % 5 == 0 else i, "t", "r", "p"))
            at += 1
    return out


def found(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                  for r in manifest(frame).collect())


@pytest.mark.parametrize("sizes", [(1,), (3, 1), (257, 256, 5, 2, 1), (1025, 0, 31)])
def test_against_building_level_by_level(spark, sizes):
    rows = rows_of(*sizes)
    want = brute(rows)
    assert found(spark, rows) == want
    assert len(rows) < 100 or not all(r[-1] for r in want) and any(r[-1] for r in want)


def test_nulls_ties_repeats_long_texts_and_extremes(spark):
    rows = [(None, None, None, None, None, "a", "b", "c"), (None, "", "de", "s", 0, None, None, None),
            (5, "x" * 300_000, "de", None, 2 ** 63 - 1, "", "", ""), (5, "y", "de", "s", 1, "", "", ""),
            (5, "y", "de", "s", 1, "", "", ""), (-3, "é", "", "s", -1, "", "", ""), (0, "1:2", "-", "-", None, "", "", "")]
    rows += [(k, "t", "de", "s", 2 ** 63 - 1, "", "", "") for k in range(10, 40)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_without_a_window_over_a_tree(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).cast("string").alias("tree"), (-F.col("id")).alias("k"))
    got = ranked(rows, "tree", "k").collect()
    for tree in "012":
        own = sorted((r.k, r["rank"]) for r in got if r.tree == tree)
        assert [n for _, n in own] == list(range(len(own)))


def test_paths_lead_to_the_root(spark):
    items = spark.range(700).select(F.lit("t").alias("tree"), F.col("id").alias("rank"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    root, paths = climb([sha(str(i)) for i in range(700)])
    for r in proofs(items).collect():
        assert r.root == root
        assert [(s.side, s.digest or "") for s in r.path] == paths[r["rank"]]
