import re
from collections import defaultdict

import numpy as np
import pytest

from litsearch.llm import mixing
from litsearch.llm.mixing import Plan, block_bits, mix, mixed_documents, permuted, slots_of, split_tree, taken, water_fill
from tests.conftest import SF_SMALL


def test_water_fill_reshares_the_excess():
    assert water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = water_fill([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert water_fill([0, 0], [5, 2]) == [0, 0]
    assert water_fill([], []) == []


def test_tree_keeps_quotas_exactly():
    table = split_tree([1000, 3, 0, 77], 13, 5)
    assert table.sum(axis=0).tolist() == [1000, 3, 0, 77] and (table >= 0).all()
    assert (table == split_tree([1000, 3, 0, 77], 13, 5)).all()
    assert np.ptp(table.sum(axis=1)) <= 13


def test_words_come_near_targets(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = taken(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r for r in docs.collect()}
    by_source = defaultdict(list)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text))
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        by_source[texts[r.doc_id].source].append(r)
    names = sorted(by_source)
    sizes = [sum(r.size for r in by_source[s]) for s in names]
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, w in zip(names, want):
        got = by_source[s]
        assert got[0].target == w and got[0].source_size == sum(r.size for r in got)
        assert 0 <= w - sum(r.taken for r in got) <= max(r.size for r in got)
    assert all(len(r.shards) == len(r.positions) and r.taken == r.size * len(r.shards) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, taken(docs).collect()))


def test_every_slot_once_and_documents_agree(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows, plans, shards = mix(docs, words_per_shard=5000)
    rows = rows.collect()
    assert shards > 10 and {d.shard for r in rows for d in r.draws} <= set(range(shards))
    copies = sorted(r.doc_id for r in rows for _ in r.draws)
    mixed = mixed_documents(docs, words_per_shard=5000)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == copies


def test_edges(spark):
    schema = "doc_id long, text string, source string, words int, draws string"
    docs = spark.createDataFrame([(1, "a b", "s", 1, "x"), (1, "a b", "s", 1, "x"), (None, "c " * 50, None, 1, "x"),
                                  (2, None, "s", 1, "x"), (3, "", "t", 1, "x")], schema)
    got = taken(docs).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 54
    assert {(r.source_size, r.target) for r in got} == {(4, 12.0), (50, 42.0), (0, 0.0)}
    assert {r.taken for r in got if r.size == 2} == {6}
    assert mixed_documents(docs).columns == docs.columns
    assert taken(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation_holds_every_slot_once(n):
    got = permuted(np.arange(n), n, 7, 2)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        gaps = np.diff(got)
        assert len(set(gaps.tolist())) > n // 3  # neighbours do not stay at one distance
        assert (got != permuted(np.arange(n), n, 8, 2)).mean() > 0.9


def tree(quota, first, count, seed):
    """The leaves' quotas, drawn again by plain recursion."""
    if count == 1:
        return [list(quota)]
    rng, total = np.random.default_rng([seed, first, count]), sum(quota)
    left = rng.multivariate_hypergeometric(quota, total * (count // 2) // count, method="marginals").tolist() if total else quota
    right = [q - x for q, x in zip(quota, left)]
    return tree(left, first, count // 2, seed) + tree(right, first + count // 2, count - count // 2, seed)


def place(slot, n, seed, source):
    """One slot's place in the permutation, with Python's whole numbers."""
    half, whole = max(1, ((n - 1).bit_length() + 1) // 2), (1 << 64) - 1
    keys = np.random.default_rng([seed, source, n]).integers(0, 2 ** 63, mixing.ROUNDS, dtype=np.uint64).tolist()

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & whole
        return x ^ (x >> 31)

    while True:
        left, right = slot >> half, slot & ((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ (mixed(right + key & whole) & ((1 << half) - 1))
        slot = left << half | right
        if slot < n:
            return slot


@pytest.mark.parametrize("nodes, few", [(1024, 100_000), (4, 0)])
def test_shards_as_tree_and_permutation_say(spark, monkeypatch, nodes, few):
    monkeypatch.setattr(mixing, "TOP_NODES", nodes)
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", few)
    monkeypatch.setattr(mixing, "CHUNK", 37)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows, plans, shards = mix(docs, words_per_shard=5000, seed=3)
    bits = block_bits(plans, shards)
    slots = slots_of(plans, bits)
    ends = np.cumsum(tree(slots, 0, shards, 3), axis=0)
    number = {p.source: i for i, p in enumerate(plans)}
    some = 0
    for r in rows.collect():
        i = number[r.source]
        p, block = plans[i], r.place >> (40 - bits[i])
        copies = list(range(p.passes)) + [p.passes] * (r.place < p.bound)
        want = [int(np.searchsorted(ends[:, i], place((c << bits[i]) + block, slots[i], 3, i), "right")) for c in copies]
        assert [d.copy for d in r.draws] == copies and [d.shard for d in r.draws] == want
        some += len(want)
    assert some > 100 and (split_tree(slots, shards, 3) == np.array(tree(slots, 0, shards, 3))).all()


def test_shards_of_like_size(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    rows, _, shards = mix(docs, words_per_shard=50_000)
    words = np.zeros(shards)
    for r in rows.collect():
        for d in r.draws:
            words[d.shard] += r.words
    assert shards > 5 and words.min() > 0.5 * words.mean() and words.max() < 1.7 * words.mean()


def test_quotas_of_any_size():
    plans = [Plan(str(i), 10 ** 15, 1.5e15, 1, 2 ** 39) for i in range(3)] + [Plan(None, 5, 15.0, 3, 0)]
    bits = block_bits(plans, 10 ** 9)
    slots = slots_of(plans, bits)
    assert sum(slots) < 10 ** 9 and slots[3] >= 3
    assert split_tree(slots, 3, 1).sum(axis=0).tolist() == slots


def test_nulls_and_long_texts(spark):
    schema = "doc_id long, text string, source string, _i string, place string, draws string"
    nothing = spark.createDataFrame([(None, None, None, None, None, None)] * 3, schema)
    assert [(r.size, r.taken, r.shards) for r in taken(nothing).collect()] == [(0, 0, [])] * 3
    assert mixed_documents(nothing).count() == 0
    long_text = "w " * 300_000
    docs = spark.createDataFrame([(i, long_text if i == 5 else "a b c", "s", "x", "y", "z") for i in range(40)], schema)
    assert {r.size for r in taken(docs).collect()} == {3, 300_000}
    assert {r.draws for r in mixed_documents(docs, words_per_shard=50_000).collect()} <= {"z"}
