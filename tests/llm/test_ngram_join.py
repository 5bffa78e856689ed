import random

import numpy as np
import pytest

from litsearch.llm import shingles as H
from litsearch.llm.components import components
from litsearch.llm.ngram_join import choose_boundary, keep_one, similar_groups


def word_sets(text, words):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ") if x]
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(texts, words, percent):
    """Component of every row (index of its first row), all pairs compared."""
    sets = [word_sets(t, words) for t in texts]
    label = list(range(len(texts)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def noisy_texts(seed, groups=14, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 8, 11, 12, 13, 18, 25, 40, 90, 200]))]
        if g % 4 == 0:
            base = base + passage
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(words))
                words[k:k + 1] = rng.choice([[], ["New"], [words[k], "x"]])
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [70, 80, 90])
@pytest.mark.parametrize("boundary", [9, 14])
def test_linked_sets_share_a_key(percent, boundary):
    rng = np.random.default_rng(percent + boundary)
    checked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        drop, add = rng.integers(0, 1 + n // 8), rng.integers(0, 1 + n // 8)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2 ** 63, add).astype(np.uint64)]))
        if len(b) and H.linked(a, b, percent):
            checked += 1
            assert np.intersect1d(H.keys_of(a, boundary, percent), H.keys_of(b, boundary, percent)).size, (n, drop, add)
    assert checked > 300


def test_sets_that_agree_only_in_empty_segments_share_a_key():
    end, percent = 30, 90
    count, spare = H.segments_of(end, percent)
    pool = np.random.default_rng(0).integers(0, 2 ** 63, 4000).astype(np.uint64)
    first = pool[(pool >> np.uint64(20)) % np.uint64(count) == 0][:40]
    a, b = H.segment_keys(np.sort(first[:20]), 0, end, percent), H.segment_keys(np.sort(first[20:40]), 0, end, percent)
    assert np.intersect1d(a, b).size and count - 1 > spare


def test_links_between_counts_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 50))).astype(np.uint64)) for _ in range(80)]
    want = [(i, j) for i in range(80) for j in range(i + 1, 80) if H.linked(sets[i], sets[j], 60)]
    assert H.links_between(sets, None, 60) == want
    assert sorted(H.links_between(sets[:30], sets[30:], 60)) == sorted(
        (i, j) for i in range(30) for j in range(50) if H.linked(sets[i], sets[30 + j], 60))


@pytest.mark.parametrize("words,percent,block", [(3, 90, 10 ** 6), (3, 90, 300), (5, 80, 500)])
def test_components_against_all_pairs(spark, words, percent, block):
    texts = noisy_texts(words + block) + ["", " ", "One", "one", "a B", "A b", "a b c"]
    docs = spark.createDataFrame([(i + 100, t, "x", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, node string, keys int")
    got = {r.doc_id - 100: (r.component_id - 100, r.n_shingles)
           for r in similar_groups(docs, words, percent, block_tokens=block).collect()}
    label, sizes = brute(texts, words, percent)
    assert [got[i] for i in range(len(texts))] == list(zip(label, sizes))


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d", 1), (5, "a b c d", 2), (5, "q r s t", 3), (None, "a b c d", 4),
                                  (None, None, 5), (7, "", 6), (3, "A B C D", 7)], "doc_id long, text string, row int")
    got = sorted(map(tuple, similar_groups(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
                     .fillna(-1).collect()))
    assert got == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (5, 2, 5), (7, 0, 7)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [3, 5, 6, 7]
    assert similar_groups(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_long_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_boundary_follows_the_sizes():
    assert choose_boundary({}, 90) == 9
    assert choose_boundary({12: 1000, 15: 10 ** 6}, 90) >= choose_boundary({12: 10}, 90)


def test_keep_one_row_of_each_group(spark):
    from litsearch.llm.ngram_join import keep_one
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " end", " ".join(f"v{i}" for i in range(30))
    rows = [(4, base), (4, near), (7, near), (None, base), (4, base), (9, other), (9, other), (3, None), (3, None),
            (5, ""), (None, " \n"), (None, "only here without any id at all"), (2, "short")]
    frame = spark.createDataFrame([(i, t, "k", "r", 1) for i, t in rows],
                                  "doc_id long, text string, key string, row string, root int").repartition(3)
    got = keep_one(frame)
    assert got.columns == frame.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    group = [k for k in kept if k[1] in (base, near)]
    assert len(group) == 1 and group[0][0] == 4
    assert [k for k in kept if k not in group] == sorted(
        [(9, other), (3, None), (3, None), (5, ""), (None, " \n"), (None, "only here without any id at all"), (2, "short")], key=str)
    assert keep_one(frame.limit(0)).count() == 0
