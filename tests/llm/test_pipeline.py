import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from litsearch.llm import line_dedup, mixing, ngram_join, piece_codec
from litsearch.llm.common import stored
from tests.conftest import SF_SMALL
from tests.llm.test_line_dedup import one_common_key


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF_SMALL), name)
        seen.append((name, before, docs))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: Counter(r.doc_id for r in after.select("doc_id").collect()) for name, _, after in seen}
    assert set(ids["line_dedup"]) == set(ids["toxicity"])
    assert set(ids["ngram_join"]) <= set(ids["line_dedup"]) and max(ids["ngram_join"].values()) == 1
    assert max(ids["mixing"].values()) <= 3 and set(ids["mixing"]) <= set(ids["ngram_join"])
    assert ids["sentencepiece"] == ids["mixing"]

    # each stage does what its operator says of the same input
    by = {name: (before, after) for name, before, after in seen}
    cut = {r.doc_id: r.text for r in by["line_dedup"][1].collect()}
    assert cut == {r.doc_id: r.text for r in line_dedup.without_repeated_lines(by["line_dedup"][0]).collect()}
    groups = ngram_join.similar_groups(by["ngram_join"][0], 5, 80).collect()
    assert set(ids["ngram_join"]) == {r.doc_id for r in groups if r.n_shingles == 0 or r.doc_id == r.component_id}
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.taken(by["mixing"][0]).collect()}
    assert all(taken[i][0] == n * taken[i][1] for i, n in ids["mixing"].items())
    want = {(r.doc_id, r.ids_sha256) for r in piece_codec.encode(by["sentencepiece"][0], digest=True).collect()}
    assert want == {(r.doc_id, r.ids_sha256) for r in docs.collect()}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "empty")
    assert docs.count() == 0


CLASHING = ["row", "key", "_key", "draws", "place", "dropped", "doc", "node", "root", "line", "pos", "toxic", "_i", "copy"]


def test_odd_rows_through_all_stages(spark):
    """Null ids and texts, empty and very long texts, repeated rows and ids, columns with the operators' own names."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    twice, one, other, nameless, long_text = text(4), text(4), text(4), text(4), text(3000)
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = [(None, None), (None, ""), (10 ** 6, None), (10 ** 6 + 1, twice), (10 ** 6 + 1, twice), (10 ** 6 + 2, one),
           (10 ** 6 + 2, other), (None, nameless), (10 ** 6 + 3, long_text), (10 ** 6 + 4, " \n\n ")]
    odd = spark.createDataFrame(odd, "doc_id long, text string").select(
        "doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in base.dtypes if c not in ("doc_id", "text")])
    docs = base.unionByName(odd).select("*", *[F.lit(c).alias(c) for c in CLASHING])
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), name)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.where(" or ".join(f"`{c}` <> '{c}'" for c in CLASHING)).isEmpty()
            kept[name] = Counter((r.doc_id, r.text) for r in docs.where(
                "doc_id is null or doc_id >= 1000000").select("doc_id", "text").collect())
    assert kept["toxicity"].total() == 10
    lines = kept["line_dedup"]
    assert lines.total() == 10 and lines[(10 ** 6 + 1, twice)] == 2 and lines[(10 ** 6 + 3, long_text)] == 1
    whole = [(10 ** 6 + 1, twice), (10 ** 6 + 2, one), (10 ** 6 + 2, other), (None, nameless), (10 ** 6 + 3, long_text)]
    assert [kept["ngram_join"][x] for x in whole] == [1] * 5
    # texts without words take nothing of a target, drawn or not
    assert set(kept["mixing"]) <= set(kept["ngram_join"]) and max(kept["mixing"].values(), default=0) <= 3 * 2
    drawn = Counter()
    for (i, _), n in kept["mixing"].items():
        drawn[i] += n
    last = docs.where("doc_id is null or doc_id >= 1000000").select("doc_id").collect()
    assert Counter(r.doc_id for r in last) == drawn


def test_line_stage_compares_lines_of_one_frequent_key(spark):
    texts, _ = one_common_key(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r.doc_id: r.text for r in P.drop_repeated_lines(spark, docs, SF_SMALL).collect()}
    assert cut == {**dict(enumerate(texts)), 1: ""}
