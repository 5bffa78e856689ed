import zlib

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from litsearch.llm import quality_gam as Q
from litsearch.llm.queries import op7_quality


def test_learns_an_interaction_by_pair_tables():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = Q.train(x, y, np.ones(4000)), Q.train(x, y, np.ones(4000), pairs=0)
    assert with_pairs.pairs[0][:2] == (0, 1)
    assert ((with_pairs.scores(x) > 0.5) == y).mean() > 0.93 > 0.7 > ((without.scores(x) > 0.5) == y).mean()


def test_scoring_adds_up_table_entries_one_by_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    model = Q.train(x, (x[:, 0] + x[:, 1] > 0).astype(float), np.ones(300))
    for row, logit in zip(x[:20], model.logits(x[:20])):
        want = model.base + sum(t[(c <= v).sum()] for t, c, v in zip(model.tables, model.cuts, row))
        want += sum(t[(model.pair_cuts[a] <= row[a]).sum(), (model.pair_cuts[b] <= row[b]).sum()]
                    for a, b, t in model.pairs)
        assert abs(want - logit) < 1e-12


def test_features_of_odd_texts():
    for t in ("", " \n", "x", "é", "a" * 100000, "\n" * 50, "A B a b a b", "\0"):
        assert len(Q.features(t)) == len(Q.FEATURES) and np.isfinite(Q.features(t)).all()


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op7_quality(spark, sf).toPandas()
    assert len(got) == 10000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    d = got.merge(ds.dataset(f"{sf}/labels.parquet").to_table().to_pandas(), on="doc_id")
    d = d[d.held_out]
    assert d[d.quality == 1].predicted.mean() > 0.99
    assert d[d.quality == 0].predicted.mean() < 0.1


def test_edges(spark):
    rows = [(1, "Fine words here."), (1, "Fine words here."), (None, "# $ %"), (2, None), (3, ""), (4, "# $ % &")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, good int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert Q.score(empty, Q.fit(docs, labels, F.lit(True))).count() == 0
    assert {r.score for r in Q.score(docs, Q.fit(empty, labels, F.lit(True))).collect()} == {0.5}
