import zlib

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from litsearch.llm import toxicity as X
from litsearch.llm.queries import op9_toxicity


def small_net():
    net = X.WindowNetwork.fresh([b"aa", b"bb"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    return net


def test_gradients_against_differences():
    net, words = small_net(), [b"aa", b"zz", b"bbb"]
    windows = np.array([[0, 1, 2, 1, -1, -1], [2, 0, -1, -1, -1, -1]])
    label = np.array([1.0, 0.0])
    decay, X.DECAY = X.DECAY, 0.0
    try:
        _, g = net.gradients(words, windows, label)
    finally:
        X.DECAY = decay
    rng = np.random.default_rng(1)
    _, (rows, grams, _, _) = net.word_vectors(words)
    for k, w in net.weights.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            if k in ("words", "grams"):
                at = (int(rng.choice(rows if k == "words" else grams)), at[1])
            old = w[at]
            w[at] = old + 1e-5
            up, _ = net.gradients(words, windows, label)
            w[at] = old - 1e-5
            down, _ = net.gradients(words, windows, label)
            w[at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5, (k, at)


def test_windows_overlap_and_cover():
    for n in (1, 47, 48, 49, 84, 85, 500):
        starts = X.windows_of(n)
        covered = {i for s in starts for i in range(s, min(s + X.WINDOW, n))}
        assert covered == set(range(n))
        assert all(b - a == X.WINDOW - X.OVERLAP for a, b in zip(starts, starts[1:]))
        assert starts[-1] < n


def test_score_is_the_best_window_one_by_one():
    net = X.WindowNetwork.fresh([b"w1"])
    words = [b"w%d" % (i % 7) for i in range(200)]
    (got,) = X.Scorer(net).window_scores([words])
    table = net.gate_table(net.word_vectors(words)[0])
    for s, logit in zip(X.windows_of(len(words)), got):
        one = X.laid_out(np.arange(len(words)), np.array([s]))
        assert abs(net.run(table, one)[0][0] - logit) < 1e-4


def test_finds_toxic_words_anywhere_in_long_texts():
    rng = np.random.default_rng(0)
    plain = [b"w%d" % i for i in range(60)]
    texts, labels = [], []
    for i in range(120):
        t = [plain[k] for k in rng.integers(0, 60, 70)]
        if i % 2:
            t[int(rng.integers(0, 70))] = b"vile"
        texts.append(t)
        labels.append(i % 2)
    scorer = X.Scorer(X.train(texts, labels, steps=150))
    clean = [plain[k] for k in rng.integers(0, 60, 3000)]
    bad = clean[:2900] + [b"vile"] + clean[2900:]
    a, b = scorer.window_scores([clean, bad])
    assert a.max() < 0 < b.max() and b.argmax() >= len(b) - 5


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, sf).toPandas()
    assert len(got) == 10000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    d = got.merge(ds.dataset(f"{sf}/labels.parquet").to_table().to_pandas(), on="doc_id")
    d = d[d.held_out]
    assert d[d.toxic == 1].predicted.mean() > 0.75
    assert d[d.toxic == 0].predicted.mean() < 0.03


def test_edges(spark):
    rows = [(1, "you vile thing"), (1, "you vile thing"), (None, "nice day"), (2, None), (3, ""), (4, "# $"),
            (5, "nice " * 50000)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, score string, row double")
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 0), (2, None)], "doc_id long, toxic int")
    net = X.fit(docs, labels, F.lit(True))
    got = X.score(docs, net).collect()
    assert len(got) == 7 and {r.score for r in got if r.doc_id in (2, 3, 4)} == {0.0}
    assert X.drop_toxic(docs, net).columns == docs.columns
    empty = docs.limit(0)
    assert X.score(empty, X.fit(empty, labels, F.lit(True))).count() == 0
