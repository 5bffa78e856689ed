import zlib

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from litsearch.llm import language_id as L
from litsearch.llm.queries import op2_language_id


def test_gradients_against_differences():
    net = L.ByteNetwork.fresh(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, mask = L.packed([b"hello", b"ab", b"xyz"])
    label = np.array([0, 2, 1])
    _, g = net.gradients(data, mask.astype(np.float64), label)
    rng = np.random.default_rng(0)
    for k, w in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape) if not k.startswith("in_") else (
                int(data[0, rng.integers(3)]), int(rng.integers(w.shape[1])))
            old = w[at]
            w[at] = old + 1e-5
            up, _ = net.gradients(data, mask, label)
            w[at] = old - 1e-5
            down, _ = net.gradients(data, mask, label)
            w[at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, (k, at)


def test_padding_changes_nothing():
    net = L.ByteNetwork.fresh(["a", "b"])
    alone, _ = net.run(*L.packed([b"abc"]))
    beside, _ = net.run(*L.packed([b"abc", b"x" * 20]))
    assert np.allclose(alone[:, 0], beside[:3, 0], atol=1e-6)


def test_windows_cover_every_letter():
    text = "Ünï " + "é" * 100 + " a-b 12"
    joined = b"".join(L.windows_of(text))
    assert joined == ("Ünï" + "é" * 100 + "ab").lower().replace("ü", "Ü").encode()
    assert max(map(len, L.windows_of(text))) <= L.WINDOW


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_language_id(spark, sf).toPandas()
    docs = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "lang"]).to_pandas()
    d = docs.merge(got, on="doc_id")
    assert len(d) == len(docs) == len(got)
    assert (d.held_out == d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (d[d.held_out].lang_pred == d[d.held_out].lang).mean() > 0.97
    assert d.score.between(0, 1).all()


def test_edges(spark):
    rows = [(1, "the of and", "en"), (1, "the of and", "en"), (None, "der die das", "de"), (2, None, "en"),
            (3, "", None), (4, "12 # 7", "en"), (5, "ª日本", "en"), (6, "x" * 20000, "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    net = L.fit(docs, F.lit(True))
    assert net.languages == ["de", "en"]
    got = L.identify(docs, net).collect()
    assert len(got) == 8 and [r.lang_pred for r in got if r.doc_id in (2, 3, 4)] == ["und"] * 3
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (1, 5, 6, None))
    empty = docs.limit(0)
    assert L.identify(empty, L.fit(empty, F.lit(True))).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.fit(empty, F.lit(True))).collect()} == {"und"}


def test_runs_label_every_byte_once():
    net = L.train([b"abc", b"xyz"] * 50, ["p", "q"] * 50, steps=60)
    runs = L.label_runs("abc xyz", L.Labeller(net))
    assert [r for r in runs] == [(0, 3, "p"), (4, 7, "q")]
    frame = pd.concat(L._predicted(iter([pd.Series(["abc abc", "xyz"])]), net))
    assert frame.lang_pred.tolist() == ["p", "q"]
