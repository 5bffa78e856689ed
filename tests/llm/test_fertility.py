import math
import re
from collections import Counter

import pandas as pd
import pyarrow.dataset as ds
import sentencepiece

from litsearch.llm.fertility import _rows, fertility_rules, script_of
from litsearch.llm.piece_codec import model_path
from tests.conftest import SF_SMALL

EDGE = ["", " \t\x0b", "word", "a b c a b c", "x\n\nx\n \n \nx", "a b c\x1cd", "# $ | < a", "é" * 9000 + " b"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i:i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, dup, len(marked),
            len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_base_figures_against_brute_force():
    texts = EDGE + ds.dataset(f"{SF_SMALL}/documents.parquet").to_table().column("text").to_pylist()
    got = pd.concat(list(_rows(iter([pd.Series(texts)]), model_path(), model_path("byte_bpe_multi_50k.tiktoken"))))
    for t, r in zip(texts, got.itertuples(index=False)):
        assert tuple(r[:6]) == brute(t)
        assert not (r.base_failed and r.kept)


def test_fertility_against_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    text = "Der schnelle braune Fuchs läuft über den Zaun 😀 und weiter"
    ids = [i for w in text.split() for i in sp.encode(w)]
    (frame,) = _rows(iter([pd.Series([text])]), model_path(), model_path("byte_bpe_multi_50k.tiktoken"))
    r = frame.iloc[0]
    count = Counter(ids).values()
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in count) / math.log2(len(ids) + 1)
    assert r.byte_share == sum(3 <= i < 259 for i in ids) / len(ids)
    assert abs(r.token_entropy - entropy) < 1e-12
    assert r.chars_per_token == sum(map(len, text.split())) / len(ids)


def test_scripts():
    assert [script_of(t) for t in ("abc é", "привет", "漢字かな", "한국어", "123 !", "")] == [
        "latin", "cyrillic", "cjk", "hangul", "other", "other"]


def test_null_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5)], "doc_id long, text string, kept int")
    assert [(r.n_words, r.base_failed, r.kept) for r in fertility_rules(docs).collect()] == [(0, True, False)] * 2
    assert fertility_rules(docs.limit(0)).count() == 0


def test_clean_labelled_texts_stay():
    docs = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().to_pandas()
    marks = ds.dataset("/root/testdata/sf0.01/labels.parquet").to_table().to_pandas()
    d = docs.merge(marks, on="doc_id")
    got = pd.concat(list(_rows(iter([d.text]), model_path(), model_path("byte_bpe_multi_50k.tiktoken"))))
    d["kept"], d["base"] = got.kept.values, got.base_failed.values
    clean = d[(d.quality == 1) & ~d.base]
    assert clean.kept.mean() > 0.98
    assert d[(d.quality == 0)].kept.mean() < 0.4


def test_repeated_words_with_many_codes():
    import numpy as np
    from litsearch.llm.fertility import repeated_words

    def plain(codes):
        seen, marked = {}, set()
        for i in range(len(codes) - 2):
            seen.setdefault(tuple(codes[i:i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                marked |= {i + k for i in at for k in range(3)}
        return len(marked)

    assert repeated_words(np.array([0, 0, 2 ** 21, 50, 0, 1, 0])) == 0
    rng = np.random.default_rng(3)
    for high in (5, 2 ** 21 - 1, 2 ** 21 + 3, 2 ** 40):
        words = rng.integers(0, high, 12)
        codes = words[rng.integers(0, 12, 400)]
        assert repeated_words(codes) == plain(codes.tolist())
    many = np.arange(2_200_000)
    assert repeated_words(np.concatenate([many, many[-5:]])) == 10
