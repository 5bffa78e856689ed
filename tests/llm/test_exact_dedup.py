import hashlib

import pytest
from pyspark.sql import functions as F

from litsearch.llm import exact_dedup as E
from litsearch.llm.queries import op1_exact_dedup
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, name string, level int, h long, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "b") for r in rows], SCHEMA).repartition(4)


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        given = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not given, hashlib.sha256(text.encode()).hexdigest()))
            given = given or i == keep
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_chars", [3, 64, 4096])
def test_against_a_dictionary(spark, block_chars):
    rows = [(i, ["abc", "abcabc", "abd", "", None, "é" * 7, "a\nb", "abcabd", "abc" * 300][i * i % 9]) for i in range(60)]
    rows += [(100, "x" * 9000), (101, "x" * 9001), (102, "x" * 9000), (103, "y" + "x" * 8999)]
    rows += [(5, "abc"), (5, "abc"), (None, "abc"), (None, None), (None, "only here"), (7, "only here too"), (7, "twice")]
    assert found(E.exact_dedup(frame(spark, rows), block_chars)) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "same")] * 4 + [(2, "same")] * 3
    assert found(E.exact_dedup(frame(spark, rows))) == brute(rows)
    assert E.exact_dedup(frame(spark, []).where("false")).count() == 0


def test_names_do_not_trust_the_hash(spark, monkeypatch):
    """With a hash that is the same for all blocks, different texts still get different names."""
    rows = [(i, t) for i, t in enumerate(["aaaa", "bbbb", "aaaa", "ab", "ba", "abab" * 5, "abab" * 5, "", None, "b"])]
    monkeypatch.setattr(E.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert found(E.exact_dedup(frame(spark, rows), 2)) == brute(rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert found(op1_exact_dedup(spark, SF_SMALL)) == brute(rows)
