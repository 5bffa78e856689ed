"""Hand-made cases for the semantic traps of the pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from litsearch.functions.paper import author, effective_amount, effective_threshold, id_of_type
from litsearch.functions.text import abstract_text, token_count, trim_ws
from litsearch.operators import feedback as FB
from litsearch.operators import merge as MG
from litsearch.operators.boolean import Unreadable, match_strings, parsed_strings, postfix_of
from litsearch.operators.index import index_rows, latest_per_object
from litsearch.operators.lexical import (CHAMPIONS, match_terms, open_candidates, ranked_candidates,
                                         terms_from_text, top_candidates)
from litsearch.operators.ranking import rank_results
from litsearch.operators.similarity import (block_topk, bounded_pairs, cosine, dense_topk, similarity_corpus, sum_of_squares,
                                            term_counts)
from litsearch.plans.search import counts_in_row, prepare_corpus
from litsearch.schemas import PAPER_COLUMNS
from litsearch.plans.results import result_documents, result_rows
from litsearch.sources.requests import validate_requests, with_ids


def test_threshold_equal_to_score_is_rejected(spark):
    df = spark.createDataFrame([("q", "p", 0.3)], "query_id string, pmc_id string, s double")
    df = df.select("query_id", "pmc_id", F.col("s").cast("float").alias("search_score"),
                   F.lit(0.3).cast("float").alias("threshold"))
    assert MG.above_threshold(df).count() == 0
    # compared with a DOUBLE 0.3 the FLOAT score would pass: the trap
    assert df.where(F.col("search_score") > F.lit(0.3)).count() == 1


def test_defaults(spark):
    df = spark.createDataFrame([(0, 0.0), (None, None), (5, 0.5)], "amount int, threshold float")
    rows = df.select(effective_amount("amount").alias("a"),
                     effective_threshold("threshold").alias("t")).collect()
    assert [r.a for r in rows] == [3, 3, 5]
    assert rows[0].t == pytest.approx(0.3) and rows[2].t == pytest.approx(0.5)


def test_index_token_limit_3500_kept_3501_dropped(spark):
    a3500 = " ".join(["w"] * 3500)
    a3501 = " ".join(["w"] * 3501)
    df = spark.createDataFrame([("q", "question", "a", a3500), ("q", "question", "b", a3501),
                                ("q", "question", "c", "")],
                               "query_id string, user_query string, pmc_id string, abstract string")
    rows = index_rows(df).collect()
    assert [r.object_id for r in rows] == ["a"]
    assert rows[0].data.startswith("[question] - w w")
    assert rows[0].category == "plain-text" and rows[0].properties == ""


def test_unicode_trim_and_join(spark):
    df = spark.createDataFrame([(["  One", "two\u0085 "],)], "p array<string>")
    assert df.select(abstract_text("p")).first()[0] == "One\ntwo"
    df2 = spark.createDataFrame([("\t x y \n",)], "t string")
    assert df2.select(trim_ws("t")).first()[0] == "x y"


def test_author_space_always_present(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None), (None, None)], "s string, g string")
    assert [r[0] for r in df.select(author("s", "g")).collect()] == ["A B", "A ", " "]


def test_ids_last_of_type_wins_unknown_ignored(spark):
    df = spark.createDataFrame(
        [([("1", "pmc"), ("x", "other"), ("2", "pmc"), ("d", "doi")],), ([],)],
        "ids array<struct<id:string,type:string>>")
    rows = df.select(id_of_type("ids", "pmc").alias("p"), id_of_type("ids", "doi").alias("d"),
                     id_of_type("ids", "pmid").alias("m")).collect()
    assert (rows[0].p, rows[0].d, rows[0].m) == ("2", "d", "")
    assert (rows[1].p, rows[1].d, rows[1].m) == ("", "", "")


def test_duplicate_pmc_id_last_wins(spark):
    df = spark.createDataFrame([("q", "p", 1, "first"), ("q", "p", 2, "second"), ("q", "r", 3, "x")],
                               "query_id string, pmc_id string, rk int, v string")
    out = {r.pmc_id: r.v for r in MG.dedupe_last(df).collect()}
    assert out == {"p": "second", "r": "x"}


def test_all_abstracts_empty_true_without_papers(spark):
    active = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    papers = spark.createDataFrame([("a", ""), ("b", ""), ("b", "text")],
                                   "query_id string, abstract string")
    out = {r.query_id: r.all_empty for r in MG.all_abstracts_empty(active, papers).collect()}
    assert out == {"a": True, "b": False, "c": True}


def test_keyword_weights_count_repeats_and_zero_scores(spark):
    df = spark.createDataFrame([("q", ["k", "k", "z"], 0.5), ("q", ["z"], 0.0), ("q", ["y"], 0.25)],
                               "query_id string, keywords array<string>, search_score float")
    w = {r.keyword: r.weight for r in FB.keyword_weights(df).collect()}
    assert w == {"k": 1.0, "z": 0.5, "y": 0.25}
    top = FB.top_keywords(FB.keyword_weights(df), 2).orderBy("kw_rank").collect()
    assert [r.keyword for r in top] == ["k", "z"]


def test_keyword_ties_broken_by_keyword(spark):
    df = spark.createDataFrame([("q", ["b", "a", "c", "d"], 1.0)],
                               "query_id string, keywords array<string>, search_score float")
    fb = FB.feedback_query(FB.top_keywords(FB.keyword_weights(df))).first()
    assert fb.next_query == "a b c"


@pytest.mark.parametrize("amount,expected_count,expected_order", [
    (5, 3, ["p1", "p2", "p3"]),      # amount > n: all rows in append order
    (3, 3, ["p3", "p2", "p1"]),      # amount = n: sorted by score
    (2, 2, ["p3", "p2"]),            # amount < n: first amount by score
])
def test_rank_results(spark, amount, expected_count, expected_order):
    rows = spark.createDataFrame(
        [("q", 0, 1, "p1", 0.4), ("q", 0, 2, "p2", 0.5), ("q", 1, 1, "p3", 0.9)],
        "query_id string, round int, hit_rank int, pmc_id string, search_score float")
    params = spark.createDataFrame([("q", amount)], "query_id string, amount int")
    out = rank_results(rows, params).orderBy("rk").collect()
    assert [r.pmc_id for r in out] == expected_order
    assert {r.paper_count for r in out} == {expected_count}


def test_bag_semantics_duplicates_count(spark):
    rows = spark.createDataFrame(
        [("q", 0, 1, "p1", 0.7), ("q", 1, 1, "p1", 0.7)],
        "query_id string, round int, hit_rank int, pmc_id string, search_score float")
    params = spark.createDataFrame([("q", 2)], "query_id string, amount int")
    assert rank_results(rows, params).count() == 2
    assert MG.first_per_paper(rows).count() == 1


def test_sum_of_squares_and_cosine(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(sum_of_squares("t")).collect()] == [11, 0]
    one = spark.range(1).select(cosine(F.lit(2), F.lit(3), F.lit(6)).alias("c")).first().c
    import math
    assert one == pytest.approx(5 / (math.sqrt(3) * math.sqrt(6 + 4 + 3)))


def corpus_of(spark, papers):
    """A prepared corpus of (pmc_id, title, abstract)."""
    rows = [{**dict.fromkeys(PAPER_COLUMNS, ""), "pmc_id": i, "article_title": t, "abstract": a, "keywords": []}
            for i, t, a in papers]
    return prepare_corpus(spark.createDataFrame(
        [[r[c] for c in PAPER_COLUMNS] for r in rows],
        ", ".join(f"{c} {'array<string>' if c == 'keywords' else 'string'}" for c in PAPER_COLUMNS)), term_buckets=4)


def zipf_papers(seed, n, longest):
    import random
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(f"p{i:05d}", "", "the " * rnd.randint(1, 3) + " ".join(rnd.choices(words, weights, k=rnd.randint(0, longest))))
            for i in range(n)]


def test_similarity_corpus_is_exact(spark):
    """Whole-corpus top k equals brute force over all pairs, incl. papers
    that share no term with the question."""
    import math
    import random
    from collections import Counter
    papers = zipf_papers(7, 300, 60)
    rnd = random.Random(1)
    qs = [("q1", "w1 w2"), ("q2", "zzz unknown"), ("q3", "w3 w3 w300"), ("q4", ""), ("q5", "the"), ("q6", "the w399 w398 w390")]
    qs += [(f"r{i}", " ".join(rnd.choices(papers[rnd.randrange(300)][2].split(), k=12)) + " w9") for i in range(8)]
    corpus = corpus_of(spark, papers)
    post = corpus.lexical.postings.where("tf_abs > 0").select("tb", "term", "pmc_id", F.col("tf_abs").alias("tf"))
    for floor in (1, 4, 10_000):
        got = similarity_corpus(spark.createDataFrame(qs, "query_id string, user_query string"),
                                corpus.stats.select("pmc_id", "abs_sq"), post, corpus.lexical.terms.drop("rest"), k=5,
                                term_buckets=4, floor=floor)
        got = {(r.query_id, r.hit_rank): (r.pmc_id, r.score) for r in got.collect()}
        vectors = {pid: Counter(a.split()) for pid, _, a in papers}
        for qid, q in qs:
            qv = Counter(q.split())
            qq, scores = sum(x * x for x in qv.values()), []
            for pid, a in vectors.items():
                qa, aa = sum(qv[w] * a[w] for w in qv), sum(x * x for x in a.values())
                scores.append((-((qa + qq) / (math.sqrt(qq) * math.sqrt(aa + 2.0 * qa + qq))) if qq else 0, pid))
            expected = [pid for _, pid in sorted(scores)[:5]] if qq else []
            assert [got[(qid, i)][0] for i in range(1, 6) if (qid, i) in got] == expected, (qid, floor)


def test_similarity_pairs_do_not_follow_a_word_of_all_papers(spark):
    papers = zipf_papers(3, 3000, 80)
    corpus = corpus_of(spark, papers)
    post = corpus.lexical.postings.where("tf_abs > 0").select("tb", "term", "pmc_id", F.col("tf_abs").alias("tf"))
    q = spark.createDataFrame([("q", "the"), ("r", "the w350 w351 w352")], "query_id string, user_query string")
    floor, others, _ = bounded_pairs(q, corpus.stats.select("pmc_id", "abs_sq"), post, 4,
                                     corpus.lexical.terms.drop("rest"), 5)
    assert floor.count() <= 2 * 330 and others.count() < 100


def test_similarity_reads_no_long_list_for_many_tiny_papers(spark):
    """More papers than the floor are as small as its largest: a common word is read up to its reach all the same."""
    papers = [(f"t{i}", "", f"tiny{i}") for i in range(400)] + zipf_papers(3, 600, 80)
    corpus = corpus_of(spark, papers)
    post = corpus.lexical.postings.where("tf_abs > 0").select("tb", "term", "pmc_id", "abs_sq", F.col("tf_abs").alias("tf"))
    q = spark.createDataFrame([("q", "the the w350 w351 w352 w353")], "query_id string, user_query string")
    _, others, unread = bounded_pairs(q, corpus.stats.select("pmc_id", "abs_sq"), post, 4, corpus.lexical.terms.drop("rest"), 5)
    reach = {r.term: r.reach for r in unread.collect()}
    assert reach["the"] < 50 and others.count() < 50


def test_counts_in_row_of_two_fields(spark):
    row = spark.sql("select array('b', 'a', 'ab', 'b') own, array('c', 'b', 'a', 'c') other, cast(array() as array<string>) none")
    got = row.select(*[counts_in_row(F.col(x), F.col(y)).alias(x + y) for x, y in (
        ("own", "other"), ("own", "none"), ("none", "other"), ("none", "none"))]).first()
    plain = {k: sorted(map(tuple, v)) for k, v in got.asDict().items()}
    assert plain["ownother"] == [("a", 1, 1), ("ab", 1, 0), ("b", 2, 1), ("c", 0, 2)]
    assert plain["ownnone"] == [("a", 1, 0), ("ab", 1, 0), ("b", 2, 0)]
    assert plain["noneother"] == [("a", 0, 1), ("b", 0, 1), ("c", 0, 2)] and plain["nonenone"] == []


def test_counts_of_many_rows_in_batches():
    """Rows of a batch are counted apart, empty, null and very long ones too, however the batch is cut."""
    import random
    import pyarrow as pa
    from collections import Counter
    from litsearch.plans.search import COUNTED_ROWS, counted_rows
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "ab", "b", "\u00e9t\u00e9", "\U0001f600x", "z" * 40, str(rng.randrange(50))])
    lists = lambda n: [rng.choice([None, []]) if rng.random() < 0.2 else [word() for _ in range(rng.choice([1, 5, 30, 3000 // (1 + i % 99)]))]  # noqa: E731,E501
                       for i in range(n)]
    for n in (0, 1, COUNTED_ROWS, COUNTED_ROWS * 2 + 7):
        own, other = lists(n), lists(n)
        got = counted_rows(pa.array([[]] + own, pa.list_(pa.string())).slice(1), pa.array(other, pa.list_(pa.string()))).to_pylist()
        assert len(got) == n
        for a, b, row in zip(own, other, got):
            a, b = Counter(a or []), Counter(b or [])
            assert [(x["term"], x["own"], x["other"]) for x in row] == [
                (t, a[t], b[t]) for t in sorted(a.keys() | b.keys(), key=str.encode)]


def test_block_topk_keeps_lesser_ids_of_equal_scores():
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (2500, 3)).astype(float)  # many equal scores
    index = pd.DataFrame({"vec_id": rng.permutation(2500), "embedding": list(vectors)})
    questions = pd.DataFrame({"vec_id": np.arange(40), "embedding": list(vectors[:40])})
    for k, rows in ((7, 2500), (7, 3), (1200, 2500)):
        got = block_topk(questions, index[:rows], k)
        for i in range(40):
            scores = vectors[:rows] @ vectors[i]
            want = sorted(zip(-scores, index["vec_id"][:rows]))[:k]
            assert [(-s, v) for s, v in want] == list(zip(got["score"], got["vec_id"]))[i * len(want):(i + 1) * len(want)]


def test_ranked_candidates_equal_scoring_every_match(spark):
    import random
    rnd = random.Random(4)
    papers = zipf_papers(5, 1500, 50)
    corpus = corpus_of(spark, papers)
    qs = [("stop", "the"), ("rare", "w399"), ("none", "zzz"), ("mixed", "the w1 w2 w399"), ("few", "w390 w391")]
    qs += [(f"q{i}", " ".join({*rnd.choices(papers[rnd.randrange(1500)][2].split(), k=15), "the"})) for i in range(15)]
    terms = terms_from_text(spark.createDataFrame(qs, "query_id string, text string"), "text", "any")
    limits = spark.createDataFrame([(q, 2 + 3 * (i % 4)) for i, (q, _) in enumerate(qs)], "query_id string, limit long")
    want = top_candidates(match_terms(terms, corpus.lexical, "any"), limits, 11)
    got = ranked_candidates(terms, corpus.lexical, limits, 11, few=0)
    key = lambda df: {(r.query_id, r.rk): (r.pmc_id, round(r.bm25, 5)) for r in df.collect()}
    assert key(got) == key(want) and len(key(got)) > 80


def test_scored_papers_do_not_follow_a_word_of_all_papers(spark):
    corpus = corpus_of(spark, [(f"p{i:05d}", "", "the " * (1 + i % 5) + f"a{i} " * (i % 97)) for i in range(4000)])
    terms = spark.createDataFrame([("q", "the")], "query_id string, term string")
    limits = spark.createDataFrame([("q", 6)], "query_id string, limit long")
    kept, unread = open_candidates(terms, corpus.lexical, limits, 6)
    assert 6 <= kept.count() <= CHAMPIONS and unread.count() == 1


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(term_counts("t")).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_dense_topk_in_blocks(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    mat = rng.normal(size=(150, 8)).round(1)
    mat[20] = mat[90] = mat[3]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(mat)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    hits = dense_topk(df.where("vec_id % 2 = 0"), df, k=7, question_rows=20, index_rows=40)
    assert "BatchEvalPython" not in hits._jdf.queryExecution().toString()
    got = {(r.query_vec_id, r.hit_rank): r.vec_id for r in hits.collect()}
    single = mat.astype(np.float32).astype(np.float64)
    for q in range(0, 150, 2):
        order = np.lexsort((np.arange(150), -(single @ single[q])))[:7]
        assert [got[(q, i)] for i in range(1, 8)] == list(order)
    assert len(got) == 75 * 7
    assert dense_topk(df.limit(0), df, k=3).count() == 0


def test_boolean_match_all_and_any(spark):
    lex = corpus_of(spark, [("p1", "red apple", ""), ("p2", "red pear", ""), ("p3", "green apple", "")]).lexical
    q = spark.createDataFrame([("q", "red apple"), ("no", "red zebra")], "query_id string, text string")
    all_ = {r.pmc_id for r in match_terms(terms_from_text(q, "text", "all"), lex, "all").collect()}
    any_ = {r.pmc_id for r in match_terms(terms_from_text(q.where("query_id = 'q'"), "text", "any"), lex, "any").collect()}
    assert all_ == {"p1"} and any_ == {"p1", "p2", "p3"}
    # (red or green) and (apple)
    t = spark.createDataFrame([("q", 0, "red"), ("q", 0, "green"), ("q", 1, "apple")],
                              "query_id string, group_id int, term string")
    assert {r.pmc_id for r in match_terms(t, lex, "all").collect()} == {"p1", "p3"}


def test_validate_requests(spark):
    df = spark.createDataFrame([("1", "ok", 1), ("2", None, 0), ("3", "", 0), ("4", "x", -1)],
                               "query_id string, user_query string, amount int")
    out = {r.query_id: (r.status, r.reason) for r in validate_requests(df).collect()}
    assert out["1"] == ("accepted", "")
    assert out["2"][0] == out["3"][0] == out["4"][0] == "rejected"


def test_validate_requests_without_and_with_the_same_id(spark):
    rows = [(None, "a", 1), (None, "b", 1), (None, "b", 1), ("x", "c", 1), ("x", "d", 1), ("x", "c", 1)]
    checked = validate_requests(spark.createDataFrame(rows, "query_id string, user_query string, amount int"))
    got = sorted((r.query_id or "", r.reason) for r in checked.collect())
    assert got == [("", "")] * 3 + [("x", ""), ("x", "query_id is taken"), ("x", "query_id is taken")]
    assert checked.columns == ["query_id", "user_query", "amount", "reason", "status"]
    assert "Window" not in checked._jdf.queryExecution().toString()


def test_ids_of_equal_requests(spark):
    rows = [(None, "a", 1, 0.5, "h")] * 5 + [("own", "a", 1, 0.5, "h")]
    given = with_ids(spark.createDataFrame(
        rows, "query_id string, query string, amount int, threshold float, remote_addr string").repartition(3))
    ids = sorted(r.query_id for r in given.collect())
    assert len(set(ids)) == 6 and "own" in ids and ids == sorted(r.query_id for r in given.collect())
    assert "Window" not in given._jdf.queryExecution().toString()


def test_latest_per_object(spark):
    log = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2), ("b", "v1", 1)],
                                "object_id string, data string, version int")
    out = {r.object_id: r.data for r in latest_per_object(log).collect()}
    assert out == {"a": "v2", "b": "v1"}


def test_result_document_nulls_and_escaping(spark):
    ranked = spark.createDataFrame(
        [("q1", 1, 0.5, "T<i>", "", [], "", "PMC1", "", "a b", "u", "2020", 1)],
        "query_id string, rk int, search_score float, article_title string, abstract string, "
        "keywords array<string>, doi string, pmc_id string, pm_id string, author string, "
        "url string, pub_year string, paper_count int")
    attempts = spark.createDataFrame([("q1", 0, "x & y"), ("q2", 0, "z")],
                                     "query_id string, round int, query_text string")
    queries = spark.createDataFrame([("q1", "hello", 0.3), ("q2", "none", 0.6)],
                                    "query_id string, user_query string, threshold float")
    docs = {r.query_id: r.document for r in result_documents(
        result_rows(ranked, attempts, queries), 123).collect()}
    d1, d2 = json.loads(docs["q1"]), json.loads(docs["q2"])
    assert d1["ts"] == 123 and d1["data"]["paper_count"] == 1
    assert d1["data"]["papers"][0]["keywords"] is None          # nil list
    assert list(d1["data"]["papers"][0]) == ["search_score", "article_title", "abstract",
                                             "keywords", "doi", "pmc_id", "pm_id", "author",
                                             "url", "pub_year"]
    assert "\\u003c" in docs["q1"] and "\\u0026" in docs["q1"]  # HTML-safe like the service
    assert d2["data"]["papers"] is None and d2["data"]["paper_count"] == 0
    assert d2["data"]["keywords"] == ["z"]


def test_token_count_counts_letters_and_digits(spark):
    df = spark.createDataFrame([("Hello, world 42! Ça-va",)], "t string")
    assert df.select(token_count("t")).first()[0] == 5


@pytest.mark.parametrize("text, postfix, leaves", [
    ('("bacteria" and "cancer") and ("a" or "b" or "c d")', [0, 1, -1, 2, 3, -2, 4, -2, -1], ["bacteria", "cancer", "a", "b", "c d"]),
    ("a b OR c", [0, 1, -1, 2, -2], ["a", "b", "c"]),
    ("a or b and c", [0, 1, -2, 2, -1], ["a", "b", "c"]),
    ('((("x")))', [0], ["x"]),
    ('a(b or"and")c', [0, 1, 2, -2, -1, 3, -1], ["a", "b", "and", "c"]),
])
def test_search_string_is_read(text, postfix, leaves):
    assert postfix_of(text) == (postfix, leaves)


@pytest.mark.parametrize("text, reason", [
    ("", "empty"), ("  \n", "empty"), ("()", "operator without operand"), ("(a", "unbalanced parenthesis"),
    ("a)", "unbalanced parenthesis"), ("a and", "operator without operand"), ("or a", "operator without operand"),
    ("a and or b", "operator without operand"), ('"a', "unterminated quote"), ("(a or)", "operator without operand"),
    ('"a" "', "unterminated quote")])
def test_search_string_that_cannot_be_read(text, reason):
    with pytest.raises(Unreadable, match=reason):
        postfix_of(text)


def test_search_strings_against_plain_sets(spark):
    import random
    rnd = random.Random(8)
    words = list("abcdefgh")
    papers = [(f"p{i}", "", " ".join(rnd.sample(words, rnd.randint(0, 6)))) for i in range(60)]
    has = {w: {p for p, _, a in papers if w in a.split()} for w in words + ["zz"]}

    def tree(depth):
        if not depth or rnd.random() < 0.2:
            some = rnd.sample(words + ["zz"], rnd.choice([1, 1, 2]))
            return '"' + " ".join(some).upper() + '"', set.intersection(*[has[w] for w in some])
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        op = rnd.choice(["and", "or"])
        return f"({a} {op} {b})", x & y if op == "and" else x | y

    cases = {f"q{i}": tree(i % 5) for i in range(40)}
    deep = "(" * 60 + "a" + " or b) and c" + ")" * 59  # many levels
    cases["deep"] = (deep, (has["a"] | has["b"]) & has["c"])
    rows = [(q, t) for q, (t, _) in cases.items()] + [("null", None), ("dash", '"—" or a'), ("open", "(a")]
    parsed = parsed_strings(spark.createDataFrame(rows, "query_id string, search_string string"))
    assert {r.query_id: r.reason for r in parsed.where("reason is not null").collect()} == {
        "null": "empty", "dash": "term without letters or digits", "open": "unbalanced parenthesis"}
    got = {}
    for r in match_strings(parsed, corpus_of(spark, papers).lexical).collect():
        got.setdefault(r.query_id, set()).add(r.pmc_id)
    assert {q: got.get(q, set()) for q in cases} == {q: x for q, (_, x) in cases.items()}


def test_search_string_reads_the_lists_of_its_cover_only(spark):
    from litsearch.operators.boolean import cover
    df = spark.createDataFrame([([0, 1, -2, 2, -1], [10, 10, 7]), ([0, 1, -2, 2, -1], [3, 2, 7])],
                               "postfix array<int>, costs array<long>")
    assert [sorted(r[0]) for r in df.select(cover(F.col("postfix"), F.col("costs"))).collect()] == [[2], [0, 1]]


def test_token_limit_by_a_vocabulary(spark):
    import base64

    import public_tokenizers
    import tiktoken
    from litsearch.functions.vocabulary import token_counter, vocabulary_path
    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "one two three", "étiologie — naïve <|endoftext|>", "word " * 5000, "a" * 3000]
    rows = [("q", "ask", f"p{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id string, user_query string, pmc_id string, abstract string")
    counts = {r.pmc_id: r.n for r in df.select("pmc_id", token_counter()("abstract").alias("n")).collect()}
    assert counts == {f"p{i}": len(plain.encode_ordinary(t)) for i, t in enumerate(texts)}
    kept = {r.object_id: r.n_tokens for r in index_rows(df, count=token_counter()).collect()}
    assert kept == {i: n for i, n in counts.items() if 0 < n <= 3500}
    papers = [("a", "", "plain words"), ("b", "", "½¾ ☃☃☃☃")]
    base = corpus_of(spark, papers).papers.drop("pk")
    stats = {r.pmc_id: r.n_tokens for r in prepare_corpus(base, term_buckets=2, count=token_counter()).stats.collect()}
    assert stats == {i: len(plain.encode_ordinary(t)) for i, _, t in papers}
