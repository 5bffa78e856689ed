"""An index made by upserts and deletions gives what one built at once gives."""

from pyspark.sql import functions as F

from litsearch.operators.lexical import match_terms, ranked_candidates, terms_from_text
from litsearch.operators.similarity import similarity_corpus
from litsearch.plans import segments
from litsearch.plans.search import SearchConfig, prepare_corpus, search
from litsearch.plans.segments import SegmentedIndex
from litsearch.schemas import PAPER_COLUMNS
from litsearch.session import scratch_path
from tests.test_semantics import zipf_papers


def frame(spark, papers):
    rows = [[i if c == "pmc_id" else a if c == "abstract" else [a[:3]] if c == "keywords" else t if c == "article_title" else ""
             for c in PAPER_COLUMNS] for i, t, a in papers]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'array<string>' if c == 'keywords' else 'string'}"
                                                 for c in PAPER_COLUMNS))


def hits(spark, corpus):
    qs = [("stop", "the"), ("mixed", "the w1 w2 w300"), ("rare", "w390 w391 w392"), ("two", "w5 w9")]
    qs = spark.createDataFrame(qs, "query_id string, user_query string")
    limits = qs.select("query_id", F.lit(9).cast("long").alias("limit"))
    any_ = terms_from_text(qs, "user_query", "any")
    ranked = ranked_candidates(any_, corpus.lexical, limits, 9, few=0)
    both = match_terms(terms_from_text(qs, "user_query", "all"), corpus.lexical, "all")
    post = corpus.lexical.postings.where("tf_abs > 0").select("tb", "term", "pmc_id", F.col("tf_abs").alias("tf"))
    close = similarity_corpus(qs, corpus.stats.select("pmc_id", "abs_sq"), post, corpus.lexical.terms.drop("rest"), k=6,
                              term_buckets=corpus.lexical.term_buckets, floor=7)
    out = search(qs.withColumn("remote_addr", F.lit("h")).withColumn("amount", F.lit(3)).withColumn(
        "threshold", F.lit(0.4).cast("float")), any_.withColumn("alt", F.lit(0)), corpus=corpus,
        config=SearchConfig(rounds=2))
    return ({(r.query_id, r.rk): (r.pmc_id, r.bm25) for r in ranked.collect()},
            {(r.query_id, r.pmc_id): r.bm25 for r in both.collect()},
            {(r.query_id, r.hit_rank): (r.pmc_id, r.score) for r in close.collect()},
            {(r.query_id, r["round"], r.pmc_id): (r.search_score, r.article_title) for r in out.rows.collect()})


def test_upserts_equal_a_rebuild(spark):
    first, second, third = zipf_papers(1, 400, 30), zipf_papers(2, 700, 60), zipf_papers(3, 90, 200)
    third = [(f"n{i}", t, a) for i, t, a in third]
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), term_buckets=4)
    index.upsert(frame(spark, first))
    index.upsert(frame(spark, second[200:] + second[200:210]))  # replaces 200 of the first, adds 300
    index.delete(spark.createDataFrame([("p00000",), ("p00250",), ("p00699",), ("unknown",)], "pmc_id string"))
    index.upsert(frame(spark, third))
    now = {i: (i, t, a) for i, t, a in first + second[200:] + third}
    for gone in ("p00000", "p00250", "p00699"):
        del now[gone]
    want = hits(spark, prepare_corpus(frame(spark, list(now.values())), term_buckets=4))
    corpus = index.corpus()
    assert corpus.stats.count() == len(now) == corpus.papers.count() == corpus.lexical.n_docs
    got = hits(spark, corpus)
    assert got == want and len(got[3]) > 5
    assert not index.compact_if_needed() and index.compact_if_needed(3)
    again = SegmentedIndex(spark, index.root, term_buckets=4)
    again.upsert(frame(spark, []))
    assert hits(spark, again.corpus()) == want


def test_a_run_that_died_before_its_log_row_is_not_seen(spark):
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), term_buckets=2)
    index.upsert(frame(spark, [("a", "", "one two"), ("b", "", "two")]))
    commit, index._commit = index._commit, lambda *_: None
    index.upsert(frame(spark, [("a", "", "three"), ("c", "", "two")]))
    index._commit = commit
    assert {r.pmc_id for r in SegmentedIndex(spark, index.root, term_buckets=2).corpus().stats.collect()} == {"a", "b"}
    index.upsert(frame(spark, [("a", "", "four")]))
    live = {r.term for r in index.corpus().lexical.terms.collect()}
    assert live == {"two", "four"}


def test_dead_rows_are_told_without_a_shuffle(spark, monkeypatch):
    """No posting is shuffled to leave out those of dead papers, and papers that share a slot with dead ones stay."""
    monkeypatch.setattr(segments, "bits_for", lambda keys: 64)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no guess of a size helps
    try:
        index = SegmentedIndex(spark, scratch_path(spark, "segments"), term_buckets=2)
        index.upsert(frame(spark, [(f"p{i}", "", f"old w{i}") for i in range(300)]))
        index.upsert(frame(spark, [(f"p{i}", "", f"new w{i}") for i in range(0, 300, 3)]))
        index.delete(spark.createDataFrame([("p1",), ("p4",)], "pmc_id string"))
        postings = index._rows("postings")
        assert "hashpartitioning" not in postings._jdf.queryExecution().executedPlan().toString()
        got = {(r.term, r.pmc_id) for r in postings.collect()}
        terms = {r.term: r.df for r in index.corpus().lexical.terms.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    live = [i for i in range(300) if i not in (1, 4)]
    assert got == {(f"w{i}", f"p{i}") for i in live} | {("new" if i % 3 == 0 else "old", f"p{i}") for i in live}
    assert (terms["old"], terms["new"], len(terms)) == (198, 100, 300)
