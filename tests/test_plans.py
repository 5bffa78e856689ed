"""The physical plans keep the properties the scale design relies on."""

from pyspark.sql import functions as F

from litsearch.catalog import queries as Q
from litsearch.operators import lexical
from litsearch.operators.lexical import match_terms
from litsearch.session import few
from litsearch.plans.search import SearchConfig, exploded_terms, paper_terms, round_candidates, with_paper_key
from litsearch.operators.similarity import question_vectors
from litsearch.sources import fixtures as FX
from litsearch.sources.requests import apply_defaults
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidate_topk_is_partial_before_shuffle(spark):
    p = plan(Q.q_candidates_topk(spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_round_prunes_postings_by_term_bucket(spark):
    d = FX.load(spark, SF_SMALL)
    corpus = Q.corpus_for(spark, SF_SMALL)
    q = apply_defaults(d["queries"])
    active = q.join(question_vectors(q), "query_id").withColumn("next_alt", F.lit(1))
    terms = d["query_terms"].where("alt = 2").select("query_id", "group_id", "term")
    p = plan(round_candidates(active, terms, corpus, SearchConfig(match="any"), 6))
    assert "dynamicpruningexpression" in p.lower()
    assert "WindowGroupLimit" in p


def test_corpus_preparation_shuffles_counts_once(spark):
    """Counts are made in a paper's row: only the postings themselves are dealt out, and the papers' texts never."""
    papers = FX.load(spark, SF_SMALL)["papers"]
    rows = paper_terms(papers.withColumn("real_id", F.col("pmc_id")))
    assert "Exchange" not in plan(exploded_terms(rows))
    assert "SortMergeJoin" not in plan(with_paper_key(papers)) and "hashpartitioning" not in plan(with_paper_key(papers))


def test_lookup_does_not_shuffle_the_postings(spark):
    """The rarest group's papers are few: the postings meet them as they are read."""
    d = FX.load(spark, SF_SMALL)
    corpus = Q.corpus_for(spark, SF_SMALL)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no guess of a size helps
    try:
        p = plan(match_terms(d["query_terms"].where("alt = 0"), corpus.lexical, "all"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert p.count("BroadcastHashJoin [pmc_id") == 1 and p.count("LeftSemi") >= 2


def test_ranked_lookup_does_not_shuffle_the_postings(spark, monkeypatch):
    """Postings meet the pairs as they are read, few ones themselves, of many a bitmap; both give the same scores."""
    d = FX.load(spark, SF_SMALL)
    index = Q.corpus_for(spark, SF_SMALL).lexical
    lists = d["query_terms"].where("alt = 2").select("query_id", "term").distinct().join(index.terms, "term")
    pairs = (lists.join(index.postings, ["tb", "term"]).where("pmc_id like '%1' and tf > 0").select("query_id", "pmc_id").distinct()
             .withColumn("known", F.lit(1.0)))
    got = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (500_000, 100):
            monkeypatch.setattr(lexical, "few", lambda df, name: few(df, name, rows if "pairs" in name else 500_000))
            scored = lexical._looked_up(pairs, lists, index)
            assert "hashpartitioning(term" not in plan(scored)
            got.append({(r.query_id, r.pmc_id): round(r.score, 6) for r in scored.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    terms = lists.select("query_id", F.lit(0).alias("group_id"), "term")
    want = {(r.query_id, r.pmc_id): round(1 + r.bm25, 6) for r in match_terms(terms, index, "any").collect()}
    assert got[0] == got[1] and len(got[0]) > 100
    assert all(abs(x - want[k]) < 2e-6 for k, x in got[0].items())


def test_papers_that_share_ids_have_short_keys(spark):
    """Only papers that share both ids are named by a hash too, and only their texts are shuffled."""
    papers = FX.load(spark, SF_SMALL)["papers"].limit(8).withColumn("pmc_id", F.lit("x"))
    papers = papers.withColumn("pm_id", F.when(F.col("pm_id") % 4 == 0, "7").otherwise(F.col("pm_id")))
    named = with_paper_key(papers.unionByName(papers))  # rows that agree in every column become one
    keys = [r.pk for r in named.collect() if r.pm_id != "7"]
    assert named.select("pk").distinct().count() == named.count() == papers.distinct().count()
    lone = {r.pm_id for r in papers.collect()} - {"7"}
    assert len(lone) > 2 and len(keys) == len(lone)
    once = with_paper_key(papers.where("pm_id <> '7'"))
    assert {r.pk for r in once.collect()} == {f"x\u0001{i}" for i in lone}
    assert "hashpartitioning" not in plan(once)


def test_documents_scan_reads_only_needed_columns(spark):
    docs = FX.read_table(spark, SF_SMALL, "documents")
    p = plan(FX.papers_from_documents(docs).select("pmc_id", "article_title"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
