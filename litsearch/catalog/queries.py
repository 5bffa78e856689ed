"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Inputs always come from the scale-factor folder's tables through the rules
in ``litsearch.sources.fixtures``, so every query's work grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.functions.paper import author, id_of_type, paper_url
from litsearch.functions.text import abstract_text
from litsearch.operators import feedback as FB
from litsearch.operators import lexical as LX
from litsearch.operators import merge as MG
from litsearch.operators import ranking as RK
from litsearch.operators import similarity as SIM
from litsearch.operators.index import index_rows, indexable, latest_per_object
from litsearch.schemas import CANDIDATE_FACTOR, MAX_INDEX_TOKENS, PAPER_COLUMNS
from litsearch.session import few
from litsearch.sources import fixtures as FX
from litsearch.sources.requests import apply_defaults, validate_requests


def _tables(spark: SparkSession, sf_dir: str) -> dict:
    d = FX.load(spark, sf_dir)
    d["params"] = apply_defaults(d["queries"])
    return d


_CORPUS_CACHE: dict = {}


def corpus_for(spark: SparkSession, sf_dir: str):
    """The prepared corpus of a folder (tokenized once, stored in the shared
    checkpoint folder, reused by every query of the session)."""
    from litsearch.plans.search import prepare_corpus
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _CORPUS_CACHE:
        _CORPUS_CACHE[key] = prepare_corpus(FX.load(spark, sf_dir)["papers"])
    return _CORPUS_CACHE[key]


class Round:
    """The first round of the pipeline for one alternative, over the
    prepared corpus (postings and per-paper stats; no text re-read)."""

    def __init__(self, spark: SparkSession, sf_dir: str, alt: int = 2, match: str = "any"):
        d = _tables(spark, sf_dir)
        self.d = d
        self.corpus = corpus_for(spark, sf_dir)
        self.params = d["params"]
        terms = d["query_terms"].where(F.col("alt") == alt).select("query_id", "group_id", "term")
        most = CANDIDATE_FACTOR * int(self.params.agg(F.max("amount")).first()[0] or 1)
        limits = self.params.select("query_id", (F.col("amount").cast("long") * CANDIDATE_FACTOR).alias("limit"))
        if match == "any":
            self.cands = LX.ranked_candidates(terms, self.corpus.lexical, limits, most)
        else:
            self.cands = LX.top_candidates(LX.match_terms(terms, self.corpus.lexical, match), limits, most)

    @cached_property
    def stored(self) -> DataFrame:
        """The candidates, found once for all the steps that read them."""
        return few(self.cands.select("query_id", "pmc_id", "rk"), "round-candidates")[0]

    def candidate_papers(self) -> DataFrame:
        """Candidates with the full paper columns (for index rows)."""
        papers = self.corpus.papers.drop("pmc_id").withColumnRenamed("pk", "pmc_id")
        return self.stored.join(papers, "pmc_id")

    def candidate_stats(self) -> DataFrame:
        return self.stored.join(self.corpus.stats, "pmc_id")

    def hits(self, score=SIM.COSINE) -> DataFrame:
        from litsearch.plans.search import candidate_dots
        c = self.candidate_stats().where(
            (~F.col("empty_abstract")) & (F.col("n_tokens") <= F.lit(MAX_INDEX_TOKENS)))
        active = self.params.join(SIM.question_vectors(self.params), "query_id")
        dots = candidate_dots(c.select("query_id", "pmc_id", "n_tokens"), active, self.corpus.lexical, score)
        entries = (c.join(dots, ["query_id", "pmc_id"], "left")
                   .join(active.select("query_id", "q_sq"), "query_id")
                   .select("query_id", "pmc_id", "abs_sq", "q_sq",
                           F.coalesce(F.col("qa"), F.lit(0)).alias("qa")))
        return SIM.score_own_index(entries, score=score)

    def scored_left(self) -> DataFrame:
        c = self.candidate_stats().select("query_id", "pmc_id", "rk", "keywords")
        return MG.score_papers_left(c, self.hits())

    def passing(self) -> DataFrame:
        s = self.scored_left().where(F.col("hit_rank").isNotNull())
        return MG.above_threshold(s.join(self.params.select("query_id", "threshold"), "query_id"))


# --- lexical ---------------------------------------------------------------------

def q_candidates_topk(spark, sf_dir):
    r = Round(spark, sf_dir)
    return r.cands.select("query_id", "pmc_id", "bm25", F.col("rk").cast("int").alias("rk"))


def q_candidates_boolean(spark, sf_dir):
    d = _tables(spark, sf_dir)
    lex = corpus_for(spark, sf_dir).lexical
    out = None
    for alt in (0, 1):
        t = d["query_terms"].where(F.col("alt") == alt).select("query_id", "group_id", "term")
        m = LX.match_terms(t, lex, "all").select(
            "query_id", F.lit(alt).alias("alt"), "pmc_id", "bm25", "n_groups")
        out = m if out is None else out.unionByName(m)
    return out


def q_boolean_strings(spark, sf_dir):
    """Search strings as text; those that cannot be read come with the reason and no paper."""
    from litsearch.operators.boolean import match_strings, parsed_strings
    parsed = parsed_strings(FX.search_strings_from_queries(_tables(spark, sf_dir)["queries"]))
    matches = match_strings(parsed, corpus_for(spark, sf_dir).lexical)
    strings = parsed.select("query_id", "search_string", "reason")
    rejected = strings.where("reason is not null").select(
        "query_id", "search_string", F.lit(None).cast("string").alias("pmc_id"), F.lit(None).cast("double").alias("bm25"),
        "reason")
    return strings.join(matches, "query_id").select("query_id", "search_string", "pmc_id", "bm25", "reason").unionByName(
        rejected)


# --- similarity ------------------------------------------------------------------

def _similarity(spark, sf_dir):
    d = _tables(spark, sf_dir)
    corpus = corpus_for(spark, sf_dir)
    idx = corpus.stats.where((~F.col("empty_abstract"))
                             & (F.col("n_tokens") <= F.lit(MAX_INDEX_TOKENS))).select("pmc_id", "abs_sq")
    lex = corpus.lexical
    post = lex.postings.where(F.col("tf_abs") > 0).select(
        *(["tb"] if lex.term_buckets else []), "term", "pmc_id", "abs_sq", F.col("tf_abs").alias("tf"))
    return d, SIM.similarity_corpus(d["queries"], idx, post, lex.terms.drop("rest"), term_buckets=lex.term_buckets)


def q_similarity_tf(spark, sf_dir):
    _, hits = _similarity(spark, sf_dir)
    return hits.select("query_id", "pmc_id", "search_score", F.col("hit_rank").cast("int"))


def q_threshold_hits(spark, sf_dir):
    d, hits = _similarity(spark, sf_dir)
    h = hits.join(d["params"].select("query_id", "threshold"), "query_id")
    return MG.above_threshold(h).select("query_id", "pmc_id", "search_score",
                                        F.col("hit_rank").cast("int"), "threshold")


def q_similarity_embedding(spark, sf_dir):
    emb = FX.read_table(spark, sf_dir, "embeddings")
    hits = SIM.dense_topk(emb, emb)
    return hits.select("query_vec_id", "vec_id", F.round("score", 6).alias("score"),
                       F.col("hit_rank").cast("int"))


# --- merge / feedback ------------------------------------------------------------

def q_score_papers(spark, sf_dir):
    r = Round(spark, sf_dir)
    c = MG.dedupe_last(r.stored)
    return MG.score_papers(c, r.hits()).select(
        "query_id", "pmc_id", F.col("rk").cast("int"), F.col("hit_rank").cast("int"), "search_score")


def q_score_papers_bm25(spark, sf_dir):
    """J1 with another score: the hits of each question's own index by BM25 of the abstract."""
    r = Round(spark, sf_dir)
    c = MG.dedupe_last(r.stored)
    return MG.score_papers(c, r.hits(SIM.BM25)).select(
        "query_id", "pmc_id", F.col("rk").cast("int"), F.col("hit_rank").cast("int"), "search_score")


def q_score_papers_left(spark, sf_dir):
    r = Round(spark, sf_dir)
    return r.scored_left().select("query_id", "pmc_id", F.col("rk").cast("int"),
                                  F.col("hit_rank").cast("int"), "search_score")


def q_rank_results(spark, sf_dir):
    r = Round(spark, sf_dir)
    rows = r.passing().withColumn("round", F.lit(0))
    ranked = RK.rank_results(rows, r.params)
    return ranked.select("query_id", F.col("rk").cast("int"), "pmc_id", "search_score",
                         "paper_count")


def q_all_abstracts_empty(spark, sf_dir):
    r = Round(spark, sf_dir, alt=0, match="all")
    return MG.all_abstracts_empty(r.params, r.candidate_stats())


def q_keyword_weights(spark, sf_dir):
    r = Round(spark, sf_dir)
    return FB.keyword_weights(r.scored_left())


def q_keyword_top3(spark, sf_dir):
    r = Round(spark, sf_dir)
    top = FB.top_keywords(FB.keyword_weights(r.scored_left()))
    return top.select("query_id", "keyword", "weight", F.col("kw_rank").cast("int"))


def q_feedback_query(spark, sf_dir):
    r = Round(spark, sf_dir)
    fb = FB.feedback_query(FB.top_keywords(FB.keyword_weights(r.scored_left())))
    return fb.select("query_id", "next_query")


def q_stop_condition(spark, sf_dir):
    """A4 + I5 for one round (alt 2): enough, feedback or no keywords."""
    r = Round(spark, sf_dir)
    empty = MG.all_abstracts_empty(r.params, r.candidate_stats())
    ok = empty.where(~F.col("all_empty")).select("query_id")
    rows = r.passing()
    counts = MG.result_counts(ok, rows).join(r.params.select("query_id", "amount"), "query_id")
    wanting = counts.where(F.col("amount") > F.col("n_results"))
    src = (rows.join(wanting.where(F.col("n_results") > 0), "query_id", "left_semi")
           .select("query_id", "keywords", "search_score")
           .unionByName(r.scored_left().join(wanting.where(F.col("n_results") == 0),
                                             "query_id", "left_semi")
                        .select("query_id", "keywords", "search_score")))
    fb = FB.feedback_query(FB.top_keywords(FB.keyword_weights(src)))
    return counts.join(fb, "query_id", "left").select(
        "query_id", "n_results", "amount",
        F.when(F.col("amount") <= F.col("n_results"), F.lit("enough"))
         .when(F.col("next_query").isNotNull(), F.lit("feedback"))
         .otherwise(F.lit("no_keywords")).alias("status"),
        F.when(F.col("amount") > F.col("n_results"), F.col("next_query")).alias("next_query"))


# --- index -------------------------------------------------------------------------

def q_index_rows(spark, sf_dir):
    r = Round(spark, sf_dir)
    c = r.candidate_papers().join(r.params.select("query_id", "user_query"), "query_id")
    return index_rows(c).select("query_id", "object_id", "data", "properties", "category",
                                "n_tokens")


def q_index_rows_vocabulary(spark, sf_dir):
    """S6 with P12 counted by a byte-level vocabulary instead of letter and digit runs."""
    from litsearch.functions.vocabulary import token_counter
    r = Round(spark, sf_dir)
    c = r.candidate_papers().join(r.params.select("query_id", "user_query"), "query_id")
    return index_rows(c, count=token_counter()).select("query_id", "object_id", "data", "properties", "category",
                                                       "n_tokens")


def q_candidates_after_upserts(spark, sf_dir):
    """The candidates of an index that grew by upserts and a deletion.

    Old versions of a third of the papers (title and abstract exchanged) and some papers that go again come
    first, then half of the papers as they are, a deletion, and the other half.
    """
    from litsearch.plans.segments import SegmentedIndex
    from litsearch.session import scratch_path
    d = _tables(spark, sf_dir)
    papers, number = d["papers"], F.regexp_replace("pmc_id", "^PMC", "").cast("long")
    index = SegmentedIndex(spark, scratch_path(spark, "segments"))
    old = papers.where(number % 3 == 0).withColumn("_title", F.col("article_title")).withColumn(
        "article_title", F.col("abstract")).withColumn("abstract", F.col("_title")).drop("_title")
    leaving = papers.where(number % 5 == 0).withColumn("pmc_id", F.concat(F.lit("X"), F.col("pmc_id")))
    index.upsert(old.unionByName(leaving))
    index.upsert(papers.where(number % 2 == 0))
    index.delete(leaving.select("pmc_id"))
    index.upsert(papers.where(number % 2 == 1))
    terms = d["query_terms"].where(F.col("alt") == 2).select("query_id", "group_id", "term")
    most = CANDIDATE_FACTOR * int(d["params"].agg(F.max("amount")).first()[0] or 1)
    limits = d["params"].select("query_id", (F.col("amount").cast("long") * CANDIDATE_FACTOR).alias("limit"))
    return LX.ranked_candidates(terms, index.corpus().lexical, limits, most).select(
        "query_id", "pmc_id", "bm25", F.col("rk").cast("int").alias("rk"))


def _index_log(spark, sf_dir) -> DataFrame:
    """Two versions of the index: every paper, then even doc ids again under
    the next question (question = doc_id modulo the number of questions)."""
    docs = FX.read_table(spark, sf_dir, "documents")
    bench = FX.read_table(spark, sf_dir, "benchmark")
    queries = FX.queries_from_benchmark(bench).select("query_id", "user_query")
    n_q = bench.count()
    papers = FX.papers_from_documents(docs).withColumn(
        "doc_id", F.regexp_replace("pmc_id", "^PMC", "").cast("long"))
    v1 = papers.withColumn("query_id", (F.col("doc_id") % n_q).cast("string")) \
        .withColumn("version", F.lit(1))
    v2 = papers.where(F.col("doc_id") % 2 == 0) \
        .withColumn("query_id", ((F.col("doc_id") + 1) % n_q).cast("string")) \
        .withColumn("version", F.lit(2))
    log = None
    for version, v in ((1, v1), (2, v2)):
        rows = index_rows(v.join(queries, "query_id")).select(
            "object_id", "data", F.lit(version).alias("version"))
        log = rows if log is None else log.unionByName(rows)
    return log


def q_index_upsert(spark, sf_dir):
    return latest_per_object(_index_log(spark, sf_dir)).select("object_id", "data", "version")


# --- scalar functions --------------------------------------------------------------

def q_abstract_text(spark, sf_dir):
    docs = FX.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", abstract_text(F.split("text", "\n", -1)).alias("abstract"))


def q_paper_author(spark, sf_dir):
    docs = FX.read_table(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("lang"))
    return docs.select("doc_id", author("source", given).alias("author"))


def article_ids(doc_id) -> "F.Column":
    """Article-id list with a missing doi / pmid, a repeated pmc id and an
    unknown type, as the XML would carry them."""
    d = F.col(doc_id)
    pmc0 = F.when(d % 2 == 0, F.concat(F.lit("PMC"), d.cast("string"))).otherwise(d.cast("string"))
    items = F.array(
        F.when(d % 7 != 0, F.struct(F.concat(F.lit(FX.DOI_PREFIX), d.cast("string")).alias("id"),
                                    F.lit("doi").alias("type"))),
        F.struct(F.concat(F.lit("pub-"), d.cast("string")).alias("id"),
                 F.lit("publisher-id").alias("type")),
        F.struct(pmc0.alias("id"), F.lit("pmc").alias("type")),
        F.when(d % 3 != 0, F.struct((d + FX.PM_ID_OFFSET).cast("string").alias("id"),
                                    F.lit("pmid").alias("type"))),
        F.when(d % 5 == 0, F.struct(F.concat(pmc0, F.lit("-v2")).alias("id"),
                                    F.lit("pmc").alias("type"))),
    )
    return F.filter(items, lambda x: x.isNotNull())


def q_paper_ids(spark, sf_dir):
    docs = FX.read_table(spark, sf_dir, "documents").select("doc_id", article_ids("doc_id").alias("ids"))
    return docs.select("doc_id", id_of_type("ids", "doi").alias("doi"),
                       id_of_type("ids", "pmc").alias("pmc_id"),
                       id_of_type("ids", "pmid").alias("pm_id"))


def q_paper_url(spark, sf_dir):
    docs = FX.read_table(spark, sf_dir, "documents")
    p = FX.papers_from_documents(docs)
    p = p.withColumn("doc_id", F.regexp_replace("pmc_id", "^PMC", "").cast("long"))
    return p.select("doc_id", "pmc_id", paper_url("pmc_id").alias("url"))


# --- requests ------------------------------------------------------------------------

def q_default_params(spark, sf_dir):
    d = _tables(spark, sf_dir)
    return d["params"].select("query_id", "amount", "threshold")


def conversation_requests(spark, sf_dir) -> DataFrame:
    """Requests made of the user turns of ``conversations`` (some invalid)."""
    conv = FX.read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    cid = F.col("conv_id")
    q = (F.when(cid % 11 == 0, F.lit(None).cast("string"))
         .when(cid % 13 == 0, F.lit(""))
         .otherwise(F.array_join(SIM.tokens("text"), " ")))
    return conv.select(
        F.concat(F.lit("c"), cid.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"),
        q.alias("user_query"), (cid % 6 - 1).cast("int").alias("amount"))


def q_validate_requests(spark, sf_dir):
    d = _tables(spark, sf_dir)
    req = d["queries"].select("query_id", "user_query", "amount").unionByName(
        conversation_requests(spark, sf_dir))
    return validate_requests(req).select("query_id", "status", "reason")


def q_requests_json(spark, sf_dir):
    from litsearch.session import scratch_path
    from litsearch.sources.requests import read_requests_json, requests_to_queries
    d = _tables(spark, sf_dir)
    path = scratch_path(spark, "requests")
    (d["queries"].select("query_id", F.col("user_query").alias("query"), "amount", "threshold",
                         "remote_addr")
     .write.mode("errorifexists").json(path))
    return requests_to_queries(read_requests_json(spark, path)).select(
        "query_id", "user_query", "remote_addr", "amount", "threshold")


def q_requests_without_id(spark, sf_dir):
    """Bodies with query, amount and threshold only, as clients send them: ids are assigned."""
    from litsearch.session import scratch_path
    from litsearch.sources.requests import read_requests_json, requests_to_queries
    path = scratch_path(spark, "bodies")
    (_tables(spark, sf_dir)["queries"].select(F.col("user_query").alias("query"), "amount", "threshold")
     .write.mode("errorifexists").json(path))
    q = requests_to_queries(read_requests_json(spark, path))
    return q.groupBy("user_query", "amount", "threshold").agg(
        F.count("*").alias("n_requests"), F.countDistinct("query_id").alias("n_ids"))


def q_get_requests(spark, sf_dir):
    """The questions as paths of GET requests, with the defaults applied."""
    from litsearch.sources.requests import get_requests
    q = _tables(spark, sf_dir)["queries"].select("query_id", "user_query", "remote_addr")
    return apply_defaults(get_requests(q))


# --- conversation ------------------------------------------------------------------------

def q_conversation_assign(spark, sf_dir):
    from litsearch.streaming.conversation import assign_conversations
    ev = FX.read_table(spark, sf_dir, "events")
    return assign_conversations(ev.select("event_id", F.col("user_id").alias("addr"), "ts"),
                                key="addr", order=("ts", "event_id"), request_id="event_id")


# --- XML ------------------------------------------------------------------------------

def _write_articles(spark, sf_dir, defects: bool) -> str:
    from litsearch.session import scratch_path
    docs = FX.read_table(spark, sf_dir, "documents")
    path = scratch_path(spark, "articles")
    FX.articles_from_documents(docs, defects=defects).write.mode("errorifexists").text(path)
    return path


def q_xml_papers(spark, sf_dir):
    from litsearch.sources.xml import ingest
    papers, _ = ingest(spark, _write_articles(spark, sf_dir, defects=False))
    return papers


def q_xml_rejects(spark, sf_dir):
    from litsearch.sources.xml import ingest
    _, rejects = ingest(spark, _write_articles(spark, sf_dir, defects=True))
    return rejects.select(
        F.regexp_extract("article_xml", r'pub-id-type="pmc">([^<]*)</article-id>', 1).alias("pmc_id"),
        "error")


_INGEST_CACHE: dict = {}


def ingested(spark, sf_dir) -> str:
    """The log of a stream over two deliveries of all articles (memoized): some are broken in
    the first, of these some in the second too."""
    from litsearch.session import scratch_path
    from litsearch.streaming.ingest import start_ingest_stream
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _INGEST_CACHE:
        docs = FX.read_table(spark, sf_dir, "documents")
        dumps, log, checkpoint = (scratch_path(spark, n) for n in ("dumps", "ingest-log", "ingest-checkpoint"))
        for defects in (True, "front"):
            FX.articles_from_documents(docs, defects=defects).write.mode("append").text(dumps)
            start_ingest_stream(spark, dumps, log, checkpoint, settleSeconds="0").awaitTermination()
        _INGEST_CACHE[key] = log
    return _INGEST_CACHE[key]


def q_stream_xml_papers(spark, sf_dir):
    """The papers of all records that decode at the first or the second delivery."""
    from litsearch.streaming.ingest import read_papers
    return read_papers(spark, ingested(spark, sf_dir))


def q_xml_outcomes(spark, sf_dir):
    """S3: every record's outcome: accepted, recovered by its repeat, or rejected for good."""
    from litsearch.streaming.ingest import outcomes
    return outcomes(spark, ingested(spark, sf_dir)).select(
        F.col("record").alias("pmc_id"), "outcome", "attempts", "error")


# --- the loop (no SQL form: rows-only check, Python model in the tests) ------------

_SEARCH_CACHE: dict = {}


def run_search(spark, sf_dir, **kwargs):
    """The full iterative search over the folder's tables (memoized per
    session and folder: several registered outputs read the same run)."""
    from litsearch.plans.search import SearchConfig, search
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, tuple(sorted(kwargs.items())))
    if key not in _SEARCH_CACHE:
        d = FX.load(spark, sf_dir)
        _SEARCH_CACHE[key] = search(d["queries"], d["query_terms"],
                                    corpus=corpus_for(spark, sf_dir),
                                    config=SearchConfig(**kwargs))
    return _SEARCH_CACHE[key]


def q_search_iterative(spark, sf_dir):
    out = run_search(spark, sf_dir)
    return out.ranked.select("query_id", F.col("rk").cast("int"), "pmc_id", "search_score",
                             "paper_count", "round", "hit_rank")


def q_search_rounds(spark, sf_dir):
    out = run_search(spark, sf_dir)
    return out.rows.select("query_id", "round", "hit_rank", "pmc_id", "search_score")


def q_search_one_round(spark, sf_dir):
    out = run_search(spark, sf_dir, rounds=1)
    return out.outcomes.select("query_id", "status", "n_results", "next_query", "next_alt")


def repeated_ids(papers: DataFrame) -> DataFrame:
    """The papers with every 5th id empty and every 3rd other one that of the paper two before it."""
    n = F.regexp_replace("pmc_id", "^PMC", "").cast("long")
    other = n - 2
    taken = F.when(other % 2 == 0, F.concat(F.lit("PMC"), other.cast("string"))).otherwise(other.cast("string"))
    return papers.withColumn("pmc_id", F.when(n % 5 == 0, F.lit("")).when(n % 3 == 0, taken)
                             .otherwise(F.col("pmc_id")))


def q_search_repeated_ids(spark, sf_dir):
    """One round over a corpus where papers share ids or have none: per question
    and id, the last candidate stands."""
    from litsearch.plans.search import SearchConfig, search
    d = FX.load(spark, sf_dir)
    terms = d["query_terms"].where(F.col("alt") == 2).withColumn("alt", F.lit(0))
    out = search(d["queries"], terms, repeated_ids(d["papers"]), config=SearchConfig(rounds=1, match="any"))
    return out.rows.select("query_id", "pmc_id", "pm_id", "hit_rank", "search_score")


def q_search_two_rounds(spark, sf_dir):
    """Result rows (bag) of the first two rounds of the loop."""
    out = run_search(spark, sf_dir, rounds=2)
    return out.rows.select("query_id", "round", "hit_rank", "pmc_id", "search_score")


def q_query_log(spark, sf_dir):
    return run_search(spark, sf_dir).attempts.select("query_id", "round", "query_text", "kind")


def q_search_ends(spark, sf_dir):
    """Why every question ended, and in which round."""
    return run_search(spark, sf_dir).ends.select("query_id", "round", "n_results", "status")


def q_requery_alternatives(spark, sf_dir):
    a = run_search(spark, sf_dir).attempts
    return a.where(F.col("kind") == "requery").select("query_id", "round", "query_text")


RESULT_TS = 1700000000000   # fixed envelope time stamp for repeatable documents


def q_result_document(spark, sf_dir):
    from litsearch.plans.results import result_documents, result_rows
    out = run_search(spark, sf_dir)
    res = result_rows(out.ranked, out.attempts, out.queries)
    return result_documents(res, RESULT_TS, wrap="resq")


# --- streams (availableNow over files derived from the tables) -------------------------

def q_stream_search(spark, sf_dir):
    """The questions as JSON request files, searched per micro-batch."""
    from litsearch.session import scratch_path
    from litsearch.streaming.search import start_search_stream
    d = FX.load(spark, sf_dir)
    req_dir, sink, ckpt = (scratch_path(spark, n) for n in ("req", "sink", "ckpt"))
    (d["queries"].select("query_id", F.col("user_query").alias("query"), "amount", "threshold",
                         "remote_addr").write.json(req_dir))
    corpus = corpus_for(spark, sf_dir)
    q = start_search_stream(spark, req_dir, sink, ckpt, corpus)
    q.awaitTermination()
    return spark.read.parquet(sink).select(
        "query_id", F.col("rk").cast("int"), "pmc_id", "search_score", "paper_count", "round",
        "hit_rank")


EVENTS_PER_FILE = 200_000


def _write_in_order(parts, base: str, one_file: bool = True) -> None:
    """Write the parts one after the other (file order = processing order of
    the stream source); with ``one_file`` each as a single file."""
    for part in parts:
        (part.coalesce(1) if one_file else part).write.mode("append").parquet(base)


def q_stream_conversation(spark, sf_dir):
    """C1 stream: events in time slices, one micro-batch each; user ids as text addresses."""
    from litsearch.session import materialize, scratch_path
    from litsearch.streaming.conversation import start_conversation_stream
    ev = FX.read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("addr"), "ts")
    src, sink, state, ckpt = (scratch_path(spark, n) for n in ("events", "conv", "known", "ckpt"))
    seconds = F.col("ts").cast("timestamp").cast("double")
    bounds = ev.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"),
                    F.count("*").alias("n")).first()
    slices = max(4, -(-bounds["n"] // EVENTS_PER_FILE))  # so a file stays small however long the table
    place = (seconds - F.lit(bounds["lo"])) / F.lit(max(bounds["hi"] - bounds["lo"], 1e-9)) * slices
    # dealt into slices by one pass; a slice then reads its own partition only
    dealt = materialize(ev.withColumn("slice", F.least(F.floor(place), F.lit(slices - 1)).cast("int")), "slices", "slice")
    _write_in_order([dealt.where(F.col("slice") == i).drop("slice") for i in range(slices)], src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    start_conversation_stream(stream, sink, state, ckpt).awaitTermination()
    out = spark.read.schema("request_id bigint, addr string, conversation_id bigint").parquet(sink)
    return out.select(F.col("request_id").alias("event_id"), F.col("addr").cast(FX.read_table(
        spark, sf_dir, "events").schema["user_id"].dataType).alias("addr"), "conversation_id")


def q_stream_index_upsert(spark, sf_dir):
    """S7 stream: the two index versions arrive as two micro-batches."""
    from litsearch.session import scratch_path
    from litsearch.streaming.search import read_latest_index, start_index_stream
    log = _index_log(spark, sf_dir)
    items, log_dir, ckpt = (scratch_path(spark, n) for n in ("items", "ilog", "ckpt"))
    _write_in_order([log.where(F.col("version") == v) for v in (1, 2)], items, one_file=False)
    q = start_index_stream(spark, items, log.schema, log_dir, ckpt)
    q.awaitTermination()
    return read_latest_index(spark, log_dir).select("object_id", "data", "version")


def registry() -> dict:
    return {
        "candidates_topk": q_candidates_topk,
        "candidates_boolean": q_candidates_boolean,
        "boolean_strings": q_boolean_strings,
        "similarity_tf": q_similarity_tf,
        "similarity_embedding": q_similarity_embedding,
        "threshold_hits": q_threshold_hits,
        "score_papers": q_score_papers,
        "score_papers_bm25": q_score_papers_bm25,
        "score_papers_left": q_score_papers_left,
        "rank_results": q_rank_results,
        "all_abstracts_empty": q_all_abstracts_empty,
        "keyword_weights": q_keyword_weights,
        "keyword_top3": q_keyword_top3,
        "feedback_query": q_feedback_query,
        "stop_condition": q_stop_condition,
        "index_rows": q_index_rows,
        "index_rows_vocabulary": q_index_rows_vocabulary,
        "candidates_after_upserts": q_candidates_after_upserts,
        "index_upsert": q_index_upsert,
        "abstract_text": q_abstract_text,
        "paper_author": q_paper_author,
        "paper_ids": q_paper_ids,
        "paper_url": q_paper_url,
        "default_params": q_default_params,
        "requests_json": q_requests_json,
        "requests_without_id": q_requests_without_id,
        "get_requests": q_get_requests,
        "validate_requests": q_validate_requests,
        "conversation_assign": q_conversation_assign,
        "xml_papers": q_xml_papers,
        "xml_rejects": q_xml_rejects,
        "stream_xml_papers": q_stream_xml_papers,
        "xml_outcomes": q_xml_outcomes,
        "search_one_round": q_search_one_round,
        "search_rounds": q_search_rounds,
        "search_two_rounds": q_search_two_rounds,
        "search_repeated_ids": q_search_repeated_ids,
        "search_iterative": q_search_iterative,
        "query_log": q_query_log,
        "search_ends": q_search_ends,
        "requery_alternatives": q_requery_alternatives,
        "result_document": q_result_document,
        "stream_search": q_stream_search,
        "stream_conversation": q_stream_conversation,
        "stream_index_upsert": q_stream_index_upsert,
    }
