"""The iterative search: rounds of retrieve, index, score, merge, feed back.

Every round runs for all still-active questions at once, as one set of
DataFrame plans keyed by ``query_id``. The driver only decides whether
another round is needed (one count per round). Each round's outputs are
written to the shared checkpoint folder, which cuts the lineage and makes
a lost executor cost at most the current round.

Differences from the reference, on purpose: the loop ends after the round
bound instead of spinning; questions never share state; ties are fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsearch.operators.feedback import feedback_query, keyword_weights, top_keywords
from litsearch.operators.lexical import (DEFAULT_FIELDS, LexicalIndex, champion_postings, join_postings,
                                         match_terms, of_terms, ranked_candidates, term_bucket, term_counts_by_impact,
                                         term_table, terms_from_text, top_candidates)
from litsearch.operators.merge import (all_abstracts_empty, dedupe_last,
                                       first_per_paper, result_counts, score_papers_left)
from litsearch.operators.ranking import rank_results
from litsearch.functions.text import tokens
from litsearch.operators.similarity import COSINE, Score, question_vectors, score_own_index
from litsearch.schemas import (CANDIDATE_FACTOR, INDEX_HITS, MAX_INDEX_TOKENS, MAX_REFINEMENTS,
                               PAPER_COLUMNS, TOP_KEYWORDS)
from litsearch.session import few, materialize, scratch_path
from litsearch.sources.requests import apply_defaults

RESULT_COLUMNS = ["query_id", "round", "hit_rank"] + PAPER_COLUMNS + ["search_score"]
INDEX_COLUMNS = ["query_id", "pmc_id", "abs_sq", "qa", "round"]
COUNTED_ROWS = 512  # papers whose tokens a worker counts at a time
ROW_COLUMNS = ["query_id", "round", "hit_rank", "pmc_id", "keywords", "search_score", "pk"]


@dataclass
class SearchConfig:
    match: str = "all"
    fields: tuple = DEFAULT_FIELDS
    hits: int = INDEX_HITS
    top_keywords: int = TOP_KEYWORDS
    max_tokens: int = MAX_INDEX_TOKENS
    max_refinements: int = MAX_REFINEMENTS
    distinct_papers: bool = False
    score: Score = COSINE              # of a question and the papers of its index
    rounds: int | None = None          # stop after this many rounds (tests)


@dataclass
class Corpus:
    """Corpus prepared once.

    ``papers``: the full ``Paper`` columns and ``pk``, read once at the end for
    the result rows. ``pk`` names a paper within the corpus: its ``pmc_id``, or
    where that is empty or several papers have it, the id with the pm id and a hash of
    the paper. ``stats`` and ``lexical`` go by ``pk`` (in their ``pmc_id`` column;
    ``stats.real_id`` is the paper's own id). ``stats``: one narrow row per paper (keywords, empty flag,
    token count, a.a, BM25 length) - what every round reads. ``lexical``:
    postings with ``tf`` (searched fields), ``tf_abs`` (abstract) and ``df``,
    stored partitioned by term bucket. No round reads the text again.
    """

    papers: DataFrame
    stats: DataFrame
    lexical: LexicalIndex


@dataclass
class SearchOutput:
    rows: DataFrame          # every appended result row (bag), with round and hit rank
    attempts: DataFrame      # query_id, round, query_text, kind
    ranked: DataFrame        # T4 applied, with rk and paper_count
    queries: DataFrame       # questions with effective amount and threshold
    rounds_run: int = 0
    active_per_round: list = field(default_factory=list)
    outcomes: DataFrame | None = None   # per round and question: status, next string
    ends: DataFrame | None = None       # per question: last round and why it ended there


def default_term_buckets(spark: SparkSession) -> int:
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def prepare_corpus(papers: DataFrame, fields=DEFAULT_FIELDS, persist: bool = True,
                   term_buckets: int | None = None, count: Callable | None = None) -> Corpus:
    """Tokenize once; write bucketed postings and narrow per-paper stats.

    Term counts, token count, a.a and BM25 length of a paper are computed in its own row
    and stored, so no text and no count is shuffled for them. The stored terms are
    exploded into the postings, from which the terms' histograms are made; postings are
    dealt by ``tb = xxhash64(term) mod B`` by a ``rebalance`` (AQE splits a bucket made
    large by a term found in most papers) and sorted by term inside each file. ``count``: a column function
    that gives an abstract's number of tokens for the index limit (P12), such as
    ``functions.vocabulary.token_counter``; else its letter and digit runs count.
    """
    spark = papers.sparkSession
    buckets = int(term_buckets or default_term_buckets(spark))
    papers = with_paper_key(spread(papers.select(*PAPER_COLUMNS)))
    save = materialize if persist else (lambda df, *_: df)
    papers = save(papers, "papers")
    base = papers.withColumnRenamed("pmc_id", "real_id").withColumnRenamed("pk", "pmc_id")
    rows = save(paper_terms(base, fields, count), "paper-terms")
    stats = rows.drop("terms")
    n_docs, avg_len = corpus_size(stats)
    postings, champions, terms = lexical_tables(exploded_terms(rows), avg_len, buckets, save)
    return Corpus(papers, stats, LexicalIndex(postings, n_docs, avg_len, buckets, terms, champions))


def corpus_size(stats: DataFrame) -> tuple[int, float]:
    """Number of papers and average BM25 length: the two scalars that the driver reads."""
    agg = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total")).first()
    n_docs, total = int(agg["n"] or 0), int(agg["total"] or 0)
    return n_docs, (total / n_docs) if n_docs else 0.0


def lexical_tables(counts: DataFrame, avg_len: float, buckets: int, save) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (partitioned by term bucket), champions and terms of (term, paper) ``counts``.

    ``save(df, name, partition_by)`` stores a table and returns it.
    """
    postings = counts.withColumn("tb", term_bucket("term", buckets))
    postings = save(postings.hint("rebalance", "tb").sortWithinPartitions("tb", "term"), "postings", "tb")
    # a term's postings are in few files by now, so that a task has most of them and adds them up before the shuffle
    doc_freq = save(term_counts_by_impact(postings, avg_len), "term-counts")
    # the terms with champions are few beside the postings, which are then not shuffled for them
    cuts, _ = few(doc_freq.where("cut is not null").select("term", "cut"), "cuts")
    champions = champion_postings(postings.select("tb", "term", "pmc_id", "tf", "doc_len").join(cuts, "term"), avg_len)
    champions = save(champions, "champions")
    return postings, champions, save(term_table(doc_freq.drop("cut"), champions, buckets), "terms")


def with_paper_key(papers: DataFrame) -> DataFrame:
    """Add ``pk``: unique among papers. Papers that agree in every column become one.

    A paper whose ``pmc_id`` is empty or shared is named by that and its ``pm_id``; only where both are shared
    a hash of the paper is added, and only those texts are shuffled to find equal ones.
    """
    repeated, _ = few(papers.groupBy("pmc_id").agg(F.count(F.lit(1)).alias("_n"))
                      .where((F.col("_n") > 1) | (F.col("pmc_id") == "")).select("pmc_id"), "repeated-ids")
    alone = papers.join(repeated, "pmc_id", "left_anti").withColumn("pk", F.col("pmc_id"))
    if repeated.isEmpty():
        return alone.select(*PAPER_COLUMNS, "pk")
    several = papers.join(repeated, "pmc_id", "left_semi")
    both = F.concat("pmc_id", F.lit("\u0001"), "pm_id")
    shared, _ = few(several.groupBy(both.alias("_ids")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_ids"),
                    "repeated-id-pairs")
    several = several.withColumn("_ids", both)
    by_ids = several.join(shared, "_ids", "left_anti").withColumn("pk", F.col("_ids"))
    hashed = F.concat("_ids", F.lit("\u0001"), F.hex(F.xxhash64(*PAPER_COLUMNS)))
    by_hash = several.join(shared, "_ids", "left_semi").withColumn("pk", hashed).dropDuplicates(["pk"])
    named = alone.select(*PAPER_COLUMNS, "pk").unionByName(by_ids.select(*PAPER_COLUMNS, "pk"))
    return named if shared.isEmpty() else named.unionByName(by_hash.select(*PAPER_COLUMNS, "pk"))


def spread(papers: DataFrame) -> DataFrame:
    """Text work is CPU bound: spread a few input files over all cores."""
    few_files = len(papers.inputFiles()) < papers.sparkSession.sparkContext.defaultParallelism
    return papers.hint("rebalance") if few_files else papers


def sorted_counts(own: pa.Array, other: pa.Array) -> pa.Array:
    """Per row of two token lists its distinct tokens in order, each with its count in either; null counts as empty.

    The tokens of all rows get numbers in their order, and (row, number) pairs are sorted as longs:
    equal ones are neighbours then, and the places where they change give the counts.
    """
    sizes = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in (own, other)]
    named = pa.concat_arrays([own.flatten(), other.flatten()]).dictionary_encode()
    order = pc.sort_indices(named.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    codes = number[named.indices.to_numpy()]
    rows, width = np.arange(len(own), dtype=np.int64), max(len(order), 1)
    pairs = np.concatenate([np.repeat(rows, n) for n in sizes]) * width + codes
    pairs = pairs * 2 + (np.arange(len(pairs)) >= sizes[0].sum())  # the last bit: whether of ``other``
    pairs.sort()
    tokens_at = pairs >> 1
    starts = np.flatnonzero(np.diff(tokens_at, prepend=-1))
    total = np.diff(starts, append=len(pairs))
    in_other = np.add.reduceat(pairs & 1, starts) if len(starts) else total
    found = tokens_at[starts]
    counts = pa.StructArray.from_arrays(
        [named.dictionary.take(pa.array(order[found % width])), pa.array(total - in_other), pa.array(in_other)],
        ["term", "own", "other"])
    return pa.ListArray.from_arrays(np.searchsorted(found // width, np.arange(len(own) + 1)).astype(np.int32), counts)


def counted_rows(own: pa.Array, other: pa.Array) -> pa.Array:
    """``sorted_counts`` of a batch, a few rows at a time."""
    parts = [sorted_counts(own.slice(i, COUNTED_ROWS), other.slice(i, COUNTED_ROWS))
             for i in range(0, max(len(own), 1), COUNTED_ROWS)]
    return pa.concat_arrays(parts)


def counts_in_row(own, other):
    """array<struct<term, own, other>>: how often each token is in the arrays ``own`` and ``other``.

    Interpreted column functions on arrays took most of the time of a corpus, so Arrow batches are
    counted, ``COUNTED_ROWS`` rows at a time; nothing is shuffled.
    """
    return F.arrow_udf(counted_rows, "array<struct<term string, own bigint, other bigint>>")(own, other)


def paper_terms(papers: DataFrame, fields=DEFAULT_FIELDS, count: Callable | None = None) -> DataFrame:
    """One row per paper: pmc_id, real_id, keywords, empty_abstract, n_tokens, abs_sq, doc_len and ``terms``.

    ``terms`` has per distinct token ``tf``, its count in the searched ``fields`` (BM25), and ``tf_abs``, that in the
    abstract (similarity); ``doc_len`` is the paper's number of searched tokens, ``abs_sq`` its a.a. Everything
    is computed within the row.
    """
    others = [f for f in fields if f != "abstract"]
    in_fields = list(fields).count("abstract")
    own = [count("abstract").alias("n_tokens")] if count else []
    kept = ["pmc_id", "real_id", "keywords"]
    rows = papers.select(*kept, (F.col("abstract") == F.lit("")).alias("empty_abstract"), *own,
                         F.coalesce(tokens("abstract"), F.array().cast("array<string>")).alias("_own"),
                         F.concat(F.array().cast("array<string>"), *[
                             F.coalesce(tokens(f), F.array().cast("array<string>")) for f in others]).alias("_other"))
    if not count:
        rows = rows.withColumn("n_tokens", F.size("_own"))
    rows = rows.select(*kept, "empty_abstract", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
                       (F.size("_other") + F.size("_own") * in_fields).cast("long").alias("doc_len"),
                       counts_in_row(F.col("_own"), F.col("_other")).alias("_counts"))
    square = F.aggregate("_counts", F.lit(0).cast("long"), lambda total, x: total + x["own"] * x["own"])
    terms = F.transform("_counts", lambda x: F.struct(
        x["term"].alias("term"), (x["other"] + x["own"] * in_fields).alias("tf"), x["own"].alias("tf_abs")))
    return rows.select(*kept, "empty_abstract", "n_tokens", square.alias("abs_sq"), "doc_len", terms.alias("terms"))


def exploded_terms(rows: DataFrame) -> DataFrame:
    """(term, pmc_id, doc_len, abs_sq, tf, tf_abs) of ``paper_terms``."""
    exploded = rows.select("pmc_id", "doc_len", "abs_sq", F.explode("terms").alias("t"))
    return exploded.select("t.term", "pmc_id", "doc_len", "abs_sq", "t.tf", "t.tf_abs")


def candidate_dots(pairs_idx: DataFrame, active: DataFrame, lexical: LexicalIndex,
                   score: Score = COSINE) -> DataFrame:
    """The sum of a score's parts (q.a for the cosine) for (question, indexable candidate) pairs from the postings.

    ``pairs_idx``: query_id, pmc_id, n_tokens. Each candidate is paired with its question's
    terms (at most the words of the question) and looked up in the postings on (term, pmc_id).
    """
    qterms = (active.select("query_id", F.explode("q_map").alias("term", "qtf"))
              .join(lexical.terms.select("term", "df"), "term"))
    qterms, _ = few(qterms, "question-counts")
    pairs_idx, small = few(pairs_idx, "index-pairs")
    post = lexical.postings.select(*(["tb"] if lexical.term_buckets else []),
                                   "term", "pmc_id", "tf_abs").where(F.col("tf_abs") > 0)
    post = of_terms(post, qterms, lexical.term_buckets, pairs_idx if small else None)
    joined = join_postings(pairs_idx.join(qterms, "query_id"), post, lexical.term_buckets, keys=("term", "pmc_id"))
    return joined.groupBy("query_id", "pmc_id").agg(F.sum(score.part(lexical)).alias("qa"))


def render_terms(terms: DataFrame, keys=("query_id", "alt")) -> DataFrame:
    """Boolean search string text: ("a" or "b") and ("c"), groups by id."""
    keys = list(keys)
    per_group = terms.groupBy(*keys, "group_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("term"), F.lit('"')))),
                     " or ").alias("_g"))
    return per_group.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "_g"))),
                                 lambda x: F.concat(F.lit("("), x["_g"], F.lit(")"))),
                     " and ").alias("query_text"))


def _empty_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "query_id string, round int, hit_rank int, pmc_id string, keywords array<string>, "
            "search_score float, pk string")


def round_candidates(active: DataFrame, terms: DataFrame, corpus: Corpus, cfg: SearchConfig,
                     max_amount: int) -> DataFrame:
    """S1 + T1 + J3 for one round, with everything later steps need per paper.

    Output per (question, candidate): rank, keywords, a.a, empty-abstract and
    indexable flags (A1, F2, F3), and q.a - all from narrow tables.
    """
    limits = active.select("query_id", (F.col("amount").cast("long") * CANDIDATE_FACTOR).alias("limit"))
    most = CANDIDATE_FACTOR * max_amount
    if cfg.match == "any":
        cands = ranked_candidates(terms, corpus.lexical, limits, most)
    else:
        cands = top_candidates(match_terms(terms, corpus.lexical, cfg.match), limits, most)
    cands, _ = few(cands.select("query_id", "pmc_id", "rk"), "ranked")  # read for the stats and for the scores
    cands = cands.join(
        corpus.stats.select("pmc_id", "real_id", "keywords", "empty_abstract", "n_tokens", "abs_sq"), "pmc_id")
    cands = dedupe_last(cands, ("query_id", "real_id"))                    # J3
    ok_len = (~F.col("empty_abstract")) & (F.col("n_tokens") <= F.lit(int(cfg.max_tokens)))
    cands = cands.withColumn("indexable", ok_len)
    dots = candidate_dots(cands.where("indexable").select("query_id", "pmc_id", "n_tokens"), active,
                          corpus.lexical, cfg.score)
    zero = F.lit(0).cast(dots.schema["qa"].dataType)
    return (cands.join(dots, ["query_id", "pmc_id"], "left")
            .select("query_id", F.col("real_id").alias("pmc_id"), F.col("pmc_id").alias("pk"), "rk",
                    "keywords", "abs_sq", "empty_abstract", "indexable",
                    F.when(F.col("indexable"), F.coalesce(F.col("qa"), zero)).otherwise(zero).alias("qa")))


def round_scores(round_no: int, active: DataFrame, cands: DataFrame,
                 index_acc: DataFrame | None, cfg: SearchConfig):
    """A1, S6, J4/T2, J2, J1 + F4 for one round over the round's candidates.

    Returns (scored, new_index, empty): ``scored`` has one row per candidate
    of a question whose abstracts are not all empty, with hit rank, score
    (0 without a hit) and the ``passing`` flag.
    """
    empty = all_abstracts_empty(active, cands.withColumn(
        "abstract", F.when(F.col("empty_abstract"), F.lit("")).otherwise(F.lit("x"))))   # A1
    ok = empty.where(~F.col("all_empty")).select("query_id")
    cands_ok = cands.join(ok, "query_id", "left_semi")
    new_index = (cands_ok.where(F.col("indexable"))                       # S6, F2, F3
                 .select("query_id", "pmc_id", "abs_sq", "qa",
                         F.lit(round_no).cast("int").alias("round")))
    index_all = new_index if index_acc is None else index_acc.unionByName(new_index)
    index_q = dedupe_last(index_all.join(ok, "query_id", "left_semi"), position="round")  # S7
    hits = score_own_index(index_q.join(active.select("query_id", "q_sq"), "query_id"),
                           cfg.hits, cfg.score)                            # J4 + T2
    scored = score_papers_left(cands_ok, hits)                             # J2
    thr = active.select("query_id", "threshold")
    scored = scored.join(thr, "query_id").withColumn(
        "passing", F.col("hit_rank").isNotNull()
        & (F.col("search_score").cast("float") > F.col("threshold").cast("float")))   # J1, F4
    scored = scored.select("query_id", "pmc_id", "pk", "rk", "keywords",
                           F.col("hit_rank").cast("int").alias("hit_rank"),
                           F.col("search_score").cast("float").alias("search_score"),
                           "passing", F.lit(round_no).cast("int").alias("round"),
                           "indexable", "abs_sq", "qa")
    return scored, new_index, empty


def round_outcome(active: DataFrame, scored: DataFrame, empty: DataFrame,
                  rows_all: DataFrame, query_terms: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Per question either stop or the next search string.

    status: enough | feedback | no_keywords (non-empty round) or
    requery | exhausted (all abstracts empty).
    """
    params = active.select("query_id", "amount", "next_alt")
    ok = empty.where(~F.col("all_empty")).select("query_id")
    counts = result_counts(ok, rows_all).join(params, "query_id")          # A4
    wanting = counts.where(F.col("amount") > F.col("n_results"))
    from_rows = rows_all.join(wanting.where(F.col("n_results") > 0).select("query_id"),
                              "query_id", "left_semi")
    from_round = scored.join(wanting.where(F.col("n_results") == 0).select("query_id"),
                             "query_id", "left_semi")
    src = (from_rows.select("query_id", "keywords", "search_score")
           .unionByName(from_round.select("query_id", "keywords", "search_score")))
    fb = feedback_query(top_keywords(keyword_weights(src), cfg.top_keywords))  # A2, T3, P11
    merged = counts.join(fb, "query_id", "left").select(
        "query_id",
        F.when(F.col("amount") <= F.col("n_results"), F.lit("enough"))
         .when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, F.lit("feedback"))
         .otherwise(F.lit("no_keywords")).alias("status"),
        F.when(F.col("amount") > F.col("n_results"), F.col("next_query")).alias("next_query"),
        "next_alt", "n_results")
    alts = query_terms.select("query_id", F.col("alt").alias("next_alt")).distinct() \
        .withColumn("_has", F.lit(True))
    requery = (empty.where(F.col("all_empty")).select("query_id")
               .join(params, "query_id")
               .join(alts, ["query_id", "next_alt"], "left")
               .select("query_id",
                       F.when(F.col("_has"), F.lit("requery")).otherwise(F.lit("exhausted"))
                        .alias("status"),
                       F.lit(None).cast("string").alias("next_query"), "next_alt",
                       F.lit(0).cast("long").alias("n_results")))
    return merged.unionByName(requery)


def search(queries: DataFrame, query_terms: DataFrame, papers: DataFrame | None = None, *,
           corpus: Corpus | None = None, config: SearchConfig | None = None,
           **kwargs) -> SearchOutput:
    """The bounded feedback loop for a whole table of questions.

    ``queries``: query_id, user_query, remote_addr, amount, threshold
    (validated). ``query_terms``: query_id, alt, group_id, term - the search
    strings a language model would write; alt 0 starts, later alts answer a
    re-ask. Returns result rows, attempts and the ranked result.
    """
    cfg = config or SearchConfig(**kwargs)
    spark = queries.sparkSession
    if corpus is None:
        corpus = prepare_corpus(papers, cfg.fields)
    q = materialize(apply_defaults(queries), "queries")
    max_amount = int(q.agg(F.max("amount")).first()[0] or 0)
    qvec = question_vectors(q)
    base = q.join(qvec, "query_id")
    rendered = render_terms(query_terms)

    active = materialize(
        base.join(rendered.where(F.col("alt") == 0).select("query_id", "query_text"), "query_id", "left")
        .select("query_id", "user_query", "amount", "threshold", "q_map", "q_sq",
                F.lit(1).alias("next_alt"), F.coalesce("query_text", F.lit("")).alias("query_text"),
                F.lit("initial").alias("kind")), "active")
    terms = query_terms.where(F.col("alt") == 0).select("query_id", "group_id", "term")

    n_rounds = cfg.max_refinements + 1
    if cfg.rounds is not None:
        n_rounds = min(n_rounds, cfg.rounds)
    scored_log, record_log = RoundLog(spark, "scored"), RoundLog(spark, "rounds")
    initial = active
    rounds_run, active_counts = 0, []
    for round_no in range(n_rounds):
        n_active = active.count()
        active_counts.append(n_active)
        if n_active == 0:
            break
        cands = materialize(round_candidates(active, terms, corpus, cfg, max(max_amount, 1)),
                            f"cands-r{round_no}")
        index_acc = scored_log.rows.where(F.col("indexable")).select(*INDEX_COLUMNS) if round_no else None
        scored, _, empty = round_scores(round_no, active, cands, index_acc, cfg)
        scored_log.add(scored, round_no)
        scored = scored_log.rows.where(F.col("round") == round_no)
        rows_acc = scored_log.rows.where(F.col("passing")).select(*ROW_COLUMNS)
        rows_view = first_per_paper(rows_acc) if cfg.distinct_papers else rows_acc
        outcome = round_outcome(active, scored, empty, rows_view, query_terms, cfg)
        rounds_run += 1
        # One table per round: the outcome of every question plus, for those
        # that go on, the next round's state (lineage cut here).
        alt_text = rendered.withColumnRenamed("alt", "next_alt").withColumnRenamed("query_text", "alt_text")
        added = scored.where(F.col("passing")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_added"))
        record = (outcome.join(active.drop("next_alt"), "query_id")
                  .join(alt_text, ["query_id", "next_alt"], "left").join(added, "query_id", "left")
                  .select(
                      "query_id", "status", "n_results", "next_query", "next_alt",
                      F.lit(round_no).cast("int").alias("round"),
                      "user_query", "amount", "threshold", "q_map", "q_sq",
                      F.when(F.col("status") == "requery", F.col("next_alt") + 1)
                       .otherwise(F.col("next_alt")).alias("_next_alt"),
                      F.when(F.col("status") == "feedback", F.col("next_query"))
                       .otherwise(F.coalesce(F.col("alt_text"), F.lit(""))).alias("_query_text"),
                      fixed_point().alias("fixed")))
        record_log.add(record, round_no)
        record = record_log.rows.where(F.col("round") == round_no)
        active = (record.where(F.col("status").isin("feedback", "requery") & ~F.col("fixed"))
                  .select("query_id", "user_query", "amount", "threshold", "q_map", "q_sq",
                          F.col("_next_alt").alias("next_alt"),
                          F.col("_query_text").alias("query_text"),
                          F.col("status").alias("kind")))
        fb_terms = terms_from_text(active.where(F.col("kind") == "feedback"), "query_text", cfg.match)
        rq_terms = (query_terms.join(active.where(F.col("kind") == "requery")
                                     .select("query_id", (F.col("next_alt") - 1).alias("alt")),
                                     ["query_id", "alt"])
                    .select("query_id", "group_id", "term"))
        terms = fb_terms.unionByName(rq_terms)

    rows = (scored_log.rows.where(F.col("passing")).select(*ROW_COLUMNS) if scored_log.rows is not None
            else _empty_rows(spark))
    if cfg.distinct_papers:
        rows = first_per_paper(rows)
    rows, _ = few(rows, "result-rows")  # met by the papers as they are read
    rows = rows.join(corpus.papers.drop("keywords", "pmc_id"), "pk")
    ranked = rank_results(rows, q)
    attempts = initial.select("query_id", F.lit(0).cast("int").alias("round"), "query_text", "kind")
    if not n_rounds:
        attempts = attempts.limit(0)
    outcomes = None
    if record_log.rows is not None:
        records = with_repeats(record_log.rows, n_rounds)
        outcomes = records.select("query_id", "status", "n_results", "next_query", "next_alt", "round")
        attempts = attempts.unionByName(
            records.where(F.col("status").isin("feedback", "requery") & (F.col("round") + 1 < n_rounds))
            .select("query_id", (F.col("round") + 1).cast("int").alias("round"), F.col("_query_text").alias("query_text"),
                    F.col("status").alias("kind")))
    return SearchOutput(rows.select(*RESULT_COLUMNS), attempts, ranked, q, rounds_run,
                        active_counts, outcomes, end_status(outcomes))


class RoundLog:
    """A table of the shared folder with one partition per round; ``rows`` reads all rounds written so far."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.rows = spark, scratch_path(spark, name), None

    def add(self, df: DataFrame, round_no: int) -> None:
        df.drop("round").write.mode("overwrite").parquet(f"{self.path}/round={round_no}")
        schema = df.drop("round").schema.add("round", T.IntegerType())
        self.rows = self.spark.read.schema(schema).parquet(self.path)


def fixed_point():
    """Whether all further rounds of a question equal the one just run.

    It searched with a feedback string, added no row, and gets the same string again: the same
    candidates are then put into the same index, and rows and scored papers stay what they are.
    """
    return ((F.col("status") == "feedback") & (F.col("kind") == "feedback") & F.col("n_added").isNull()
            & (F.col("next_query") == F.col("query_text")))


def with_repeats(records: DataFrame, n_rounds: int) -> DataFrame:
    """``records`` and, for questions at a fixed point, the rounds up to the bound, which were not run."""
    later = F.sequence(F.col("round"), F.when(F.col("fixed"), F.lit(n_rounds - 1)).otherwise(F.col("round")))
    return records.withColumn("round", F.explode(later))


def end_status(outcomes: DataFrame | None) -> DataFrame | None:
    """Per question its last round and status; ``bound`` where only the round bound stopped it."""
    if outcomes is None:
        return None
    last = outcomes.groupBy("query_id").agg(F.max("round").alias("round"))
    return outcomes.join(last, ["query_id", "round"]).select(
        "query_id", "round", "n_results",
        F.when(F.col("status").isin("feedback", "requery"), F.lit("bound")).otherwise(F.col("status"))
        .alias("status"))
