"""Similarity search of questions against indexed papers.

Sparse score (default): cosine of raw term counts between the question and
the index text ``"[question] - abstract"``. The index text's tokens are the
question's tokens followed by the abstract's, so its vector is ``q + a`` and

    cos = (q.a + q.q) / (sqrt(q.q) * sqrt(a.a + 2 q.a + q.q))

Only ``a.a`` is stored per paper; ``q.a`` is the one value computed per
(question, paper). Everything is an integer until the square roots, so the
result is exact and engine independent.

Two execution shapes:

* ``score_own_index`` - the index of a question is small (its own
  candidates): ``q.a`` is computed inside the row from the abstract tokens,
  with no shuffle and no join.
* ``similarity_corpus`` - the whole corpus is the index. Exact without scoring
  all pairs, nor all that share a word:

  1. The ``FLOOR`` papers with the smallest ``a.a`` are scored first. (Papers that share
     no term score ``sqrt(q.q)/sqrt(a.a + q.q)``, which orders them by ``a.a`` alone.)
     The k-th best score is a question's threshold.
  2. Let ``u`` be the length of the question's vector on a term and all more common ones. A
     paper that has no other term of it has ``q.a <= u |a|``, and so at most the
     score of that bound, which falls with ``a.a``. From some ``a.a`` on, the term's ``reach``, the
     bound stays below the threshold: of the term's list only papers up to it are read, however many
     papers are as small as those of the floor.
  3. The papers found give candidates; the same bound with the part of ``q.a`` that is known, the
     terms not read for a paper of this ``a.a`` and its own ``a.a`` drops most of them, and the
     rest look up those terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsearch.functions.text import tokens
from litsearch.operators.lexical import BM25_B, BM25_K1, SCORE_DIGITS, LexicalIndex, join_postings, of_terms, term_weight
from litsearch.schemas import INDEX_HITS
from litsearch.session import few, materialize


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def term_counts(toks) -> Column:
    """array<struct<term, cnt>> of the distinct tokens of a token array.

    The sorted array is cut where a token differs from the one before; a token's
    count is the distance to the next cut.
    """
    def counted(sorted_toks):
        n = F.size(sorted_toks)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                          lambda i: (i < n) & ((i == 0) | (F.get(sorted_toks, i) != F.get(sorted_toks, i - 1))))
        return F.transform(starts, lambda i, at: F.struct(
            F.get(sorted_toks, i).alias("term"),
            (F.coalesce(F.get(starts, at + 1), n) - i).cast("long").alias("cnt")))

    # a one-element array binds the sorted tokens, so that they are sorted once
    return F.transform(F.array(F.array_sort(_col(toks))), counted)[0]


def sum_of_squares(toks) -> Column:
    """Sum of squared term counts of a token array, computed in the row.

    The sorted array is scanned once: extending a run of equal tokens from
    length r to r + 1 adds 2r + 1 to the sum.
    """
    sorted_toks = F.array_sort(_col(toks))
    init = F.struct(F.lit("").alias("prev"), F.lit(0).cast("long").alias("run"),
                    F.lit(0).cast("long").alias("total"))

    def step(acc, x):
        same = (acc["run"] > 0) & (acc["prev"] == x)
        return F.struct(
            x.alias("prev"),
            F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            (acc["total"] + F.when(same, acc["run"] * 2 + 1).otherwise(F.lit(1).cast("long"))).alias("total"),
        )

    return F.aggregate(sorted_toks, init, step, lambda acc: acc["total"])


def question_map(q_counts) -> Column:
    """term -> count map of a question (keys are distinct)."""
    return F.map_from_entries(_col(q_counts))


def cosine(qa, qq, aa) -> Column:
    """Closed-form cosine of ``q`` and ``q + a``; 0 for an empty question."""
    qa, qq, aa = _col(qa).cast("double"), _col(qq).cast("double"), _col(aa).cast("double")
    denom = F.sqrt(qq) * F.sqrt(aa + F.lit(2.0) * qa + qq)
    return F.when(qq > 0, (qa + qq) / denom).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Score:
    """A similarity of a question and a paper's abstract, made of parts of their common terms.

    ``part``: what one term adds, from the columns ``qtf``, ``tf_abs``, ``df`` and ``n_tokens``
    (of the abstract) and the index; ``total``: the score of the parts' sum ``qa``, from the
    columns ``qa``, ``q_sq`` and ``abs_sq``. It has to grow with ``qa``. Both are column
    expressions, so a score of one's own costs no more than these.
    """

    name: str
    part: Callable[[LexicalIndex], Column]
    total: Callable[[], Column]


def _bm25_part(index: LexicalIndex) -> Column:
    tf = F.col("tf_abs").cast("double")
    length = F.lit(1.0 - BM25_B) + F.lit(BM25_B) * F.col("n_tokens") / F.lit(index.avg_len if index.avg_len > 0 else 1.0)
    return F.col("qtf") * term_weight(index.n_docs) * (tf * F.lit(BM25_K1 + 1.0)) / (tf + F.lit(BM25_K1) * length)


def _bm25_total() -> Column:
    qa = F.col("qa").cast("double")
    return F.round(F.when(F.col("q_sq") > 0, qa / (qa + F.col("q_sq"))).otherwise(F.lit(0.0)), SCORE_DIGITS)


COSINE = Score("cosine", lambda index: F.col("qtf") * F.col("tf_abs"), lambda: cosine("qa", "q_sq", "abs_sq"))
#: BM25 of the abstract against the question's tokens, brought below 1 by the question's own squares.
BM25 = Score("bm25", _bm25_part, _bm25_total)


def question_vectors(queries: DataFrame) -> DataFrame:
    """(query_id, q_map, q_sq) from ``user_query``."""
    return (queries.select("query_id", tokens("user_query").alias("_qt"))
            .select("query_id", question_map(term_counts("_qt")).alias("q_map"),
                    sum_of_squares("_qt").alias("q_sq")))


def score_own_index(entries: DataFrame, k: int = INDEX_HITS, score: Score = COSINE) -> DataFrame:
    """Top ``k`` hits per question over a per-question index.

    ``entries``: query_id, pmc_id, qa, abs_sq, q_sq (one row per indexed
    paper of the question; ``qa`` was computed when the paper was indexed).
    Output adds ``score`` (double), ``search_score`` (float), ``hit_rank``.
    """
    scored = entries.where(F.col("q_sq") > 0).withColumn("score", score.total())
    return rank_hits(scored, k)


def rank_hits(scored: DataFrame, k: int = INDEX_HITS) -> DataFrame:
    """Top ``k`` per question by score (ties by id) with a literal limit."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("pmc_id"))
    return (scored.withColumn("hit_rank", F.row_number().over(w))
            .where(F.col("hit_rank") <= F.lit(int(k)))
            .withColumn("search_score", F.col("score").cast("float")))


FLOOR = 320              # papers of the smallest a.a that are scored for every question, at least 16 k
SLACK = 1e-9             # of bounds, for rounding


def reach() -> Column:
    """The greatest ``a.a`` of a paper that may score ``threshold`` with no more than ``q.a = u |a|``; null: there is none.

    ``cosine(u x, q.q, x^2) >= t`` solved for ``x``: ``A x^2 - 2 B x - C <= 0``.
    """
    t, qq, u = F.col("threshold") - SLACK, F.col("q_sq").cast("double"), F.col("u")
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - t * t)
    a, b, c = t * t * qq - u * u, u * qq * rest, qq * qq * rest
    x = (b + F.sqrt(b * b + a * c)) / a
    return F.when((t > 0) & (a > qq * 1e-9), x * x * (1.0 + 1e-6))


def bounded_pairs(questions: DataFrame, index_papers: DataFrame, postings: DataFrame, term_buckets: int,
                  terms: DataFrame, k: int, floor: int = FLOOR):
    """What ``similarity_corpus`` has to score: (floor pairs with ``qa``, other open pairs with the part of ``qa``
    that comes from rarer terms, the questions' terms that papers of ``abs_sq`` beyond ``reach`` have not looked up yet)."""
    questions = questions.where(F.size(tokens("user_query")) > 0)
    q = questions.select("query_id", tokens("user_query").alias("_qt"))
    q = q.select("query_id", sum_of_squares("_qt").alias("q_sq"), F.explode(term_counts("_qt")).alias("_tc"))
    q = q.select("query_id", "q_sq", F.col("_tc.term").alias("term"), F.col("_tc.cnt").alias("qtf"))
    q, _ = few(q.join(terms, "term", "left"), "question-vectors")
    norms = index_papers.select("pmc_id", "abs_sq")
    if "abs_sq" not in postings.columns:
        postings = postings.join(norms, "pmc_id")
    floor = max(int(floor), 16 * int(k))
    low = materialize(norms.orderBy(F.asc("abs_sq"), F.asc("pmc_id")).limit(floor + 1), "floor")  # floor + 1 rows
    edge = low.agg(F.count("*").alias("n"), F.max(F.struct("abs_sq", "pmc_id")).alias("last")).first()
    more = edge["n"] > floor
    if more:  # the last row is the first paper beyond the floor
        low = low.where((F.col("abs_sq") < edge["last"]["abs_sq"]) | (F.col("pmc_id") < edge["last"]["pmc_id"]))
    most_low = int(edge["last"]["abs_sq"]) if edge["n"] else 0
    keys = [c for c in ("tb", "term") if c in terms.columns]
    known = q.where("df is not null")
    in_low = postings.where(F.col("abs_sq") <= most_low).join(F.broadcast(low.select("pmc_id")), "pmc_id", "left_semi")
    shared = (known.join(in_low, keys).groupBy("query_id", "pmc_id")
              .agg(F.sum(F.col("qtf") * F.col("tf")).alias("qa"), F.max("abs_sq").alias("abs_sq"), F.max("q_sq").alias("q_sq")))
    # of papers that share nothing only the first k can be among the best k
    first = F.array(*[F.struct(F.lit(r["pmc_id"]).alias("pmc_id"), F.lit(int(r["abs_sq"])).cast("long").alias("abs_sq"))
                      for r in low.orderBy(F.asc("abs_sq"), F.asc("pmc_id")).limit(int(k)).collect()])  # k rows
    alone = (q.groupBy("query_id").agg(F.max("q_sq").alias("q_sq")).select("query_id", "q_sq", F.explode(first).alias("p"))
             .select("query_id", F.col("p.pmc_id").alias("pmc_id"), F.lit(0).cast("long").alias("qa"),
                     F.col("p.abs_sq").alias("abs_sq"), "q_sq")) if edge["n"] else shared.limit(0).select(
                         "query_id", "pmc_id", "qa", "abs_sq", "q_sq")
    at_floor = (shared.select(*alone.columns).unionByName(alone).groupBy("query_id", "pmc_id")
                .agg(*[F.max(c).alias(c) for c in ("qa", "abs_sq", "q_sq")]))
    at_floor = materialize(at_floor, "floor-pairs")
    if not more:
        return at_floor, None, None
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("pmc_id"))
    threshold = (at_floor.withColumn("score", cosine("qa", "q_sq", "abs_sq")).withColumn("_rk", F.row_number().over(w))
                 .where(F.col("_rk") == int(k)).select("query_id", F.col("score").alias("threshold")))
    common = Window.partitionBy("query_id").orderBy(F.desc("df"), "term")
    length = F.sqrt(F.sum(F.col("qtf") * F.col("qtf")).over(common).cast("double"))
    plan = known.join(threshold, "query_id", "left").withColumn("u", length).withColumn("reach", reach())
    plan, _ = few(plan, "term-plan")
    unread = plan.where("reach is not null")
    left = unread.groupBy("query_id").agg(F.collect_list(F.struct("reach", "u")).alias("unread"))  # the words of a question
    part = (join_postings(plan.select("query_id", "q_sq", "qtf", "threshold", "reach", *keys),
                          postings.where(F.col("abs_sq") >= most_low), term_buckets)
            .where(F.col("reach").isNull() | (F.col("abs_sq") <= F.col("reach")))
            .groupBy("query_id", "pmc_id").agg(F.sum(F.col("qtf") * F.col("tf")).alias("qa"),
                                               *[F.max(c).alias(c) for c in ("q_sq", "threshold", "abs_sq")]))
    part = part.join(few(left, "unread-terms")[0], "query_id", "left")
    u = F.array_max(F.transform(F.filter("unread", lambda x: x["reach"] < F.col("abs_sq")), lambda x: x["u"]))
    most = F.col("qa") + F.coalesce(u, F.lit(0.0)) * F.sqrt(F.col("abs_sq").cast("double"))
    part = part.where(F.col("threshold").isNull() | (cosine(most, "q_sq", "abs_sq") >= F.col("threshold") - SLACK))
    part = (part.join(F.broadcast(low.select("pmc_id")), "pmc_id", "left_anti")
            .join(norms.select("pmc_id"), "pmc_id", "left_semi"))
    return at_floor, part.select("query_id", "pmc_id", "qa", "abs_sq", "q_sq"), unread.select("query_id", "qtf", "reach", *keys)


def similarity_corpus(questions: DataFrame, index_papers: DataFrame, postings: DataFrame, terms: DataFrame,
                      k: int = INDEX_HITS, term_buckets: int = 0, floor: int = FLOOR) -> DataFrame:
    """Exact top ``k`` of every question over a whole index (sparse score).

    ``questions``: query_id, user_query. ``index_papers``: pmc_id, abs_sq (already
    filtered to indexable rows). ``postings``: term, pmc_id, tf over abstracts, best with the paper's abs_sq, and
    ``terms``: term, df (optionally both bucketed by ``tb``). A question without tokens
    has no hits. Output: query_id, pmc_id, score, search_score, hit_rank.
    """
    pairs, others, unread = bounded_pairs(questions, index_papers, postings, term_buckets, terms, k, floor)
    if others is not None:
        others, small = few(others, "open-pairs")
        wanted = (others.select("query_id", "pmc_id", F.col("abs_sq").alias("_sq")).join(unread, "query_id")
                  .where(F.col("reach") < F.col("_sq")).drop("reach", "_sq"))
        more = (join_postings(wanted, of_terms(postings, unread, term_buckets, others if small else None), term_buckets,
                              keys=("term", "pmc_id")).groupBy("query_id", "pmc_id")
                .agg(F.sum(F.col("qtf") * F.col("tf")).alias("more")))
        others = others.join(more, ["query_id", "pmc_id"], "left").withColumn(
            "qa", F.col("qa") + F.coalesce("more", F.lit(0)))
        pairs = pairs.unionByName(others.select(*pairs.columns))
    return rank_hits(pairs.withColumn("score", cosine("qa", "q_sq", "abs_sq")), k).select(
        "query_id", "pmc_id", "score", "search_score", "hit_rank")


# --- dense vectors ----------------------------------------------------------

QUESTION_ROWS, INDEX_ROWS = 4096, 16384   # rows of a block; a task holds one block of each
STEP = 1024                               # index rows that are scored at once


def block_topk(questions: pd.DataFrame, index: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact top ``k`` of each question within one index block, ties by id."""
    q_ids = questions["vec_id"].to_numpy()
    if not len(q_ids) or not len(index):
        return pd.DataFrame({"query_vec_id": q_ids[:0], "vec_id": q_ids[:0], "score": np.zeros(0)})
    q_mat = np.stack(questions["embedding"].to_numpy()).astype(np.float64)
    index = index.sort_values("vec_id", ignore_index=True)
    ids, mat = index["vec_id"].to_numpy(), np.stack(index["embedding"].to_numpy()).astype(np.float64)
    best_ids = np.zeros((len(q_ids), 0), dtype=np.int64)
    best = np.zeros((len(q_ids), 0))
    for at in range(0, len(ids), STEP):
        here, scores = ids[at:at + STEP], q_mat @ mat[at:at + STEP].T
        rows, cols = (np.nonzero(scores > best[:, -1:]) if best.shape[1] == k  # an equal score has a greater id here
                      else np.indices(scores.shape).reshape(2, -1))
        if not len(rows):
            continue
        # only rows that gain are sorted, and of them the scores that may enter
        gains = np.bincount(rows, minlength=len(q_ids))
        some = np.nonzero(gains)[0]
        place = np.cumsum(gains) - gains
        wide = np.full((len(some), best.shape[1] + gains.max()), -np.inf)
        wide_ids = np.zeros(wide.shape, dtype=np.int64)
        wide[:, :best.shape[1]], wide_ids[:, :best.shape[1]] = best[some], best_ids[some]
        to = np.searchsorted(some, rows), best.shape[1] + np.arange(len(rows)) - place[rows]
        wide[to], wide_ids[to] = scores[rows, cols], here[cols]
        order = np.argsort(-wide, axis=1, kind="stable")[:, :k]  # earlier columns have lesser ids
        if best.shape[1] < k:
            best, best_ids = np.zeros((len(q_ids), order.shape[1])), np.zeros((len(q_ids), order.shape[1]), dtype=np.int64)
        best[some], best_ids[some] = np.take_along_axis(wide, order, axis=1), np.take_along_axis(wide_ids, order, axis=1)
    return pd.DataFrame({"query_vec_id": np.repeat(q_ids, best.shape[1]), "vec_id": best_ids.reshape(-1),
                         "score": best.reshape(-1)})


def dense_topk(questions: DataFrame, index: DataFrame, k: int = INDEX_HITS,
               question_rows: int = QUESTION_ROWS, index_rows: int = INDEX_ROWS) -> DataFrame:
    """Exact top ``k`` by dot product (cosine on unit vectors).

    ``questions``/``index``: vec_id BIGINT, embedding ARRAY<FLOAT>. Both sides are dealt
    by a hash of the id into blocks, and every pair of blocks meets in one task
    (co-grouped by the pair). A task returns the local top ``k`` of its questions, and a
    literal ``row_number`` limit finishes after one more shuffle. The driver sees two
    counts. Every question meets every vector, so the work is their product; what one
    task holds is not. Null vectors are left out.
    """
    spark = index.sparkSession
    sides = [df.select("vec_id", "embedding").where("embedding is not null") for df in (questions, index)]
    n_q, n_i = (max(1, -(-df.count() // rows)) for df, rows in zip(sides, (question_rows, index_rows)))

    def dealt(df, own, own_blocks, other, other_blocks):
        return (df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))
                .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_q * n_i, 100_000)), "qb", "ib"))

    q = dealt(sides[0], "qb", n_q, "ib", n_i).groupBy("qb", "ib")
    i = dealt(sides[1], "ib", n_i, "qb", n_q).groupBy("qb", "ib")
    local = q.cogroup(i).applyInPandas(lambda one, other: block_topk(one, other, k),
                                       "query_vec_id long, vec_id long, score double")
    w = Window.partitionBy("query_vec_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (local.withColumn("hit_rank", F.row_number().over(w))
            .where(F.col("hit_rank") <= F.lit(int(k))))
