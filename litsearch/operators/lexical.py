"""Lexical side: postings, boolean match and ranked candidate retrieval.

S1  candidate retrieval: the best ``2 * amount`` papers by BM25 of the terms
    that they share with the question (``ranked_candidates``).
S1b boolean search strings: AND of groups, each an OR of terms. A paper
    matches when it contains a term of every group (``match_terms``).
T1  relevance order with a literal group limit so Spark plans a partial
    ``WindowGroupLimit`` before the shuffle on ``query_id``.

What is never done: join every question with every paper that has one of its
common words.

* AND: only papers of a question's rarest group can match, so candidates are
  the postings of that group; all other terms are looked up by (term, paper).
* OR: exact top k by upper bounds. For terms of more than ``CHAMPIONS``
  papers the index keeps the ``CHAMPIONS`` postings of greatest impact; what any
  other posting adds is at most the least of them. Champions and the whole lists of
  rarer terms give candidates, the best of these are scored in full, and the
  k-th score is a threshold. Whole lists of common terms are only read, cheapest
  per bound first, until papers outside of what was read cannot reach the threshold;
  a paper is scored in full only if its own bound reaches it.

Scale notes: stored postings are partitioned by a term bucket ``tb``; joining on
(tb, term) lets run-time partition pruning read only the buckets of a round's
terms. The per-term tables are aggregated map-side; the champions' ``row_number``
is limited before its shuffle too, so a term found in every paper sends
``CHAMPIONS`` rows a task. AQE broadcasts the question side when its measured
size allows, and splits hot ``term`` partitions (skew join) when it does not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsearch.functions.bitmap import bitmap, bits_for, marked
from litsearch.functions.text import tokens
from litsearch.session import few, materialize

# --- fixed BM25 parameters ------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
SCORE_DIGITS = 6     # ranking uses scores rounded to 6 digits, ties by id
CHAMPIONS = 64       # postings of greatest impact kept apart for each longer list
LAYERS = 32          # of impact, to find a term's champions without sorting its list
SEEDS = 4            # so many times the limit are scored in full for a threshold
FEW_MATCHES = 20_000_000   # postings of a search's terms up to which all of them are scored
SLACK = 2e-6         # of bounds, for rounding
# --------------------------------------------------------------------------

DEFAULT_FIELDS = ("article_title", "abstract")


@dataclass
class LexicalIndex:
    """Postings of a corpus plus the two corpus-wide scalars of BM25.

    ``postings``: term, pmc_id, tf, doc_len and optionally ``tf_abs``
    (count in the abstract alone) and ``tb`` (term bucket, the partition
    column of a stored index). ``terms``: tb, term, df, rest (the most that a posting
    beyond the champions has as ``impact``; 0 if there is none). ``champions``: as
    postings.
    """

    postings: DataFrame
    n_docs: int
    avg_len: float
    term_buckets: int = 0    # > 0: postings carry ``tb`` (stored partitioned by it)
    terms: DataFrame | None = None
    champions: DataFrame | None = None


def term_bucket(term, buckets: int) -> Column:
    """Stable bucket of a term (partition column of stored postings)."""
    t = F.col(term) if isinstance(term, str) else term
    return F.pmod(F.xxhash64(t), F.lit(int(buckets))).cast("int")


def join_postings(left: DataFrame, postings: DataFrame, buckets: int = 0, keys=("term",),
                  how: str = "inner") -> DataFrame:
    """Join on ``term`` (plus the term bucket ``tb`` when ``buckets`` > 0).

    With the bucket among the keys, postings stored partitioned by ``tb``
    are pruned at run time to the buckets of the terms on the small side
    (dynamic partition pruning): only those directories are read.
    """
    keys = list(keys)
    if buckets:
        if "tb" not in left.columns:
            left = left.withColumn("tb", term_bucket("term", buckets))
        # Tokens are never empty, so this keeps every row; the optimizer
        # only adds run-time partition pruning when the small side carries a
        # predicate it considers selective.
        left = left.where(F.length("term") > 0)
        keys = ["tb"] + keys
    return left.join(postings, keys, how)


def of_terms(postings: DataFrame, terms: DataFrame, buckets: int = 0, papers: DataFrame | None = None) -> DataFrame:
    """The postings of the terms of ``terms`` alone: what a look-up by (term, paper) has to shuffle and sort.

    ``papers``: with pmc_id, small enough to be sent to the tasks; of other papers no posting is kept then.
    """
    keys = (["tb"] if buckets else []) + ["term"]
    if buckets and "tb" not in terms.columns:
        terms = terms.withColumn("tb", term_bucket("term", buckets))
    found = postings.join(terms.select(*keys).distinct().where(F.length("term") > 0), keys, "left_semi")
    return found if papers is None else found.join(F.broadcast(papers.select("pmc_id")), "pmc_id", "left_semi")


def searchable_text(fields=DEFAULT_FIELDS) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def impact(avg_len: float) -> Column:
    """What a posting adds to BM25 before the term's weight."""
    tf = F.col("tf").cast("double")
    norm = F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * F.col("doc_len") / F.lit(avg_len if avg_len > 0 else 1.0))
    return (tf * F.lit(BM25_K1 + 1.0)) / (tf + norm)


def term_weight(n_docs: int) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))


def term_counts_by_impact(counts: DataFrame, avg_len: float, champions: int = CHAMPIONS) -> DataFrame:
    """term, df and ``cut``: an impact that at least ``champions`` of the term's postings reach (null if it has
    no more than that), read off a histogram of ``LAYERS`` layers; no posting is sorted for it."""
    layer = F.floor(impact(avg_len) / (BM25_K1 + 1.0) * LAYERS)
    rows = counts.where(F.col("tf") > 0).select("term", F.least(layer, F.lit(LAYERS - 1)).alias("layer"))
    sums = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *[
        F.sum((F.col("layer") == i).cast("int")).alias(f"_{i}") for i in range(LAYERS)])
    cut, above = F.lit(None).cast("double"), F.lit(0)
    for i in range(LAYERS):  # from the lowest layer up: the last that leaves enough at or above it stands
        enough = (F.col("df") - above) >= champions
        cut = F.when(enough, F.lit(i * (BM25_K1 + 1.0) / LAYERS)).otherwise(cut)
        above = above + F.col(f"_{i}")
    return sums.select("term", "df", F.when(F.col("df") > champions, cut).alias("cut"))


def champion_postings(postings: DataFrame, avg_len: float, champions: int = CHAMPIONS) -> DataFrame:
    """The ``champions`` postings of greatest impact of every term that has more; ``postings`` with ``cut``."""
    w = Window.partitionBy("term").orderBy(F.desc("impact"), F.asc("pmc_id"))
    upper = postings.where("tf > 0 and cut is not null").withColumn("impact", impact(avg_len))
    upper = upper.where(F.col("impact") >= F.col("cut") - SLACK).drop("cut")
    return upper.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= champions).drop("_n")


def term_table(df: DataFrame, champions: DataFrame, buckets: int = 0) -> DataFrame:
    """term, df, rest (see ``LexicalIndex``) and the bucket ``tb`` if there are any, from (term, df)."""
    rest = champions.groupBy("term").agg(F.min("impact").alias("rest"))
    out = df.join(rest, "term", "left").select("term", "df", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    return out.withColumn("tb", term_bucket("term", buckets)) if buckets else out


def terms_from_text(df: DataFrame, text_col: str, match: str = "all",
                    key: str = "query_id") -> DataFrame:
    """Split a search string into (key, group_id, term) groups.

    ``match='all'``: each distinct token is its own group (AND);
    ``match='any'``: one group holding all tokens (OR).
    """
    toks = tokens(text_col)
    exploded = df.select(key, toks.alias("toks")).select(
        key, "toks", F.explode(F.array_distinct("toks")).alias("term"))
    if match == "all":
        gid = (F.array_position("toks", F.col("term")) - 1).cast("int")
    elif match == "any":
        gid = F.lit(0).cast("int")
    else:
        raise ValueError(f"match must be 'all' or 'any', not {match!r}")
    return exploded.select(key, gid.alias("group_id"), "term")


def question_terms(terms: DataFrame) -> DataFrame:
    """Distinct (query_id, group_id, term) with ``n_groups`` and ``primary``: a term of several groups scores once."""
    by_query = Window.partitionBy("query_id")
    by_term = Window.partitionBy("query_id", "term")
    return (terms.select("query_id", "group_id", "term").distinct()
            .withColumn("n_groups", F.size(F.collect_set("group_id").over(by_query)))
            .withColumn("primary", F.col("group_id") == F.min("group_id").over(by_term)))


def searchable_postings(index: LexicalIndex) -> DataFrame:
    """The postings of the searched fields; a term's ``df`` comes from ``index.terms``."""
    cols = ["term", "pmc_id", "tf", "doc_len"] + (["tb"] if index.term_buckets else [])
    return index.postings.where(F.col("tf") > 0).select(*cols)


def contribution(index: LexicalIndex) -> Column:
    return term_weight(index.n_docs) * impact(index.avg_len)


def match_terms(terms: DataFrame, index: LexicalIndex, match: str = "all") -> DataFrame:
    """Boolean match and BM25 per (query_id, pmc_id).

    ``terms``: (query_id, group_id, term). A term listed in several groups
    adds to BM25 once. Output: query_id, pmc_id, bm25 (rounded), n_matched,
    n_groups. With ``match='all'`` only papers matching every group remain; they
    are found by the rarest group of each question.
    """
    if match not in ("all", "any"):
        raise ValueError(f"match must be 'all' or 'any', not {match!r}")
    qt = question_terms(terms).join(index.terms.select("term", "df"), "term", "left" if match == "all" else "inner")
    if match == "all":
        qt, _ = few(qt, "question-terms")
        size = (qt.groupBy("query_id", "group_id").agg(F.sum(F.coalesce("df", F.lit(0))).alias("size"))
                .groupBy("query_id").agg(F.min_by("group_id", F.struct("size", "group_id")).alias("group_id"),
                                         F.min("size").alias("size")).where("size > 0").drop("size"))
        first = qt.where("df is not null").join(size, ["query_id", "group_id"]).select("query_id", "term")
        first, _ = few(first, "rarest-terms")
        found = join_postings(first, searchable_postings(index), index.term_buckets).select("query_id", "pmc_id").distinct()
        found, small = few(found, "rarest-papers")
        pairs = found.join(qt.where("df is not null"), "query_id")
        postings = of_terms(searchable_postings(index), qt, index.term_buckets, found if small else None)
        joined = join_postings(pairs, postings, index.term_buckets, keys=("term", "pmc_id"))
    else:
        joined = join_postings(qt, searchable_postings(index), index.term_buckets)
    agg = joined.groupBy("query_id", "pmc_id").agg(
        F.sum(F.when(F.col("primary"), contribution(index)).otherwise(F.lit(0.0))).alias("bm25_raw"),
        F.size(F.collect_set("group_id")).alias("n_matched"),
        F.max("n_groups").alias("n_groups"),
    )
    if match == "all":
        agg = agg.where(F.col("n_matched") == F.col("n_groups"))
    return agg.select("query_id", "pmc_id", F.round("bm25_raw", SCORE_DIGITS).alias("bm25"),
                      F.col("n_matched").cast("int").alias("n_matched"),
                      F.col("n_groups").cast("int").alias("n_groups"))


def _best(scored: DataFrame, limits: DataFrame, by: str, most: int, times: int = 1) -> DataFrame:
    """The best ``times * limit`` rows of each question, with their place ``rk`` and ``limit``."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), F.asc("pmc_id"))
    ranked = scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= F.lit(int(most * times)))
    return ranked.join(limits.select("query_id", "limit"), "query_id").where(F.col("rk") <= F.col("limit") * times)


def _looked_up(pairs: DataFrame, lists: DataFrame, index: LexicalIndex) -> DataFrame:
    """``pairs`` (query_id, pmc_id, known) with ``score``: ``known`` and what the terms of ``lists`` add.

    Postings meet the terms and the pairs where they are read, so that no posting is shuffled, only what a task adds up
    for a pair. Few pairs are sent there themselves, of many a bitmap is; the join with ``pairs`` is exact.
    """
    lists, _ = few(lists.select("query_id", "term", "df"), "looked-up-terms")
    pairs, small = few(pairs, "looked-up-pairs")
    wanted = pairs.select("query_id", "pmc_id")
    postings = of_terms(searchable_postings(index), lists, index.term_buckets, wanted if small else None)
    parts = join_postings(lists, postings, index.term_buckets)
    if small:
        parts = parts.join(F.broadcast(wanted), ["query_id", "pmc_id"], "left_semi")
    else:
        bits, key = bits_for(pairs.count()), F.xxhash64("query_id", "pmc_id")
        parts = marked(parts, key, bitmap(wanted, key, bits), bits, "_wanted").where("_wanted")
    more = parts.groupBy("query_id", "pmc_id").agg(F.sum(contribution(index)).alias("more"))
    return pairs.join(more, ["query_id", "pmc_id"], "left").withColumn(
        "score", F.col("known") + F.coalesce("more", F.lit(0.0))).drop("more")


def _threshold(scored: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """query_id, floor: the score that ``limit`` papers reach at least, where so many were scored."""
    return (_best(scored, limits, "score", most).where(F.col("rk") == F.col("limit"))
            .select("query_id", F.col("score").alias("floor")))


def open_candidates(terms: DataFrame, index: LexicalIndex, limits: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Papers that may be among the best ``limit`` of a question (OR of its terms), and the lists not read for them.

    The first has query_id, pmc_id and ``known``, the part of the score that comes from whole lists;
    the second (query_id, term) the terms of which only champions were read. ``most`` bounds every limit.
    """
    weight = term_weight(index.n_docs)
    cols = (["tb"] if index.term_buckets else []) + ["term", "df", "rest"]
    lists = materialize(terms.select("query_id", "term").distinct().join(index.terms.select(*cols), "term")
                        .withColumn("rest", weight * F.col("rest")), "question-lists")
    keys = [c for c in cols if c in ("tb", "term")]
    long_lists = lists.where("rest > 0").select("query_id", *cols)

    def read(whole: DataFrame, champions: DataFrame) -> DataFrame:
        part = contribution(index)
        zero = F.lit(0.0)
        rows = join_postings(whole.select("query_id", "df", *keys), searchable_postings(index), index.term_buckets).select(
            "query_id", "pmc_id", part.alias("known"), zero.alias("top"), zero.alias("rest"))
        tops = champions.join(index.champions.select("pmc_id", "tf", "doc_len", *keys), keys).select(
            "query_id", "pmc_id", zero.alias("known"), part.alias("top"), "rest")
        return rows.unionByName(tops).groupBy("query_id", "pmc_id").agg(
            *[F.sum(c).alias(c) for c in ("known", "top", "rest")])

    first = read(lists.where("rest = 0"), long_lists).withColumn("reach", F.col("known") + F.col("top"))
    seeds = materialize(_best(first, limits, "reach", most, SEEDS).select("query_id", "pmc_id", "known"), "seeds")
    seeds = _looked_up(seeds, long_lists, index)
    floors = materialize(_threshold(seeds, limits, most), "first-floors")
    # cheapest bound first: lists are read until what is left unread cannot reach the floor
    cheap = Window.partitionBy("query_id").orderBy(F.col("df") / F.col("rest"), "term")
    total = Window.partitionBy("query_id")
    plan = (lists.where("rest > 0").join(floors, "query_id", "left")
            .withColumn("open", F.sum("rest").over(total) - F.coalesce(
                F.sum("rest").over(cheap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("whole", F.col("floor").isNull() | (F.col("open") >= F.col("floor") - SLACK)))
    plan = materialize(plan.select("query_id", *cols, "whole"), "list-plan")
    unread = plan.where(~F.col("whole")).select("query_id", *cols)
    left = unread.groupBy("query_id").agg(F.sum("rest").alias("left"))
    short = lists.where("rest = 0").select("query_id", *cols)
    found = read(short.unionByName(plan.where("whole").select("query_id", *cols)), unread)
    found = (found.join(left, "query_id", "left").withColumn("reach", F.col("known") + F.col("top"))
             .withColumn("bound", F.col("reach") + F.coalesce("left", F.lit(0.0)) - F.col("rest")))
    found = materialize(found.join(floors, "query_id", "left")
                        .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
                        .select("query_id", "pmc_id", "known", "reach", "bound"), "bounded")
    # the best by what is known of them now give a higher floor
    again = materialize(_best(found, limits, "reach", most, SEEDS).select("query_id", "pmc_id", "known"), "seeds-again")
    floors = _threshold(_looked_up(again, unread, index), limits, most)
    kept = (found.join(floors, "query_id", "left")
            .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)))
    return materialize(kept.select("query_id", "pmc_id", "known"), "open-candidates"), unread


def ranked_candidates(terms: DataFrame, index: LexicalIndex, limits: DataFrame, max_limit: int,
                      few: int = FEW_MATCHES) -> DataFrame:
    """The rows of ``top_candidates`` over ``match_terms(..., "any")`` (T1), by the cheaper of two ways.

    The postings of all questions' terms are counted first, from the term table. Up to ``few``
    of them, one join that scores every match costs less than the jobs of the pruned search;
    beyond, no match is scored that cannot count. Both give the same rows.
    """
    distinct = terms.select("query_id", "term").distinct()
    matches = distinct.join(index.terms.select("term", "df"), "term").agg(F.sum("df")).first()[0] or 0
    if matches <= few:
        return top_candidates(match_terms(terms, index, "any"), limits, max_limit)
    kept, unread = open_candidates(terms, index, limits, max_limit)
    scored = _looked_up(kept, unread, index)
    return top_candidates(scored.select("query_id", "pmc_id", F.round("score", SCORE_DIGITS).alias("bm25")),
                          limits, max_limit)


def top_candidates(matches: DataFrame, limits: DataFrame, max_limit: int) -> DataFrame:
    """Relevance order per question, first ``limit`` rows.

    ``limits``: (query_id, limit). ``max_limit`` is a literal upper bound of
    every limit; it lets the optimizer insert a partial per-partition top-k
    (``WindowGroupLimit``) before the shuffle on ``query_id``, so a question
    matching a third of the corpus still sends only ``max_limit`` rows per
    partition to one task.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), F.asc("pmc_id"))
    ranked = matches.withColumn("rk", F.row_number().over(w))
    ranked = ranked.where(F.col("rk") <= F.lit(int(max_limit)))
    return (ranked.join(limits.select("query_id", "limit"), "query_id")
            .where(F.col("rk") <= F.col("limit")).drop("limit"))
