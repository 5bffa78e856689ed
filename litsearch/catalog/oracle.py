"""Reference SQL (DuckDB dialect) for the registered queries.

Each statement recomputes its inputs from the raw tables (``documents``,
``benchmark``, ``embeddings``, ``events``, ``conversations``) with the same
rules as ``litsearch.sources.fixtures``; the views are registered by the
checker. The statements are a brute-force restatement of each operator's
meaning (e.g. similarity over every question x paper pair), not a copy of
the Spark plans.
"""

from __future__ import annotations

import re

from litsearch.operators.lexical import BM25_B, BM25_K1, SCORE_DIGITS
from litsearch.schemas import (CANDIDATE_FACTOR, DEFAULT_AMOUNT, DEFAULT_THRESHOLD, INDEX_HITS,
                               MAX_INDEX_TOKENS, MAX_REFINEMENTS, TOP_KEYWORDS, URL_PREFIX)
from litsearch.sources import fixtures as FX

PAT = r"'[\p{L}\p{N}]+'"
WS = r"[\s\x{0B}\x{85}\p{Z}]+"


def tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {PAT})"


def trim_ws(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{WS}', ''), '{WS}\\z', '')"


def url(expr: str) -> str:
    return f"'{URL_PREFIX}' || regexp_replace({expr}, '^PMC', '') || '/'"


# --- corpus -------------------------------------------------------------------
PAPERS = f"""
docs AS (
  SELECT doc_id, text, lang, source, {tok('text')} AS toks, false AS extra FROM documents
  UNION ALL
  SELECT doc_id + {FX.EXTRA_OFFSET}, text, lang, source, {tok('text')} AS toks, true AS extra
  FROM documents WHERE doc_id % {FX.EXTRA_EVERY} = 0),
papers0 AS (
  SELECT doc_id,
    array_to_string({tok("string_split(text, chr(10))[1]")}, ' ') AS article_title,
    CASE WHEN extra THEN '' ELSE {trim_ws('text')} END AS abstract,
    CASE WHEN doc_id % 9 = 0 THEN []::VARCHAR[]
         ELSE list_sort(list_distinct(list_filter(toks, lambda t: length(t) >= {FX.KEYWORD_MIN_LEN})))
    END AS keywords,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE '{FX.DOI_PREFIX}' || CAST(doc_id AS VARCHAR) END AS doi,
    CASE WHEN doc_id % 2 = 0 THEN 'PMC' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END
      AS pmc_id,
    CAST(doc_id + {FX.PM_ID_OFFSET} AS VARCHAR) AS pm_id,
    source || ' ' || lang AS author,
    CAST({FX.FIRST_YEAR} + doc_id % {FX.YEAR_SPAN} AS VARCHAR) AS pub_year
  FROM docs),
papers AS (
  SELECT doc_id, article_title, abstract, keywords, doi, pmc_id, pm_id, author,
         {url('pmc_id')} AS url, pub_year, len({tok('abstract')}) AS n_tokens
  FROM papers0),
abs_terms AS (
  SELECT pmc_id, term, count(*) AS tf
  FROM (SELECT pmc_id, unnest({tok('abstract')}) AS term FROM papers) GROUP BY pmc_id, term),
abs_sq AS (SELECT pmc_id, sum(tf * tf) AS abs_sq FROM abs_terms GROUP BY pmc_id),
papers_s AS (
  SELECT p.*, coalesce(s.abs_sq, 0) AS abs_sq FROM papers p LEFT JOIN abs_sq s USING (pmc_id))"""

PAPER_COLS = "article_title, abstract, keywords, doi, pmc_id, pm_id, author, url, pub_year"

# --- questions -----------------------------------------------------------------
QUERIES = f"""
bench AS (SELECT item_id, {tok('text')} AS toks FROM benchmark),
queries AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id,
    array_to_string(toks, ' ') AS user_query,
    '10.0.0.' || CAST(item_id % 5 AS VARCHAR) || ':5000' AS remote_addr,
    CAST(item_id % 7 AS INTEGER) AS amount,
    CAST(CASE WHEN item_id % 4 = 0 THEN 0.0 ELSE 0.6 END AS FLOAT) AS threshold
  FROM bench),
params AS (
  SELECT query_id, user_query,
    CAST(CASE WHEN coalesce(amount, 0) = 0 THEN {DEFAULT_AMOUNT} ELSE amount END AS INTEGER) AS amount,
    CASE WHEN coalesce(threshold, CAST(0 AS FLOAT)) = CAST(0 AS FLOAT)
         THEN CAST({DEFAULT_THRESHOLD} AS FLOAT) ELSE threshold END AS threshold
  FROM queries),
qtok AS (SELECT query_id, {tok('user_query')} AS toks FROM queries),
query_terms AS (
  SELECT query_id, 0 AS alt, CAST(list_position(toks, t) - 1 AS INTEGER) AS group_id, t AS term
  FROM (SELECT query_id, toks, unnest(list_distinct(toks)) AS t FROM qtok)
  UNION ALL
  SELECT query_id, 1 AS alt, CASE WHEN length(t) >= {FX.ALT1_MIN_LEN} THEN 0 ELSE 1 END AS group_id, t AS term
  FROM (SELECT query_id, unnest(list_distinct(toks)) AS t FROM qtok)
  UNION ALL
  SELECT query_id, 2 AS alt, 0 AS group_id, t AS term
  FROM (SELECT query_id, unnest(list_distinct(toks)) AS t FROM qtok)),
qv AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({tok('user_query')}) AS term FROM queries) GROUP BY query_id, term),
qsq AS (SELECT query_id, sum(qtf * qtf) AS q_sq FROM qv GROUP BY query_id)"""

# --- lexical index ---------------------------------------------------------------
LEXICAL = f"""
lex_docs AS (SELECT pmc_id, {tok("concat_ws(' ', article_title, abstract)")} AS toks FROM papers),
lex_len AS (SELECT pmc_id, len(toks) AS doc_len FROM lex_docs),
postings AS (
  SELECT term, pmc_id, count(*) AS tf
  FROM (SELECT pmc_id, unnest(toks) AS term FROM lex_docs) GROUP BY term, pmc_id),
dfreq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
lstats AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs,
                  CAST(sum(doc_len) AS DOUBLE) / count(*) AS avg_len FROM lex_len)"""


def match_cte(name: str, terms: str, match: str = "all") -> str:
    """BM25 + boolean match of a terms relation (query_id, group_id, term)."""
    k1, b = repr(BM25_K1), repr(BM25_B)
    k1p, one_b = repr(BM25_K1 + 1.0), repr(1.0 - BM25_B)
    cond = "n_matched = n_groups" if match == "all" else "n_matched >= 1"
    return f"""
{name}_qt AS (SELECT DISTINCT query_id, group_id, term FROM ({terms})),
{name}_n AS (SELECT query_id, count(DISTINCT group_id) AS n_groups FROM {name}_qt GROUP BY query_id),
{name}_p AS (SELECT query_id, term, min(group_id) AS pg FROM {name}_qt GROUP BY query_id, term),
{name}_raw AS (
  SELECT q.query_id, p.pmc_id,
    sum(CASE WHEN q.group_id = pp.pg THEN
          (ln(CAST(1.0 AS DOUBLE) + ((s.n_docs - d.df) + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE)))
           * (p.tf * CAST({k1p} AS DOUBLE)))
          / (p.tf + CAST({k1} AS DOUBLE) * (CAST({one_b} AS DOUBLE)
               + (CAST({b} AS DOUBLE) * l.doc_len) / s.avg_len))
        ELSE CAST(0 AS DOUBLE) END) AS bm25_raw,
    count(DISTINCT q.group_id) AS n_matched, max(n.n_groups) AS n_groups
  FROM {name}_qt q
  JOIN postings p ON p.term = q.term
  JOIN dfreq d ON d.term = q.term
  JOIN lex_len l ON l.pmc_id = p.pmc_id
  JOIN {name}_p pp ON pp.query_id = q.query_id AND pp.term = q.term
  JOIN {name}_n n ON n.query_id = q.query_id
  CROSS JOIN lstats s
  GROUP BY q.query_id, p.pmc_id),
{name} AS (
  SELECT query_id, pmc_id, round(bm25_raw, {SCORE_DIGITS}) AS bm25,
         CAST(n_matched AS INTEGER) AS n_matched, CAST(n_groups AS INTEGER) AS n_groups
  FROM {name}_raw WHERE {cond})"""


def topk_cte(name: str, matches: str) -> str:
    """First 2 * amount candidates per question by BM25 (ties by id)."""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY m.bm25 DESC, m.pmc_id) AS rk,
           pr.amount
    FROM {matches} m JOIN params pr USING (query_id))
  WHERE rk <= {CANDIDATE_FACTOR} * amount)"""


def own_hits_cte(name: str, cands: str) -> str:
    """Per-question index = its indexable candidates; top hits by cosine."""
    return f"""
{name}_idx AS (
  SELECT c.query_id, c.pmc_id, ps.abs_sq
  FROM {cands} c JOIN papers_s ps USING (pmc_id)
  WHERE ps.abstract <> '' AND ps.n_tokens <= {MAX_INDEX_TOKENS}),
{name}_dot AS (
  SELECT i.query_id, i.pmc_id, sum(v.qtf * a.tf) AS qa
  FROM {name}_idx i JOIN abs_terms a ON a.pmc_id = i.pmc_id
  JOIN qv v ON v.query_id = i.query_id AND v.term = a.term
  GROUP BY i.query_id, i.pmc_id),
{name}_sc AS (
  SELECT i.query_id, i.pmc_id, {cosine_sql('coalesce(d.qa, 0)', 'q.q_sq', 'i.abs_sq')} AS score
  FROM {name}_idx i JOIN qsq q ON q.query_id = i.query_id
  LEFT JOIN {name}_dot d ON d.query_id = i.query_id AND d.pmc_id = i.pmc_id
  WHERE q.q_sq > 0),
{name} AS (
  SELECT query_id, pmc_id, CAST(score AS FLOAT) AS search_score, hit_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmc_id) AS hit_rank
    FROM {name}_sc) WHERE hit_rank <= {INDEX_HITS})"""


def cosine_sql(qa: str, qq: str, aa: str) -> str:
    return (f"CASE WHEN {qq} > 0 THEN (CAST({qa} AS DOUBLE) + CAST({qq} AS DOUBLE)) / "
            f"(sqrt(CAST({qq} AS DOUBLE)) * sqrt(CAST({aa} AS DOUBLE) + CAST(2.0 AS DOUBLE) * "
            f"CAST({qa} AS DOUBLE) + CAST({qq} AS DOUBLE))) ELSE CAST(0 AS DOUBLE) END")


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


ROUND0 = [PAPERS, QUERIES, LEXICAL,
          match_cte("m2", "SELECT query_id, group_id, term FROM query_terms WHERE alt = 2", "any"),
          topk_cte("c2", "m2"),
          own_hits_cte("h2", "c2")]


def _scored_left(cands: str, hits: str) -> str:
    return f"""
sl AS (
  SELECT c.query_id, c.pmc_id, c.rk, ps.keywords, h.hit_rank,
         coalesce(h.search_score, CAST(0 AS FLOAT)) AS search_score
  FROM {cands} c JOIN papers_s ps USING (pmc_id)
  LEFT JOIN {hits} h ON h.query_id = c.query_id AND h.pmc_id = c.pmc_id)"""


def _passing() -> str:
    return """
passing AS (
  SELECT sl.query_id, sl.pmc_id, sl.rk, sl.keywords, sl.hit_rank, sl.search_score, p.threshold
  FROM sl JOIN params p USING (query_id)
  WHERE sl.hit_rank IS NOT NULL AND sl.search_score > p.threshold)"""


def _weights(src: str) -> str:
    return f"""
kw AS (SELECT query_id, keyword, sum(CAST(search_score AS DOUBLE)) AS weight
       FROM (SELECT query_id, search_score, unnest(keywords) AS keyword FROM {src})
       GROUP BY query_id, keyword),
kwtop AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, keyword) AS kw_rank
    FROM kw) WHERE kw_rank <= {TOP_KEYWORDS})"""


def sql_candidates_topk() -> str:
    return with_(*ROUND0[:5]) + "SELECT query_id, pmc_id, bm25, CAST(rk AS INTEGER) AS rk FROM c2"


def sql_candidates_boolean() -> str:
    parts = [PAPERS, QUERIES, LEXICAL,
             match_cte("a0", "SELECT query_id, group_id, term FROM query_terms WHERE alt = 0"),
             match_cte("a1", "SELECT query_id, group_id, term FROM query_terms WHERE alt = 1")]
    return with_(*parts) + """
SELECT query_id, 0 AS alt, pmc_id, bm25, n_groups FROM a0
UNION ALL
SELECT query_id, 1 AS alt, pmc_id, bm25, n_groups FROM a1"""


def sql_boolean_strings() -> str:
    """The meaning of each form written out; the strings only as text."""
    used = match_cte("used", "SELECT query_id, 0 AS group_id, term FROM word WHERE NOT (form = 3 AND pos = 4)", "any")
    return with_(PAPERS, QUERIES, LEXICAL, """
word AS (
  SELECT query_id, CAST(query_id AS BIGINT) % 6 AS form, pos, toks[pos] AS term FROM qtok, range(1, 5) AS r(pos)),
string AS (
  SELECT query_id, CAST(query_id AS BIGINT) % 6 AS form, CASE CAST(query_id AS BIGINT) % 6
    WHEN 0 THEN '("' || toks[1] || '" and "' || toks[2] || '") or ("' || toks[3] || '" and "' || toks[4] || '")'
    WHEN 1 THEN '"' || toks[1] || '" AND ("' || toks[2] || '" or ("' || toks[3] || '" and "' || toks[4] || '"))'
    WHEN 2 THEN toks[1] || ' ' || toks[2] || ' or "' || toks[3] || ' ' || toks[4] || '"'
    WHEN 3 THEN '"' || toks[1] || '" or "' || toks[2] || '" and "' || toks[3] || '"'
    WHEN 4 THEN '("' || toks[1] || '" and ("' || toks[2] || '")'
    ELSE '"' || toks[1] || '" or' END AS search_string
  FROM qtok),
has AS (
  SELECT w.query_id, w.form, p.pmc_id, bool_or(pos = 1) AS a, bool_or(pos = 2) AS b, bool_or(pos = 3) AS c,
         bool_or(pos = 4) AS d
  FROM word w JOIN postings p USING (term) GROUP BY w.query_id, w.form, p.pmc_id)""", used) + """
SELECT s.query_id, s.search_string, h.pmc_id, u.bm25, NULL AS reason
FROM has h JOIN string s USING (query_id) JOIN used u ON u.query_id = h.query_id AND u.pmc_id = h.pmc_id
WHERE CASE h.form WHEN 0 THEN (a AND b) OR (c AND d) WHEN 1 THEN a AND (b OR (c AND d)) WHEN 2 THEN (a AND b) OR (c AND d)
      WHEN 3 THEN (a OR b) AND c ELSE false END
UNION ALL
SELECT query_id, search_string, NULL, NULL, CASE form WHEN 4 THEN 'unbalanced parenthesis'
  ELSE 'operator without operand' END FROM string WHERE form > 3"""


def sql_similarity_tf() -> str:
    return with_(PAPERS, QUERIES, f"""
idx AS (SELECT pmc_id, abs_sq FROM papers_s WHERE abstract <> '' AND n_tokens <= {MAX_INDEX_TOKENS}),
dots AS (SELECT v.query_id, a.pmc_id, sum(v.qtf * a.tf) AS qa
         FROM qv v JOIN abs_terms a ON a.term = v.term JOIN idx i ON i.pmc_id = a.pmc_id
         GROUP BY v.query_id, a.pmc_id),
pairs AS (SELECT q.query_id, i.pmc_id, coalesce(d.qa, 0) AS qa, q.q_sq, i.abs_sq
          FROM qsq q CROSS JOIN idx i
          LEFT JOIN dots d ON d.query_id = q.query_id AND d.pmc_id = i.pmc_id
          WHERE q.q_sq > 0),
ranked AS (SELECT query_id, pmc_id, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmc_id) AS hit_rank
           FROM (SELECT *, {cosine_sql('qa', 'q_sq', 'abs_sq')} AS score FROM pairs))""") + f"""
SELECT query_id, pmc_id, CAST(score AS FLOAT) AS search_score, CAST(hit_rank AS INTEGER) AS hit_rank
FROM ranked WHERE hit_rank <= {INDEX_HITS}"""


def sql_threshold_hits() -> str:
    base = sql_similarity_tf()
    return f"""
SELECT s.query_id, s.pmc_id, s.search_score, s.hit_rank, p.threshold
FROM ({base}) s JOIN (WITH {QUERIES.strip()} SELECT query_id, threshold FROM params) p USING (query_id)
WHERE s.search_score > p.threshold"""


def sql_similarity_embedding() -> str:
    return f"""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     i AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     s AS (SELECT q.vec_id AS query_vec_id, i.vec_id, list_dot_product(q.e, i.e) AS score
           FROM q CROSS JOIN i),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS hit_rank
           FROM s)
SELECT query_vec_id, vec_id, round(score, 6) AS score, CAST(hit_rank AS INTEGER) AS hit_rank
FROM r WHERE hit_rank <= {INDEX_HITS}"""


def sql_score_papers() -> str:
    return with_(*ROUND0) + """
SELECT c.query_id, c.pmc_id, CAST(c.rk AS INTEGER) AS rk, CAST(h.hit_rank AS INTEGER) AS hit_rank,
       h.search_score
FROM c2 c JOIN h2 h ON h.query_id = c.query_id AND h.pmc_id = c.pmc_id"""


def sql_score_papers_bm25() -> str:
    k1, b = repr(BM25_K1), repr(BM25_B)
    return with_(*ROUND0[:5], f"""
part AS (
  SELECT c.query_id, c.pmc_id, sum(v.qtf
    * ln(CAST(1.0 AS DOUBLE) + ((s.n_docs - d.df) + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE)))
    * (a.tf * CAST({repr(BM25_K1 + 1.0)} AS DOUBLE))
    / (a.tf + CAST({k1} AS DOUBLE) * (CAST({repr(1.0 - BM25_B)} AS DOUBLE)
       + (CAST({b} AS DOUBLE) * ps.n_tokens) / s.avg_len))) AS qa
  FROM c2 c JOIN papers_s ps USING (pmc_id) JOIN abs_terms a ON a.pmc_id = c.pmc_id
  JOIN qv v ON v.query_id = c.query_id AND v.term = a.term JOIN dfreq d ON d.term = a.term CROSS JOIN lstats s
  GROUP BY c.query_id, c.pmc_id),
own AS (
  SELECT c.query_id, c.pmc_id, c.rk, round(coalesce(p.qa, CAST(0 AS DOUBLE))
         / (coalesce(p.qa, CAST(0 AS DOUBLE)) + q.q_sq), {SCORE_DIGITS}) AS score
  FROM c2 c JOIN papers_s ps USING (pmc_id) JOIN qsq q ON q.query_id = c.query_id
  LEFT JOIN part p ON p.query_id = c.query_id AND p.pmc_id = c.pmc_id
  WHERE ps.abstract <> '' AND ps.n_tokens <= {MAX_INDEX_TOKENS})""") + f"""
SELECT query_id, pmc_id, CAST(rk AS INTEGER) AS rk, CAST(hit_rank AS INTEGER) AS hit_rank,
       CAST(score AS FLOAT) AS search_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmc_id) AS hit_rank FROM own)
WHERE hit_rank <= {INDEX_HITS}"""


def sql_score_papers_left() -> str:
    return with_(*ROUND0, _scored_left("c2", "h2")) + """
SELECT query_id, pmc_id, CAST(rk AS INTEGER) AS rk, CAST(hit_rank AS INTEGER) AS hit_rank, search_score
FROM sl"""


def sql_rank_results() -> str:
    return with_(*ROUND0, _scored_left("c2", "h2"), _passing()) + """,
cnt AS (SELECT query_id, count(*) AS n_found FROM passing GROUP BY query_id),
r AS (
  SELECT p.query_id, p.pmc_id, p.search_score, p.hit_rank, pr.amount, cnt.n_found,
    row_number() OVER (PARTITION BY p.query_id ORDER BY
      CASE WHEN pr.amount > cnt.n_found THEN CAST(0 AS DOUBLE) ELSE -CAST(p.search_score AS DOUBLE) END,
      p.hit_rank, p.pmc_id) AS rk
  FROM passing p JOIN params pr USING (query_id) JOIN cnt USING (query_id))
SELECT query_id, CAST(rk AS INTEGER) AS rk, pmc_id, search_score,
       CAST(least(amount, n_found) AS INTEGER) AS paper_count
FROM r WHERE amount > n_found OR rk <= amount"""


def sql_all_abstracts_empty() -> str:
    parts = [PAPERS, QUERIES, LEXICAL,
             match_cte("m0", "SELECT query_id, group_id, term FROM query_terms WHERE alt = 0"),
             topk_cte("c0", "m0")]
    return with_(*parts) + """
SELECT p.query_id, coalesce(bool_and(ps.abstract = ''), true) AS all_empty,
       count(ps.pmc_id) AS n_papers
FROM params p LEFT JOIN c0 ON c0.query_id = p.query_id
LEFT JOIN papers_s ps ON ps.pmc_id = c0.pmc_id
GROUP BY p.query_id"""


def sql_keyword_weights() -> str:
    return with_(*ROUND0, _scored_left("c2", "h2"), _weights("sl")) + \
        "SELECT query_id, keyword, weight FROM kw"


def sql_keyword_top3() -> str:
    return with_(*ROUND0, _scored_left("c2", "h2"), _weights("sl")) + \
        "SELECT query_id, keyword, weight, CAST(kw_rank AS INTEGER) AS kw_rank FROM kwtop"


def sql_feedback_query() -> str:
    return with_(*ROUND0, _scored_left("c2", "h2"), _weights("sl")) + """
SELECT query_id, string_agg(keyword, ' ' ORDER BY kw_rank) AS next_query FROM kwtop GROUP BY query_id"""


def _outcome_ctes(cands: str) -> str:
    """Questions with a non-empty abstract: count, feedback source, keywords."""
    return f"""
okq AS (SELECT DISTINCT c.query_id FROM {cands} c JOIN papers_s ps USING (pmc_id)
        WHERE ps.abstract <> ''),
cnt AS (SELECT o.query_id, count(p.pmc_id) AS n_results
        FROM okq o LEFT JOIN passing p ON p.query_id = o.query_id GROUP BY o.query_id),
src AS (
  SELECT p.query_id, p.keywords, p.search_score FROM passing p
  JOIN cnt c ON c.query_id = p.query_id JOIN params pr ON pr.query_id = p.query_id
  WHERE pr.amount > c.n_results AND c.n_results > 0
  UNION ALL
  SELECT s.query_id, s.keywords, s.search_score FROM sl s
  JOIN cnt c ON c.query_id = s.query_id JOIN params pr ON pr.query_id = s.query_id
  WHERE pr.amount > c.n_results AND c.n_results = 0),""" + _weights("src").strip("\n") + """,
fb AS (SELECT query_id, string_agg(keyword, ' ' ORDER BY kw_rank) AS next_query
       FROM kwtop GROUP BY query_id)"""


OUTCOME_STATUS = """
  CASE WHEN pr.amount <= c.n_results THEN 'enough'
       WHEN fb.next_query IS NOT NULL THEN 'feedback' ELSE 'no_keywords' END AS status,
  CASE WHEN pr.amount > c.n_results THEN fb.next_query END AS next_query"""


def sql_stop_condition() -> str:
    """One round with alt 2: count, then enough / feedback / no_keywords."""
    return with_(*ROUND0, _scored_left("c2", "h2"), _passing(), _outcome_ctes("c2")) + f"""
SELECT c.query_id, CAST(c.n_results AS BIGINT) AS n_results, pr.amount, {OUTCOME_STATUS}
FROM cnt c JOIN params pr USING (query_id) LEFT JOIN fb USING (query_id)"""


def _round0_parts():
    parts = [PAPERS, QUERIES, LEXICAL,
             match_cte("m0", "SELECT query_id, group_id, term FROM query_terms WHERE alt = 0"),
             topk_cte("c0", "m0"), own_hits_cte("h0", "c0"),
             _scored_left("c0", "h0"), _passing(), _outcome_ctes("c0")]
    select = f"""
SELECT c.query_id, {OUTCOME_STATUS}, CAST(c.n_results AS BIGINT) AS n_results, 1 AS next_alt
FROM cnt c JOIN params pr USING (query_id) LEFT JOIN fb USING (query_id)
UNION ALL
SELECT pr.query_id,
  CASE WHEN EXISTS (SELECT 1 FROM query_terms t WHERE t.query_id = pr.query_id AND t.alt = 1)
       THEN 'requery' ELSE 'exhausted' END AS status,
  NULL AS next_query, CAST(0 AS BIGINT) AS n_results, 1 AS next_alt
FROM params pr WHERE pr.query_id NOT IN (SELECT query_id FROM okq)"""
    return parts, select


def sql_search_one_round() -> str:
    """First round of the loop: alt 0, every group must match; questions
    whose abstracts are all empty (or that found nothing) re-ask (alt 1)."""
    parts, select = _round0_parts()
    return with_(*parts) + select


def sql_search_two_rounds() -> str:
    """Result rows of the first two rounds of the loop, unrolled.

    Round 1 searches with the feedback string of round 0 (each token its own
    AND group) or, after an all-empty round, with alternative 1. Its index
    holds the indexable candidates of both rounds; only its own papers can
    be appended (bag semantics: a paper may appear in both rounds).
    """
    parts, select = _round0_parts()
    t1 = f"""
o0 AS ({select}),
t1 AS (
  SELECT query_id, CAST(list_position(tk, t) - 1 AS INTEGER) AS group_id, t AS term
  FROM (SELECT query_id, tk, unnest(list_distinct(tk)) AS t
        FROM (SELECT query_id, {tok('next_query')} AS tk FROM o0 WHERE status = 'feedback'))
  UNION ALL
  SELECT q.query_id, q.group_id, q.term FROM query_terms q JOIN o0 ON o0.query_id = q.query_id
  WHERE o0.status = 'requery' AND q.alt = 1)"""
    rest = f"""
ok1 AS (SELECT DISTINCT c.query_id FROM c1 c JOIN papers_s ps USING (pmc_id) WHERE ps.abstract <> ''),
idx01 AS (
  SELECT DISTINCT query_id, pmc_id FROM (
    SELECT query_id, pmc_id FROM c0 UNION ALL SELECT query_id, pmc_id FROM c1)
  WHERE query_id IN (SELECT query_id FROM ok1)),""" + own_hits_cte("h1", "idx01").strip("\n") + """,
sl1 AS (
  SELECT c.query_id, c.pmc_id, h.hit_rank, h.search_score
  FROM c1 c JOIN h1 h ON h.query_id = c.query_id AND h.pmc_id = c.pmc_id
  WHERE c.query_id IN (SELECT query_id FROM ok1)),
passing1 AS (
  SELECT s.query_id, s.pmc_id, s.hit_rank, s.search_score FROM sl1 s JOIN params p USING (query_id)
  WHERE s.search_score > p.threshold)"""
    body = with_(*parts, t1, match_cte("m1", "SELECT query_id, group_id, term FROM t1"),
                 topk_cte("c1", "m1"), rest)
    return body + """
SELECT query_id, 0 AS round, CAST(hit_rank AS INTEGER) AS hit_rank, pmc_id, search_score FROM passing
UNION ALL
SELECT query_id, 1 AS round, CAST(hit_rank AS INTEGER) AS hit_rank, pmc_id, search_score FROM passing1"""


def _rendered() -> str:
    """Boolean search string of every (question, alternative)."""
    return """
rgroup AS (
  SELECT query_id, alt, group_id, string_agg('"' || term || '"', ' or ' ORDER BY '"' || term || '"') AS g
  FROM query_terms GROUP BY query_id, alt, group_id),
rendered AS (
  SELECT query_id, alt, string_agg('(' || g || ')', ' and ' ORDER BY group_id) AS query_text
  FROM rgroup GROUP BY query_id, alt)"""


def _materialized(cte: str) -> str:
    """Have every statement of a list of CTEs computed once (``name AS (`` at a line's start)."""
    return re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", cte.strip("\n"))


def _loop_round(r: int) -> list[str]:
    """One round of the loop: reads act{r}, t{r} and the rounds before; leaves pas{r}, out{r}, act{r + 1}, t{r + 1}."""
    so_far = " UNION ALL ".join(f"SELECT query_id, pmc_id FROM c{k}" for k in range(r + 1))
    rows = " UNION ALL ".join(f"SELECT query_id, keywords, search_score FROM pas{k}" for k in range(r + 1))
    return [
        match_cte(f"m{r}", f"SELECT query_id, group_id, term FROM t{r}"), topk_cte(f"c{r}", f"m{r}"), f"""
ok{r} AS (SELECT DISTINCT c.query_id FROM c{r} c JOIN papers_s ps USING (pmc_id) WHERE ps.abstract <> ''),
idx{r} AS (SELECT DISTINCT query_id, pmc_id FROM ({so_far}) WHERE query_id IN (SELECT query_id FROM ok{r}))""",
        own_hits_cte(f"h{r}", f"idx{r}"), f"""
sl{r} AS (
  SELECT c.query_id, c.pmc_id, ps.keywords, h.hit_rank, coalesce(h.search_score, CAST(0 AS FLOAT)) AS search_score
  FROM c{r} c JOIN papers_s ps USING (pmc_id)
  LEFT JOIN h{r} h ON h.query_id = c.query_id AND h.pmc_id = c.pmc_id
  WHERE c.query_id IN (SELECT query_id FROM ok{r})),
pas{r} AS (
  SELECT s.* FROM sl{r} s JOIN params p USING (query_id)
  WHERE s.hit_rank IS NOT NULL AND s.search_score > p.threshold),
acc{r} AS ({rows}),
cnt{r} AS (
  SELECT o.query_id, count(a.query_id) AS n_results FROM ok{r} o LEFT JOIN acc{r} a USING (query_id) GROUP BY o.query_id),
src{r} AS (
  SELECT a.query_id, a.keywords, a.search_score FROM acc{r} a
  JOIN cnt{r} c USING (query_id) JOIN params p USING (query_id) WHERE p.amount > c.n_results AND c.n_results > 0
  UNION ALL
  SELECT s.query_id, s.keywords, s.search_score FROM sl{r} s
  JOIN cnt{r} c USING (query_id) JOIN params p USING (query_id) WHERE p.amount > c.n_results AND c.n_results = 0),
kw{r} AS (
  SELECT query_id, keyword, sum(CAST(search_score AS DOUBLE)) AS weight
  FROM (SELECT query_id, search_score, unnest(keywords) AS keyword FROM src{r}) GROUP BY query_id, keyword),
fb{r} AS (
  SELECT query_id, string_agg(keyword, ' ' ORDER BY kw_rank) AS next_query FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, keyword) AS kw_rank FROM kw{r})
  WHERE kw_rank <= {TOP_KEYWORDS} GROUP BY query_id),
out{r} AS (
  SELECT c.query_id, CASE WHEN p.amount <= c.n_results THEN 'enough' WHEN f.next_query IS NOT NULL THEN 'feedback'
           ELSE 'no_keywords' END AS status,
         CASE WHEN p.amount > c.n_results THEN f.next_query END AS next_query, a.next_alt,
         CAST(c.n_results AS BIGINT) AS n_results
  FROM cnt{r} c JOIN params p USING (query_id) JOIN act{r} a USING (query_id) LEFT JOIN fb{r} f USING (query_id)
  UNION ALL
  SELECT a.query_id, CASE WHEN r.query_id IS NOT NULL THEN 'requery' ELSE 'exhausted' END, NULL, a.next_alt, CAST(0 AS BIGINT)
  FROM act{r} a LEFT JOIN rendered r ON r.query_id = a.query_id AND r.alt = a.next_alt
  WHERE a.query_id NOT IN (SELECT query_id FROM ok{r})),
act{r + 1} AS (
  SELECT o.query_id, CASE WHEN o.status = 'requery' THEN o.next_alt + 1 ELSE o.next_alt END AS next_alt,
         CASE WHEN o.status = 'feedback' THEN o.next_query ELSE coalesce(r.query_text, '') END AS query_text,
         o.status AS kind
  FROM out{r} o LEFT JOIN rendered r ON r.query_id = o.query_id AND r.alt = o.next_alt
  WHERE o.status IN ('feedback', 'requery')),
t{r + 1} AS (
  SELECT query_id, CAST(list_position(tk, t) - 1 AS INTEGER) AS group_id, t AS term
  FROM (SELECT query_id, tk, unnest(list_distinct(tk)) AS t
        FROM (SELECT query_id, {tok('query_text')} AS tk FROM act{r + 1} WHERE kind = 'feedback'))
  UNION ALL
  SELECT q.query_id, q.group_id, q.term FROM query_terms q
  JOIN act{r + 1} a ON a.query_id = q.query_id AND a.next_alt = q.alt + 1 WHERE a.kind = 'requery')"""]


def _loop(rounds: int = MAX_REFINEMENTS + 1) -> str:
    """The whole loop, unrolled."""
    start = """
act0 AS (
  SELECT p.query_id, 1 AS next_alt, coalesce(r.query_text, '') AS query_text, 'initial' AS kind
  FROM params p LEFT JOIN rendered r ON r.query_id = p.query_id AND r.alt = 0),
t0 AS (SELECT query_id, group_id, term FROM query_terms WHERE alt = 0)"""
    parts = [PAPERS, QUERIES, LEXICAL, _rendered(), start]
    for r in range(rounds):
        parts += _loop_round(r)
    found = " UNION ALL ".join(f"SELECT {r} AS round, * FROM pas{r}" for r in range(rounds))
    asked = " UNION ALL ".join(f"SELECT {r} AS round, * FROM act{r}" for r in range(rounds))
    ended = " UNION ALL ".join(f"SELECT {r} AS round, * FROM out{r}" for r in range(rounds))
    parts.append(f"""
found AS ({found}),
asked AS ({asked}),
ended AS ({ended})""")
    return "WITH " + ",\n".join(_materialized(p) for p in parts)


def sql_search_rounds() -> str:
    return _loop() + """
SELECT query_id, round, CAST(hit_rank AS INTEGER) AS hit_rank, pmc_id, search_score FROM found"""


def sql_search_iterative() -> str:
    return _loop() + """,
n AS (SELECT query_id, count(*) AS n_found FROM found GROUP BY query_id),
ranked AS (
  SELECT f.*, p.amount, n.n_found, row_number() OVER (PARTITION BY f.query_id ORDER BY
    CASE WHEN p.amount > n.n_found THEN CAST(0 AS DOUBLE) ELSE -CAST(f.search_score AS DOUBLE) END,
    f.round, f.hit_rank, f.pmc_id) AS rk
  FROM found f JOIN params p USING (query_id) JOIN n USING (query_id))
SELECT query_id, CAST(rk AS INTEGER) AS rk, pmc_id, search_score,
       CAST(least(amount, n_found) AS INTEGER) AS paper_count, round, CAST(hit_rank AS INTEGER) AS hit_rank
FROM ranked WHERE amount > n_found OR rk <= amount"""


def sql_result_document() -> str:
    """The JSON text of every question's result, field by field."""
    strings = ["article_title", "abstract", "keywords", "doi", "pmc_id", "pm_id", "author", "url", "pub_year"]
    listed = ("CASE WHEN len(p.keywords) = 0 THEN 'null' ELSE '[' || array_to_string(list_transform(p.keywords, "
              "lambda k: CAST(to_json(k) AS VARCHAR)), ',') || ']' END")
    fields = " || ".join(f"',\"{c}\":' || " + (listed if c == "keywords" else f"CAST(to_json(p.{c}) AS VARCHAR)")
                         for c in strings)
    escaped = "doc"
    for char, code in (("'&'", "\\u0026"), ("'<'", "\\u003c"), ("'>'", "\\u003e"), ("chr(8232)", "\\u2028"),
                       ("chr(8233)", "\\u2029")):
        escaped = f"replace({escaped}, {char}, '{code}')"
    ranked = sql_search_iterative().rsplit("\nSELECT query_id, CAST(rk", 1)[0]
    return ranked + f""",
shown AS (
  SELECT r.query_id, least(r.amount, r.n_found) AS paper_count, r.rk,
         '{{"search_score":' || CAST(r.search_score AS VARCHAR) || {fields} || '}}' AS paper
  FROM ranked r JOIN papers p USING (pmc_id) WHERE r.amount > r.n_found OR r.rk <= r.amount),
lists AS (
  SELECT query_id, '[' || string_agg(paper, ',' ORDER BY rk) || ']' AS papers, max(paper_count) AS paper_count
  FROM shown GROUP BY query_id),
tried AS (
  SELECT query_id, '[' || string_agg(CAST(to_json(query_text) AS VARCHAR), ',' ORDER BY round) || ']' AS strings
  FROM asked GROUP BY query_id),
documents_json AS (
  SELECT q.query_id, '{{"ts":1700000000000,"data":{{"resq":{{"query":' || CAST(to_json(q.user_query) AS VARCHAR)
    || ',"papers":' || coalesce(l.papers, 'null') || ',"keywords":' || coalesce(t.strings, 'null')
    || ',"threshold":' || CAST(q.threshold AS VARCHAR) || ',"paper_count":'
    || CAST(coalesce(l.paper_count, 0) AS VARCHAR) || '}}}}}}' AS doc
  FROM params q LEFT JOIN lists l USING (query_id) LEFT JOIN tried t USING (query_id))
SELECT query_id, {escaped} AS document FROM documents_json"""


def sql_query_log() -> str:
    return _loop() + "\nSELECT query_id, round, query_text, kind FROM asked"


def sql_requery_alternatives() -> str:
    return _loop() + "\nSELECT query_id, round, query_text FROM asked WHERE kind = 'requery'"


def sql_search_ends() -> str:
    return _loop() + """
SELECT query_id, round, n_results,
       CASE WHEN status IN ('feedback', 'requery') THEN 'bound' ELSE status END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round DESC) AS nth FROM ended) WHERE nth = 1"""


def sql_search_repeated_ids() -> str:
    """BM25 candidates by paper; per question and (shared) id the last one by
    rank stands; ties in BM25 go by the shared id and the pm id."""
    return with_(PAPERS, QUERIES, LEXICAL,
                 match_cte("m2", "SELECT query_id, group_id, term FROM query_terms WHERE alt = 2", "any"), f"""
shared AS (
  SELECT pmc_id, pm_id, CASE WHEN doc_id % 5 = 0 THEN ''
    WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'PMC' ELSE '' END || CAST(doc_id - 2 AS VARCHAR)
    ELSE pmc_id END AS shared_id FROM papers),
c2 AS (
  SELECT query_id, pmc_id, shared_id, pm_id, rk FROM (
    SELECT m.query_id, m.pmc_id, s.shared_id, s.pm_id, pr.amount,
           row_number() OVER (PARTITION BY m.query_id ORDER BY m.bm25 DESC, s.shared_id, s.pm_id) AS rk
    FROM m2 m JOIN params pr USING (query_id) JOIN shared s ON s.pmc_id = m.pmc_id)
  WHERE rk <= {CANDIDATE_FACTOR} * amount),
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shared_id ORDER BY rk DESC) AS nth FROM c2)
  WHERE nth = 1)""", own_hits_cte("h2", "last")) + """
SELECT query_id, shared_id AS pmc_id, pm_id, CAST(hit_rank AS INTEGER) AS hit_rank, search_score FROM (
  SELECT l.query_id, l.shared_id, l.pm_id, CAST(sc.score AS FLOAT) AS search_score, p.threshold,
         row_number() OVER (PARTITION BY l.query_id ORDER BY sc.score DESC, l.shared_id) AS hit_rank
  FROM h2_sc sc JOIN last l ON l.query_id = sc.query_id AND l.pmc_id = sc.pmc_id
  JOIN params p ON p.query_id = l.query_id)
WHERE hit_rank <= """ + str(INDEX_HITS) + " AND search_score > threshold"


def sql_index_rows() -> str:
    return with_(*ROUND0[:5]) + f"""
SELECT c.query_id, ps.pmc_id AS object_id, '[' || pr.user_query || '] - ' || ps.abstract AS data,
       '' AS properties, 'plain-text' AS category, CAST(ps.n_tokens AS INTEGER) AS n_tokens
FROM c2 c JOIN papers_s ps USING (pmc_id) JOIN params pr ON pr.query_id = c.query_id
WHERE ps.abstract <> '' AND ps.n_tokens <= {MAX_INDEX_TOKENS}"""


def sql_index_upsert() -> str:
    return with_(PAPERS, QUERIES, f"""
nq AS (SELECT count(*) AS n FROM bench),
log AS (
  SELECT p.pmc_id AS object_id, '[' || q.user_query || '] - ' || p.abstract AS data, 1 AS version
  FROM papers p CROSS JOIN nq JOIN queries q ON q.query_id = CAST(p.doc_id % nq.n AS VARCHAR)
  WHERE p.abstract <> '' AND p.n_tokens <= {MAX_INDEX_TOKENS}
  UNION ALL
  SELECT p.pmc_id, '[' || q.user_query || '] - ' || p.abstract, 2
  FROM papers p CROSS JOIN nq JOIN queries q ON q.query_id = CAST((p.doc_id + 1) % nq.n AS VARCHAR)
  WHERE p.abstract <> '' AND p.n_tokens <= {MAX_INDEX_TOKENS} AND p.doc_id % 2 = 0)""") + """
SELECT object_id, arg_max(data, version) AS data, max(version) AS version FROM log GROUP BY object_id"""


def sql_abstract_text() -> str:
    return f"""
SELECT doc_id, {trim_ws("array_to_string(string_split(text, chr(10)), chr(10))")} AS abstract
FROM documents"""


def sql_paper_author() -> str:
    return """
SELECT doc_id, source || ' ' || CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS author
FROM documents"""


def sql_paper_ids() -> str:
    return f"""
WITH ids AS (
  SELECT doc_id,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE '{FX.DOI_PREFIX}' || CAST(doc_id AS VARCHAR) END AS doi0,
    CASE WHEN doc_id % 2 = 0 THEN 'PMC' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END
      AS pmc0,
    CAST(doc_id + {FX.PM_ID_OFFSET} AS VARCHAR) AS pm0
  FROM documents)
SELECT doc_id,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE doi0 END AS doi,
  CASE WHEN doc_id % 5 = 0 THEN pmc0 || '-v2' ELSE pmc0 END AS pmc_id,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE pm0 END AS pm_id
FROM ids"""


def sql_paper_url() -> str:
    return with_(PAPERS) + "SELECT doc_id, pmc_id, url FROM papers"


def sql_default_params() -> str:
    return with_(QUERIES) + "SELECT query_id, amount, threshold FROM params"


def sql_requests_json() -> str:
    return with_(QUERIES) + """
SELECT query_id, user_query, remote_addr, amount, threshold FROM queries"""


def sql_requests_without_id() -> str:
    return with_(QUERIES) + """
SELECT user_query, amount, threshold, count(*) AS n_requests, count(*) AS n_ids FROM queries
GROUP BY user_query, amount, threshold"""


def sql_get_requests() -> str:
    return with_(QUERIES) + f"""
SELECT query_id, user_query, remote_addr, CAST({DEFAULT_AMOUNT} AS INTEGER) AS amount,
       CAST({DEFAULT_THRESHOLD} AS FLOAT) AS threshold FROM queries"""


def sql_validate_requests() -> str:
    return with_(QUERIES, f"""
conv AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id,
    CASE WHEN conv_id % 11 = 0 THEN NULL
         WHEN conv_id % 13 = 0 THEN ''
         ELSE array_to_string({tok('text')}, ' ') END AS user_query,
    CAST(conv_id % 6 - 1 AS INTEGER) AS amount
  FROM conversations WHERE role = 'user'),
req AS (SELECT query_id, user_query, amount FROM queries UNION ALL SELECT * FROM conv)""") + """
SELECT query_id,
  CASE WHEN user_query IS NULL OR length(user_query) < 1 OR coalesce(amount, 0) < 0
       THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN user_query IS NULL THEN 'query is required'
       WHEN length(user_query) < 1 THEN 'query is empty'
       WHEN coalesce(amount, 0) < 0 THEN 'amount is negative' ELSE '' END AS reason
FROM req"""


def sql_xml_papers() -> str:
    cols = PAPER_COLS.replace("author,", f"CASE WHEN doc_id % 11 = 0 THEN split_part(author, ' ', 1) || "
                                          f"' {FX.DECOY_GIVEN}' ELSE author END AS author,")
    return with_(PAPERS) + f"SELECT CAST(0 AS FLOAT) AS search_score, {cols} FROM papers"


def sql_xml_rejects() -> str:
    return with_(PAPERS) + """
SELECT pmc_id, CASE WHEN doc_id % 26 = 0 THEN 'undefined_entity' ELSE 'mismatched_tag' END AS error
FROM papers WHERE doc_id % 13 = 0"""


def sql_stream_xml_papers() -> str:
    return sql_xml_papers() + " WHERE NOT (doc_id % 13 = 0 AND doc_id % 26 <> 0)"


def sql_xml_outcomes() -> str:
    return with_(PAPERS) + """
SELECT pmc_id,
  CASE WHEN doc_id % 13 <> 0 THEN 'accepted' WHEN doc_id % 26 = 0 THEN 'recovered' ELSE 'rejected' END AS outcome,
  CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS attempts,
  CASE WHEN doc_id % 26 = 0 THEN 'undefined_entity' WHEN doc_id % 13 = 0 THEN 'mismatched_tag' END AS error
FROM papers"""


def sql_conversation_assign() -> str:
    return """
SELECT event_id, user_id AS addr,
  first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS conversation_id
FROM events"""


def oracle_sql() -> dict[str, str]:
    return {
        "candidates_topk": sql_candidates_topk(),
        "candidates_boolean": sql_candidates_boolean(),
        "boolean_strings": sql_boolean_strings(),
        "similarity_tf": sql_similarity_tf(),
        "similarity_embedding": sql_similarity_embedding(),
        "threshold_hits": sql_threshold_hits(),
        "score_papers": sql_score_papers(),
        "score_papers_bm25": sql_score_papers_bm25(),
        "candidates_after_upserts": sql_candidates_topk(),
        "score_papers_left": sql_score_papers_left(),
        "rank_results": sql_rank_results(),
        "all_abstracts_empty": sql_all_abstracts_empty(),
        "keyword_weights": sql_keyword_weights(),
        "keyword_top3": sql_keyword_top3(),
        "feedback_query": sql_feedback_query(),
        "stop_condition": sql_stop_condition(),
        "search_one_round": sql_search_one_round(),
        "search_two_rounds": sql_search_two_rounds(),
        "search_rounds": sql_search_rounds(),
        "search_iterative": sql_search_iterative(),
        "query_log": sql_query_log(),
        "requery_alternatives": sql_requery_alternatives(),
        "search_ends": sql_search_ends(),
        "result_document": sql_result_document(),
        "stream_search": sql_search_iterative(),
        "search_repeated_ids": sql_search_repeated_ids(),
        "index_rows": sql_index_rows(),
        "index_upsert": sql_index_upsert(),
        "abstract_text": sql_abstract_text(),
        "paper_author": sql_paper_author(),
        "paper_ids": sql_paper_ids(),
        "paper_url": sql_paper_url(),
        "default_params": sql_default_params(),
        "requests_json": sql_requests_json(),
        "requests_without_id": sql_requests_without_id(),
        "get_requests": sql_get_requests(),
        "validate_requests": sql_validate_requests(),
        "xml_papers": sql_xml_papers(),
        "xml_rejects": sql_xml_rejects(),
        "stream_xml_papers": sql_stream_xml_papers(),
        "xml_outcomes": sql_xml_outcomes(),
        "conversation_assign": sql_conversation_assign(),
        "stream_conversation": sql_conversation_assign(),
        "stream_index_upsert": sql_index_upsert(),
    }
