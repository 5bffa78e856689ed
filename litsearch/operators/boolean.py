"""Search strings as text (S1b): quoted terms, ``and``, ``or``, parentheses, nested to any depth.

A string becomes its leaves (terms) and a postfix list over them; both are columns,
and everything after the reader is DataFrame operations:

* Operators have equal rank and are read from left to right; terms without an operator
  between them are joined by ``and``. Case does not matter. Quotes keep several words
  together: such a term is in a paper that has all of its words.
* Candidates of a question are the papers of a cover: a term for each leaf that no match
  can do without, the rarest word of it. Of ``and`` the cheaper side is taken, of
  ``or`` both, by the number of papers of the words.
* Only for these papers the other words are looked up, and the postfix list is
  evaluated on the leaves that a paper has.

A string that cannot be read has a ``reason`` and no matches: nothing in it, an
unterminated quote, an unbalanced parenthesis, an operator without operand, a
term without letters or digits. Null reads as an empty string.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.functions.text import tokens
from litsearch.operators.lexical import (SCORE_DIGITS, LexicalIndex, contribution, join_postings, of_terms,
                                         searchable_postings)
from litsearch.session import few, materialize

PARSED = "postfix array<int>, leaves array<string>, reason string"
AND, OR = -1, -2
PIECE = re.compile(r'\s*(?:(?P<mark>[()])|"(?P<quoted>[^"]*)(?P<end>"?)|(?P<word>[^\s()"]+))')


class Unreadable(ValueError):
    """Why a search string cannot be read."""


def postfix_of(text: str) -> tuple[list[int], list[str]]:
    """The postfix list (leaf numbers, ``AND``, ``OR``) and the leaves of a search string."""
    out: list[int] = []
    leaves: list[str] = []
    open_parts: list[list] = [[False, None]]  # per open parenthesis: whether it has a left side, the operator that waits

    def operand_ends() -> None:
        part = open_parts[-1]
        if part[0]:
            out.append(AND if part[1] is None else part[1])
        part[0], part[1] = True, None

    at, text = 0, text.rstrip()
    while at < len(text):
        piece = PIECE.match(text, at)
        at = piece.end()
        word = (piece["word"] or "").lower()
        if piece["mark"] == "(":
            open_parts.append([False, None])
        elif piece["mark"] == ")":
            has_left, waiting = open_parts.pop()
            if not open_parts:
                raise Unreadable("unbalanced parenthesis")
            if not has_left or waiting is not None:
                raise Unreadable("operator without operand")
            operand_ends()
        elif word in ("and", "or"):
            if not open_parts[-1][0] or open_parts[-1][1] is not None:
                raise Unreadable("operator without operand")
            open_parts[-1][1] = AND if word == "and" else OR
        else:
            if piece["quoted"] is not None and not piece["end"]:
                raise Unreadable("unterminated quote")
            out.append(len(leaves))
            leaves.append(piece["quoted"] if piece["quoted"] is not None else piece["word"])
            operand_ends()
    if len(open_parts) > 1:
        raise Unreadable("unbalanced parenthesis")
    if open_parts[0][1] is not None:
        raise Unreadable("operator without operand")
    if not leaves:
        raise Unreadable("empty")
    return out, leaves


def read_strings(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            rows.append((*postfix_of(text or ""), None))
        except Unreadable as why:
            rows.append(([], [], str(why)))
    return pd.DataFrame(rows, columns=["postfix", "leaves", "reason"])


def parsed_strings(strings: DataFrame, text_col: str = "search_string") -> DataFrame:
    """``strings`` with ``postfix``, ``leaves`` and ``reason`` (null if the string can be read)."""
    rows = strings.withColumn("_read", F.pandas_udf(read_strings, PARSED)(text_col)).select("*", "_read.*").drop("_read")
    wordless = F.exists("leaves", lambda leaf: F.size(tokens(leaf)) == 0)
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & wordless, "term without letters or digits")
                           .otherwise(F.col("reason")))


def _evaluated(postfix, value, kind: str, both, either):
    """The value of a postfix list: ``value`` of a leaf number, ``both``/``either`` of two values."""
    def step(stack, op):
        def joined():
            return F.when(op == AND, both(stack[1], stack[0])).otherwise(either(stack[1], stack[0]))
        rest = F.slice(stack, F.lit(3), F.greatest(F.size(stack) - 2, F.lit(0)))
        return F.when(op >= 0, F.concat(F.array(value(op)), stack)).otherwise(F.concat(F.array(joined()), rest))
    return F.aggregate(postfix, F.array().cast(f"array<{kind}>"), step)[0]


def cover(postfix, costs):
    """The leaves of which every match has one at least, at the least total of ``costs`` (array by leaf)."""
    kind = "struct<cost:bigint,of:array<int>>"
    return _evaluated(
        postfix, lambda leaf: F.struct(F.get(costs, leaf).alias("cost"), F.array(leaf).alias("of")), kind,
        lambda a, b: F.when(a["cost"] <= b["cost"], a).otherwise(b),
        lambda a, b: F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["of"], b["of"]).alias("of")))["of"]


def holds(postfix, present):
    """Whether an expression holds for a paper that has the leaves of ``present`` (array of numbers)."""
    return _evaluated(postfix, lambda leaf: F.array_contains(present, leaf), "boolean",
                      lambda a, b: a & b, lambda a, b: a | b)


def match_strings(parsed: DataFrame, index: LexicalIndex) -> DataFrame:
    """query_id, pmc_id, bm25 (over the string's distinct words) of the papers that match, for readable strings."""
    parsed = materialize(parsed.where("reason is null").select("query_id", "postfix", "leaves"), "search-strings")
    leaf = parsed.select("query_id", F.posexplode("leaves").alias("leaf", "text"))
    words = (leaf.select("query_id", "leaf", F.array_distinct(tokens("text")).alias("of"))
             .select("query_id", "leaf", F.size("of").alias("n_words"), F.explode("of").alias("term"))
             .join(index.terms.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("long")))
    words, _ = few(words, "search-words")
    rarest = words.groupBy("query_id", "leaf").agg(F.min(F.struct("df", "term")).alias("rarest"))
    per_string = rarest.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("leaf", "rarest"))).alias("of"))
    costs = F.transform("of", lambda x: x["rarest"]["df"])
    first = parsed.join(per_string, "query_id").select(
        "query_id", F.explode(F.transform(cover(F.col("postfix"), costs), lambda i: F.get("of", i)["rarest"])).alias("r"))
    first, _ = few(first.where("r.df > 0").select("query_id", F.col("r.term").alias("term")).distinct(), "cover-words")
    postings = searchable_postings(index)
    papers = join_postings(first, postings, index.term_buckets).select("query_id", "pmc_id").distinct()
    papers, small = few(papers, "cover-papers")
    scored = words.groupBy("query_id", "term").agg(F.min("leaf").alias("scored"))
    wanted, _ = few(words.where("df > 0").join(scored, ["query_id", "term"]), "wanted-words")
    postings = of_terms(postings, wanted, index.term_buckets, papers if small else None)
    found = join_postings(papers.join(wanted, "query_id"), postings, index.term_buckets, keys=("term", "pmc_id"))
    per_leaf = found.groupBy("query_id", "pmc_id", "leaf").agg(
        (F.count("*") == F.max("n_words")).alias("whole"),
        F.sum(F.when(F.col("scored") == F.col("leaf"), contribution(index)).otherwise(F.lit(0.0))).alias("part"))
    per_paper = per_leaf.groupBy("query_id", "pmc_id").agg(
        F.collect_set(F.when(F.col("whole"), F.col("leaf"))).alias("present"), F.sum("part").alias("bm25"))
    return (per_paper.join(parsed.select("query_id", "postfix"), "query_id")
            .where(holds(F.col("postfix"), F.col("present")))
            .select("query_id", "pmc_id", F.round("bm25", SCORE_DIGITS).alias("bm25")))
