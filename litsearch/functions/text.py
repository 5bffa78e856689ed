"""Column expressions on text. All of them stay inside the JVM (codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsearch.schemas import TOKEN_PATTERN, WHITESPACE_CLASS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), 0)


def token_count(text) -> Column:
    """Token count used for the index length limit."""
    return F.size(tokens(text))


def trim_ws(text) -> Column:
    """Unicode-aware trim (P4): strips white space of every kind at both ends.

    ``trim`` only removes ASCII spaces; the class below also covers tabs,
    line breaks, U+0085, U+00A0 and the other separators.
    """
    head = F.regexp_replace(_col(text), "^" + WHITESPACE_CLASS, "")
    return F.regexp_replace(head, WHITESPACE_CLASS + r"\z", "")


def join_paragraphs(paragraphs) -> Column:
    """Abstract paragraphs joined by a newline."""
    return F.array_join(F.coalesce(_col(paragraphs), F.array().cast("array<string>")), "\n")


def abstract_text(paragraphs) -> Column:
    """P3 + P4: joined paragraphs, then trimmed."""
    return trim_ws(join_paragraphs(paragraphs))
