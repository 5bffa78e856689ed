"""Column expressions that build paper fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsearch.schemas import (DEFAULT_AMOUNT, DEFAULT_THRESHOLD, URL_PREFIX)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def author(surname, given_names) -> Column:
    """Surname, one space, given names; the space is always there (P5)."""
    return F.concat(F.coalesce(_col(surname), F.lit("")), F.lit(" "),
                    F.coalesce(_col(given_names), F.lit("")))


def id_of_type(article_ids, id_type: str) -> Column:
    """Last article id of a type, ``""`` when there is none.

    ``try_element_at`` keeps the expression safe under ANSI mode for an empty
    filter result; a map would fail on repeated types.
    """
    matching = F.filter(_col(article_ids), lambda x: x["type"] == F.lit(id_type))
    last = F.try_element_at(matching, F.lit(-1))
    return F.coalesce(last["id"], F.lit(""))


def paper_url(pmc_id) -> Column:
    """Article URL; one leading ``PMC`` is removed from the id."""
    return F.concat(F.lit(URL_PREFIX), F.regexp_replace(_col(pmc_id), "^PMC", ""), F.lit("/"))


def index_text(question, abstract) -> Column:
    """Text stored in the index for a paper (P10)."""
    return F.concat(F.lit("["), _col(question), F.lit("] - "), _col(abstract))


def search_string(keywords) -> Column:
    """Next search string from the chosen keywords."""
    return F.array_join(_col(keywords), " ")


def effective_amount(amount) -> Column:
    """0 or absent -> the default result count."""
    a = F.coalesce(_col(amount).cast("int"), F.lit(0))
    return F.when(a == 0, F.lit(DEFAULT_AMOUNT)).otherwise(a).cast("int")


def effective_threshold(threshold) -> Column:
    """0 or absent -> the default threshold, as FLOAT."""
    t = F.coalesce(_col(threshold).cast("float"), F.lit(0.0).cast("float"))
    return F.when(t == F.lit(0.0).cast("float"),
                  F.lit(DEFAULT_THRESHOLD).cast("float")).otherwise(t).cast("float")
