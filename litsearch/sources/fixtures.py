"""Inputs derived from the driver's tables (documents, benchmark, ...).

These are the deterministic rules that turn the given parquet tables into
the pipeline's own tables: ``papers`` (the corpus), ``queries`` (one row per
question) and ``query_terms`` (the boolean search strings that stand in for
the remote language model). Every rule is a column expression, so the work
scales with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.functions.paper import paper_url
from litsearch.functions.text import tokens, trim_ws
from litsearch.schemas import PAPER_COLUMNS

# --- fixed values of the fixture rules ------------------------------------
KEYWORD_MIN_LEN = 10        # keywords = all distinct tokens of at least 10 characters, sorted
EXTRA_EVERY = 10            # every 10th document also gives a paper without an abstract ...
EXTRA_OFFSET = 1000000000   # ... with this much added to its id
PM_ID_OFFSET = 30000000
DOI_PREFIX = "10.1000/"
FIRST_YEAR = 1990
YEAR_SPAN = 35
ALT1_MIN_LEN = 8            # alternative 1 parts the tokens: of at least 8 characters, and others
# --------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_extra_papers(documents: DataFrame) -> DataFrame:
    """The documents and, of every 10th, one more row (``extra``) that becomes a paper without abstract."""
    d = documents.select("doc_id", "text", "lang", "source")
    extras = F.when(F.col("doc_id") % EXTRA_EVERY == 0, F.array(F.lit(False), F.lit(True))) \
        .otherwise(F.array(F.lit(False)))
    return d.select("doc_id", "text", "lang", "source", F.explode(extras).alias("extra")).withColumn(
        "doc_id", F.col("doc_id") + F.when(F.col("extra"), F.lit(EXTRA_OFFSET)).otherwise(F.lit(0)))


def title_of(text: str):
    """The tokens of the first line."""
    return F.array_join(tokens(F.split(text, "\n", -1)[0]), " ")


def keywords_of(text: str):
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= KEYWORD_MIN_LEN)))


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """Corpus rows in the ``Paper`` layout (without score)."""
    d = with_extra_papers(documents)
    doc_id = F.col("doc_id")
    pmc_id = F.when(doc_id % 2 == 0, F.concat(F.lit("PMC"), doc_id.cast("string"))) \
        .otherwise(doc_id.cast("string"))
    out = d.select(
        title_of("text").alias("article_title"),
        F.when(F.col("extra"), F.lit("")).otherwise(trim_ws("text")).alias("abstract"),
        F.when(doc_id % 9 == 0, F.array().cast("array<string>"))
         .otherwise(keywords_of("text")).alias("keywords"),
        F.when(doc_id % 7 == 0, F.lit(""))
         .otherwise(F.concat(F.lit(DOI_PREFIX), doc_id.cast("string"))).alias("doi"),
        pmc_id.alias("pmc_id"),
        (doc_id + PM_ID_OFFSET).cast("string").alias("pm_id"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("author"),
        F.lit("").alias("url"),
        (F.lit(FIRST_YEAR) + doc_id % YEAR_SPAN).cast("string").alias("pub_year"),
    )
    return out.withColumn("url", paper_url("pmc_id")).select(*PAPER_COLUMNS)


def queries_from_benchmark(benchmark: DataFrame) -> DataFrame:
    """One question per benchmark item (schema ``QUERY``)."""
    item = F.col("item_id")
    return benchmark.select(
        item.cast("string").alias("query_id"),
        F.array_join(tokens("text"), " ").alias("user_query"),
        F.concat(F.lit("10.0.0."), (item % 5).cast("string"), F.lit(":5000")).alias("remote_addr"),
        (item % 7).cast("int").alias("amount"),
        F.when(item % 4 == 0, F.lit(0.0)).otherwise(F.lit(0.6)).cast("float").alias("threshold"),
    )


def query_terms_from_queries(queries: DataFrame) -> DataFrame:
    """Boolean search strings per question: alt 0, 1, 2 (schema ``QUERY_TERMS``).

    alt 0: every distinct token of the question is its own AND group;
    alt 1: two OR groups, the long tokens (group 0) and the others (group 1);
    alt 2: one OR group with all distinct tokens.
    ``group_id`` is the position of a token's first occurrence (0-based),
    so it does not depend on the order ``array_distinct`` returns.
    """
    q = queries.select("query_id", tokens("user_query").alias("toks"))
    alt0 = q.select("query_id", F.lit(0).alias("alt"), "toks",
                    F.explode(F.array_distinct("toks")).alias("term"))
    per_token = alt0.select(
        "query_id", "alt", (F.array_position("toks", F.col("term")) - 1).cast("int").alias("group_id"),
        "term")
    alt1 = alt0.select("query_id", F.lit(1).alias("alt"),
                       F.when(F.length("term") >= ALT1_MIN_LEN, 0).otherwise(1).alias("group_id"), "term")
    alt2 = q.select("query_id", F.lit(2).alias("alt"), F.lit(0).alias("group_id"),
                    F.explode(F.array_distinct("toks")).alias("term"))
    return per_token.unionByName(alt1).unionByName(alt2).select(
        "query_id", F.col("alt").cast("int"), F.col("group_id").cast("int"), "term")


def search_strings_from_queries(queries: DataFrame) -> DataFrame:
    """A search string per question from its first four words a, b, c, d, in six forms by number modulo 6.

    The last two cannot be read: a parenthesis stays open, an operator has no right side.
    """
    word = [F.get(tokens("user_query"), F.lit(i)) for i in range(4)]
    a, b, c, d = word
    quoted = [F.concat(F.lit('"'), w, F.lit('"')) for w in word]
    form = F.col("query_id").cast("long") % 6

    def text(pattern: str):
        return F.format_string(pattern, *quoted)

    return queries.select("query_id", F.when(form == 0, text("(%1$s and %2$s) or (%3$s and %4$s)"))
                          .when(form == 1, text("%1$s AND (%2$s or (%3$s and %4$s))"))
                          .when(form == 2, F.format_string('%s %s or "%s %s"', a, b, c, d))
                          .when(form == 3, text("%1$s or %2$s and %3$s"))
                          .when(form == 4, text("(%1$s and (%2$s)"))
                          .otherwise(text("%1$s or")).alias("search_string"))


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three pipeline inputs derived from one scale-factor folder."""
    documents = read_table(spark, sf_dir, "documents")
    benchmark = read_table(spark, sf_dir, "benchmark")
    queries = queries_from_benchmark(benchmark)
    return {
        "papers": papers_from_documents(documents),
        "queries": queries,
        "query_terms": query_terms_from_queries(queries),
    }


# --- article XML built from documents (round trip of the XML reader) -------------
DECOY_SURNAME = "Decoy"
DECOY_GIVEN = "Ann"
DECOY_YEAR = "1900"


def articles_from_documents(documents: DataFrame, defects: bool | str = False) -> DataFrame:
    """One ``<article>`` per document carrying the ``papers`` fields.

    A decoy first contributor and pub-date exercise "last wins"; doc_id % 11
    = 0 has a last contributor without given names (they then come from the
    decoy); the extra papers keep their text in ``abstract/sec/p`` (not an
    abstract paragraph); doc_id % 9 = 0 has no keywords; doc_id % 7 = 0 no
    doi; every article has an id of an unknown type. With ``defects`` the
    articles with doc_id % 13 = 0 are broken: an undefined entity in the title
    (doc_id % 26 = 0) or a missing ``</front>``; with ``"front"`` only the latter.
    """
    from litsearch.sources.xml import element, optional, xml_escape

    d = F.col("doc_id")
    title = title_of("text")
    if defects is True:
        title = F.when(d % 26 == 0, F.concat(title, F.lit(" &nbsp;"))).otherwise(xml_escape(title))
    else:
        title = xml_escape(title)
    paras = F.array_join(F.transform(F.split("text", "\n", -1),
                                     lambda p: element("p", xml_escape(p))), "")
    abstract = F.when(F.col("extra"), element("abstract", element("sec", paras))) \
        .otherwise(element("abstract", paras))
    kwds = F.array_join(F.transform(keywords_of("text"), lambda k: element("kwd", xml_escape(k))), "")
    kwd_group = optional(d % 9 != 0, element("kwd-group", kwds))
    pmc = F.when(d % 2 == 0, F.concat(F.lit("PMC"), d.cast("string"))).otherwise(d.cast("string"))
    ids = F.concat(
        element("article-id", F.concat(F.lit("pub-"), d.cast("string")), ' pub-id-type="publisher-id"'),
        optional(d % 7 != 0, element("article-id", F.concat(F.lit(DOI_PREFIX), d.cast("string")),
                                     ' pub-id-type="doi"')),
        element("article-id", pmc, ' pub-id-type="pmc"'),
        element("article-id", (d + PM_ID_OFFSET).cast("string"), ' pub-id-type="pmid"'))
    decoy = element("contrib", element("name", F.concat(
        element("surname", F.lit(DECOY_SURNAME)), element("given-names", F.lit(DECOY_GIVEN)))))
    real = element("contrib", element("name", F.concat(
        element("surname", xml_escape(F.col("source"))),
        optional(d % 11 != 0, element("given-names", xml_escape(F.col("lang")))))))
    year = (F.lit(FIRST_YEAR) + d % YEAR_SPAN).cast("string")
    dates = F.concat(element("pub-date", element("year", F.lit(DECOY_YEAR))),
                     element("pub-date", element("year", year)))
    meta = element("article-meta", F.concat(
        ids, element("title-group", element("article-title", title)),
        element("contrib-group", F.concat(decoy, real)), dates, abstract, kwd_group))
    front_end = F.lit("</front>")
    if defects:
        front_end = F.when((d % 13 == 0) & (d % 26 != 0), F.lit("")).otherwise(front_end)
    article = F.concat(
        F.lit('<article article-type="research-article"><front>'),
        element("journal-meta", element("journal-id", F.lit("J"))), meta, front_end,
        F.lit("<body><sec><p>Full text is not part of the record.</p></sec></body></article>"))
    return with_extra_papers(documents).select(article.alias("article_xml"))
