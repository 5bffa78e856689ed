"""Schemas and fixed values of the search pipeline.

All identifiers are strings and absence is ``""`` / ``[]``, scores and
thresholds are 32-bit floats.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values that define the behaviour (must stay as they are) -------
DEFAULT_AMOUNT = 3            # amount 0 or absent -> 3
DEFAULT_THRESHOLD = 0.3       # threshold 0 or absent -> 0.3 (float32)
CANDIDATE_FACTOR = 2          # candidates fetched per round = 2 * amount
INDEX_HITS = 20               # similarity hits per round
TOP_KEYWORDS = 3              # feedback keywords per round
MAX_REFINEMENTS = 11          # refinements after the first round (12 rounds)
MAX_INDEX_TOKENS = 3500       # longer abstracts are not indexed
URL_PREFIX = "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"
INDEX_CATEGORY = "plain-text"
ID_TYPE_DOI = "doi"
ID_TYPE_PMC = "pmc"
ID_TYPE_PMID = "pmid"
# --------------------------------------------------------------------------

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
WHITESPACE_CLASS = r"[\s\x{0B}\x{85}\p{Z}]+"

PAPER_FIELDS = [
    T.StructField("search_score", T.FloatType(), False),
    T.StructField("article_title", T.StringType(), False),
    T.StructField("abstract", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType(), False), False),
    T.StructField("doi", T.StringType(), False),
    T.StructField("pmc_id", T.StringType(), False),
    T.StructField("pm_id", T.StringType(), False),
    T.StructField("author", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("pub_year", T.StringType(), False),
]
PAPER = T.StructType(PAPER_FIELDS)

# Paper columns without the score: the corpus table.
PAPER_COLUMNS = [f.name for f in PAPER_FIELDS if f.name != "search_score"]

QUERY = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("user_query", T.StringType(), True),
    T.StructField("remote_addr", T.StringType(), True),
    T.StructField("amount", T.IntegerType(), True),
    T.StructField("threshold", T.FloatType(), True),
])

# JSON body of a search request (POST form); GET carries only the query.
REQUEST_BODY = T.StructType([
    T.StructField("query_id", T.StringType(), True),
    T.StructField("query", T.StringType(), True),
    T.StructField("amount", T.IntegerType(), True),
    T.StructField("threshold", T.FloatType(), True),
    T.StructField("remote_addr", T.StringType(), True),
])

QUERY_TERMS = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("alt", T.IntegerType(), False),
    T.StructField("group_id", T.IntegerType(), False),
    T.StructField("term", T.StringType(), False),
])

ARTICLE_ID = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
])
