"""Article XML ingest.

Reading: files holding any number of ``<article>`` elements (under any root)
are split by Spark's text reader on the record separator ``</article>``,
so large dumps are read in parallel splits; each record is cut to start at
its ``<article`` tag and closed again. ``</sub-article>`` does not end a
record. One Arrow function decodes the records with the standard
library's expat parser, ``SLICE`` at a time; everything after it is column expressions.

Decoding rules (those of a struct-tag XML decoder):
1. a scalar path matched several times keeps the last match, even if empty;
2. text is the element's own character data (text and tails of children);
   text inside inline markup is dropped;
3. list paths collect all matches in document order;
4. paths are exact: ``abstract/sec/p`` is not ``abstract/p``;
5. only the abstract is trimmed.
Namespaces are ignored (local names are matched). A record that does not
parse (truncated, undefined entity, ...) is returned with its error instead
of failing the job (S3).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsearch.functions.paper import author, id_of_type, paper_url
from litsearch.functions.text import abstract_text
from litsearch.schemas import ID_TYPE_DOI, ID_TYPE_PMC, ID_TYPE_PMID, PAPER_COLUMNS
from litsearch.session import materialize

RECORD_END = "</article>"
META = "front/article-meta/"
# --- fixed element paths of the article format ---------------------------------
PATH_TITLE = META + "title-group/article-title"
PATH_ABSTRACT_P = META + "abstract/p"
PATH_KWD = META + "kwd-group/kwd"
PATH_ARTICLE_ID = META + "article-id"
PATH_SURNAME = META + "contrib-group/contrib/name/surname"
PATH_GIVEN = META + "contrib-group/contrib/name/given-names"
PATH_YEAR = META + "pub-date/year"
# ----------------------------------------------------------------------------------

DECODED = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("article_title", T.StringType()),
    T.StructField("abstract_p", T.ArrayType(T.StringType())),
    T.StructField("kwd", T.ArrayType(T.StringType())),
    T.StructField("id_values", T.ArrayType(T.StringType())),
    T.StructField("id_types", T.ArrayType(T.StringType())),
    T.StructField("surname", T.StringType()),
    T.StructField("given_names", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("error_line", T.IntegerType()),
    T.StructField("error_column", T.IntegerType()),
])


SLICE = 128          # records that are decoded and handed on at once, so that a worker never holds a whole Arrow batch of them
UNBOUND_PREFIX = 27  # expat's code
PREFIX = re.compile(r"(?:</?|\s)([A-Za-z_][\w.-]*):[A-Za-z_]")
DECLARED = re.compile(r"xmlns:([A-Za-z_][\w.-]*)\s*=")


def _own_text(e: ET.Element) -> str:
    return (e.text or "") + "".join(c.tail or "" for c in e)


def _local_names(root: ET.Element) -> None:
    for el in root.iter():
        if isinstance(el.tag, str) and el.tag.startswith("{"):
            el.tag = el.tag.split("}", 1)[1]


def _last(root: ET.Element, path: str) -> str | None:
    found = root.findall(path)
    return _own_text(found[-1]) if found else None


def error_kind(message: str) -> str:
    m = message.lower()
    for needle, kind in (("undefined entity", "undefined_entity"),
                         ("mismatched tag", "mismatched_tag"),
                         ("no element found", "truncated"),
                         ("unclosed token", "truncated")):
        if needle in m:
            return kind
    return "malformed"


def _failed(kind: str, position: tuple = (None, None)) -> dict:
    row = {f.name: None for f in DECODED.fields}
    row.update(ok=False, error=kind, error_line=position[0], error_column=position[1])
    return row


def with_prefixes(record: str) -> str:
    """Declare the name-space prefixes that a record uses but its former root declared."""
    unknown = sorted(set(PREFIX.findall(record)) - {"xml", "xmlns"} - set(DECLARED.findall(record)))
    if not unknown:
        return record
    names = "".join(f' xmlns:{p}="{p}"' for p in unknown)
    return re.sub(r"^(\s*<[^\s/>]+)", lambda m: m[1] + names, record, count=1)


def decode_article(record: str) -> dict:
    """Decode one ``<article>`` element into the raw fields (rules above)."""
    try:
        try:
            root = ET.fromstring(record)
        except ET.ParseError as exc:
            if exc.code != UNBOUND_PREFIX:
                raise
            root = ET.fromstring(with_prefixes(record))
    except ET.ParseError as exc:
        return _failed(error_kind(str(exc)), exc.position)
    _local_names(root)
    ids = root.findall(PATH_ARTICLE_ID)
    return {
        "ok": True, "error": None,
        "article_title": _last(root, PATH_TITLE),
        "abstract_p": [_own_text(p) for p in root.findall(PATH_ABSTRACT_P)],
        "kwd": [_own_text(k) for k in root.findall(PATH_KWD)],
        "id_values": [_own_text(i) for i in ids],
        "id_types": [i.get("pub-id-type", "") for i in ids],
        "surname": _last(root, PATH_SURNAME),
        "given_names": _last(root, PATH_GIVEN),
        "year": _last(root, PATH_YEAR),
        "error_line": None, "error_column": None,
    }


def decoded_slices(batches, at: int):
    """Arrow batches with ``a`` and, only of records that do not decode, ``article_xml`` (column ``at``) behind the other columns."""
    import pyarrow as pa
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    kind = pa.struct([(f.name, kinds[f.dataType.simpleString()]) for f in DECODED.fields])
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            records = part.column(at).to_pylist()
            rows = [decode_article(r) if r is not None else _failed("malformed") for r in records]
            failed = pa.array([None if row["ok"] else r for r, row in zip(records, rows)], pa.string())
            names = [n for n in part.schema.names if n != part.schema.names[at]]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(rows, kind), failed],
                                             names=[*names, "a", "article_xml"])


def read_article_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<article>`` record of the files under ``path``."""
    raw = spark.read.option("lineSep", RECORD_END).text(path)
    start = F.regexp_extract("value", r"(?s)(<article[\s>].*)", 1)
    return (raw.select(start.alias("body"))
            .where(F.col("body") != "")
            .select(F.concat("body", F.lit(RECORD_END)).alias("article_xml")))


def decode(records: DataFrame) -> DataFrame:
    """Every record with the decoded struct ``a``; ``article_xml`` is kept where it does not decode, else null."""
    at = records.columns.index("article_xml")
    fields = [f for f in records.schema.fields if f.name != "article_xml"]
    schema = T.StructType([*fields, T.StructField("a", DECODED), T.StructField("article_xml", T.StringType())])
    return records.mapInArrow(lambda batches: decoded_slices(batches, at), schema)


def flatten(decoded: DataFrame, *more: str) -> DataFrame:
    """Decoded fields to the ``Paper`` layout (zero score), and the columns ``more``."""
    ids = F.arrays_zip(F.col("a.id_values").alias("id"), F.col("a.id_types").alias("type"))
    with_ids = decoded.withColumn("_ids", ids)
    out = with_ids.select(
        F.lit(0.0).cast("float").alias("search_score"),
        F.coalesce(F.col("a.article_title"), F.lit("")).alias("article_title"),
        abstract_text(F.col("a.abstract_p")).alias("abstract"),
        F.coalesce(F.col("a.kwd"), F.array().cast("array<string>")).alias("keywords"),
        id_of_type("_ids", ID_TYPE_DOI).alias("doi"),
        id_of_type("_ids", ID_TYPE_PMC).alias("pmc_id"),
        id_of_type("_ids", ID_TYPE_PMID).alias("pm_id"),
        author(F.col("a.surname"), F.col("a.given_names")).alias("author"),
        F.coalesce(F.col("a.year"), F.lit("")).alias("pub_year"), *more,
    )
    return out.withColumn("url", paper_url("pmc_id")).select("search_score", *PAPER_COLUMNS, *more)


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Papers and rejects from article files. The decoded records are stored, so both read one decode."""
    decoded = materialize(decode(read_article_records(spark, path)), "decoded")
    papers = flatten(decoded.where(F.col("a.ok")))
    rejects = decoded.where(~F.col("a.ok")).select(
        "article_xml", F.col("a.error").alias("error"))
    return papers, rejects


# --- writer (used for round-trip tests and fixtures) --------------------------------

def xml_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def element(tag: str, content: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attrs}>"), content, F.lit(f"</{tag}>"))


def optional(cond: Column, xml: Column) -> Column:
    return F.when(cond, xml).otherwise(F.lit(""))
