"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage: later stages restart from these files when an executor
    is lost, and nothing above them is computed twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def narrow(docs: DataFrame, *columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and whole ``text`` (null reads as empty), plus named columns.

    Every other column is left behind here, so a table's extra columns can
    never clash with an operator's own names.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *columns)


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null id: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


MOST_GROUPS = 10_000  # rows of counts that are broadcast


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = (f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))")
    step = "CASE WHEN xor(r, b) & 1 = 1 THEN xor(xor(r, b) >> 1, 3988292384) ELSE xor(r, b) >> 1 END"
    return f"xor(list_reduce({bits}, lambda r, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def hash_sample(df: DataFrame, limit: int, by: list[str], key: str = "doc_id", seed: int = 17) -> DataFrame:
    """At most about ``limit`` rows of each group of ``by``, chosen by a hash of ``key``.

    One narrow count per group, then a filter: rows never meet in one task.
    Expected size ``limit`` per group (Poisson spread), whatever the input size.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    share = (F.xxhash64(F.lit(seed), F.col(key)) / F.lit(2.0 ** 63) + 1) / 2
    few = counts.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS  # more groups are joined without a broadcast
    return (df.join(F.broadcast(counts) if few else counts, by)
            .where(share * F.col("_n") <= F.lit(float(limit))).drop("_n"))


FILTER_BITS = 1 << 24


def likely_in(rows: DataFrame, key, wanted: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose 64-bit ``key`` may be in ``wanted[column]``: all that are, and some others.

    A bitmap of fixed size (``bits`` / 64 longs, whatever the data) is broadcast
    and thins out rows before they are shuffled for an exact join. When it is
    too full to tell rows apart, the join just gets more of them.
    """
    slot = F.pmod(F.col(column), F.lit(bits))
    bitmap = (wanted.select(F.floor(slot / 64).alias("_word"), (slot % 64).cast("int").alias("_bit")).groupBy("_word")
              .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits")))
    own = F.pmod(key, F.lit(bits))
    hit = (F.floor(own / 64) == F.col("_word")) & (
        F.call_function("shiftright", F.col("_bits"), (own % 64).cast("int")) % 2 != 0)
    return rows.join(F.broadcast(bitmap), hit, "left_semi")
