"""Bitmaps of hashed keys: what may be in a large set, told without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 27  # powers of two; the largest is 16 MB


def bits_for(keys: int) -> int:
    """Slots for so many keys: at least 8 for each, up to the largest bitmap."""
    return 1 << max(LEAST_BITS, min(MOST_BITS, (8 * keys).bit_length()))


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """_word, _bits: the slots that the 64-bit ``key`` takes, ``bits`` / 64 rows at most."""
    slot = F.pmod(key, F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    return (keys.select(F.shiftright(slot, 6).alias("_word"), bit.alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def marked(rows: DataFrame, key: Column, slots: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with the flag ``name``: false if ``key`` is surely not among the keys of the bitmap ``slots``."""
    rows = rows.withColumn("_slot", F.pmod(key, F.lit(bits)))
    rows = rows.join(F.broadcast(slots), F.shiftright("_slot", 6) == F.col("_word"), "left")
    hit = F.call_function("shiftright", F.col("_bits"), (F.col("_slot") % 64).cast("int")) % 2 != 0
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_slot", "_word", "_bits")
