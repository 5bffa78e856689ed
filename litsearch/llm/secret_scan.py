"""Secret scanning: fixed patterns, plus two character Markov models.

Patterns find assignments of passwords and keys, access key ids and long
hexadecimal runs. Beyond them, any run of key characters is judged by two
first-order character models: one of random strings, one of ordinary
identifiers. The sum of log-likelihood ratios over its character pairs decides.

The models are trained from strings that the data label themselves: the values
that the fixed patterns find are random strings, long runs of letters outside
of them are ordinary identifiers. The random model starts from a uniform prior
of ``PRIOR`` counts per pair, so that alphabets unseen in the data count as
random too. All documents are counted; what reaches the driver is one count per
pair of characters.

The scan is in column expressions on the row: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import narrow

# the fixed patterns; a shorter hit is no secret
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE_CHARS = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # the same hits as AKIA[A-Z0-9]+ of 18 characters or more
HEX = "[0-9a-f]{16,}"  # the same hits as [0-9a-f]+ of 16 characters or more
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = "[A-Za-z_]{8,}"
PRIOR, IDENTIFIER_PRIOR = 20.0, 0.5
THRESHOLD = 12.0  # nats by which random must be likelier

PART = 64
_SPAN = "struct<start:int,end:int,value:string>"


def located(text: Column, pattern: str, likely: Column | None = None) -> Column:
    """All leftmost, non-overlapping hits as (start, end, value), in code points.

    What lies between the hits and the hits themselves take turns, so the
    lengths add up to every position. Lists grow in parts of ``PART`` hits, as each
    addition copies a list.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{_SPAN}>")

    def step(done, hit):
        begin = done["at"] + F.length(hit["between"])
        end = begin + F.length(hit["hits"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), hit["hits"].alias("value")))).alias("out"))

    pairs = F.arrays_zip(hits.alias("hits"), F.slice(between, F.lit(1), F.size(hits)).alias("between"))

    def parts(pairs):
        def part(done, first):
            grown = F.aggregate(F.slice(pairs, first, F.lit(PART)),
                                F.struct(done["at"].alias("at"), none.alias("out")), step)
            return F.transform(F.array(grown), lambda g: F.struct(
                g["at"].alias("at"), F.concat(done["out"], F.array(g["out"])).alias("out")))[0]

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(PART)),
                           F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")),
                           part, lambda done: F.flatten(done["out"]))

    found = F.transform(F.array(pairs), parts)[0]  # a one-element array binds the hits, so they are searched once
    return F.when(text.rlike(pattern) if likely is None else likely & text.rlike(pattern),
                  found).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns' hits by kind."""
    assign = F.filter(located(text, ASSIGN),
                      lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE_CHARS)
    return {"assign": assign, "access": located(text, ACCESS, F.contains(text, F.lit("AKIA"))),
            "hex": located(text, HEX)}


def pair_counts(strings: Column, rows: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring alphabet characters occurs in the arrays of ``strings``."""
    words = rows.select(F.explode(strings).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))),
                                                    lambda i: F.substring("s", i, 2))).alias("pair"))
    counted = (pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
               .groupBy("pair").agg(F.sum("n").alias("n")))
    return {r.pair: r.n for r in counted.collect()}  # at most one row per pair of the alphabet


def log_ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[int]:
    """Per pair (first character major) log P(second | first, random) / P(... | ordinary), in thousandths."""
    out = []
    for a in ALPHABET:
        r = [random.get(a + b, 0) + PRIOR / len(ALPHABET) for b in ALPHABET]
        o = [ordinary.get(a + b, 0) + IDENTIFIER_PRIOR for b in ALPHABET]
        out += [round(1000 * math.log(x / sum(r) * sum(o) / y)) for x, y in zip(r, o)]
    return out


def train(docs: DataFrame) -> list[int]:
    """Both models from the pairs of all ``docs``, as one table of log ratios."""
    rows = narrow(docs)
    text = F.col("text")
    kinds = base_spans(text)
    values = F.concat(F.transform(kinds["assign"], lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
                      F.transform(kinds["access"], lambda s: s["value"]),
                      F.transform(kinds["hex"], lambda s: s["value"]))
    ordinary = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "),
                                    F.lit(IDENTIFIER), F.lit(0))
    return log_ratios(pair_counts(values, rows), pair_counts(ordinary, rows))


def log_likelihood_ratio(value: Column, ratios: list[int]) -> Column:
    """Thousandths of nats by which ``value`` is likelier random than ordinary."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, 1))
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0).cast("long"), lambda done, i: done + F.element_at(
        table, (code(i) - 1) * len(ALPHABET) + code(i + 1)))


def scan(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``found``: all spans (start, kind, end, value) by start, then kind as listed in ``KINDS``.

    ``kind`` is the number in ``KINDS``. A run judged by the models is left out
    where it touches a fixed pattern's span. Null and empty texts have no spans;
    one row per input row.
    """
    text = F.col("text")
    rows = narrow(docs).select("doc_id", "text", *[c.alias(k) for k, c in base_spans(text).items()])
    rows = rows.select("doc_id", "assign", "access", "hex", located(text, CANDIDATE).alias("runs"))
    taken = F.concat("assign", "access", "hex")
    markov = F.filter("runs", lambda r: ~F.exists(
        taken, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        & (log_likelihood_ratio(r["value"], ratios) >= round(1000 * threshold)))

    def of_kind(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"),
                                                     s["end"].alias("end"), s["value"].alias("value")))

    listed = [of_kind(k, c) for k, c in enumerate([F.col("assign"), F.col("access"), F.col("hex"), markov])]
    return rows.select("doc_id", F.array_sort(F.concat(*listed)).alias("found"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the spans' order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, spans found per fixed kind, hash of the fixed spans, and all spans as text."""
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
