"""Conversation structure repair by a survivor-coalescence Viterbi.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``: one
optional system turn, then user and assistant in turn. Every row is kept (0),
given another role (3, user or assistant) or deleted (4; blank rows and repeats
have to be); rows without text may be inserted anywhere (3), and a truncated row
that is not deleted adds 3. The cheapest way wins, of equal ones that whose
edits' initials come first in ASCII.

Spark deals the rows by conversation, ranks repeats and sorts by turn; a task
then reads its rows as a stream. Per state of the pattern one path survives. The
paths form a tree of backpointers with reference counts: a path that no state
ends in is freed at once, as is one that costs more than another state's path and
what that state pays to catch up (``CATCH_UP``), and as soon as all survivors share an ancestor the
edits up to it are settled and leave the tree. Paths of equal cost are compared
by their whole unsettled edits. So a task holds the rows of the unsettled part
only, however long a conversation is; its text goes into a running SHA-256,
which is also why one conversation is one sequential pass.

Defined cases: a null role or text reads as one space, as does a null ``conv_id``
or ``turn`` in the key of the damage; a null ``conv_id`` is a conversation of its
own. Null turns come first, equal turns go by role and text. A role that starts
with none of s, u, a is never kept. Repeated rows are repeats like any other. An
empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsearch.llm.common import crc32_sql

RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after ua; what each reads next.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: ``CATCH_UP[x][y]``: what state x pays at most to end as well as y does on any rows still to come
#: (insert what y has read already, delete the system row that only y could keep).
CATCH_UP = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")


class Edit:
    """A node of the tree of surviving paths: one edit and the one before it."""

    __slots__ = ("before", "letter", "role", "text", "children", "ends")

    def __init__(self, before: Edit | None, letter: str, role: str | None, text: str | None):
        self.before, self.letter, self.role, self.text = before, letter, role, text
        self.children: set[Edit] = set()
        self.ends = 0  # states whose survivor ends here


class Repair:
    """The repair of one conversation, row by row."""

    def __init__(self, settled):
        self.settled = settled  # called with each edit that is final, in order
        self.root = Edit(None, "", None, None)
        self.root.ends = 1
        self.best: list[tuple[int, Edit] | None] = [(0, self.root), None, None, None]
        self.widest = self.held = 0

    def letters(self, path: tuple) -> str:
        """The unsettled edits of a candidate (cost, node, letter, ...)."""
        out, node = [path[2]], path[1]
        while node is not self.root:
            out.append(node.letter)
            node = node.before
        return "".join(reversed(out))

    def better(self, one: tuple | None, other: tuple) -> tuple:
        if one is None or other[0] < one[0]:
            return other
        if other[0] > one[0]:
            return one
        return other if self.letters(other) < self.letters(one) else one

    def _grow(self, path: tuple) -> tuple[int, Edit]:
        cost, before, letter, role, text = path
        node = Edit(before, letter, role, text)
        before.children.add(node)
        self.held += 1
        self.widest = max(self.widest, self.held)
        return cost, node

    def _replace(self, best: list) -> None:
        """Make ``best`` the survivors, without those that can no longer be part of a cheapest path."""
        reached = {p[1] for p in best if p}
        for node in reached:
            node.ends += 1  # until its place among the survivors is settled
        best = [p if p and not any(q and q[0] + CATCH_UP[x][y] < p[0] for x, q in enumerate(best)) else None
                for y, p in enumerate(best)]
        for kept in best:
            if kept:
                kept[1].ends += 1
        for node in [*reached, *(p[1] for p in self.best if p)]:
            node.ends -= 1
            while node is not self.root and not node.ends and not node.children:  # no survivor left
                node.before.children.discard(node)
                node, self.held = node.before, self.held - 1
        self.best = best
        while not self.root.ends and len(self.root.children) == 1:  # all survivors share this edit
            self.root = next(iter(self.root.children))
            self.root.before = None
            self.held -= 1
            self.settled(self.root)

    def insert(self) -> None:
        """Let states be reached by inserted rows; a cycle of insertions never pays."""
        best = list(self.best)
        for state, letter in ((2, "u"), (3, "a")):
            found = (best[state][0], best[state][1], "") if best[state] else None
            for source, reads in enumerate(STEPS):
                if best[source] and reads.get(letter) == state:
                    found = self.better(found, (best[source][0] + INSERT, best[source][1], "I", NAMES[letter], ""))
            if found and len(found) > 3:
                best[state] = self._grow(found)
        self._replace(best)

    def row(self, role: str, text: str, fault: str) -> None:
        self.insert()
        found: list[tuple | None] = [None] * len(STEPS)
        own, extra = role[:1], TRUNCATED if fault == "truncated" else 0
        for source, kept in enumerate(self.best):
            if not kept:
                continue
            cost, node = kept
            found[source] = self.better(found[source], (cost + DELETE, node, "D", None, None))
            if fault in ("blank", "duplicate"):
                continue
            for letter, state in STEPS[source].items():
                if letter == own:
                    found[state] = self.better(found[state], (cost + extra, node, "K", role, text))
                if letter in NAMES and NAMES[letter] != role:
                    found[state] = self.better(found[state], (cost + RE_ROLE + extra, node, "R", NAMES[letter], text))
        self._replace([self._grow(f) if f else None for f in found])

    def end(self) -> int:
        """Settle everything; the cost of the whole repair."""
        self.insert()
        final = None
        for state in ENDS:
            if self.best[state]:
                final = self.better(final, (self.best[state][0], self.best[state][1], ""))
        self._replace([(final[0], final[1]), None, None, None])
        return final[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(``conv_id:turn``) mod 20; dropped ones stay, marked ``gone``."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def faults(rows: DataFrame, partitions: int) -> DataFrame:
    """``rows`` dealt by conversation and sorted by turn, with ``fault``: a name of ``FAULTS``, or empty.

    One shuffle: ranking repeats and sorting by turn both use the same dealing.
    """
    word = r"[^\x20\x09-\x0D]"
    rows = rows.repartition(partitions, "conv_id").withColumn("digest", F.sha2("text", 256))
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("nth", F.row_number().over(same))
    fault = (F.when(~F.col("text").rlike(word), "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise(""))
    return (rows.select("conv_id", "turn", "role", "text", "gone", "nth", fault.alias("fault"))
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "nth"))


class Conversation:
    """Counts, repair and running hash of one conversation's sorted rows."""

    def __init__(self, conv_id):
        self.conv_id, self.low, self.high, self.turns = conv_id, None, None, 0
        self.count = dict.fromkeys(FAULTS, 0)
        self.illegal, self.last = 0, None
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0
        self.repair = Repair(self.settle)

    def settle(self, edit: Edit) -> None:
        self.audit.append(edit.letter)
        if edit.role is not None:
            self.sha.update(f"{chr(10) if self.lines else ''}{edit.role}:{edit.text}".encode())
            self.lines += 1

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += 1
        if fault:
            self.count[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        self.repair.row(role, text, fault)

    def result(self) -> dict:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.count, "illegal": self.illegal, "cost": cost,
                "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest(),
                "widest": self.repair.widest}


def repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One result per conversation of sorted rows; only the rows of unsettled edits are held."""
    now, out = None, []
    for batch in batches:
        for conv_id, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "turn", "role", "text", "gone", "fault"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = Conversation(conv_id)
            if not gone:
                now.add(turn, role, text, fault)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, gone; no nulls in the last three) its counts,
    cost, audit, hash of the repaired text and ``widest``, the most edits that were unsettled at once."""
    spark = rows.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = rows.schema["conv_id"].dataType
    longs = ["gaps", *FAULTS, "illegal", "cost"]
    schema = pa.schema([("conv_id", to_arrow_type(id_type)), *((c, pa.int64()) for c in longs),
                        ("audit", pa.string()), ("repaired_sha256", pa.string()), ("widest", pa.int64())])
    ddl = ", ".join([f"conv_id {id_type.simpleString()}", *(f"{c} long" for c in longs),
                     "audit string", "repaired_sha256 string", "widest long"])
    sorted_rows = faults(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sorted_rows.mapInArrow(lambda batches: repaired(batches, schema), ddl)


def conversation_sql() -> str:
    """DuckDB SQL for the repair of damaged ``conversations``: a recursion over rows with one string per state,
    twelve digits of cost before the edits, so that the least string is the cheapest path and the first of ties."""
    never = "repeat('9', 12)"

    def plus(path: str, cost: str, letter: str, when: str = "true") -> str:
        return (f"CASE WHEN {path} < '9' AND ({when}) THEN lpad(CAST(CAST(left({path}, 12) AS BIGINT) + {cost} AS VARCHAR),"
                f" 12, '0') || substr({path}, 13) || '{letter}' ELSE {never} END")

    def least(*paths: str) -> str:
        return f"least({', '.join(paths)})"

    rerole = "CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END"
    keep = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    free = "fault NOT IN ('blank', 'duplicate')"

    def reached(letter: str, *sources: str) -> list[str]:
        kept = [plus(s, keep, "K", f"{free} AND left(role, 1) = '{letter}'") for s in sources]
        name = NAMES.get(letter)
        return kept + ([plus(s, rerole, "R", f"{free} AND role <> '{name}'") for s in sources] if name else [])

    inserted = (f"SELECT * REPLACE ({least('p3', plus('p2', '3', 'I'))} AS p3) FROM (SELECT * REPLACE ("
                f"{least('p2', plus('p0', '3', 'I'), plus('p1', '3', 'I'), plus('p3', '3', 'I'))} AS p2) FROM ")
    deleted = [plus(f"p{i}", "4", "D") for i in range(4)]
    return f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
), after AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM source, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn FROM after
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS nth,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair FROM placed
), faulty AS (
  SELECT conv_id, turn, role, text, rn, pair,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM seen
), ids AS (SELECT DISTINCT conv_id FROM conversations
), paths AS (
  SELECT conv_id, 0::BIGINT AS n, repeat('0', 12) AS p0, {never} AS p1, {never} AS p2, {never} AS p3 FROM ids
  UNION ALL
  SELECT conv_id, rn, {deleted[0]}, {least(deleted[1], *reached("s", "p0"))},
         {least(deleted[2], *reached("u", "p0", "p1", "p3"))}, {least(deleted[3], *reached("a", "p2"))}
  FROM ({inserted}(SELECT p.*, f.role, f.text, f.fault, f.rn FROM paths p
        JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.rn = p.n + 1)))
), done AS (
  SELECT conv_id, {least("p0", "p3")} AS path FROM ({inserted}(
    SELECT p.* FROM paths p JOIN (SELECT conv_id, max(n) AS n FROM paths GROUP BY conv_id) l
      ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.n)))
), letters AS (
  SELECT conv_id, i, substr(path, 12 + i, 1) AS edit FROM done, range(1, length(path) - 11) AS r(i)
), numbered AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS rn, count(*) FILTER (edit <> 'D') OVER w AS out
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), joined AS (
  SELECT n.conv_id, n.i, n.edit, n.out, f.role, CASE n.edit WHEN 'I' THEN '' ELSE f.text END AS text,
         bool_or(n.out = 1 AND n.edit = 'K' AND left(f.role, 1) = 's') OVER (PARTITION BY n.conv_id) AS system
  FROM numbered n LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.rn = n.rn AND n.edit <> 'I'
), written AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1
           THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text
  FROM joined WHERE edit <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       CAST(left(path, 12) AS BIGINT) AS cost, substr(path, 13) AS audit, sha256(coalesce(w.text, '')) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM d.conv_id"""
