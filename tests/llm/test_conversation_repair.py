import hashlib
import random
import re
import zlib

from litsearch.llm.conversation_repair import Repair, damaged, repair

SCHEMA = "conv_id long, turn long, role string, text string, gone string, kind int, fault string"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) over every way to edit ``rows`` (role, text, fault), by trying them all.

    At most two insertions in a row: a third would repeat a state."""
    best = None

    def go(i, cost, audit, lines, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        initials = "".join(x[0][:1] for x in lines)
        if not re.fullmatch(r"(s?(ua)*u?)?", initials):
            return
        if i == len(rows) and LEGAL.fullmatch(initials):
            best = min(best or (10 ** 9,), (cost, audit, lines))
        if inserted < 2:
            for name in ("user", "assistant"):
                go(i, cost + 3, audit + "I", lines + [(name, "")], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + extra, audit + "K", lines + [(role, text)], 0)
                for name in ("user", "assistant"):
                    go(i + 1, cost + 3 + extra, audit + "R", lines + [(name, text)], 0)
    go(0, 0, "", [], 0)
    return best


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = after_damage([r for r in rows if r[0] == conv])
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = cheapest(faulty)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(3)
    got = repair(damaged(frame)).drop("widest").collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations(seed, n=120):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role,
                         rng.choice(["Yes.", "No?", "cut", " ", "é. \n", "Yes.", "a!\x0b", None, " "])))
    return rows


def test_against_every_way_to_edit(spark):
    rows = conversations(1) + [(None, *r[1:]) for r in conversations(2, 2)]
    assert found(spark, rows) == brute(rows)


def test_every_row_dropped_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "a.")])[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation_holds_few_edits(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"line {t}" + rng.choice([".", ""])) for t in range(20_000)]
    frame = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)
    r = repair(damaged(frame)).first()
    assert len(r.audit) >= 19_000 * 0.9 and r.widest < 200


def test_very_long_text_and_repeated_rows(spark):
    rows = [(1, 1, "user", "x" * 500_000 + "."), (1, 2, "assistant", "ok."), (1, 2, "assistant", "ok."), (1, 3, "user", "b")]
    assert found(spark, rows) == brute(rows)


def test_tree_keeps_only_surviving_paths():
    """The edits of the streamed tree are those of a table of whole strings, also where ties stay open for long."""
    for seed in range(60):
        rng = random.Random(seed)
        rows = [(rng.choice(["user", "assistant", "system"]), "t", rng.choice(["", "", "truncated", "blank"]))
                for _ in range(rng.randrange(0, 60))]
        edits = []
        tree = Repair(edits.append)
        for r in rows:
            tree.row(*r)
            alive, todo = 0, [tree.root]
            while todo:
                node = todo.pop()
                alive += len(node.children)
                todo += node.children
            assert alive == tree.held  # nothing but ancestors of survivors
        assert (tree.end(), "".join(e.letter for e in edits)) == whole_strings(rows)


def whole_strings(rows):
    never = (10 ** 9, "")
    plus = lambda p, c, x: never if p == never else (p[0] + c, p[1] + x)

    def inserted(p):
        p[2] = min(p[2], *(plus(p[k], 3, "I") for k in (0, 1, 3)))
        p[3] = min(p[3], plus(p[2], 3, "I"))
        return p

    p = [(0, ""), never, never, never]
    for role, _, fault in rows:
        p, extra = inserted(p), 3 if fault == "truncated" else 0
        q = [plus(x, 4, "D") for x in p]
        if fault != "blank":
            for to, sources, letter in ((1, (0,), "s"), (2, (0, 1, 3), "u"), (3, (2,), "a")):
                for k in sources:
                    if role[0] == letter:
                        q[to] = min(q[to], plus(p[k], extra, "K"))
                    elif letter != "s":
                        q[to] = min(q[to], plus(p[k], 3 + extra, "R"))
        p = q
    p = inserted(p)
    return min(p[0], p[3])
