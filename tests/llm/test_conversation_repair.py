"""Repaired conversations against all ways of editing, written out."""

import hashlib
import random
import zlib

import pytest
from cartwright.llm import conversation_repair as cr
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) by keeping, for each state, the least of whole (cost, audit) pairs."""
    seen, best = set(), {0: (0, "", ())}

    def with_new(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                role = cr.NEEDED[state]
                to = cr.LEADS[state, role[0]]
                way = cost + 5, audit + "I", (*lines, role + ":")
                best[to] = min(best.get(to, way), way)
        return best

    best = with_new(best)
    for role, text in rows:
        bound = not text.strip(BLANKS) or (role, text) in seen
        seen.add((role, text))
        more = 0 if not text.strip(BLANKS) or text.rstrip(BLANKS)[-1] in ".!?" else 5
        new = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if not bound:
                needed = cr.NEEDED[state]
                ways.append((cr.LEADS[state, needed[0]], (cost + 1 + more, audit + "R", (*lines, f"{needed}:{text}"))))
                if (state, role[:1]) in cr.LEADS:
                    ways.append((cr.LEADS[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = with_new(new)
    return min(best[s] for s in (0, 3) if s in best)


def expected(rows):
    """The summary of one conversation's (turn, role, text), in order."""
    seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        if not text.strip(BLANKS):
            counts["blank"] += 1
        elif (role, text) in seen:
            counts["duplicate"] += 1
        elif text.rstrip(BLANKS)[-1] not in ".!?":
            counts["truncated"] += 1
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = cheapest([(r, t) for _, r, t in rows])
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        counts["blank"], counts["duplicate"], counts["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def ordered(rows):
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2].encode(), r[3].encode())
    return [r[1:] for r in sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=key)]


def by_conversation(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return {c: expected(ordered(rs)) for c, rs in out.items()}


def found(frame):
    rows = frame.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def conversations(seed, n, most=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            rows.append(
                (
                    conv, rng.choice([turn, turn, turn, turn + rng.randrange(3), None]),
                    rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                    rng.choice(["Yes.", "No!", "cut off", "", " \t", None, f"Words {rng.random()}.", f"open {rng.random()}"]),
                )
            )
    rng.shuffle(rows)
    return rows


def test_cheapest_edits_of_random_rows():
    rng = random.Random(4)
    for _ in range(3000):
        rows, seen = [], set()
        roles = rng.choice([["user", "assistant"], ["system"], ["tool", "user"], ["user", "assistant", "system", "x", ""]])
        for _ in range(rng.randint(0, 30)):
            rows.append((rng.choice(roles), rng.choice(["a.", "b", "", str(rng.random()), f"{rng.random()}!"])))
        repair = cr.Repair()
        for role, text in rows:
            blank = not text.strip(BLANKS)
            repair.row(role, text, blank or (role, text) in seen, not blank and text[-1] not in ".!?")
            seen.add((role, text))
        repair.end()
        lines = tuple(f"{r}:{t}" for e, r, t in repair.decided if e != "D")
        assert (repair.cost, "".join(e for e, _, _ in repair.decided), lines) == cheapest(rows)


def test_summaries(spark):
    rows = conversations(1, 150) + [(None, 1, "user", "One."), (None, 2, "assistant", "Two."), (None, None, "user", "One.")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("blank", F.lit(1)).withColumn("cost", F.lit("x"))
    assert found(cr.summaries(frame)) == by_conversation(rows)


def test_damage_then_repair(spark):
    rows = [(c, t, "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[t % 2], f"Text {c} {t}. And?") for c in range(90) for t in range(c % 9)]
    rows += [(None, 3, None, None), (95, None, "user", "Alone.")]
    after = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(ch for ch in text if ch not in ".!?") if kind == 2 else text
        after += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, cr.damaged(frame).collect()), key=str) == sorted(after, key=str)
    got = found(cr.every_summary(cr.damaged(frame), frame))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: none for c, *_ in rows} | by_conversation(after)


def test_repaired_rows_spell_the_pattern(spark):
    rows = conversations(2, 60)
    frame = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in cr.repaired(frame).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, summary in by_conversation(rows).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == summary[-1]


def test_a_long_conversation_holds_little():
    repair, most = cr.Repair(), 0
    rng = random.Random(3)
    for at in range(50_000):
        repair.row(rng.choice(["user", "assistant", "system"]), f"{at}.", rng.random() < 0.1, rng.random() < 0.1)
        if at % 100 == 0:
            most = max(most, repair.open_edits())
    repair.end()
    assert most < 60 and len(repair.decided) >= 50_000


def test_ties_are_told_apart_by_all_that_is_open():
    """Roles that fit nowhere: which one goes stays open to the end, and is the first."""
    repair = cr.Repair()
    for at in range(20_001):
        repair.row("tool", f"{at}.", False, False)
    assert repair.open_edits() >= 20_000
    repair.end()
    audit = "".join(e for e, _, _ in repair.decided)
    assert audit == "D" + "R" * 20_000 and repair.cost == 20_002


def test_many_copies_and_one_large_conversation(spark):
    rows = [(7, t % 50, "user", "Same.") for t in range(4000)]
    rows += [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(50, 2000)]
    assert found(cr.summaries(spark.createDataFrame(rows, SCHEMA))) == by_conversation(rows)


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", None)]])
def test_empty(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(cr.every_summary(frame, frame)) == by_conversation(rows)
