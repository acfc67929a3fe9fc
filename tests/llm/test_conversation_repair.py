import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from litrank.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def accepted(rows, best):
    """All accepting edits of rows (initial, kind) up to cost ``best``, by plain recursion."""
    out = []

    def walk(i, q, cost, audit):
        if cost > best:
            return
        if i == len(rows) and q in "0a":
            out.append((cost, audit))
        step = {"0": "su", "s": "u", "u": "a", "a": "u"}[q]
        for to in step.replace("s", ""):
            walk(i, to, cost + 5, audit + "I")
        if i < len(rows):
            initial, kind = rows[i]
            walk(i + 1, q, cost + 2, audit + "D")
            if kind != cr.GONE:
                pay = 5 if kind == cr.TRUNCATED else 0
                if initial and initial in step:
                    walk(i + 1, initial, cost + pay, audit + "K")
                for to in step.replace("s", ""):
                    walk(i + 1, to, cost + pay + 1, audit + "R")

    walk(0, "0", 0, "")
    return out


def test_audit_is_least_of_all_edits():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 6))]
        cost, audit, _ = cr.cheapest([(i, k, 0) for i, k in rows])
        assert (cost, audit) == min(accepted(rows, cost))


@pytest.mark.parametrize("fan", [2, 5])
def test_segments_compose_to_the_whole_audit(fan):
    rng = random.Random(fan)
    for _ in range(150):
        rows = [(rng.choice("suauax"), rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 0, 0, 2])) for _ in range(rng.randint(1, 20))]
        parts = [cr.segment_table(rows[i:i + 3]) for i in range(0, len(rows), 3)]
        tables = [p[:2] for p in parts]
        costs, orders, via = cr.compose(tables)
        nested = [cr.compose(tables[i:i + fan])[:2] for i in range(0, len(tables), fan)]
        assert cr.compose(nested)[:2] == (costs, orders)
        end = min((z for z in cr.STATES if costs[z] != cr.NO), key=lambda z: (costs[z] + 5 * len(cr.CLOSING[z]), orders[z]))
        path = via[end]
        audit = "".join(p[2][4 * a + z] for p, a, z in zip(parts, path, path[1:])) + cr.CLOSING[end]
        assert (costs[end] + 5 * len(cr.CLOSING[end]), audit) == cr.cheapest(rows)[:2]


def dialogues(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 25)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            text = rng.choice(["Yes.", "No!", "a longer line?", "cut off", "", " \n", "é \U0001F600.", "b.\n"]) + rng.choice(["", " x.", "  "])
            rows.append((conv, turn, role, text))
    rows += [(40, None, "user", "Hi."), (40, None, "assistant", "Ho."), (40, 3, None, "text."), (40, 3, "user", None)]
    rows += [(None, 0, "user", "no conversation."), (None, 1, "assistant", "fine.")]
    rows += [(41, 0, "user", "same.")] * 3 + [(41, 1, "assistant", "x.")]
    rows += [(42, None, "user", "only null turns."), (43, 0, "", "no role.")]
    gone = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped.")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string") \
        .withColumns({"key": F.lit(1), "rank": F.lit("x"), "audit": F.lit(2.0)}), gone


def plain(rows):
    """The contract for the rows of one conversation, without Spark; the edits are tested above."""
    held = []
    for _, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        side = zlib.crc32(f"{' ' if rows[0][0] is None else rows[0][0]}:{' ' if turn is None else turn}".encode()) % 20
        if side == 0:
            continue
        text = "" if side == 1 else "".join(c for c in text if c not in ".!?") if side == 2 else text
        held += [(turn, "user" if side == 4 else role, text)] * (2 if side == 3 else 1)
    held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, seen = [], set()
    for _, role, text in held:
        bare = text.strip(SPACE)
        kinds.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    cost, audit, _ = cr.cheapest([(r[1][:1], {"b": 2, "d": 2, "t": 1, "": 0}[k], 0) for r, k in zip(held, kinds)])
    lines, rest = [], list(held)
    for e in audit:
        row = rest.pop(0) if e != "I" else (None, "", "")
        if e == "D":
            continue
        role = row[1] if e == "K" else "assistant" if lines and lines[-1][0][0] == "u" else "user"
        lines.append((role, row[2]))
    turns = {r[0] for r in held if r[0] is not None}
    initials = [r[1][:1] for r in held]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()), lines


@pytest.mark.parametrize("sizes", [{}, {"short_rows": 4, "segment": 3, "fan": 2}, {"short_rows": 0, "segment": 2, "fan": 3},
                                   {"short_bytes": 60, "segment": 64}])
def test_reports_whatever_the_sizes(spark, sizes):
    df, gone = dialogues(spark)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(cr.damage(df), **sizes).collect()}
    by_conv = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        by_conv.setdefault(r.conv_id, []).append(tuple(r))
    assert got == {c: plain(rows)[0] for c, rows in by_conv.items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("short_rows", [512, 3])
def test_repaired_turns(spark, short_rows):
    df, _ = dialogues(spark)
    rows = cr.repair(cr.damage(df), turns=True, short_rows=short_rows, segment=4, fan=2).collect()
    by_conv = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        by_conv.setdefault(r.conv_id, []).append(tuple(r))
    for conv, given in by_conv.items():
        mine = sorted((r.position, r.role, r.text) for r in rows if r.conv_id == conv)
        assert mine == [(i, *line) for i, line in enumerate(plain(given)[1])]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cr.repair(cr.damage(none)).collect() == [] and cr.repair(cr.damage(none), turns=True).collect() == []
