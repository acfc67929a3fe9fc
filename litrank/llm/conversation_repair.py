"""Repair of conversations by iterative-deepening A* over edits.

The rows of a conversation, in turn order, get edits so that the initials of the roles read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete (2; required for blank and
duplicate rows), Insert an empty user or assistant row (5); a truncated row that is not deleted
adds 5. ``cheapest`` goes depth first, edits in ASCII order, under a cost bound that grows to
the least cost beyond it; a table of failed states (row, grammar state) holds the largest budget
each failed with. The estimate of the rest is what its faulty rows cost at least. The first
accepting path has the least cost, and is the least in ASCII of those that have it.

Conversations of at most ``SHORT_ROWS`` rows and ``SHORT_BYTES`` bytes meet in one task, which
streams over its sorted rows and holds one conversation at a time. Longer ones are split, however
many rows they have:

* Equal rows become one row with a number of copies; a row is a duplicate if the first turn of
  its role and text, found by an aggregation, is another one.
* Rows are ranked by a range partitioning and cut into segments of ``SEGMENT`` rows. For each
  pair of grammar states before and after it, a segment is solved by itself. No audit of a
  segment is the beginning of another one (each ends with the edit of its last row), so that the
  least audit of a whole is made of least audits of its segments.
* Tables of costs and of the order of audits, 16 numbers each, are composed ``FAN`` at a time, up
  to one table; the choice goes down the same way. Audits are strung together only at the end.
* SHA-256 runs over a conversation from its first byte to its last: the rows of a long
  conversation are hashed in order by one task, as a stream, without being held.

Defined results
    * A null role or text is one space (a blank text, a role that starts no turn); so are null
      ids in the key of ``damage``. Rows with a null ``conv_id`` are one conversation, whose
      ``conv_id`` stays null.
    * Rows of one turn are ordered by role, then text. Null turns come first.
    * An empty role has no initial: such a row is rerolled or deleted.
    * A conversation whose rows are all gone has zeros, an empty audit and no repaired rows. An
      empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import ship_code, stored
from litrank.operators.budget import rank_in_groups
from litrank.operators.joins import join_small

SHORT_ROWS = 512
SHORT_BYTES = 4 << 20
SEGMENT = 64
FAN = 64

# The white space of the contract, [\x20\x09-\x0D], and its end marks.
BLANK = " \t\n\x0b\x0c\r"
END_MARKS = ".!?"

FINE, TRUNCATED, GONE = 0, 1, 2
# Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 accept.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
STATES = range(4)
CLOSING = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")

REPORT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
TURNS = "conv_id bigint, position bigint, edit string, role string, text string"


# --- the cheapest edits ---------------------------------------------------------------------------------

def cheapest(rows: list[tuple[str, int, int]], start: int = 0, goal: int | None = None):
    """Cost, audit and end state of the cheapest edits of ``rows``, ties least in ASCII.

    A row is (initial, kind, copies that are deleted right after it). With a ``goal`` the path
    ends there, with the edit of the last row; without one it may end with Inserts."""
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (2 if rows[i][1] else 0) + 2 * rows[i][2]

    def edits(i, q):
        role, after = ADDED[q]
        if i == n:
            return [("I", 5, i, after)] if goal is None else []
        initial, kind, copies = rows[i]
        rest, pay = "D" * copies, 2 * copies
        out = [("D" + rest, 2 + pay, i + 1, q), ("I", 5, i, after)]
        if kind != GONE:
            pay += 5 if kind == TRUNCATED else 0
            if initial in STEP[q]:
                out.append(("K" + rest, pay, i + 1, STEP[q][initial]))
            out.append(("R" + rest, 1 + pay, i + 1, after))
        return out

    failed: dict[tuple[int, int], int] = {}
    bound = least[0]
    while True:
        beyond = None
        path: list[str] = []
        stack: list[tuple] = []
        node = (0, start, 0)
        while node or stack:
            if node:
                i, q, g = node
                budget, known = bound - g, failed.get((i, q), -1)
                if least[i] > budget or known >= budget:
                    over = g + (least[i] if least[i] > budget else known + 1)
                    beyond = over if beyond is None else min(beyond, over)
                elif i == n and (q == goal if goal is not None else q in (0, 3)):
                    return g, "".join(path), q
                else:
                    stack.append((i, q, g, iter(edits(i, q))))
                    path.append("")
                node = None
                continue
            i, q, g, left = stack[-1]
            step = next(left, None)
            if step:
                path[-1] = step[0]
                node = (step[2], step[3], g + step[1])
            else:
                failed[i, q] = max(failed.get((i, q), -1), bound - g)
                stack.pop()
                path.pop()
        bound = beyond


def edited(rows, audit: str, state: int = 0):
    """Yield ``(edit, role, text)`` of each edit of ``audit`` over ``rows`` (role, text, copies), role and text
    null where a row is deleted; returns the grammar state after them."""
    rows, left = iter(rows), 0
    for letter in audit:
        if letter != "I":
            if left:
                left -= 1
                role = text = None
            else:
                role, text, left = next(rows)
        if letter == "D":
            yield "D", None, None
            continue
        if letter == "I":
            role, text = ADDED[state][0], ""
        elif letter == "R":
            role = ADDED[state][0]
        yield letter, role, text
        state = STEP[state][role[:1]]
    return state


def faults(rows: list[tuple]) -> list[int | None]:
    """The first fault of each row (role, text) in order: 'b', 'd', 't' or ''."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(BLANK)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in END_MARKS else "")
        seen.add((role, text))
    return out


KIND = {"b": GONE, "d": GONE, "t": TRUNCATED, "": FINE}


def report(rows: list[tuple]) -> tuple:
    """Gaps, counts of faults, cost and audit of the rows (turn, role, text) of one conversation."""
    turns = {t for t, _, _ in rows if t is not None}
    found = faults([r[1:] for r in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    cost, audit, _ = cheapest([(r[1][:1], KIND[f], 0) for r, f in zip(rows, found)])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit


# --- damage -------------------------------------------------------------------------------------

def damage(rows: DataFrame, sides: int = 20) -> DataFrame:
    """``rows`` with faults by a hash of ``conv_id:turn``, as ``copies`` of a row: 0 drops it, 1 empties
    the text, 2 takes its end marks, 3 repeats it, 4 makes the user say it."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    side = F.pmod(F.crc32(key), F.lit(sides))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn", F.when(side == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(side == 1, F.lit("")).when(side == 2, F.translate(text, END_MARKS, "")).otherwise(text).alias("text"),
        F.when(side == 0, 0).when(side == 3, 2).otherwise(1).alias("copies"))


# --- short conversations ------------------------------------------------------------------------

def _stream(batches, columns: int):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(columns)))


def _batches(rows, kinds: list, size: int = 1000):
    schema = pa.schema([(str(i), k) for i, k in enumerate(kinds)])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)


_REPORT_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_TURN_KINDS = [pa.int64()] * 2 + [pa.string()] * 3


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


def _short_reports(batches):
    def out():
        for _, group in groupby(_stream(batches, 6), key=lambda r: r[0]):
            rows, conv = [], None
            for _, conv, turn, role, text, copies in group:
                rows += [(turn, role, text)] * copies
            *counts, audit = report(rows)
            done = edited([(r, t, 0) for _, r, t in rows], audit)
            text = b"\n".join(_line(role, t) for _, role, t in done if role is not None)
            yield (conv, *counts, audit, hashlib.sha256(text).hexdigest())
    return _batches(out(), _REPORT_KINDS)


def _short_turns(batches):
    def out():
        for _, group in groupby(_stream(batches, 6), key=lambda r: r[0]):
            rows, conv = [], None
            for _, conv, turn, role, text, copies in group:
                rows += [(turn, role, text)] * copies
            done = edited([(r, t, 0) for _, r, t in rows], report(rows)[-1])
            kept = (e for e in done if e[1] is not None)
            yield from ((conv, i, *e) for i, e in enumerate(kept))
    return _batches(out(), _TURN_KINDS)


# --- long conversations -------------------------------------------------------------------------

NO = -1          # cost of a pair of states that nothing joins
_TABLE = "key string, id bigint, costs array<bigint>, orders array<int>, illegal bigint, first string, last string"


def segment_table(rows: list[tuple[str, int, int]]):
    """Costs, orders and audits for each (state before, state after) of a segment. The order of an
    audit is its place among those of the same state before."""
    costs, orders, audits = [NO] * 16, [NO] * 16, [None] * 16
    opens = any(kind != GONE and initial == "s" for initial, kind, _ in rows)
    for a in STATES:
        found = {}
        for z in STATES:
            if z >= 2 or a == z or (a == 0 and z == 1 and opens):
                costs[4 * a + z], found[z], _ = cheapest(rows, a, z)
        for place, z in enumerate(sorted(found, key=found.get)):
            orders[4 * a + z], audits[4 * a + z] = place, found[z]
    return costs, orders, audits


def compose(tables: list[tuple]):
    """The table of consecutive (costs, orders), and for each pair of states the states passed."""
    costs, orders = [NO] * 16, [NO] * 16
    via: list[list[int] | None] = [None] * 16
    for a in STATES:
        # state reached -> (cost, order, states passed), from a on
        at = {a: (0, 0, [a])}
        for c, o in tables:
            best: dict[int, tuple] = {}
            for q, (cost, order, path) in at.items():
                for z in STATES:
                    if c[4 * q + z] != NO:
                        one = (cost + c[4 * q + z], order, o[4 * q + z], path, z)
                        if z not in best or one[:2] < best[z][:2]:
                            best[z] = one
            by_audit = sorted(best, key=lambda z: best[z][1:3])
            at = {z: (best[z][0], place, best[z][3] + [z]) for place, z in enumerate(by_audit)}
        for z, (cost, order, path) in at.items():
            costs[4 * a + z], orders[4 * a + z], via[4 * a + z] = cost, order, path
    return costs, orders, via


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rank")
    rows = list(zip(pdf["initial"], pdf["kind"], pdf["copies"] - 1))
    costs, orders, audits = segment_table(rows)
    names = [r[0] for r in rows]
    illegal = sum(r[2] for r in rows) + sum(x + y not in LEGAL for x, y in zip(names, names[1:]))
    return pd.DataFrame([{"key": pdf["key"].iloc[0], "id": pdf["segment"].iloc[0], "costs": costs, "orders": orders,
                          "illegal": illegal, "first": names[0], "last": names[-1], "audits": audits}])


def _tables(pdf: pd.DataFrame) -> list[tuple]:
    return [([int(c) for c in costs], [int(o) for o in orders]) for costs, orders in zip(pdf["costs"], pdf["orders"])]


def _up(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    costs, orders, _ = compose(_tables(pdf))
    first, last = pdf["first"].tolist(), pdf["last"].tolist()
    illegal = int(pdf["illegal"].sum()) + sum(x + y not in LEGAL for x, y in zip(last, first[1:]))
    return pd.DataFrame([{"key": pdf["key"].iloc[0], "id": pdf["id"].iloc[0] // fan, "costs": costs, "orders": orders,
                          "illegal": illegal, "first": first[0], "last": last[-1]}])


def _down(tables: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    tables = tables.sort_values("id")
    a, z = int(chosen["a"].iloc[0]), int(chosen["z"].iloc[0])
    path = compose(_tables(tables))[2][4 * a + z]
    return pd.DataFrame({"key": tables["key"], "id": tables["id"], "a": path[:-1], "z": path[1:]})


def _top(pdf: pd.DataFrame) -> pd.DataFrame:
    (costs, orders), = _tables(pdf)
    z = min((z for z in STATES if costs[z] != NO), key=lambda z: (costs[z] + 5 * len(CLOSING[z]), orders[z]))
    return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "a": 0, "z": z, "cost": costs[z] + 5 * len(CLOSING[z]),
                         "illegal": pdf["illegal"]})


def _chosen(segments: DataFrame, fan: int):
    """The states before and after each segment (key, id, a, z), and (key, cost, illegal, z) of
    each conversation."""
    levels = [segments.drop("audits")]
    while levels[-1].agg(F.max("id")).first()[0]:
        parents = levels[-1].groupBy("key", F.floor(F.col("id") / fan).alias("parent"))
        levels.append(stored(parents.applyInPandas(lambda pdf: _up(pdf, fan), _TABLE), "repair-up"))
    top = stored(levels[-1].groupBy("key").applyInPandas(
        _top, "key string, id bigint, a int, z int, cost bigint, illegal bigint"), "repair-top")
    chosen = top.select("key", "id", "a", "z")
    for level in levels[-2::-1]:
        children = level.groupBy("key", F.floor(F.col("id") / fan).alias("parent"))
        pairs = children.cogroup(chosen.groupBy("key", "id"))
        chosen = stored(pairs.applyInPandas(_down, "key string, id bigint, a int, z int"), "repair-down")
    return chosen, top.select("key", "cost", "illegal", "z")


def _long_edits(batches):
    """``(key, edits of the next rows)`` of long conversations, in order. A segment's rows follow
    its audit; the conversation's last segment is followed by a row with the closing Inserts."""
    for key, group in groupby(_stream(batches, 7), key=lambda r: r[0]):
        state, feed = 0, iter(group)
        for _, _, place, audit, role, text, copies in feed:
            rows = ((r[4], r[5], r[6] - 1) for r in feed)
            done = edited(rows, audit, state)
            while True:
                try:
                    yield key, next(done)
                except StopIteration as end:
                    state = end.value
                    break


def _long_digests(batches):
    def out():
        for key, group in groupby(_long_edits(batches), key=lambda e: e[0]):
            digest, glue = hashlib.sha256(), b""
            for _, (_, role, text) in group:
                if role is not None:
                    digest.update(glue + _line(role, text))
                    glue = b"\n"
            yield key, digest.hexdigest()
    return _batches(out(), [pa.string()] * 2)


def _long_turns(batches):
    def out():
        for key, group in groupby(_long_edits(batches), key=lambda e: e[0]):
            kept = (e for _, e in group if e[1] is not None)
            yield from ((key, i, *e) for i, e in enumerate(kept))
    return _batches(out(), [pa.string(), pa.int64()] + [pa.string()] * 3)


def _long(rows: DataFrame, turns: bool, segment: int, fan: int) -> DataFrame:
    whole = stored(rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "repair-long")
    alive = whole.where("copies > 0")
    digest = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = alive.groupBy("key", digest.alias("digest")).agg(F.min(turn).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").drop("n")
    shown = F.rtrim("text", F.lit(BLANK))
    fault = F.when(shown == "", "b").when(F.coalesce(turn > F.col("first"), F.lit(False)), "d") \
        .when(~F.right(shown, F.lit(1)).isin(*END_MARKS), "t").otherwise("")
    flagged = alive.withColumn("digest", digest).join(again, ["key", "digest"], "left").withColumn("fault", fault) \
        .drop("first", "digest")
    ranked = stored(rank_in_groups(flagged, ["key"], ["turn", "role", "text"])
                    .withColumn("segment", F.floor((F.col("rank") - 1) / segment)), "repair-ranked")
    kind = F.when(F.col("fault").isin("b", "d"), GONE).when(F.col("fault") == "t", TRUNCATED).otherwise(FINE)
    narrow = ranked.select("key", "segment", "rank", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"),
                           "copies")
    segments = stored(narrow.groupBy("key", "segment").applyInPandas(_segment, _TABLE + ", audits array<string>"),
                      "repair-segments")
    chosen, top = _chosen(segments, fan)
    pieces = chosen.join(segments.select("key", "id", "audits"), ["key", "id"]) \
        .select("key", "id", F.get("audits", F.col("a") * 4 + F.col("z")).alias("audit"))
    close = F.element_at(F.array(*map(F.lit, CLOSING)), F.col("z") + 1)
    pieces = stored(pieces.unionByName(top.select("key", F.lit(2 ** 62).alias("id"), close.alias("audit"))), "repair-audits")
    none = F.lit(None).cast("string")
    feed = pieces.select("key", F.col("id").alias("segment"), F.lit(0).cast("bigint").alias("rank"), "audit",
                         none.alias("role"), none.alias("text"), F.lit(0).cast("bigint").alias("copies")) \
        .unionByName(ranked.select("key", "segment", "rank", none.alias("audit"), "role", "text", "copies")) \
        .repartition("key").sortWithinPartitions("key", "segment", "rank")
    ids = whole.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    if turns:
        made = feed.mapInArrow(_long_turns, "key string, position bigint, edit string, role string, text string")
        return made.join(ids, "key").select("conv_id", "position", "edit", "role", "text")
    digests = feed.mapInArrow(_long_digests, "key string, repaired_sha256 string")
    audits = pieces.groupBy("key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("id", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    counted = ranked.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1).alias("span"),
        F.sum(F.when(F.col("fault") == "b", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "d", F.col("copies"))
              .when(F.col("fault") == "b", 0).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("bigint")).alias("truncated"))
    turns_seen = ranked.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(F.count("*").alias("seen"))
    zero = F.lit(0).cast("bigint")
    out = ids.join(counted, "key", "left").join(turns_seen, "key", "left").join(top, "key", "left") \
        .join(audits, "key", "left").join(digests, "key", "left")
    number = lambda c: F.coalesce(F.col(c), zero).alias(c)
    return out.select(
        "conv_id", F.coalesce(F.col("span") - F.col("seen"), zero).alias("gaps"), number("blank"), number("duplicate"),
        number("truncated"), number("illegal"), number("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame, turns: bool = False, short_rows: int = SHORT_ROWS, short_bytes: int = SHORT_BYTES,
           segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row for each conversation: counts of faults, cost and audit of the cheapest edits, and the
    digest of the repaired ``role:text`` lines. With ``turns``: the repaired rows themselves, with
    their positions and edits. ``rows`` may have ``copies``: how often each row occurs; 0 keeps
    only its conversation in the result."""
    spark = rows.sparkSession
    ship_code(spark)
    copies = F.col("copies").cast("bigint") if "copies" in rows.columns else F.lit(1).cast("bigint")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    here = copies > 0
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(here, role).otherwise(F.lit("")).alias("role"), F.when(here, text).otherwise(F.lit("")).alias("text"),
        copies.alias("copies"))
    sizes = rows.groupBy("key").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"),
                                    F.sum(F.octet_length("text") * F.col("copies")).alias("size"))
    long = stored(sizes.where((F.col("n") > short_rows) | (F.col("size") > short_bytes)).select("key"), "repair-keys")
    any_long = bool(long.take(1))
    short = join_small(rows, long, ["key"], "left_anti") if any_long else rows
    made = short.repartition("key").sortWithinPartitions("key", "turn", "role", "text") \
        .mapInArrow(_short_turns if turns else _short_reports, TURNS if turns else REPORT)
    if not any_long:
        return made
    return made.unionByName(_long(join_small(rows, long, ["key"], "left_semi"), turns, segment, fan))
