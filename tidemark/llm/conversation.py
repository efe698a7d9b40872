"""Repair of a conversation's structure by the cheapest edits, found with A* on the lattice of edits.

A node of the lattice is (rows consumed, what the conversation so far ends in); edges keep, rerole, delete or insert a
row. The heuristic is the sum, over the rows to come, of what no path avoids: three for a row that must be deleted, one
for a row that is cut off. It is never too high and never falls faster than paths pay, so nodes leave the queue, ordered
by (cost plus heuristic, edits so far), with their cheapest and, of equals, ASCII-least edits.

Conversations are sorted by ranges of (conversation, turn), so a long one is many tasks, and cut into blocks of rows.
Where a conversation is more than one block, A* gives each block's best edits between all states at its two ends, and
the blocks are put together from those: edits of equal cost between the same two nodes are never one the beginning of the
other, so the best of the whole is made of the best of the blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, read, written

#: Rows of a conversation that one search takes; longer ones are put together from blocks.
BLOCK = 256
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: What a conversation can end in: nothing, system, user, assistant; and the state of a finished one.
EMPTY, SYSTEM, USER, ASSISTANT, DONE = range(5)
INITIALS = "sua"
NONE, MUST_GO, CUT_OFF = range(3)
_SPACES = "\\x20\\x09-\\x0D"


def letter(initial: str, fault: int) -> str:
    """One character for what the search knows of a row: its role's initial (s, u, a or another) and its fault."""
    return chr(65 + 3 * (INITIALS.find(initial) if initial in INITIALS and initial else 3) + fault)


def kept_state(state: int, initial: int) -> int:
    """What a conversation in a state ends in with a row of that role (0: s, 1: u, 2: a) after it; -1: not allowed."""
    if initial == 0:
        return SYSTEM if state == EMPTY else -1
    if initial == 1:
        return USER if state != USER else -1
    return ASSISTANT if initial == 2 and state == USER else -1


@lru_cache(1 << 14)
def cheapest(rows: str, state: int, whole: bool) -> tuple[tuple[int, int, str], ...]:
    """(state at the end, cost, edits) of the best edits of rows (letters) from a state on.

    whole: of the one that ends a conversation, with what is inserted after the last row (state DONE). Otherwise of each
    state that the rows can end in, with nothing inserted after the last row.
    """
    n = len(rows)
    codes = [ord(c) - 65 for c in rows]
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0, DELETE, TRUNCATED)[codes[i] % 3]
    ends = {EMPTY: 4, SYSTEM: 3, USER: 2, ASSISTANT: 2}[state]
    queue, closed, found = [(ahead[0], "", 0, state)], set(), []
    while queue:
        least, edits, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = least - ahead[i]
        if i == n:
            if not whole:
                found.append((state, cost, edits))
                if len(found) == ends:
                    break
                continue
            if state in (EMPTY, ASSISTANT):
                return ((DONE, cost, edits),)
        else:
            initial, fault = divmod(codes[i], 3)
            base = cost + ahead[i + 1]
            if fault != MUST_GO:
                more = TRUNCATED if fault == CUT_OFF else 0
                kept, turn = kept_state(state, initial), ASSISTANT if state == USER else USER
                if kept >= 0:
                    heapq.heappush(queue, (base + more, edits + "K", i + 1, kept))
                if kept != turn:  # the same row for less
                    heapq.heappush(queue, (base + REROLE + more, edits + "R", i + 1, turn))
            heapq.heappush(queue, (base + DELETE, edits + "D", i + 1, state))
        heapq.heappush(queue, (least + INSERT, edits + "I", i, ASSISTANT if state == USER else USER))
    return tuple(found)


def illegal_pairs(rows: str) -> int:
    """Neighbours that are not system-user, user-assistant or assistant-user."""
    initials = [(ord(c) - 65) // 3 for c in rows]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:], strict=False))


_MOVES = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def _blocks(kind: pa.DataType, block: int):
    """Cuts sorted rows (conv, letters) into blocks and searches each; a conversation that lies inside a task and fits
    one block is finished at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv, held, first = None, "", True  # first: whether the conversation may have begun in an earlier task
        started, edge = False, True
        out: list[tuple] = []

        def cut(rows: str, whole: bool) -> None:
            nonlocal number
            if whole:
                moves = [(EMPTY, *x) for x in cheapest(rows, EMPTY, True)]
            else:
                moves = [(s, *x) for s in (EMPTY, SYSTEM, USER, ASSISTANT) for x in cheapest(rows, s, False)]
            out.append((conv, part, number, rows[0], rows[-1], illegal_pairs(rows), [dict(zip(("enter", "leave", "cost", "edits"), m, strict=True)) for m in moves]))
            number += 1

        def table() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = (kind, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), _MOVES)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", "part", "number", "head", "tail", "illegal", "moves"])
            out.clear()
            return made

        for rows in batches:
            for c, letters in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if not started or c != conv:
                    if held:
                        cut(held, first and not edge)
                    edge = not started  # the first conversation of a task may go on from the one before
                    conv, held, first, started = c, "", True, True
                held += letters
                if len(held) > block:
                    end = (len(held) - 1) // block * block
                    for a in range(0, end, block):
                        cut(held[a : a + block], False)
                    held, first = held[end:], False
            yield table()
        if held:
            cut(held, False)  # the last one may go on in the next task
        yield table()

    return run


def _joined(kind: pa.DataType):
    """Puts the blocks of each conversation, which come in order, together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, best, illegal, tail, started = None, {}, 0, "", False
        out: list[tuple] = []

        def finish() -> None:
            ends = {EMPTY: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, ""), DONE: (0, "")}
            cost, edits = min((c + ends[s][0], e + ends[s][1]) for s, (c, e) in best.items())
            out.append((conv, cost, edits, illegal))

        for rows in batches:
            for c, head, end, inner, moves in zip(*(rows.column(k).to_pylist() for k in ("conv", "head", "tail", "illegal", "moves")), strict=True):
                if not started or c != conv:
                    if started:
                        finish()
                    conv, best, illegal, tail, started = c, {EMPTY: (0, "")}, 0, "", True
                illegal += inner + (illegal_pairs(tail + head) if tail else 0)
                tail, new = end, {}
                for m in moves:
                    if m["enter"] in best:
                        cost, edits = best[m["enter"]]
                        total = cost + m["cost"]
                        known = new.get(m["leave"])
                        if known is None or total <= known[0]:
                            tried = (total, edits + m["edits"])
                            new[m["leave"]] = tried if known is None else min(known, tried)
                best = new
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (kind, pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv", "cost", "audit", "illegal"])
            out.clear()
        if started:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out[-1], (kind, pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv", "cost", "audit", "illegal"])

    return run


def _turns(rows: DataFrame, conv_col: str) -> DataFrame:
    """The columns that matter, nulls of role and text as one space, and a hash of the text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col(conv_col).alias("conv"), "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("hash"))


def conversation_audits(rows: DataFrame, conv_col: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """One row per conversation of rows (turn, role, text): its id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows go by turn (nulls first), those of one turn by role, then by the text's hash. The first fault of a row counts:
    blank (no visible character), duplicate (role and text seen earlier), truncated (the last visible character is none
    of . ! ?). gaps: turns missing between the smallest and the largest; illegal: neighbours whose roles' initials are
    not su, ua or au. Edits: Keep, Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert
    an empty user or assistant turn (2); a truncated row that stays costs 1 more. audit holds the initials of the
    cheapest edits, the ASCII-least of equals, after which roles' initials read (s?(ua)+)?.

    Null ids are one conversation; null roles and texts count as one space, null turns come first and leave no gaps.
    Repeated rows are duplicates of each other. Other columns are ignored; an empty table gives an empty result. Copies
    of a row are counted before the rows are shuffled, and a conversation of any length is dealt to many tasks by turn.
    """
    visible = F.col("text").rlike(f"[^{_SPACES}]")
    turns = _turns(rows, conv_col).withColumn("blank", ~visible).withColumn("cut", ~F.col("text").rlike(f"[.!?][{_SPACES}]*\\z"))
    same = turns.groupBy("conv", "turn", "role", "hash", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = same.filter("NOT blank").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min(at).alias("first"))
    known = same.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")), "left").withColumn("new", F.col("first").eqNullSafe(at) & ~F.col("blank"))
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    base = F.when((place == 0) | (F.col("role") == ""), 3).otherwise(place - 1) * 3 + 65
    one = F.when(F.col("new"), F.concat(F.char(base + F.when(F.col("cut"), CUT_OFF).otherwise(NONE)), F.repeat(F.char(base + MUST_GO), (F.col("n") - 1).cast("int")))).otherwise(F.repeat(F.char(base + MUST_GO), F.col("n").cast("int")))
    coded = written(known.select("conv", "turn", "role", "hash", "blank", "cut", "new", "n", one.alias("letters")), "turns")
    left = F.when(F.col("new"), F.col("n") - 1).otherwise(F.col("n"))
    days = coded.groupBy("conv", "turn").agg(*(F.sum(F.when(c, x).otherwise(F.lit(0))).alias(k) for k, c, x in (("blank", F.col("blank"), F.col("n")), ("duplicate", ~F.col("blank"), left), ("truncated", F.col("new") & F.col("cut"), F.lit(1)))))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    facts = days.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *(F.sum(k).cast("long").alias(k) for k in ("blank", "duplicate", "truncated")))
    kind = coded.schema["conv"].dataType
    arrow = pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()
    name = kind.simpleString()
    order = ["conv", F.asc_nulls_first("turn"), "role", "hash"]
    dealt = coded.repartitionByRange("conv", F.asc_nulls_first("turn")).sortWithinPartitions(*order).select("conv", "letters")
    moves = "array<struct<enter:int,leave:int,cost:long,edits:string>>"
    blocks = dealt.mapInArrow(_blocks(arrow, block), f"conv {name}, part int, number long, head string, tail string, illegal long, moves {moves}")
    audits = blocks.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_joined(arrow), f"conv {name}, cost long, audit string, illegal long")
    out = facts.join(audits.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    return out.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired_turns(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The rows that are left and inserted when audits (of conversation_audits over the same rows) are applied: the
    conversation's id, place (from 0), role and text. Rows of a conversation come one after the other, in order.

    A conversation's rows pass through one task, a batch at a time: nothing of it is held but its audit.
    """
    turns = _turns(rows, conv_col).select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "hash")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in turns.dtypes}
    edits = audits.select(F.col(conv_col).alias("conv"), F.lit(0).alias("kind"), none["turn"], none["role"], F.col("audit").alias("text"), none["hash"])
    kind = turns.schema["conv"].dataType.simpleString()
    both = turns.union(edits).repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "hash")
    out = both.select("conv", "kind", "role", "text").mapInArrow(_applied, f"conv {kind}, place long, role string, text string")
    return out.withColumnRenamed("conv", conv_col)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, place, state = None, "", 0, 0, EMPTY
    out: list[tuple] = []

    def emit(role: str, text: str) -> None:
        nonlocal place, state
        out.append((conv, place, role, text))
        place, state = place + 1, kept_state(state, INITIALS.find(role[:1]))

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit("assistant" if state == USER else "user", "")
            at += 1

    kind = None
    for rows in batches:
        kind = rows.schema.field(0).type
        for c, turn, role, text in zip(*(x.to_pylist() for x in rows.columns), strict=True):
            if turn == 0:
                insert()
                conv, audit, at, place, state = c, text, 0, 0, EMPTY
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                emit(role, text)
            elif edit == "R":
                emit("assistant" if state == USER else "user", text)
        yield _repaired(out, kind)
        out.clear()
    if kind is not None:
        insert()
        yield _repaired(out, kind)


def _repaired(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "place", "role", "text"])


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults by a hash of each row's place: of 20 rows one is dropped, one emptied, one loses its sentence
    ends, one is repeated, and one is made the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.withColumn("_way", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).filter("_way <> 0")
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("_way") == 4, "user").otherwise(said("role"))
    copies = F.explode(F.when(F.col("_way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the rows `role:text` of each conversation, which come in order."""
    conv, now, kind = None, None, None
    for rows in batches:
        kind, done = rows.schema.field(0).type, []
        for c, place, role, text in zip(*(x.to_pylist() for x in rows.columns), strict=True):
            if place == 0:
                if now is not None:
                    done.append((conv, now.hexdigest()))
                conv, now = c, hashlib.sha256()
            else:
                now.update(b"\n")
            now.update(f"{role}:{text}".encode())
        yield _hashes(done, kind)
    if now is not None:
        yield _hashes([(conv, now.hexdigest())], kind)


def _hashes(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv", "sha"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their audits, and a hash of each repaired one. SHA-256 can only be taken in order, so the
    texts of one conversation are hashed in one task, as they pass by."""
    arrow_rows(spark)
    given = read(spark, sf_dir, "conversations")
    rows = damaged(given)
    audits = written(conversation_audits(rows), "audits")
    repaired = repaired_turns(rows, audits)
    kind = rows.schema["conv_id"].dataType.simpleString()
    hashes = repaired.mapInArrow(_digests, f"conv {kind}, sha string")
    out = given.select("conv_id").distinct().join(audits.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# The same rows in SQL: a walk along the rows that keeps the best edits for each state -----------------------------------


def _step(row: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {row} IS NOT NULL THEN struct_pack(c := {row}.c + {cost}, a := {row}.a || '{edit}') END"


def _best(*rows: str) -> str:
    return f"list_min([{', '.join(rows)}])"


_I2 = _best("s2", *(_step(f"s{q}", "2", "I") for q in (0, 1, 3)))
_KEEP = lambda q, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_step(f'w.i{q}', 'late', 'K')} END"
_ROLE = lambda q: f"CASE WHEN NOT gone THEN {_step(f'w.i{q}', '2 + late', 'R')} END"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
OP11_SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS MATERIALIZED (SELECT *, {_CRC} % 20 AS way FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN way = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE way <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER o AS rn, lag(left(role, 1)) OVER o || left(role, 1) AS pair FROM hurt WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
faults AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM placed),
lines AS MATERIALIZED (SELECT *, blank OR again AS gone, (cut AND NOT blank AND NOT again)::BIGINT AS late FROM faults),
walk AS (
  SELECT conv_id, 0::BIGINT AS rn, struct_pack(c := 0::BIGINT, a := '') AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM lines)
  UNION ALL
  SELECT w.conv_id, l.rn, {_step("w.i0", "3", "D")}, {_best(_step("w.i1", "3", "D"), _KEEP(0, "s"))}, {_best(_step("w.i2", "3", "D"), *(f(*x) for q in (0, 1, 3) for f, x in ((_ROLE, (q,)), (_KEEP, (q, "u")))))}, {_best(_step("w.i3", "3", "D"), _ROLE(2), _KEEP(2, "a"))}
  FROM (SELECT *, s0 AS i0, s1 AS i1, {_best("s3", _step("i2", "2", "I"))} AS i3 FROM (SELECT *, {_I2} AS i2 FROM walk)) w JOIN lines l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND l.rn = w.rn + 1),
ends AS (SELECT conv_id, arg_max({_best("s0", "i3")}, rn) AS b FROM (SELECT *, {_best("s3", _step("i2", "2", "I"))} AS i3 FROM (SELECT *, {_I2} AS i2 FROM walk)) GROUP BY conv_id),
edits AS (SELECT conv_id, p, substr(b.a, p, 1) AS e, length(replace(left(b.a, p), 'I', '')) AS rn FROM (SELECT *, unnest(generate_series(1, length(b.a))) AS p FROM ends)),
made AS (SELECT e.conv_id, p, e, CASE WHEN e <> 'I' THEN l.text ELSE '' END AS text, l.role, first_value(e = 'K' AND l.initial = 's') OVER o AS led, row_number() OVER o AS j
  FROM edits e LEFT JOIN lines l ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.rn = l.rn WHERE e <> 'D' WINDOW o AS (PARTITION BY e.conv_id ORDER BY p)),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM made GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, sum(late) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id)
SELECT g.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal,
  coalesce(e.b.c, 0)::BIGINT AS cost, coalesce(e.b.a, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON g.conv_id IS NOT DISTINCT FROM t.conv_id
"""
