"""Conversation repair against a plain search over all prefixes of edits."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tidemark.llm import conversation as C
from tidemark.llm import queries

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """(role, text, fault) of rows (turn, role, text) in order; fault is that of the search."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, out = set(), []
    for _, role, text in rows:
        shown = VISIBLE.findall(text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return rows, out


def plain_repair(rows):
    """Best (cost, edits) for each state after each row, from all of the row before: no queue and no heuristic."""
    step = lambda state, initial: {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(initial, {}).get(state)
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s, (c, e, made) in list(out.items()):
                role = "assistant" if s == "u" else "user"
                tried = (c + 2, e + "I", (*made, (role, "")))
                if role[0] not in out or tried[:2] < out[role[0]][:2]:
                    out[role[0]] = tried
        return out

    for role, text, fault in rows:
        now, new = inserted(best), {}

        def take(state, found):
            if state not in new or found[:2] < new[state][:2]:  # noqa: B023
                new[state] = found  # noqa: B023

        for s, (c, e, made) in now.items():
            late = fault == "truncated"
            if fault not in ("blank", "duplicate"):
                if step(s, role[:1]):
                    take(step(s, role[:1]), (c + late, e + "K", (*made, (role, text))))
                turn = "assistant" if s == "u" else "user"
                take(turn[0], (c + 2 + late, e + "R", (*made, (turn, text))))
            take(s, (c + 3, e + "D", made))
        best = new
    cost, edits, made = min((x for s, x in inserted(best).items() if s in ("", "a")), key=lambda x: x[:2])
    return cost, edits, made


def expected(rows):
    """The query's columns for damaged rows (turn, role, text) of one conversation."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ordered, found = faults(rows)
    turns = {t for t, _, _ in ordered if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    count = lambda k: sum(f == k for _, _, f in found)
    initials = [r[:1] for r, _, _ in found]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, edits, made = plain_repair(found)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def hurt(conv, turn, role, text):
    way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    row = (turn, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
    return [row] * {0: 0, 3: 2}.get(way, 1)


def made_up():
    rng, rows = random.Random(8), []
    for conv in [*range(120), None]:
        for _ in range(rng.choice([1, 2, 5, 9, 14])):
            turn = rng.choice([None, *range(12)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(["Yes.", "No!", "why", "", " \t", None, "Yes.", "a b?  \n", "x.\ny"])))
    return rows + rows[:20]


def check(spark, tmp_path, rows, types="conv_id long, turn long, role string, text string", more=()):
    df = spark.createDataFrame([(*r, *more) for r in rows], types)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.columns == ["conv_id", *names]
    got = sorted(((r["conv_id"], *(r[c] for c in names)) for r in out.collect()), key=repr)
    want = {r[0]: [] for r in rows}
    for r in rows:
        want[r[0]] += hurt(*r)
    assert got == sorted(((k, *expected(v)) for k, v in want.items()), key=repr)
    return got


def test_query_with_nulls_ties_and_repeats(spark, tmp_path):
    rows = made_up()
    got = check(spark, tmp_path, rows)
    assert {"K", "R", "D", "I"} <= set("".join(r[7] for r in got)) and any(r[7] == "" for r in got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = [d[0] for d in db.execute(C.OP11_SQL).description]
    assert columns[0] == "conv_id" and sorted(db.execute(C.OP11_SQL).fetchall(), key=repr) == got


def test_long_conversation_is_put_together_from_blocks(spark, tmp_path):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same!", ""])) for t in range(1500)]
    rows += [(8, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(700)]
    check(spark, tmp_path, rows, "conv_id long, turn long, role string, text string, hash int, kind string", (1, "k"))


def test_empty_table(spark, tmp_path):
    assert check(spark, tmp_path, []) == []


def test_blocks_of_any_size_give_the_same_edits(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"{t}.", f"{t}", "ha!", " "])) for c in range(6) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [sorted(map(tuple, C.conversation_audits(df, block=n).collect())) for n in (3, 16, 256)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 6


def test_heuristic_is_admissible():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice("suat"), str(i), rng.choice(["", "", "truncated", "duplicate"])) for i in range(rng.randint(0, 9))]
        letters = "".join(C.letter(r, {"": 0, "duplicate": 1, "truncated": 2}[f]) for r, _, f in rows)
        assert C.cheapest(letters, C.EMPTY, True) == ((C.DONE, *plain_repair(rows)[:2]),)


@pytest.mark.parametrize("text,cut", [("a.", False), ("a. \n", False), ("a", True), ("a.b", True), ("?", False)])
def test_truncation(spark, text, cut):
    df = spark.createDataFrame([(1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    assert C.conversation_audits(df).first()["truncated"] == int(cut)
