"""Conversation repair against dynamic programming over whole conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from conftest import SMALL

from quayline.llm import catalog, repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(initials, faults):
    """(cost, audit): the least of all, row by row, over the states."""
    best = {"": (0, "")}

    def with_inserts():
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                new = (cost + 5, audit + "I")
                best[DUE[state]] = min(best.get(DUE[state], new), new)

    for initial, fault in zip(initials, faults):
        with_inserts()
        now = {}

        def offer(state, *new):
            now[state] = min(now.get(state, new), new)

        for state, (cost, audit) in best.items():
            offer(state, cost + 2, audit + "D")
            if fault not in "bd":
                stays = 5 if fault == "t" else 0
                if (state, initial) in STEP:
                    offer(STEP[state, initial], cost + stays, audit + "K")
                offer(DUE[state], cost + 1 + stays, audit + "R")
        best = now
    with_inserts()
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    """Reports of (conv_id, turn, role, text) rows, after damage."""
    convs = {}
    blank = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own = convs.setdefault(conv, [])
        own += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return [report(conv, sorted(own)) for conv, own in convs.items()]


def report(conv, rows):
    seen, faults = set(), ""
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
    initials = [role[:1] for _, _, role, _ in rows]
    cost, audit = cheapest(initials, faults)
    state, i, lines = "", 0, []
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        state = STEP[state, initials[i]] if edit == "K" else DUE[state]
        role = rows[i][2] if edit == "K" else {"u": "user", "a": "assistant"}[state]
        lines.append(f"{role}:{'' if edit == 'I' else rows[i][3]}")
        i += edit != "I"
    turns = {turn for given, turn, _, _ in rows if given}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (
        conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def told(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, convs, longest):
    dice = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "User", "", None, "tool", "usher"]
    texts = ["Yes.", "No!", "why", "Well?", "", " \t", None, "a.b", "é", "So it is. ", "x\n\ny."]
    rows = []
    for conv in range(convs):
        for turn in range(dice.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if dice.random() < 0.7 else dice.choice(roles)
            text = f"{dice.choice(texts) or ''} {turn}." if dice.random() < 0.6 else dice.choice(texts)
            rows += [(conv, turn if dice.random() < 0.95 else dice.choice([None, turn + 7, turn - 3]), role, text)] * dice.choice([1, 1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(200))
def test_search_finds_the_least_of_the_cheapest(seed):
    dice = random.Random(seed)
    n = dice.randint(1, 14)
    initials = [dice.choice("suax") for _ in range(n)]
    faults = "".join(dice.choice("----bdt") for _ in range(n))
    cost, audit = cheapest(initials, faults)
    found, end = repair.searched(initials, faults)
    assert found + repair.TAIL[end] == audit
    costs = repair.transfer(initials, faults)
    assert min(costs[t] + repair.ENDS[t] for t in range(4)) == cost


def test_search_of_long_faulty_rows_ends():
    dice = random.Random(1)
    for initials in ("s" * 256, "a" * 256, "".join(dice.choice("suax") for _ in range(256))):
        faults = "".join(dice.choice("--bdt") for _ in range(256))
        found, end = repair.searched(initials, faults)
        assert found + repair.TAIL[end] == cheapest(initials, faults)[1]


@pytest.mark.parametrize("most", [1, 3, repair.SEGMENT])
def test_reports_are_those_of_whole_conversations(spark, most):
    rows = made(7, 60, 12) + [(None, None, "user", "a."), (None, 1, "assistant", "b."), (99, 0, None, None)]
    rows += [(500, i, ("user", "assistant")[i % 2], f"{i % 90}." if i % 5 else "cut") for i in range(700)]
    rows += [(501, 1, "user", "same.")] * 40 + [(c, 0, "user", "hello.") for c in range(1000, 1040)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", audit string")
    assert told(repair.after_damage(docs.repartition(4), most)) == sorted(expected(rows), key=str)


def test_empty_table_and_dropped_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert told(repair.after_damage(spark.createDataFrame([], SCHEMA))) == []
    found = told(repair.after_damage(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)))
    assert found == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_query_reports_the_whole_table(spark):
    rows = [tuple(r) for r in catalog.read_table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert told(catalog.op12_conversation_repair(spark, SMALL)) == sorted(expected(rows), key=str)
