"""Conversation repair against a search over whole suffixes."""

import random
import re
import sys
import zlib
from functools import cache
from hashlib import sha256

import pytest

from lexiframe.llm import conversations as cv
from lexiframe.llm import queries
from lexiframe.sources.tables import table

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, part string, CONV int"


def damaged(rows):
    """Rows (conv, turn, role, text) after their faults, by conversation."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        kept = out.setdefault(conv, [])
        blank = lambda x: " " if x is None else x
        role, text = blank(role), blank(text)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def best(rows):
    """What the contract asks of one conversation, its rows after damage being given."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(k, last, added):
        """Least (cost, edits, turns) of rows from k on."""
        ways = []
        if added < 2:
            for role in ("user", "assistant"):
                if role[0] in legal[last]:
                    c, e, o = rest(k, role[0], added + 1)
                    ways.append((c + 2, "I" + e, (role + ":", *o)))
        if k == len(rows):
            return min([*ways, (0, "", ()) if last in ("", "a") else (9**9, "", ())])
        _, role, text = rows[k]
        c, e, o = rest(k + 1, last, 0)
        ways.append((c + 3, "D" + e, o))
        if faults[k] not in ("blank", "duplicate"):
            late = faults[k] == "truncated"
            for new, cost, edit in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                if new[:1] and new[0] in legal[last]:
                    c, e, o = rest(k + 1, new[0], 0)
                    ways.append((c + cost + late, edit + e, (f"{new}:{text}", *o)))
        return min(ways)

    cost, audit, turns = rest(0, "", 0)
    known = {t for t, _, _ in rows if t is not None}
    pairs = zip(rows, rows[1:])
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), "cost": cost,
            "audit": audit, "repaired_sha256": sha256("\n".join(turns).encode()).hexdigest()}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " ", "", None, "What? ", "It is.\n", "It is", "a\x0b", "Ok!"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Sam"]
    rows = []
    for conv in [None, *range(conversations)]:
        for k in range(rng.randint(0, longest)):
            turn = None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 1])
            role = rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles)
            text = f"{rng.random()}." if rng.random() < 0.5 else rng.choice(texts)
            rows += [(conv, turn, role, text, "x", 1)] * rng.choice([1, 1, 1, 1, 2])
    return rows


def found(pieces):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"}
            for r in cv.reports(pieces).collect()}


@pytest.mark.parametrize("piece_rows", [4096, 3])
def test_repair_is_the_best(spark, piece_rows):
    """Whole in one task, and cut in pieces of three rows that go the long way."""
    rows = [r for r in random_rows(5, 150, 14)]
    by_conv = {}
    for conv, turn, role, text, *_ in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = found(cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), piece_rows=piece_rows))
    want = {conv: best(own) for conv, own in by_conv.items()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], by_conv[conv]


def test_one_conversation_over_many_tasks(spark):
    """Half of all rows are one conversation; its texts, some of them common, lie in many pieces."""
    rng = random.Random(3)
    hot = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["Hi.", "Yes", f"{k}."])) for k in range(700)]
    rows = hot + [(100 + k, t, "user", "Hi.") for k in range(300) for t in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = found(cv.repair(frame, piece_rows=40, piece_bytes=400))
    assert got[7] == best([r[1:] for r in hot]) and len(got) == 301
    assert got[200] == best([(t, "user", "Hi.") for t in range(2)])


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "system", ""), (2, 5, "tool", "x" * 300_000)]
    pieces = cv.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    said = {r["conv_id"]: (r["audit"], [tuple(t) for t in r["said"]]) for r in pieces.collect()}
    assert said[1] == ("DKDI", [("user", "There."), ("assistant", "")]) or said[1][0] == best(
        [(0, "user", "Hi."), (1, "user", "There."), (2, "system", "")])["audit"]
    assert said[2] == (best([(5, "tool", "x" * 300_000)])["audit"], [])


def test_no_rows_and_odd_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair(empty).count() == 0 and cv.reports(cv.repair(empty)).count() == 0
    assert cv.damage(empty).count() == 0
    named = spark.createDataFrame([("x", 1, "p", "Hi.", "u")], "part string, piece int, more string, said string, a string")
    pieces = cv.repair(named, conv="part", turn="piece", role="more", text="said")
    row = pieces.first()
    assert (row["conv_id"], row["part"], row["piece"]) == ("x", 0, 0) and row["audit"] == best([(1, "p", "Hi.")])["audit"]


def test_query_against_search(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").collect()]
    want = {conv: best(own) for conv, own in damaged(rows).items()}
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"}
           for r in queries.op12_conversations(spark, small).collect()}
    assert got == want
