"""Conversation repair against a plain search over all edits, with nulls, blanks, ties, repeated rows and long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from stridelake.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, n string, sha int, conv int"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """Cheapest edits by dynamic programming over (what is written so far, in short), kept apart from the operator's states."""
    rows = ordered(rows)
    marks = faults(rows)
    best = {"": (0, "", ())}  # by the last two initials written

    def keep(table, key, new):
        if key not in table or new[:2] < table[key][:2]:
            table[key] = new

    def legal(key, c):
        return c == "s" and key == "" or c == "u" and key[-1:] in ("", "s", "a") or c == "a" and key[-1:] == "u"

    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, lines) in list(table.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    if legal(key, c):
                        keep(table, c, (cost + 2, audit + "I", (*lines, name + ":")))
        return table

    for (_, _, role, text), fault in zip(rows, marks):
        now = {}
        for key, (cost, audit, lines) in inserted(best).items():
            keep(now, key, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if legal(key, role[:1]):
                    keep(now, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if legal(key, c):
                        keep(now, c, (cost + 2 + more, audit + "R", (*lines, f"{name}:{text}")))
        best = now
    cost, audit, lines = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    assert GOOD.match("".join(x[0] for x in lines))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows):
    after = damaged(rows)
    return sorted(str((c, *plain([r for r in after if r[0] == c]))) for c in {r[0] for r in rows})


def conversation(conv, n, rng):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "No", " \n\t", "", None, "Why?", "é!", "one. two ", "漢字", "\x1c"]
    turns = [None, *range(n)]
    some = [(conv, rng.choice(turns), rng.choice(roles[: rng.choice([2, 8])]), rng.choice([*texts, f"Line {rng.random()}.", f"Part {rng.random()}"])) for _ in range(n)]
    return some + some[: rng.randint(0, 2)]


@pytest.mark.parametrize("segment", [512, 3])
def test_repair(spark, segment, monkeypatch):
    rng = random.Random(segment)
    rows = [r for c in range(120) for r in conversation(None if c == 7 else c, rng.randint(1, 14), rng)] + conversation(500, 900, rng)
    rows += [(600, t, "user", "Again.") for t in range(300)] + [(601, 5, "assistant", "Same.")] * 40 + [(602, t, ("user", "assistant")[t % 2], f"Fine {t}.") for t in range(1500)]
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    assert sorted(str(tuple(r)) for r in conversations.repair_conversations(df).collect()) == expected(rows)


def test_nothing_left_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversations.repair_conversations(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_conversations(df.filter("false")).count() == 0
    assert [r["audit"] for r in conversations.repair_conversations(df, damage=False).collect()] == ["KI"]


def test_joined_segments_are_the_whole():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice("sua x"), rng.random() < 0.2, rng.random() < 0.2, rng.choice([0, 0, 0, 2])) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(rows))
        ways = [[{"from": s, "to": q, "cost": c, "audit": a} for s in conversations.NEXT for q, (c, a) in conversations.lightest(part, s).items()] for part in (rows[:cut], rows[cut:])]
        end = conversations.joined(conversations.joined({conversations.START: (0, "")}, ways[0]), ways[1])
        whole = conversations.lightest(rows, conversations.START)
        accept = conversations.START, conversations.ASSISTANT
        assert min(v for q, v in end.items() if q in accept) == min(v for q, v in whole.items() if q in accept)
