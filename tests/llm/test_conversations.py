"""Conversation repair against a search through all edits, and damage against its definition."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cartomill.llm import conversations
from cartomill.llm.conversations import damaged, flagged, op12_conversations, repaired_conversations, repairs

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All ways: a trie walk over edits with up to two insertions before each row and at the end."""
    marks, best = faults(rows), None
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, letters)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost = 3 * sum(gaps) + sum({"K": 0, "R": 3, "D": 4}[e] + (3 if m == "truncated" and e != "D" else 0) for e, m in zip(letters, marks))
            audit = "".join("I" * g + e for g, e in zip(gaps, letters)) + "I" * gaps[-1]
            if best and (cost, audit) >= best[:2]:
                continue
            lines, row = [], 0
            for e in audit:
                if e == "I":
                    lines.append((None, ""))
                else:
                    if e != "D":
                        lines.append((rows[row][0] if e == "K" else None, rows[row][1]))
                    row += 1
            shift = 1 if lines and lines[0][0] and lines[0][0][:1] == "s" else 0
            lines = [(role if role is not None else "user" if (i - shift) % 2 == 0 else "assistant", text) for i, (role, text) in enumerate(lines)]
            if FORM.fullmatch("".join(role[:1] or "-" for role, _ in lines)):
                best = (cost, audit, "\n".join(f"{role}:{text}" for role, text in lines))
    return best


def plain(rows, original):
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        pairs = [r[1:] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        marks = faults(pairs)
        cost, audit, text = cheapest(pairs)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)), cost, audit, text))
    return sorted(out, key=repr)


def cases(seed, n=40):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "no", " ", "", None, "A! \n", "x.  ", "ä?\t"]
    weights = [6, 6, 3, 1, 1, 1, 1]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(6)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None, -3]), rng.choices(roles, weights)[0], rng.choice(texts)))
        if rng.random() < 0.2 and rows:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 2), (2, 256)])
def test_equals_all_edits(spark, monkeypatch, seed, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = cases(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, repairs(flagged(damaged(df))).collect()), key=repr) == plain(plain_damage(rows), rows)
    clean = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
    assert sorted(map(tuple, repaired_conversations(df).collect()), key=repr) == plain(clean, rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, *range(30)) for t in (None, 0, 1, 2)]
    got = damaged(spark.createDataFrame(rows, SCHEMA)).where("NOT gone").drop("gone")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_damage(rows), key=repr)


def test_long_conversation_over_many_blocks(spark):
    """Blocks give what one fold gives, and a clean conversation costs nothing."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(2_000)]
    rows += [(2, i, "user" if i % 7 else "system", f"{i}" if i % 5 else f"{i}.") for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in repaired_conversations(df).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "K" * 2_000)
    old, conversations.BLOCK = conversations.BLOCK, 10_000
    try:
        assert {r["conv_id"]: r for r in repaired_conversations(df).collect()} == got
    finally:
        conversations.BLOCK = old


def test_very_long_text_extreme_turns_and_nothing_left(spark, tmp_path):
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (-1, -(1 << 62), "user", "w " * 300_000 + "."), (-1, 1 << 62, "assistant", "Yes." + " " * 300_000)]
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("kind", "gone", "copy", "bare", "initial", "fault", "again", "turns", "best", "cost", "audit")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op12_conversations(spark, str(tmp_path)).collect()}
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", NOTHING)
    assert got[-1]["gaps"] == (1 << 63) - 1 and got[-1]["audit"] == "KK"


def test_empty(spark):
    assert repairs(flagged(damaged(spark.createDataFrame([], SCHEMA)))).collect() == []
