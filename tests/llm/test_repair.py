"""Conversation repair against a plain recursion over the grammar's states."""

import hashlib
import random
import re
import zlib

import pytest

from terrajobs.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, kind string, position int"
NEXT = (2, 2, 3, 2)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NAMES = {2: "user", 3: "assistant"}


def plain_edits(rows):
    """(cost, audit, lines) for rows (role, text, must go, truncated): least cost, then audit."""
    none = (10**9, "", ())
    best = [(0, "", ()), none, none, (0, "", ())]

    def closed(values):
        for _ in range(4):
            for g in range(4):
                cost, audit, lines = values[NEXT[g]]
                values[g] = min(values[g], (cost + 3, "I" + audit, (f"{NAMES[NEXT[g]]}:", *lines)))
        return values

    best = closed(best)
    for role, text, gone, cut in reversed(rows):
        values = []
        for g in range(4):
            options = [(best[g][0] + 4, "D" + best[g][1], best[g][2])]
            if not gone:
                more, to = 3 * cut, best[NEXT[g]]
                options.append((to[0] + 3 + more, "R" + to[1], (f"{NAMES[NEXT[g]]}:{text}", *to[2])))
                if (role[:1], g) in KEPT:
                    to = best[KEPT[role[:1], g]]
                    options.append((to[0] + more, "K" + to[1], (f"{role}:{text}", *to[2])))
            values.append(min(options))
        best = closed(values)
    return best[0]


def plain_digest(rows):
    """The whole contract for one conversation's (conv_id, turn, role, text)."""
    damaged = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns, seen, judged = {t for t, _, _ in damaged if t is not None}, set(), []
    blank = duplicate = truncated = 0
    for _, role, text in damaged:
        solid = text.strip(" \t\n\v\f\r")
        if not solid:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif solid[-1] not in ".!?":
            truncated += 1
        judged.append((role, text, not solid or (role, text) in seen, bool(solid) and solid[-1] not in ".!?"))
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:], strict=False))
    cost, audit, lines = plain_edits(judged)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(70)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Å"])
            text = rng.choice(["Yes.", "No", "a.b", " \n", "", None, "Ωmega!\n", "why?\u0085", "x" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text, "k", 1))
    rows += rows[:40] + [(500, t, "user", "same.", "k", 1) for t in range(60)] + [(501, None, "user", "same.", "k", 1)] * 5
    return rows


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    roles = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(4000):
        symbols = bytes(rng.choice([0, 1, 2, 3, 2, 3, 6, 7, 4, 8, 10, 11]) for _ in range(rng.randrange(9)))
        want = plain_edits([(roles[s & 3], "t", bool(s & 8), bool(s & 4)) for s in symbols])
        assert R.cheapest_edits(symbols) == want[:2]
    assert R.cheapest_edits(b"") == (0, "")
    assert R.cheapest_edits(bytes([1, 2, 3] + [2, 3] * 5000)) == (0, "K" * 10003)


def test_digests(spark):
    rows = conversations()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    got = R.digests(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = got.collect()
    assert len(got) == len(by)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: plain_digest(v) for c, v in by.items()}
    empty = [r for r in got if not r.audit]
    assert all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.cost == 0 for r in empty)


def test_repaired_turns(spark):
    """The operator's own output: legal conversations, kept and changed rows in order."""
    df = spark.createDataFrame(conversations(), SCHEMA)
    found = R.audits(df).collect()
    turns = {}
    for r in R.repaired(df).collect():
        turns.setdefault(r.conv_id, []).append(r)
    for report in found:
        own = sorted(turns.get(report.conv_id, []), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert [r.edit for r in own] == [e for e in report.audit if e != "D"]
        assert all(r.text == "" for r in own if r.edit == "I")
    assert R.audits(df.limit(0)).count() == R.repaired(df.limit(0)).count() == R.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_conversation_repair"])
def test_sql(spark, sf_dir, name):
    import duckdb

    from terrajobs.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
