"""Structure repair against a search over all edits, and the rules of damage and faults."""

import hashlib
import random
import re
import zlib

import pytest

from sweepfield.llm import structure_repair as sr
from sweepfield.llm.catalog import op13_structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos string"
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}


def search(turns):
    """Least (cost, audit) over all edits; ``turns`` holds (role kind, fault)."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    reached = {"": (0, "")}

    def add(into, state, cost, audit):
        if state is not None and (state not in into or (cost, audit) < into[state]):
            into[state] = (cost, audit)
            return True
        return False

    def inserts(states):
        grown = True
        while grown:
            grown = False
            for state, (cost, audit) in list(states.items()):
                for role in "ua":
                    grown |= add(states, follow.get((state, role)), cost + 2, audit + "I")

    for role, fault in turns:
        inserts(reached)
        after = {}
        for state, (cost, audit) in reached.items():
            add(after, state, cost + 3, audit + "D")
            if fault < 2:
                for new in "ua":
                    add(after, follow.get((state, new)), cost + 2 + fault, audit + "R")
                add(after, follow.get((state, role)), cost + fault, audit + "K")
        reached = after
    inserts(reached)
    return min(reached[s] for s in ("", "a") if s in reached)


def test_runs_equal_the_search():
    rng, solver = random.Random(13), sr.Solver()
    for _ in range(600):
        turns = []
        while len(turns) < rng.randint(0, 14):
            turns += [(rng.choice("suao"), rng.choice([0, 0, 0, 1, 2]))] * rng.choice([1, 1, 1, 2, 5])
        assert solver.solve("".join(sr.symbol(*t) for t in turns)) == search(turns)
    for length in (63, 64, 65, 700):
        for turn in (("u", 0), ("a", 1), ("o", 0), ("s", 0), ("u", 2)):
            assert solver.solve(sr.symbol(*turn) * length) == search([turn] * length)


def test_a_long_run_takes_few_steps():
    solver = sr.Solver()
    cost, audit = solver.solve(sr.symbol("u", 0) * 1_000_000)
    assert cost == 1_000_000 and set(audit) <= set("KRDI") and len(solver.powers) < 40


def expected(rows, damaged=True):
    """By conversation: what the query returns."""
    space = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, text, *_ in rows:
        own = found.setdefault(conv, [])
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damaged else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, faults = [t for t, *_ in own if t is not None], []
        for i, (_, role, text) in enumerate(own):
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in [r[1:] for r in own[:i]] else "" if solid[-1] in ".!?" else "truncated")
        kinds = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in own]
        rank = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
        cost, audit = search([(k, rank[f]) for k, f in zip(kinds, faults)])
        made, left = [], list(own)
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit in "IR":
                role = "assistant" if made and made[-1][0][0] == "u" else "user"
            if edit != "D":
                made.append((role, text))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip([r[1][:1] for r in own], [r[1][:1] for r in own][1:]))
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(), made)
    return found


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Fine.", "why?", "so it goes", " \t\n", "", "A. B", None, "Ok! ", "é…", "long " * 300 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text, "x", "y"))
    rows += [(None, t, "user", f"hi {t}.", "x", "y") for t in range(5)] + [(90, None, "user", "a.", "x", "y")] * 3
    return rows + [(91, i, "user" if i % 3 else "system", "go on.", "x", "y") for i in range(400)]


@pytest.mark.parametrize("piece", [sr.PIECE, 4])
def test_summary_equals_the_loop(spark, piece, monkeypatch):
    monkeypatch.setattr(sr, "PIECE", piece)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in sr.summary(df, sr.damage(df)).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}


def test_repaired_turns(spark):
    rows = conversations(6)
    df = spark.createDataFrame(rows, SCHEMA)
    plans, turns = sr.repair(df)
    want = expected(rows, damaged=False)
    got = {}
    for r in turns.orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: v[-1] for k, v in want.items() if v[-1]}
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {k: v[5:7] for k, v in want.items()}


def test_no_turns(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert sr.summary(df, sr.damage(df)).count() == 0 and sr.repair(df)[1].count() == 0
    # Dropped altogether: a row of zeros.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in op13_structure_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
