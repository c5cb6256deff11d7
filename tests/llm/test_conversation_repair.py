"""Conversation repair against exhaustive search, in runs of any length, with dirty rows."""

import hashlib
import random
import re
import zlib

import pytest

from promptmill.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, symbol string, part int, c string, digest int, audit string"
EXTRA = (5, "s", 6, "c", 7, "x")


def _search(rows):
    """(cost, audit, lines) of the best repair by trying every edit; rows are (role, text, must go, truncated)."""
    best = {}

    def legal(initials):
        return re.fullmatch("(s?(ua)+)?", initials)

    def prefix(initials):
        return legal(initials) or legal(initials + "a") or legal(initials + "ua")

    def go(at, initials, cost, audit, lines, inserts):
        if not prefix(initials):
            return
        if at == len(rows) and legal(initials):
            key = (cost, audit)
            if not best or key < min(best):
                best[key] = lines
        if best and cost > min(best)[0]:
            return
        if inserts < 2:
            for made in ("user", "assistant"):
                go(at, initials + made[0], cost + 3, audit + "I", lines + [made + ":"], inserts + 1)
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            go(at + 1, initials, cost + 4, audit + "D", lines, 0)
            if not must_go:
                late = 3 * truncated
                if role:
                    go(at + 1, initials + role[0], cost + late, audit + "K", lines + [f"{role}:{text}"], 0)
                for made in ("user", "assistant"):
                    go(at + 1, initials + made[0], cost + 3 + late, audit + "R", lines + [f"{made}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    (cost, audit), lines = min(best.items())
    return cost, audit, lines


def _expected(rows):
    """The whole result of one conversation, from rows (turn, role, text) in any order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        ended = text.rstrip(" \t\n\x0b\x0c\r")
        if not ended:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if ended[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = _search([(r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(rows, faults)])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def _random_symbols(n, seed):
    r = random.Random(seed)
    return bytes(r.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8]) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_least_path_equals_search(seed):
    symbols = _random_symbols(seed % 6, seed)
    rows = [("?sua"[s & 3], "", s >= 8, bool(s & 4)) for s in symbols]
    cost, audit, _ = _search(rows)
    assert repair.solve(symbols) == (cost, audit)


@pytest.mark.parametrize("run", [1, 2, 3, 7, 64])
def test_runs_of_any_length_give_the_same_repair(run):
    for seed in range(40):
        symbols = _random_symbols(5 + 3 * seed, 1000 + seed)
        assert repair.solve(symbols, run) == repair.solve(symbols, 1 << 20)


def test_long_conversation_is_solved_in_bounded_runs():
    cost, audit = repair.solve(_random_symbols(60_000, 5))
    assert sum(c != "I" for c in audit) == 60_000 and cost > 0


CONVERSATIONS = {
    1: [(0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", "Hello."), (4, "user", "Bye")],
    2: [(None, "user", None), (None, None, "Lost."), (3, "assistant", "Yes!"), (3, "assistant", "Yes!"), (3, "assistant", "Yes?")],
    3: [],
    4: [(0, "user", ""), (1, "user", " \n"), (2, "user", "")],
    5: [(0, "", "No role."), (1, "tool", "Called."), (2, "uncle", "Odd.")],
    6: [(9, "assistant", "b."), (9, "assistant", "a."), (9, "user", "a."), (-9, "system", "Négative!")],
    None: [(0, "user", "One."), (0, "user", "One."), (1, "assistant", "Two. \t\n")],
    8: [(i, "user" if i % 2 == 0 else "assistant", "x" * 50_000 + ("." if i % 3 else "")) for i in range(4)],
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(c, t, r, x, *EXTRA) for c, of in CONVERSATIONS.items() for t, r, x in of], SCHEMA).repartition(4)


def test_dirty_conversations(spark, rows):
    ids = spark.createDataFrame([(c, *[None] * 3, *EXTRA) for c in CONVERSATIONS], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(rows, ids).collect()}
    assert got == {c: _expected(of)[0] for c, of in CONVERSATIONS.items()}
    without = {r[0]: tuple(r)[1:] for r in repair.repair(rows).collect()}
    assert without == {c: v for c, v in got.items() if c != 3}


def test_repaired_turns_are_what_was_hashed(rows):
    found = {}
    for r in repair.repaired_turns(rows).orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert len(found[r.conv_id]) == r.place + 1
    assert found == {c: lines for c, of in CONVERSATIONS.items() if (lines := _expected(of)[1])}


def test_damage_by_checksum(spark):
    given = [(c, t, "assistant", "Well. Yes!") for c in [None, *range(30)] for t in (None, 0, 1, 2)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in given], SCHEMA)
    want = []
    for c, t, role, text in given:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            changed = (c, t, "user" if fault == 4 else role, "" if fault == 1 else "Well Yes" if fault == 2 else text)
            want += [changed] * (2 if fault == 3 else 1)
    got = [tuple(r) for r in repair.damage(df).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damage(none), none).count() == 0 and repair.repaired_turns(none).count() == 0
