"""Conversation repair against all edits of short conversations, and odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repair


def best_by_trial(rows):
    """Least (cost, audit) over every way to edit, with up to two inserts at a place."""
    n, found = len(rows), None
    for kinds in itertools.product("DKR", repeat=n):
        for inserts in itertools.product(range(3), repeat=n + 1):
            cost, audit, roles = 0, "", ""
            options = [""]
            for j in range(n + 1):
                audit += "I" * inserts[j]
                cost += repair.INSERT * inserts[j]
                options = [o + x for o in options for x in map("".join, itertools.product("ua", repeat=inserts[j]))]
                if j == n:
                    break
                initial, delete, truncated = rows[j]
                audit += kinds[j]
                if kinds[j] == "D":
                    cost += repair.DELETE
                    continue
                if delete:
                    cost = 10 ** 9
                cost += (kinds[j] == "R") * repair.REROLE + truncated * repair.TRUNCATED
                options = [o + x for o in options for x in ([initial or "?"] if kinds[j] == "K" else "ua")]
            if found is not None and (cost, audit) >= found:
                continue
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                found = (cost, audit)
    return found


ROW = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.booleans(), st.booleans())


@settings(max_examples=80, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_cheapest_and_least_audit(rows):
    dp = repair.Repair()
    for r in rows:
        dp.add(*r)
    audit = "".join(e.edit for e in dp.finish())
    assert (dp.cost, audit) == best_by_trial(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(ROW, max_size=60), st.integers(1, 7))
def test_decided_edits_and_hash_collisions(rows, every):
    whole = repair.Repair()
    for r in rows:
        whole.add(*r)
    want = [(e.edit, e.row, e.role) for e in whole.finish()]
    for prime in (repair._PRIME, 3):  # modulo 3 most hashes collide
        held, repair._PRIME = repair._PRIME, prime
        try:
            parts, got = repair.Repair(), []
            for i, r in enumerate(rows):
                parts.add(*r)
                if i % every == 0:
                    got += parts.decided()
            got += parts.finish()
        finally:
            repair._PRIME = held
        assert [(e.edit, e.row, e.role) for e in got] == want and parts.cost == whole.cost


def test_memory_of_a_long_conversation_is_what_is_open():
    dp, rng, most = repair.Repair(), random.Random(5), 0
    for i in range(30_000):
        dp.add(rng.choice("uas"), rng.random() < 0.1, rng.random() < 0.1)
        if i % 500 == 0:
            dp.decided()
            most = max(most, max(n.depth for _, n in dp.layer.values()))
    assert most < 500


def reference(rows):
    """Counts and digests of one conversation's rows, by plain code."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    rows = [(t, r or "", x or "") for t, r, x in rows]
    seen, marks = set(), []
    for t, r, x in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", x)
        dup = not blank and (r, x) in seen
        cut = not blank and not dup and re.findall(r"[^\x20\x09-\x0D]", x)[-1] not in ".!?"
        marks.append((r[:1], blank, dup, cut))
        seen.add((r, x))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    cost, audit = best_by_trial([(i, b or d, c) for i, b, d, c in marks])
    out, j, kept = [], 0, 0
    for e in audit:
        row = rows[j] if e != "I" else ("", "", "")
        j += e != "I"
        if e == "D":
            continue
        if e == "K" and row[1][:1] == "s":
            out.append((row[1], row[2]))
            continue
        out.append((row[1] if e == "K" else ("user", "assistant")[kept % 2], row[2]))
        kept += 1
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(m[1] for m in marks), sum(m[2] for m in marks),
            sum(m[3] for m in marks), illegal, cost, audit, sha), out


@pytest.mark.parametrize("hold", [1, 4096])
def test_odd_rows(spark, monkeypatch, hold):
    monkeypatch.setattr(repair, "HOLD", hold)
    long = "x" * 200_000 + "."
    rows = [(1, 0, "system", "Be brief."), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 5, "assistant", long),
            (2, None, None, None), (2, None, "user", "a."), (2, 1, "user", "a."), (2, 3, "assistant", "cut off"),
            (None, 0, "user", "q?"), (None, 9, "assistant", "é!  "), (3, 1, "", ""), (4, 1, "tool", "t."), (4, 2, "assistant", "漢."),
            (4, 2, "assistant", "漢."), (4, None, "assistant", "漢.")]
    schema = "conv_id long, turn long, role string, text string, later string, said string, step int, _conv int"
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], schema)
    want = {c: reference([r[1:] for r in rows if r[0] == c]) for c in (1, 2, None, 3, 4)}
    got = {r[0]: tuple(r)[1:] for r in repair.audits(df).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    edits = repair.edits(df).orderBy("conv_id", "step").collect()
    for c, (summary, out) in want.items():
        mine = [e for e in edits if e.conv_id == c]
        assert "".join(e.edit for e in mine) == summary[6] and [e.step for e in mine] == list(range(len(mine)))
        assert [(e.role, e.text) for e in mine if e.edit != "D"] == out
    assert repair.audits(df.limit(0)).count() == 0 and repair.edits(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(i, j, "assistant" if j % 2 else "user", f"A. b! c? {i}") for i in range(20) for j in range(6)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=key) == sorted(want, key=key)
