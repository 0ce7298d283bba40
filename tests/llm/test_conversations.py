"""Operator 13 against a shortest path found state by state, audits compared as strings."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import conversations, queries

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits: a label per (row, roles so far), relaxed until nothing changes."""
    nxt = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}     # last role so far -> allowed
    best = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        changed = True
        while changed:                                     # inserts before row i
            changed = False
            for state in nxt:
                if (i, state) in best:
                    cost, audit, out = best[i, state]
                    for r in nxt[state]:
                        if r != "s":
                            new = (cost + 5, audit + "I", (*out, ("user" if r == "u" else "assistant") + ":"))
                            if (i, r) not in best or new[:2] < best[i, r][:2]:
                                best[i, r], changed = new, True
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for state in nxt:
            if (i, state) not in best:
                continue
            cost, audit, out = best[i, state]
            options = [(2, "D", state, None)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in nxt[state]:
                    options.append((more, "K", role[:1], role))
                options += [(1 + more, "R", r, "user" if r == "u" else "assistant") for r in nxt[state] if r != "s"]
            for c, letter, to, kept in options:
                new = (cost + c, audit + letter, out if kept is None else (*out, f"{kept}:{text}"))
                if (i + 1, to) not in best or new[:2] < best[i + 1, to][:2]:
                    best[i + 1, to] = new
    return min((best[len(rows), s] for s in ("", "a") if (len(rows), s) in best), key=lambda x: x[:2])


def plain(rows, ids):
    out = []
    for conv in ids:
        mine = [r[1:] for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in mine:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "blank" if BLANK.match(text) else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
            counts[fault] += 1
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, kept = cheapest(marked)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def run(spark, rows, ids=None, parts=4, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, id long, cost string").repartition(parts)
    ids = ids and spark.createDataFrame([(i,) for i in ids], "conv_id long")
    got = [tuple(r) for r in conversations.repair(df, ids, **more).collect()]
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversations(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain(damaged(rows), sorted({r[0] for r in rows}))


def made(rng, n, conv, odd=0.2):
    rows = []
    for k in range(n):
        role = ["system", "user", "assistant", "tool", ""][int(rng.integers(0, 5))] if rng.random() < odd else ("user", "assistant")[k % 2]
        text = ["", " \n", "same.", f"text {k}!", f"cut {k}", "same"][int(rng.choice(6, p=[.05, .05, .1, .6, .15, .05]))]
        rows.append((conv, k + int(rng.integers(0, 2)) * 3, role, text))
    return rows


@pytest.mark.parametrize("size", [conversations.ROWS, 1, 3, 10])
@pytest.mark.parametrize("odd", [0.15, 1.0])
def test_chunks_agree_with_one_path(spark, size, odd):
    rng = np.random.default_rng(int(size + 10 * odd))
    rows = made(rng, 160, 7, odd) + made(rng, 30, 1, odd) + made(rng, 1, 9, odd) + [r for c in range(20, 30) for r in made(rng, 5, c, odd)]
    ids = sorted({r[0] for r in rows}) + [1000]
    assert run(spark, rows, ids, size=size) == plain(rows, ids)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "q?"), (None, None, None, None), (None, 2, "assistant", "a."), (1, None, "user", "a."), (1, None, "user", "b."),
            (2, 5, "system", "s."), (3, 1, "system", "s."), (3, 2, "user", "cut"), (4, 1, "", "x."), (4, 9, "Assistant", "x."),
            (5, -(1 << 63), "user", "x."), (5, (1 << 63) - 1, "user", "y."), (6, 1, "user", "long. " * 300_000)]
    rows += [(8, 3, "user", "same.")] * 70 + [(9, k, "assistant", "same.") for k in range(50)] + [(11, 1, "usher", "é. ")]
    ids = [*{r[0]: 0 for r in rows}, 77]
    got = run(spark, rows, ids, size=8)
    want = [(*r[:1], r[1] if r[1] < 1 << 63 else None, *r[2:]) for r in plain([(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows], ids)]
    assert got == want and [r[1] for r in got if r[0] == 5] == [None]
    assert [r for r in got if r[0] == 77] == [(77, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert run(spark, []) == [] and run(spark, [], [3])[0][0] == 3


def test_damage_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [r for c in range(40) for r in made(rng, 12, c, 0.1)] + [(None, None, None, None), (None, 4, "user", "x."), (41, None, "user", "a. b! c?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in conversations.repair(conversations.damage(df), df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == plain(damaged(rows), [*range(40), 41, None])


@given(st.lists(st.integers(0, 7), max_size=14), st.lists(st.integers(0, 2), min_size=15, max_size=15), st.integers(0, 14))
@settings(max_examples=300, deadline=None)
def test_trace_finds_the_least_audit_from_any_cut(kinds, deleted, cut):
    names = ["system", "user", "assistant", "tool"]
    rows = []
    for k, kind in enumerate(kinds):
        rows += [("user", "", "blank")] * deleted[k] + [(names[kind & 3], f"{k}", "truncated" if kind & 4 else "")]
    rows += [("user", "", "blank")] * deleted[len(kinds)]
    cost, audit, kept = cheapest(rows)
    cut = min(cut, len(kinds))
    behind = conversations.backward(bytes(kinds[cut:]), conversations.END)
    a, rows_a, state = conversations.trace(bytes(kinds[:cut]), [*deleted[:cut], 0], behind, 0, False)
    b, rows_b, _ = conversations.trace(bytes(kinds[cut:]), deleted[cut:len(kinds) + 1], conversations.END, state, True)
    assert a + b == audit and cost == conversations.backward(bytes(kinds), conversations.END)[0] + 2 * sum(deleted[:len(kinds) + 1])
    out = [(role or names[kinds[k] & 3]) + ":" + (str(k) if k >= 0 else "") for k, role in rows_a]
    out += [(role or names[kinds[cut + k] & 3]) + ":" + (str(cut + k) if k >= 0 else "") for k, role in rows_b]
    assert tuple(out) == kept
