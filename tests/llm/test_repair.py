from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pixelloom.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, own string, kind int, sig string"
LEGAL_ROLES = re.compile(r"(s?(ua)+)?")


def cheapest(sig):
    """Least (cost, letters) by trying every edit of every row with every number of inserted rows, without layers or ranks."""
    best = None
    edits = []
    for x in sig:
        if x == "x":
            edits.append([("D", "", 2)])
        else:
            more, own = 5 * x.isupper(), x.lower()
            edits.append([("D", "", 2), ("R", "u", 1 + more), ("R", "a", 1 + more), *([("K", own, more)] if own != "o" else [])])
    gaps = ["", "u", "a", "ua", "au"]
    for picked in itertools.product(*edits):
        for ins in itertools.product(gaps, repeat=len(sig) + 1):
            roles = ins[0] + "".join(e[1] + g for e, g in zip(picked, ins[1:]))
            if LEGAL_ROLES.fullmatch(roles):
                found = (sum(e[2] for e in picked) + 5 * sum(map(len, ins)), "I" * len(ins[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(picked, ins[1:])))
                best = found if best is None or found < best else best
    return best


def layered(sig):
    """Least (cost, letters) with whole texts per state: rows and inserts one at a time, until nothing gets better."""
    state = {"": (0, "")}
    grow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(layer):
        todo = list(layer)
        while todo:
            s = todo.pop()
            for r in grow[s]:
                new = (layer[s][0] + 5, layer[s][1] + "I")
                if r != "s" and (r not in layer or new < layer[r]):
                    layer[r] = new
                    todo.append(r)
        return layer

    for x in sig:
        nxt = {}
        for s, (cost, audit) in insert(dict(state)).items():
            ways = [(s, 2, "D")]
            if x != "x":
                more = 5 * x.isupper()
                ways += [(r, (0 if op == "K" else 1) + more, op) for r in grow[s] for op in ("KR" if r == x.lower() and r != "s" else "K" if r == x.lower() else "R" if r != "s" else "")]
            for r, c, op in ways:
                new = (cost + c, audit + op)
                if r not in nxt or new < nxt[r]:
                    nxt[r] = new
        state = nxt
    return min(v for s, v in insert(state).items() if s in ("", "a"))


def test_short_signatures_by_all_edits():
    trie = rp.Trie()
    for n in range(4):
        for sig in map("".join, sorted(itertools.product("AOSUaosux", repeat=n))):
            if n < 3 or zlib.crc32(sig.encode()) % 9 == 0:
                assert trie.solve(sig) == cheapest(sig) == layered(sig), sig


def test_long_signatures_share_prefixes():
    rng = random.Random(3)
    start = "".join(rng.choice("uauauasoxUA") for _ in range(120))
    sigs = sorted({start[: rng.randrange(100, 120)] + "".join(rng.choice("AOSUaosux") for _ in range(rng.randrange(40))) for _ in range(300)})
    trie = rp.Trie()
    for s in sigs:
        assert trie.solve(s) == layered(s), s
    assert trie.made < 0.3 * sum(map(len, sigs))


def plain(rows, lost=()):
    """The contract for damaged (conv_id, turn, role, text) rows, in plain Python; ``lost``: conversations without rows."""
    out = []
    for conv in {r[0] for r in rows} | set(lost):
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            kept = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
        ini = [r[1][:1] for r in own]
        sig = "".join("x" if f in ("b", "d") and f else (i if i and i in "sua" else "o").upper() if f == "t" else i if i and i in "sua" else "o" for i, f in zip(ini, faults))
        cost, audit = layered(sig)
        lines, at, state = [], 0, ""
        for op in audit:
            if op == "I":
                state = "a" if state == "u" else "u"
                lines.append(("assistant" if state == "a" else "user") + ":")
                continue
            _, role, text = own[at]
            at += 1
            if op == "K":
                state = role[0]
                lines.append(f"{role}:{text}")
            elif op == "R":
                state = "a" if state == "u" else "u"
                lines.append(("assistant" if state == "a" else "user") + f":{text}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def broken(rows):
    """``damage`` in plain Python: rows, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out, {r[0] for r in rows}


def random_rows(n, convs, seed):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "Why?", "cut", "cut off ", "\n\t", "", None, "Größe. ", "a.b\x0b", "東京。", "ok? ", ". "]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User", "user"]), rng.choice(words)) for _ in range(n)]


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "o", 2, "s") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_with_nulls_ties_and_repeats(spark, seed):
    rows = random_rows(400, 30, seed)
    assert result(rp.repair(frame(spark, rows))) == plain(rows)
    left, ids = broken(rows)
    assert result(rp.repair(rp.damage(frame(spark, rows)), gone="gone")) == plain(left, ids)


def test_one_conversation_holds_most_rows_and_a_long_text(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Line {i % 1500}.") for i in range(4000)] + [(8, 0, "user", "x" * 500_000 + "?"), (8, 1, "assistant", "Good.")]
    got = result(rp.repair(frame(spark, rows)))
    assert got == plain(rows) and [r[3] for r in got if r[0] == 7] == [2500]


def test_empty_table_and_extreme_turns(spark):
    assert rp.repair(frame(spark, [])).count() == 0
    assert result(rp.repair(rp.damage(frame(spark, [])), gone="gone")) == []
    wide = [(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Ho.")]
    assert result(rp.repair(frame(spark, wide)))[0][1] == 2**63 - 1
