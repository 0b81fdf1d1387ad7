"""Repair of conversation structure: the cheapest edits that give roles of the form ``(s?(ua)+)?``.

What the cheapest edits are depends only on a conversation's signature, one letter a row for its role and fault.  Signatures are
made distinct and sorted over the cluster; a task walks its sorted range as a prefix trie, keeps one layer of the
dynamic program for each letter of the path it stands on, and adds layers only where a signature leaves the one before, so that a shared
prefix is solved once.  Answers are emitted where a signature ends and are joined back to conversations.

Texts are shuffled once.  A first pass over digests (role initial, fault, hash of role and text) makes the signatures; a second streams the texts of a
conversation behind its answer and hashes the repaired one.  The hash of a whole conversation can't be split, so a conversation is one stream, in one task;
what a task holds of it is its signature and answer (a byte a row) and the hashes of rows seen, never its texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, col, drop_stored, stored, tidied

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LONGEST = 2**63 - 1
SPACES = " \t\n\x0b\x0c\r"

# -- the automaton of roles: 0 nothing yet, 1 a system row, 2 a user row, 3 an assistant row ------------------------
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role may follow: system only at the start, user after all but a user, assistant after a user.
FOLLOWS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Inserted rows before a row, or at the end: (from, to, letters).  More than two would come back to where they were.
INSERTS = [(s, s, "") for s in range(4)] + [(START, USER, "I"), (SYSTEM, USER, "I"), (USER, ASSISTANT, "I"), (ASSISTANT, USER, "I"), (START, ASSISTANT, "II"), (SYSTEM, ASSISTANT, "II")]
LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


@functools.cache
def moves(symbol: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, letters) of the edits that take one row: ``x`` has to go, capitals are truncated, ``o`` is any other role."""
    ops = [(s, s, DELETE, "D") for s in range(4)]
    if symbol != "x":
        extra, own = TRUNCATED * symbol.isupper(), LETTER.get(symbol.lower())
        ops += [(s, own, KEEP + extra, "K") for s in FOLLOWS.get(own, ())]
        ops += [(s, role, REROLE + extra, "R") for role in (USER, ASSISTANT) for s in FOLLOWS[role]]
    return tuple((a, d, INSERT * len(ins) + cost, ins + op) for a, b, ins in INSERTS for c, d, cost, op in ops if b == c)


#: Per state (cost over the layer's least, place of its edits' letters among the states' in ASCII order), None if it can't be reached.
Profile = tuple[tuple[int, int] | None, ...]
ROOT: Profile = ((0, 0), None, None, None)


@functools.lru_cache(1 << 16)
def step(profile: Profile, symbol: str) -> tuple[int, Profile, tuple[tuple[int, str] | None, ...]]:
    """One more row: what the least cost grows by, the next profile, and per state where it comes from and by which letters.

    Letters kept in a layer end with a row's edit, so none of two states' is the beginning of the other's, and their
    order decides whatever follows; letters from one state differ in their new part alone.
    """
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    for a, b, cost, letters in moves(symbol):
        if profile[a] is not None:
            new = (profile[a][0] + cost, profile[a][1], letters, a)
            if best[b] is None or new < best[b]:
                best[b] = new
    least = min(x[0] for x in best if x)
    order = sorted((x[1], x[2], s) for s, x in enumerate(best) if x)
    place = {s: k for k, (_, _, s) in enumerate(order)}
    return least, tuple((x[0] - least, place[s]) if x else None for s, x in enumerate(best)), tuple((x[3], x[2]) if x else None for x in best)


def finish(profile: Profile) -> tuple[int, int, str]:
    """(cost over the layer's least, state, letters of the last inserted rows) of the best way to end."""
    ends = [(profile[a][0] + INSERT * len(ins), profile[a][1], ins, a) for a, b, ins in INSERTS if profile[a] is not None and b in (START, ASSISTANT)]
    cost, _, ins, a = min(ends)
    return cost, a, ins


class Trie:
    """The path of a sorted walk: one layer a letter, those of a shared prefix are kept."""

    def __init__(self) -> None:
        self.path, self.layers, self.made = "", [(0, ROOT, None)], 0

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and letters of the cheapest edits; ties go to the ASCII-least letters."""
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            base, profile, _ = self.layers[-1]
            more, after, back = step(profile, symbol)
            self.layers.append((base + more, after, back))
        self.made += len(signature) - shared
        self.path = signature
        base, profile, _ = self.layers[-1]
        cost, state, tail = finish(profile)
        parts = [tail]
        for _, _, back in reversed(self.layers[1:]):
            state, letters = back[state]
            parts.append(letters)
        return base + cost, "".join(reversed(parts))


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """sig, cost, audit of distinct signatures: sorted ranges, each walked as a trie."""
    @tidied
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            sigs = batch.column(0).to_pylist()
            found = [trie.solve(s) for s in sigs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["sig", "cost", "audit"])

    return signatures.select("sig").distinct().repartitionByRange("sig").sortWithinPartitions("sig").mapInArrow(walk, "sig string, cost long, audit string")


# -- rows ----------------------------------------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` as the query breaks them: conv_id, turn, role, text, gone (the row was dropped; it only names its conversation).

    By crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.  Nulls
    count as one space.
    """
    space = F.lit(" ")
    part = lambda name: F.coalesce(col(rows, name).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(part("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    out = rows.select(col(rows, "conv_id").cast("long").alias("conv_id"), col(rows, "turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))


FACTS = "conv_id long, n long, gaps long, blank long, duplicate long, truncated long, illegal long, sig string"
LEGAL = {"su", "ua", "au"}


def _signatures(rows: DataFrame) -> DataFrame:
    """A row per conversation: counts and signature, from digests alone."""
    text = F.col("text")
    ended = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    blank = ~text.rlike(SPACE_CLASS.replace("[", "[^"))
    fault = F.when(blank, F.lit("b")).when(ended, F.lit("")).otherwise(F.lit("t"))
    slim = rows.select("conv_id", "gone", "turn", "role", "own", F.concat(_initial(F.col("role")), fault).alias("about"))
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", "gone", F.col("turn").asc_nulls_first(), "role", "own").select("conv_id", "gone", "turn", "own", "about")

    @tidied
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, began = None, [], False
        fresh = lambda conv: {"conv": conv, "n": 0, "turns": 0, "low": None, "high": None, "b": 0, "d": 0, "t": 0, "illegal": 0, "last": None, "seen": set(), "sig": []}

        def close():
            gaps = 0 if now["low"] is None else min(now["high"] - now["low"] + 1 - now["turns"], LONGEST)
            done.append((now["conv"], now["n"], gaps, now["b"], now["d"], now["t"], now["illegal"], "".join(now["sig"])))

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*done))], names=["conv_id", "n", "gaps", "blank", "duplicate", "truncated", "illegal", "sig"])
            done.clear()
            return out

        for batch in batches:
            for conv, gone, turn, own, about in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not began or conv != now["conv"]:
                    if began:
                        close()
                    now, began = fresh(conv), True
                if gone:
                    continue
                now["n"] += 1
                if turn is not None and turn != now["high"]:  # turns come in order
                    now["turns"] += 1
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                initial, fault = about[0], about[1:]
                if now["last"] is not None and now["last"] + initial not in LEGAL:
                    now["illegal"] += 1
                now["last"] = initial
                if fault != "b" and own in now["seen"]:
                    fault = "d"
                now["seen"].add(own)
                if fault:
                    now[fault] += 1
                now["sig"].append("x" if fault in ("b", "d") else initial.upper() if fault else initial)
            if len(done) >= 2000:
                yield emit()
        if began:
            close()
        if done:
            yield emit()

    return slim.mapInArrow(scan, FACTS)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _hashed(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts and answers with the hash of the repaired text, which streams by behind its answer."""
    none = lambda kind: F.lit(None).cast(kind)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    head = facts.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), F.lit("").alias("role"), none("binary").alias("own"), F.col("audit").alias("text"), F.array(*numbers).alias("numbers"))
    body = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "own", "text", none("array<bigint>").alias("numbers"))
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "own")
    both = both.select("conv_id", "kind", "role", "text", "numbers")

    @tidied
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv = audit = numbers = digest = None
        at, state, first, began = 0, START, True, False

        def put(role: str, text: str):
            nonlocal first
            digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
            first = False

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = ASSISTANT if state == USER else USER
                put("assistant" if state == ASSISTANT else "user", "")
                at += 1

        def close():
            inserted()
            done.append((conv, *numbers, audit, digest.hexdigest()))

        def emit():
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])
            done.clear()
            return out

        for batch in batches:
            for id_, kind, role, text, facts_ in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if kind == 0:
                    if began:
                        close()
                    conv, audit, numbers, digest = id_, text, facts_, hashlib.sha256()
                    at, state, first, began = 0, START, True, True
                    continue
                inserted()
                op = audit[at]
                at += 1
                if op == "K":
                    state = LETTER[role[0]]
                    put(role, text)
                elif op == "R":
                    state = ASSISTANT if state == USER else USER
                    put("assistant" if state == ASSISTANT else "user", text)
            if len(done) >= 2000:
                yield emit()
        if began:
            close()
        if done:
            yield emit()

    return both.mapInArrow(stream, RESULT)


def repair(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; equal turns go by role, then by the hash of role and text.  Null roles and texts
    count as one space; a null conv_id is a conversation of its own; repeated rows count as rows.  Roles that start with s, u or a count as
    system, user or assistant, others (the empty one too) have to be changed or deleted.  Where ``gone`` names a column, rows in which it
    is true only name their conversation: it is returned even if it has no other row, with zeros, an empty audit and the hash of the empty text.
    No rows give an empty result; other columns, whatever their names, are not read.
    """
    space = lambda name: F.coalesce(col(rows, name).cast("string"), F.lit(" "))
    dropped = F.coalesce(col(rows, gone), F.lit(False)) if gone else F.lit(False)
    own = rows.select(col(rows, conv_id).cast("long").alias("conv_id"), col(rows, turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), dropped.alias("gone"))
    # The length keeps role and text apart.
    own = own.withColumn("own", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    facts = stored(_signatures(own), "repair-facts")
    answers = solve_signatures(facts)
    out = stored(_hashed(own, facts.join(answers, "sig")), "repair-out")
    drop_stored(facts)
    return out
