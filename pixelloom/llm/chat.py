"""Chat formatting: records of many layouts become canonical turns, then one marked text with a loss mask.  DataFrame functions only.

A layout is declared as a ``Mapping``: which fields hold turns or lists of turns, and what their roles are called.  A record (JSON)
is parsed with the fields that any mapping knows; the sorted paths of those it has (``messages[].role``, ``example.turns[].utterance``) are
hashed to its fingerprint, and the fingerprint selects the mapping.  Fields that no mapping knows don't count.

The template writes ``### role: text</turn>`` and a newline a turn.  Inside roles and texts a backslash, a ``#`` that begins ``###`` and a ``<`` that
begins ``</turn>`` get a backslash behind them (in roles a colon too), so that no control string is left in them, the end mark can be split at
literally, and dropping each backslash's partner restores the text.  A mask has one (skip, take) pair a turn, in code points of
the turn's piece: what is taken is learned from, the text of assistants.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh

END, HEAD, COLON = "</turn>\n", "### ", ": "
LEARNED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Text:
    """A field that is one turn, or, where it ``joins``, a further paragraph of the turn before."""

    path: str
    role: str
    optional: bool = False
    joins: bool = False

    def paths(self) -> tuple[list[str], list[str]]:
        """Paths that a record must have, and may have."""
        return ([], [self.path]) if self.optional else ([self.path], [])


@dataclass(frozen=True)
class Turns:
    """A list of objects, each a turn."""

    path: str
    role: str
    text: str

    def paths(self) -> tuple[list[str], list[str]]:
        return [f"{self.path}[].{self.role}"], [f"{self.path}[].{self.text}"]


@dataclass(frozen=True)
class Mapping:
    name: str
    parts: tuple[Text | Turns, ...]
    roles: dict[str, str] = field(default_factory=dict)  # the layout's names of roles
    ignored: tuple[str, ...] = ()  # paths of texts that may be there and say nothing new

    def fingerprints(self) -> list[str]:
        must = [p for part in self.parts for p in part.paths()[0]]
        may = [p for part in self.parts for p in part.paths()[1]] + list(self.ignored)
        return [fingerprint([*must, *some]) for n in range(len(may) + 1) for some in itertools.combinations(may, n)]


MAPPINGS = (
    Mapping("messages", (Turns("messages", "role", "content"),), ignored=("prompt",)),
    Mapping("conversations", (Turns("conversations", "from", "value"),), {"human": "user", "gpt": "assistant"}, ("system",)),
    Mapping("example_turns", (Turns("example.turns", "speaker", "utterance"),)),
    Mapping("prompt_completion_turns", (Turns("prompt", "role", "content"), Turns("completion", "role", "content"))),
    Mapping("prompt_completion", (Text("system", "system", optional=True), Text("prompt", "user"), Text("completion", "assistant"))),
    Mapping("prompt_response", (Text("system", "system", optional=True), Text("prompt", "user"), Text("response", "assistant"))),
    Mapping("instruction", (Text("system", "system", optional=True), Text("instruction", "user"), Text("input", "user", optional=True, joins=True), Text("output", "assistant"))),
    Mapping("question_answer", (Text("question", "user"), Text("answer", "assistant"))),
)


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _schema(leaves: dict[str, T.DataType]) -> T.StructType:
    """Nested struct with the given types at dotted paths."""
    tree: dict = {}
    for path, kind in leaves.items():
        *up, last = path.split(".")
        at = tree
        for name in up:
            at = at.setdefault(name, {})
        at[last] = kind
    build = lambda node: T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else v) for k, v in node.items()])
    return build(tree)


def _at(root: Column, path: str) -> Column:
    return functools.reduce(lambda c, name: c[name], path.split("."), root)


def _vocabulary(mappings: tuple[Mapping, ...]) -> tuple[list[str], dict[str, dict[str, set[str]]]]:
    """Paths of all texts, and per path of a list the names of its objects' fields."""
    parts = [p for m in mappings for p in m.parts]
    texts = sorted({p.path for p in parts if isinstance(p, Text)} | {x for m in mappings for x in m.ignored})
    lists: dict[str, set[str]] = {}
    for p in parts:
        if isinstance(p, Turns):
            lists.setdefault(p.path, set()).update((p.role, p.text))
    return texts, {k: sorted(v) for k, v in sorted(lists.items())}


def _parsed(record: Column, mappings: tuple[Mapping, ...]) -> tuple[Column, Column]:
    """The record's texts and its lists; a field of another kind than asked for is null."""
    texts, lists = _vocabulary(mappings)
    options = {"maxStringLen": str(2**31 - 1)}
    as_list = lambda names: T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return (
        F.from_json(record, _schema({p: T.StringType() for p in texts}), options),
        F.from_json(record, _schema({p: as_list(n) for p, n in lists.items()}), options),
    )


def _paths(texts: Column, lists: Column, mappings: tuple[Mapping, ...]) -> Column:
    """Sorted array of the known paths that a record has.  A list that is empty counts as having all its fields."""
    known_texts, known_lists = _vocabulary(mappings)
    found = {}
    for p in known_texts:
        has = _at(texts, p).isNotNull()
        found[p] = has & _at(lists, p).isNull() if p in known_lists else has  # as a text, a list would be its JSON
    for p, names in known_lists.items():
        for n in names:
            found[f"{p}[].{n}"] = F.coalesce((F.size(_at(lists, p)) == 0) | F.exists(_at(lists, p), lambda e: e[n].isNotNull()), F.lit(False)) & _at(lists, p).isNotNull()
    return F.array_compact(F.array(*(F.when(found[p], F.lit(p)) for p in sorted(found))))


def _turns(mapping: Mapping, texts: Column, lists: Column) -> Column:
    """Canonical turns of a record in this mapping's layout."""
    def canonical(role: Column) -> Column:
        out = F.coalesce(role, F.lit(""))
        for name, to in mapping.roles.items():
            out = F.when(role == name, F.lit(to)).otherwise(out)
        return out

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    found = F.array().cast(TURNS)
    parts = list(mapping.parts)
    while parts:
        p = parts.pop(0)
        if isinstance(p, Turns):
            found = F.concat(found, F.transform(_at(lists, p.path), lambda e: turn(canonical(e[p.role]), e[p.text])))
            continue
        text = _at(texts, p.path)
        while parts and isinstance(parts[0], Text) and parts[0].joins:
            more = _at(texts, parts.pop(0).path)
            text = F.concat(text, F.when(F.length(more) > 0, F.concat(F.lit("\n\n"), more)).otherwise(F.lit("")))
        one = F.array(turn(F.lit(p.role), text))
        found = F.concat(found, F.when(_at(texts, p.path).isNull(), F.array().cast(TURNS)).otherwise(one) if p.optional else one)
    return found


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with fingerprint, layout (the mapping's name) and turns, in place of any columns of these names.

    A record that is null, isn't JSON or whose fingerprint no mapping has gets a null layout and null turns; it is kept, so that
    the layouts to be declared can be counted by fingerprint.  Fields that are null count as absent.
    """
    names = {k: fresh(records, f"_{k}") for k in ("texts", "lists", "print")}
    texts, lists = _parsed(col(records, record), mappings)
    out = records.withColumns({names["texts"]: texts, names["lists"]: lists})
    texts, lists = F.col(names["texts"]), F.col(names["lists"])
    out = out.withColumn(names["print"], F.sha2(F.array_join(_paths(texts, lists, mappings), "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        own = F.col(names["print"]).isin(m.fingerprints())
        layout, turns = F.when(own, F.lit(m.name)).otherwise(layout), F.when(own, _turns(m, texts, lists)).otherwise(turns)
    return out.withColumns({"fingerprint": F.col(names["print"]), "layout": layout, "turns": turns}).drop(*names.values())


# -- template ----------------------------------------------------------------------------------------------------

_CONTROL = r"\\|#(?=##)|<(?=/turn>)"


def escaped(text: Column, extra: str = "") -> Column:
    return F.regexp_replace(text, _CONTROL + extra, r"$0\\")


def unescaped(text: Column) -> Column:
    """Each backslash goes, and what follows it, another one too, stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(records: DataFrame, turns: str = "turns") -> DataFrame:
    """``records`` with ``formatted`` and ``loss`` for their canonical turns; null turns give nulls.  No turns give an empty text."""
    head = fresh(records, "_heads")
    out = records.withColumn(head, F.transform(col(records, turns), lambda t: F.struct(
        F.concat(F.lit(HEAD), escaped(t["role"], "|:"), F.lit(COLON)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned"))))
    return out.withColumns({
        "formatted": F.array_join(F.transform(F.col(head), lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""),
        "loss": F.transform(F.col(head), lambda p: F.struct(F.length(p["head"]).alias("skip"), F.when(p["learned"], F.length(p["body"])).otherwise(F.lit(0)).alias("take"))),
    }).drop(head)


def read_back(formatted: DataFrame, text: str = "formatted", loss: str = "loss") -> DataFrame:
    """The inverse: ``turns`` from the marked text, and ``learned``, the texts under the mask, in order."""
    pieces = fresh(formatted, "_pieces")
    split = F.split(col(formatted, text), r"\Q" + END + r"\E")
    out = formatted.withColumn(pieces, F.slice(split, F.lit(1), F.size(split) - 1))
    mark = lambda p: F.instr(p, COLON)
    return out.withColumns({
        "turns": F.transform(F.col(pieces), lambda p: F.struct(unescaped(p.substr(F.lit(len(HEAD) + 1), mark(p) - len(HEAD) - 1)).alias("role"), unescaped(p.substr(mark(p) + len(COLON), F.length(p))).alias("text"))),
        "learned": F.filter(F.zip_with(F.col(pieces), col(formatted, loss), lambda p, m: F.when(m["take"] > 0, unescaped(p.substr(m["skip"] + 1, m["take"])))), lambda x: x.isNotNull()),
    }).drop(pieces)


def format_records(records: DataFrame, *, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with fingerprint, layout, formatted and loss; columns of these names are replaced, all others stay.

    Repeated records are formatted each.  Nothing is shuffled; a record is one row, however long (2 GB).
    """
    out = canonical_turns(records, record, mappings)
    return format_turns(out).drop("turns")


def digest(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted text and mask."""
    back = read_back(formatted.select(*keep, "formatted", "loss"))
    lines = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = back.withColumns({"_lines": lines, "_learned": F.array_join("learned", "")})
    return learned.select(
        *keep, F.size("turns").cast("long").alias("n_turns"), F.sha2("_lines", 256).alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


# -- rows of a conversation as records of many layouts -------------------------------------------------------------

#: Of the query: a conversation whose texts hold the template's own marks.
PLANTED = (-7, r"\### Assistant: </turn> ok")


def with_planted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` and of one more conversation that says control strings."""
    own = rows.select(col(rows, "conv_id").cast("long").alias("conv_id"), col(rows, "turn").cast("long").alias("turn"), col(rows, "role").cast("string").alias("role"), col(rows, "text").cast("string").alias("text"))
    conv, text = PLANTED
    said = rows.sparkSession.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return own.unionByName(said)


def as_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: a conversation's rows by turn (nulls first, then role and text) as JSON, in one of six layouts by its id.

    Null roles and texts are empty.  A layout that can't say a conversation isn't used for it: named roles need the three known ones, single
    texts a user's and an assistant's turn.  A null conv_id is a conversation of its own.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", blank("role").alias("role"), blank("text").alias("text")))).alias("t"))
    t = F.col("t")
    kind = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 6
    known = F.forall(t, lambda x: x["role"].isin("system", "user", "assistant"))
    two = (F.size(t) == 2) & (F.try_element_at(t, F.lit(1))["role"] == "user") & (F.try_element_at(t, F.lit(2))["role"] == "assistant")
    turns = lambda rows_, role, text: F.transform(rows_, lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))
    said = F.transform(t, lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    first, second = (F.try_element_at(t, F.lit(k))["text"] for k in (1, 2))
    split = F.size(t) - 1
    json = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    record = (
        F.when((kind == 1) & known, json(conversations=said, id=F.col("conv_id")))
        .when((kind == 2) & two, json(prompt=first, response=second))
        .when((kind == 3) & two, json(instruction=first, output=second, source=F.lit("rows")))
        .when((kind == 4) & (F.size(t) > 1), json(prompt=turns(F.slice(t, F.lit(1), split), "role", "content"), completion=turns(F.slice(t, F.size(t), F.lit(1)), "role", "content")))
        .when(kind == 5, json(example=F.struct(turns(t, "speaker", "utterance").alias("turns"))))
        .otherwise(json(messages=turns(t, "role", "content")))
    )
    return whole.select("conv_id", record.alias("record"))
