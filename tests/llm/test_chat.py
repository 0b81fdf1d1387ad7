from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import chat
from pixelloom.llm.queries import op13_chat_format

ODD = ["", "\\", "\\\\", "###", "####", "#" * 9, "</turn>", "</turn>\n", "\\</turn>\n### user: x", "### Assistant: </turn> ok", "<", "</turn", "#\\##", "<\\/turn>", ": ", "a: b", "\n", "\x00\x1f", "päivää 東京 😀", '{"role": "user"}', "[1, 2]", "null", "\\### Assistant: </turn> ok"]
ROLES = ["user", "assistant", "system", "tool", "", "a: b", "x:\\y", "### r", "</turn>\n", "Assistant", "human"]


def marked(turns):
    """The template in plain Python: text, and the spans under the mask."""
    def esc(s, colon=False):
        out = ""
        for i, c in enumerate(s):
            out += c
            if c == "\\" or (c == "#" and s[i : i + 3] == "###") or (c == "<" and s[i : i + 7] == "</turn>") or (colon and c == ":"):
                out += "\\"
        return out

    text, learned = "", []
    for role, body in turns:
        text += f"### {esc(role, True)}: "
        if role == "assistant":
            learned.append((len(text), len(text) + len(esc(body))))
        text += esc(body) + "</turn>\n"
    return text, learned


def plain_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(marked(turns)[0])


def formatted(spark, records, extra="x"):
    df = spark.createDataFrame([(i, r, extra, 1) for i, r in enumerate(records)], "id long, record string, formatted string, loss int").repartition(3)
    return df, chat.format_records(df)


def turns_of(spark, records):
    _, out = formatted(spark, records)
    rows = chat.read_back(out).orderBy("id").collect()
    return [(r["layout"], None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) for r in rows]


def test_layouts_become_the_same_turns(spark):
    said = [("user", "Why?"), ("assistant", "So.")]
    whole = [{"role": r, "content": t} for r, t in said]
    same = [
        {"messages": whole}, {"messages": whole, "id": 4, "meta": {"a": [1, {"b": 2}]}}, {"messages": whole, "prompt": "Why?"},
        {"conversations": [{"from": "human", "value": "Why?"}, {"from": "gpt", "value": "So.", "weight": 1}]}, {"example": {"turns": [{"speaker": r, "utterance": t} for r, t in said]}, "other": None},
        {"prompt": whole[:1], "completion": whole[1:]}, {"prompt": "Why?", "completion": "So."}, {"prompt": "Why?", "response": "So.", "system": None},
        {"instruction": "Why?", "output": "So."}, {"instruction": "Why?", "input": "", "output": "So."}, {"output": "So.", "instruction": "Why?"}, {"question": "Why?", "answer": "So."},
    ]
    found = turns_of(spark, [json.dumps(r) for r in same])
    assert [t for _, t in found] == [said] * len(same)
    assert [n for n, _ in found] == ["messages"] * 3 + ["conversations", "example_turns", "prompt_completion_turns", "prompt_completion", "prompt_response"] + ["instruction"] * 3 + ["question_answer"]


def test_optional_and_joined_fields(spark):
    found = turns_of(spark, [json.dumps(r) for r in (
        {"system": "Be brief.", "prompt": "Why?", "response": "So."}, {"system": "Be brief.", "instruction": "Sum up", "input": "a text", "output": "text"},
        {"messages": [{"role": "user"}, {"role": None, "content": "x"}, {"role": "assistant", "content": None}]}, {"messages": []}, {"messages": [{"role": "user", "content": "[1]"}]}, {"prompt": '[{"role": "user", "content": "x"}]', "completion": "[2]"},
    )])
    assert found == [
        ("prompt_response", [("system", "Be brief."), ("user", "Why?"), ("assistant", "So.")]), ("instruction", [("system", "Be brief."), ("user", "Sum up\n\na text"), ("assistant", "text")]),
        ("messages", [("user", ""), ("", "x"), ("assistant", "")]), ("messages", []), ("messages", [("user", "[1]")]), ("prompt_completion", [("user", '[{"role": "user", "content": "x"}]'), ("assistant", "[2]")]),
    ]


def test_unknown_layouts_stay_without_turns(spark):
    records = [None, "", "no json", "{}", "[]", "3", '{"prompt": "x"}', '{"prompt": "x", "response": null}', '{"messages": 3}', '{"messages": [{"content": "x"}]}', '{"question": "a", "answer": "b", "output": "c"}']
    df, out = formatted(spark, records)
    rows = out.orderBy("id").collect()
    assert len(rows) == len(records) and all(r["layout"] is None and r["formatted"] is None and r["loss"] is None for r in rows)
    assert set(out.columns) == {*df.columns, "fingerprint", "layout"}
    assert out.where("id < 6").select("fingerprint").distinct().count() <= 2
    assert formatted(spark, [])[1].count() == 0


def test_fingerprints_are_hashes_of_sorted_paths(spark):
    paths = ["messages[].role", "messages[].content"]
    _, out = formatted(spark, ['{"messages": [{"role": "user", "content": "x", "z": 1}], "k": {"l": 2}}'])
    assert out.first()["fingerprint"] == hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest() == chat.fingerprint(paths)
    prints = [p for m in chat.MAPPINGS for p in m.fingerprints()]
    assert len(prints) == len(set(prints)), "no fingerprint may select two mappings"


@pytest.mark.parametrize("seed", range(3))
def test_round_trip_of_control_strings(spark, seed):
    rng = random.Random(seed)
    talks = [[(rng.choice(ROLES), "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(5))] for _ in range(150)]
    if not seed:
        talks += [[(r, t)] for r in ROLES for t in ODD]
    records = [json.dumps({"messages": [{"role": r, "content": t} for r, t in talk]}) for talk in talks]
    _, out = formatted(spark, records)
    for r, talk in zip(chat.read_back(out).orderBy("id").collect(), talks, strict=True):
        text, learned = marked(talk)
        assert r["formatted"] == text and [(t["role"], t["text"]) for t in r["turns"]] == talk
        at, spans = 0, []
        for m, (role, _) in zip(r["loss"], talk, strict=True):
            end = text.index("</turn>\n", at + m["skip"] + m["take"]) + 8
            if role == "assistant":
                spans.append((at + m["skip"], at + m["skip"] + m["take"]))
            at = end
        assert spans == learned and r["learned"] == [t for role, t in talk if role == "assistant" and t]
    got = chat.digest(out.withColumn("id", F.col("id")), ["id"]).orderBy("id").collect()
    assert [tuple(g)[1:] for g in got] == [plain_digest(t) for t in talks]


def test_rows_of_conversations(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "user", "assistant", None, "tool"]), rng.choice([*ODD, None])) for _ in range(300)]
    rows += [(100 + i, k, r, f"{i} text") for i in range(40) for k, r in enumerate(("user", "assistant"))] + [(7, 1, "assistant", "twice")] * 2 + [(500, 0, "user", "w " * 400_000)] + [(501, i, "user", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], "conv_id long, turn long, role string, text string, record string, layout string").repartition(4)
    out = chat.digest(chat.format_records(chat.as_records(chat.with_planted(df))), ["conv_id", "layout"])
    found = out.collect()
    assert len({r["layout"] for r in found}) == 6
    want = []
    rows += [(-7, 0, "user", chat.PLANTED[1]), (-7, 1, "assistant", chat.PLANTED[1])]
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        want.append((conv, *plain_digest([(r, t) for _, _, r, t in own])))
    assert sorted(((r["conv_id"], *tuple(r)[2:]) for r in found), key=str) == sorted(want, key=str)
    assert chat.digest(chat.format_records(chat.as_records(df.limit(0))), ["conv_id"]).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = op13_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD")) and plan.count("Exchange") <= 2
