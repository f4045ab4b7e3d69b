"""Chat formatting: what is read back is what was said."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quiver.llm import chat

BITS = ["[INST]", "[/INST]", "</s>", "<s>", "[\\INST]", "<\\\\/s>", "[", "]", "<", "\\", "s>", "/INST]", "INST]", "ok", " ", "\n", "é龍", "$1", "\x00"]
CLASH = ["formatted", "part", "same", "loss", "t", "p", "said"]


def turns(spark, rows):
    schema = "conv_id long, turn long, role string, text string" + "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema).repartition(3)


def brute(rows):
    said = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = {}
    for conv, parts in said.items():
        parts.sort()
        loss = b"".join(text for *_, role, text in parts if role == b"assistant")
        whole = b"".join(role + b"\n" + text + b"\n" for *_, role, text in parts)
        out[conv] = (len(parts), sha(whole), len(loss.decode()), sha(loss))
    return out


def messy():
    rng = random.Random(3)
    rows = []
    for conv in (0, 1, 2, None, -7):
        for turn in range(rng.randint(1, 200)):
            text = rng.choice([None, "", "".join(rng.choices(BITS, k=rng.randint(0, 12)))])
            rows.append((conv, rng.choice([turn, None, turn // 2, -turn]), rng.choice(["user", "assistant", "system", "[INST]", "", None]), text))
    return rows + rows[:5] + [(9, 0, "assistant", "word " * 40_000 + "</s>")]


def test_everything_comes_back(spark):
    rows = messy()
    got = {r[0]: tuple(r)[1:] for r in chat.formatted_digest(turns(spark, rows)).collect()}
    assert {k: v[:4] for k, v in got.items()} == brute(rows)


def test_only_turn_marks_are_left_as_controls(spark):
    rows = messy()
    template = chat.Template()
    parts = chat.format_conversations(turns(spark, rows)).collect()
    assert sum(p["n_turns"] for p in parts) == len(rows)
    for p in parts:
        assert re.findall(template.control, p["formatted"]) == [template.open, template.head, template.close] * p["n_turns"]
        before = -1
        for start, length in p["loss"]:
            assert p["formatted"][:start].endswith("[INST]assistant[/INST]") and start > before
            assert p["formatted"][start + length :].startswith("</s>")
            before = start


def test_texts_without_controls_are_left_alone(spark):
    rows = [(1, 0, "user", "a < b > c [x] \\ s> INST]"), (1, 1, "assistant", "")]
    (part,) = chat.format_conversations(turns(spark, rows)).collect()
    assert part["formatted"] == "[INST]user[/INST]a < b > c [x] \\ s> INST]</s>[INST]assistant[/INST]</s>"
    assert [tuple(x) for x in part["loss"]] == [(len(part["formatted"]) - 4, 0)]


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 9))) for _ in range(400)]
    template = chat.Template()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in df.select("t", chat.escape(F.col("t"), template), chat.unescape(chat.escape(F.col("t"), template), template)).collect():
        assert back == t
        assert not re.search(template.control, e)


def test_parser_takes_turns_only(spark):
    good = "[INST]user[/INST]hi</s>"
    cases = [(good, 1), (good * 2, 2), ("", 0), ("x" + good, None), (good + "x", None), (good + " " + good, None),
             ("[INST]user[/INST]hi", None), ("[INST]user</s>hi[/INST]", None), (good + "<s>", None), ("hi", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    read = [r[0] for r in df.select(chat.parse(F.col("t"), chat.Template())).collect()]
    assert [None if r is None else len(r) for r in read] == [n for _, n in cases]


def test_template_must_be_unambiguous():
    for bad in ({"open": "[IN[ST]"}, {"open": "<t"}, {"head": "[INST]"}, {"open": "[a>b]"}, {"close": "<\\s>"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_other_templates(spark):
    rows = messy()
    template = chat.Template("<turn>", "<says>", "<over>", ())
    got = {r[0]: tuple(r)[1:5] for r in chat.formatted_digest(turns(spark, rows), template).collect()}
    assert got == brute(rows)


def test_no_conversations(spark):
    assert chat.formatted_digest(turns(spark, [(1, 0, "user", "x")]).limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = chat.formatted_digest(turns(spark, messy()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
