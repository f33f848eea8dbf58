"""Exact round trips of texts full of marks."""

import hashlib
import random

from pyspark.sql import functions as F

from reelflow.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|end|>", "&", "&amp;", "&lt;", "&lsqb;", "&vert;", "lt;", "\n", " ", "é", "😀", "a", "[", "<", "\\", "$1"]


def expected(turns):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_round_trip_of_marks(spark):
    r = random.Random(3)
    rows, want = [], {}
    for conv in range(150):
        turns = [(r.choice(["system", "user", "assistant", "tool", "a|b", ""]), "".join(r.choices(PARTS, k=r.randint(0, 8)))) for _ in range(r.randint(1, 6))]
        rows += [(conv, k, *t) for k, t in enumerate(turns)]
        want[conv] = expected(turns)
    r.shuffle(rows)
    done = chat.formatted(spark.createDataFrame(rows, TURNS))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digests(done).collect()}
    assert got == want
    for x in done.collect():
        assert len(x.loss) == sum(t.role == "assistant" for t in x.turns)


def test_plain_texts_stay_plain(spark):
    done = chat.formatted(spark.createDataFrame([(1, 0, "user", "Hi <b>"), (1, 1, "assistant", "[ok]")], TURNS)).first()
    assert done.formatted == "[INST]Hi <b>[/INST]<s>[ok]</s>"
    assert [done.formatted[s.start : s.end] for s in done.loss] == ["[ok]"]


def test_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "system", "first"), (2, 0, "assistant", "y " * 60_000), (None, 0, "user", "n"),
            (3, 5, "user", "same"), (3, 5, "user", "same"), (3, 5, "assistant", "tie")]
    table = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    got = {x.conv_id: x for x in chat.digests(chat.formatted(table)).collect()}
    assert (got[1].n_turns, got[1].turns_sha256) == expected([("system", "first"), ("user", ""), ("", "x")])[:2]
    assert got[2].loss_chars == 120_000 and got[None].n_turns == 1
    assert got[3].turns_sha256 == expected([("assistant", "tie"), ("user", "same"), ("user", "same")])[1]
    assert chat.digests(chat.formatted(table.limit(0))).collect() == []


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], TURNS)
    plan = chat.digests(chat.formatted(table))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
