import hashlib
import random

import pytest

from framewright.llm import chat_format

from .conftest import EXTRA


def test_round_trip_and_masks(spark):
    rng = random.Random(9)
    pieces = ["a", "é漢😀", " ", "\n", "\\", "<", "[", "<|end|>", "<|turn|>", "</s>", "[INST]", "\\<", "|>"]
    rows = []
    for conv in [*range(40), None]:
        for turn in rng.sample(range(50), rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "ro<|le\n", None]), rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(20)))])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in EXTRA.split(", "):
        name, kind = c.split()
        if name != "text":
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    made = chat_format.format_conversations(df)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    formatted = {r.conv_id: r for r in made.collect()}
    assert set(formatted) == set(by)
    for conv, turns in by.items():
        turns = [(role, text) for _, role, text in sorted(turns, key=lambda t: t[0])]
        r = formatted[conv]
        assert chat_format.parse(r.formatted) == turns and r.n_turns == len(turns)
        assert r.formatted.count("<|turn|>") == len(turns) and "</s>" not in r.formatted and "[INST]" not in r.formatted
        spans = [chat_format.unescape(r.formatted[a:b]) for a, b in zip(r.loss_spans[::2], r.loss_spans[1::2])]
        assert spans == [t for role, t in turns if role == "assistant"]
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for conv, turns in by.items():
        whole = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns, key=lambda t: t[0]))
        assert back[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)] * 3, [(1, 0, "user", "x"), (1, 0, "user", "x")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sum(r.n_turns for r in chat_format.format_conversations(df).collect()) == len(rows)


def test_a_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(c, t, "user", f"{c}-{t}") for c in range(5) for t in range(1 + 20 * c)], "conv_id long, turn long, role string, text string")
        got = {r.conv_id: chat_format.parse(r.formatted) for r in chat_format.format_conversations(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: [("user", f"{c}-{t}") for t in range(1 + 20 * c)] for c in range(5)}
