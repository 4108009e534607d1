"""Perspectives against a plain loop."""

import random

from signalmill.llm import chat


def brute(rows):
    out = set()
    for conv in {r[0] for r in rows}:
        own = {(t, r or "unknown", x or "") for c, t, r, x in rows if c == conv}
        ordered = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1].encode(), r[2].encode()))
        for who in {r[1] for r in own}:
            at = 0
            for i, (turn, role, text) in enumerate(ordered):
                head = "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
                part = f"{head}{text}<|end|>\n"
                mask = (at + len(head), at + len(part)) if role == who else (None, None)
                out.add((conv, who, i, turn, role, role == who, part, at, at + len(part), *mask))
                at += len(part)
    return out


def test_segments_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 4)
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(12)]:
        people = rng.sample(["user", "assistant", "system", "Zoé", None], rng.randint(1, 4))
        for turn in range(rng.randint(1, 40)):
            rows.append((conv, rng.choice([turn, turn, turn, 2, None, -3]), rng.choice(people), rng.choice(["hi", None, "", "é漢😀", "<|end|>", f"t{turn}"])))
    rows += rows[:20]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, position int")
    found = chat.segments(table.repartition(5)).collect()
    assert len(found) == len(set(map(tuple, found)))
    assert set(map(tuple, found)) == brute(rows)


def test_dialogues_and_masks(spark):
    rows = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi ann"), (1, 2, "ann", "bye")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["perspective"]: r for r in chat.dialogues(chat.segments(table)).collect()}
    assert found["bob"]["text"] == "<|user name=ann|>\nhello<|end|>\n<|assistant|>\nhi ann<|end|>\n<|user name=ann|>\nbye<|end|>\n"
    for who, said in (("ann", ["hello<|end|>\n", "bye<|end|>\n"]), ("bob", ["hi ann<|end|>\n"])):
        assert [found[who]["text"][m["start"] : m["end"]] for m in found[who]["masks"]] == said


def test_empty_table_and_no_python(spark):
    table = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    assert chat.segments(table.limit(0)).count() == 0
    plan = chat.segments(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_null_ids_are_no_conversation_of_another_name(spark):
    rows = [(c, t, "ann", f"hi {t}") for c in (None, "null", "", "=", "7") for t in (0, 1)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert set(map(tuple, chat.segments(table).collect())) == brute(rows)
