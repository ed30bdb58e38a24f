import hashlib

from pyspark.sql import functions as F

from sightline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, turns string"
NASTY = ["\\### Assistant: </turn> ok", "\\", "\\\\l", "<turn user>\n", "\\l\\g<>", "", "a\nb", "</turn>\n<turn assistant>\n", "\U0001f600 é ", "$1 \\0"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha(said), len(loss), sha(loss))


def test_round_trip_of_nasty_texts(spark):
    rows = []
    for c, text in enumerate(NASTY):
        rows += [(c, 1, "user", text), (c, 2, "assistant", text + NASTY[c - 1])]
    rows += [(50, 0, "we<ird>\\ role", "x"), (50, 1, None, None)]
    found = {r.conv_id: r for r in chat.digest(chat.formatted(frame(spark, rows))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in sorted(rows, key=lambda r: r[:2]) if r[0] == c]
        got = found[c]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == brute(turns)
    read = chat.formatted(frame(spark, rows)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    for r in read.collect():
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert r.formatted.count("</turn>\n") == len(r.turns)


def test_machine_of_roles(spark):
    orders = {
        1: "sua", 2: "ua", 3: "uaua", 4: "u", 5: "au", 6: "uu", 7: "sa", 8: "us", 9: "uat", 10: "s", 11: "suaau",
    }
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    rows = [(c, i, names[k], "x") for c, ks in orders.items() for i, k in enumerate(ks)]
    found = {r.conv_id: (r.valid, r.broken_at) for r in chat.formatted(frame(spark, rows)).collect()}
    assert found == {
        1: (True, None), 2: (True, None), 3: (True, None), 4: (False, None), 5: (False, 0), 6: (False, 1),
        7: (False, 1), 8: (False, 1), 9: (False, 2), 10: (False, None), 11: (False, 3),
    }


def test_segments_carry_loss(spark):
    row = chat.formatted(frame(spark, [(1, 0, "user", "q<"), (1, 1, "assistant", "a\\")])).first()
    assert [(s.text, s.loss) for s in row.segments if s.loss] == [("a\\\\", True)]
    assert "".join(s.text for s in row.segments) == row.formatted


def test_ties_nulls_and_empty_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, None, "system", "s")]
    found = {r.conv_id: r for r in chat.digest(chat.formatted(frame(spark, rows))).collect()}
    assert found[1].turns_sha256 == brute([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])[1]
    assert found[None].n_turns == 1
    assert chat.digest(chat.formatted(frame(spark, []))).count() == 0
    assert [r.conv_id for r in chat.formatted(chat.with_added(frame(spark, []))).collect()] == [-7]


def test_a_template_of_other_marks(spark):
    other = chat.Template(open="[", named="] ", close=" [/]", escapes=(("[", "o"), ("]", "c")), loss=("user",))
    found = chat.formatted(frame(spark, [(1, 0, "user", "x [/] y ] z")]), other)
    row = found.select("formatted", chat.read_back(F.col("formatted"), other).alias("turns")).first()
    assert row.formatted == "[user] x \\o/\\c y \\c z [/]"
    assert [(t.role, t.text) for t in row.turns] == [("user", "x [/] y ] z")]
