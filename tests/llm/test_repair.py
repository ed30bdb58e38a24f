import hashlib
import random
import zlib
from functools import cache

import pytest

from sightline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, fault string, symbol string, node string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(named.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows, originals):
    """All ways through the rows of a conversation, by recursion over (row, roles so far)."""
    found = []
    for conv in originals:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        faults, seen = [], set()
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))

        @cache
        def best(i, last, inserted=0):
            """(cost, audit, output) from row i on; ``last`` is the last initial put out."""
            wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
            name = {"u": "user", "a": "assistant"}[wanted]
            options = []
            if inserted < 3:
                c, a, o = best(i, wanted, inserted + 1)
                options.append((c + 2, "I" + a, ((name, ""), *o)))
            if i == len(own):
                if last in ("", "a"):
                    options.append((0, "", ()))
                return min(options) if options else (10**6, "", ())
            _, role, text = own[i]
            c, a, o = best(i + 1, last)
            options.append((c + 3, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                c, a, o = best(i + 1, wanted)
                options.append((c + 2 + more, "R" + a, ((name, text), *o)))
                if role[:1] == wanted or last == "" and role[:1] == "s":
                    c, a, o = best(i + 1, role[:1])
                    options.append((c + more, "K" + a, ((role, text), *o)))
            return min(options)

        cost, audit, output = best(0, "")
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in output).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(rng, n=150):
    rows = []
    for conv in range(n):
        turns = rng.randrange(1, 9) if conv % 20 else 60
        for turn in range(turns):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]) if conv % 3 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "no", " \t\n", "", None, "What?  ", "Go on!", "a\nb.", f"own {turn}.", f"é {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]) if conv % 5 == 0 else turn, role, text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (None, None, "system", "Be kind."), (None, 2, "assistant", "Hello.")]
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("width", [1, 3, 16])
def test_equal_to_brute_force_for_any_width_of_blocks(spark, width):
    rows = conversations(random.Random(width))
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    found = repair.repair(df, repair.damaged(df), width)
    assert result(found) == brute(damage(rows), {r[0] for r in rows})


def test_known_repairs(spark):
    data = {
        1: [("user", "Hi."), ("assistant", "Hello.")],
        2: [("assistant", "Hello.")],
        3: [("system", "Be kind."), ("user", "Hi."), ("user", "Hi."), ("assistant", "So")],
        4: [("user", "")],
        5: [("tool", "One."), ("user", "Two.")],
    }
    rows = [(c, t, *r) for c, own in data.items() for t, r in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.cost, r.audit) for r in repair.repair(df, df).collect()}
    assert found == {1: (0, "KK"), 2: (2, "IK"), 3: (4, "KKDK"), 4: (3, "D"), 5: (4, "RR")}
    turns = repair.repaired(repair.judged(df), repair.audited(repair.judged(df)).select("conv_id", "audit"))
    kept = sorted(tuple(r) for r in turns.where("conv_id in (2, 5)").collect())
    assert kept == [(2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Hello."), (5, 1, "R", "user", "One."), (5, 2, "R", "assistant", "Two.")]


def test_a_suffix_is_solved_once(monkeypatch):
    """Sorted by their ends, blocks cost a step per distinct suffix."""
    import pyarrow as pa

    steps = []
    monkeypatch.setattr(repair, "step", lambda *a, own=repair.step: steps.append(a) or own(*a))
    blocks = sorted(["uauaua", "xauaua", "saua", "uaua", "ua", "uu"], key=lambda b: b[::-1])
    batch = pa.RecordBatch.from_pydict(
        {
            "node": blocks,
            "following": [""] * 6,
            "block": blocks,
            "costs": [list(repair.END_COSTS)] * 6,
            "audits": [list(repair.END_AUDITS)] * 6,
        }
    )
    (out,) = repair._solve(iter([batch]))
    suffixes = {b[i:] for b in blocks for i in range(len(b))}
    assert len(steps) == len(suffixes) and out.column("audits").to_pylist()[blocks.index("uauaua")][0] == "KKKKKK"


def test_a_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (found,) = repair.repair(df, df).collect()
    assert (found.cost, found.audit, found.illegal) == (0, "K" * 5000, 0)
    assert found.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair(df, repair.damaged(df)).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = repair.repair(one, one.where("false")).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
