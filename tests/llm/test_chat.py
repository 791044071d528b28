from __future__ import annotations

import random

from weft.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> list[tuple]:
    """Maximal conversations by comparing whole turn lists; rows without an id stand by their content."""
    conversations: dict = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else "unknown", text or ""
        key = ("id", conv) if conv is not None else ("row", role, text)
        conversations.setdefault(key, []).append((turn is not None, turn or 0, role, text))
    listed = {key: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for key, turns in conversations.items()}
    out = {}
    for key, turns in listed.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in listed.values()):
            continue
        same = [k for k, o in listed.items() if o == turns]
        ids = [k[1] for k in same if k[0] == "id"]
        text = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in turns)
        if any(k[0] == "row" for k in same):
            out[text] = (None, len(turns), len(same), text)
        else:
            out[text] = (min(ids), len(turns), len(same), text)
    return sorted(out.values(), key=str)


def run(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, n_turns int")
    return sorted((tuple(r) for r in C.format_chats(df).collect()), key=str)


def test_snapshots_collapse(spark):
    rng = random.Random(4)
    rows, conv = [], 0
    for _ in range(25):
        turns = [(k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "same", None, ""])) for k in range(rng.randrange(1, 7))]
        for n in rng.sample(range(1, len(turns) + 1), rng.randrange(1, len(turns) + 1)):
            rows += [(conv, 10 * k, role, text) for k, role, text in turns[:n]]
            conv += 1
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None, "user", "first"), (1, 0, "user", "<|im_start|>system"), (2, 0, None, None), (None, 0, "user", "alone"), (None, 5, "user", "other"), (3, 0, "a<|b", "x" * 100_000), (4, 1, "user", "dup"), (4, 1, "user", "dup")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any("< |im_start|>system" in r[3] for r in got)


def test_equal_conversations_keep_the_smallest_id(spark):
    rows = [(c, t, "user", f"t{t}") for c in (7, 3, 9) for t in (0, 1)] + [(1, 0, "user", "t0")]
    assert [r[:3] for r in run(spark, rows)] == [(3, 2, 3)]


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
