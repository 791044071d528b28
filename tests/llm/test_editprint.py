from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import editprint as E
from weft.llm import slots


def brute(text: str) -> bytes:
    """The fingerprint by walking one block, and in it one character, at a time."""
    moves, inner, outer, hashed = E._random()
    codes = [ord(c) for c in text]
    blocks, symbols = [], []
    for k in range(len(codes)):
        cut = 0 if k == 0 else None
        if k >= E.GRAM:
            gram = 0
            for c in codes[k - E.GRAM : k]:
                gram = (gram * 0x100000001B3 + c) % (1 << 64)
            gram = int(E._mixed(np.array([gram], np.uint64))[0])
            cut = gram if gram % E.SPACING == 0 else None
        if cut is None and len(blocks[-1]) == E.BLOCK:
            forced += 1
            cut = forced
        elif cut is not None:
            forced = 0
        if cut is not None:
            blocks.append([])
            symbols.append(cut)
        blocks[-1].append(int(E._classes(np.array([codes[k]], "<u4"))[0]))
    at, seen = 0, []
    for t in range(2 * len(blocks)):
        seen.append(at)
        if at < len(blocks):
            x = np.array([symbols[at] ^ (t * 0x632BE59BD9B4E019) % (1 << 64)], np.uint64)
            at += int(E._mixed(x)[0] >> np.uint64(63))
    bits = []
    for bit in range(E.BITS):
        step = max(r for r in outer[bit].tolist() if r <= len(seen))
        symbol = E.PAD
        if step and seen[step - 1] < len(blocks):
            block, at = blocks[seen[step - 1]], 0
            for t in range(max(r for r in inner[bit].tolist() if r <= 2 * len(block))):
                symbol = block[at] if at < len(block) else E.PAD
                at += int(moves[t, symbol])
        bits.append(int(hashed[bit, symbol]) if text else 0)
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["ther", "ing", "é", "an", "tion", "中文", "ou", "𐍈"]) + str(rng.randrange(9)) for _ in range(n))


def test_fingerprints_equal_single_walks(monkeypatch):
    rng = random.Random(6)
    texts = ["", "a", "ab", words(rng, 3), words(rng, 400), words(rng, 1500), "x" * 2048, "y" * 6000, words(rng, 60)]
    wanted = [brute(t) for t in texts]
    assert [row.tobytes() for row in E.fingerprints(texts)] == wanted
    for name, value in (("TOGETHER", 2), ("PIECE", 100), ("HELD", 3)):
        monkeypatch.setattr(E, name, value)
    assert [row.tobytes() for row in E.fingerprints(texts)] == wanted
    assert wanted[0] == bytes(E.BITS // 8)


def test_likeness_falls_with_edit_distance():
    rng = random.Random(7)
    base = [words(rng, 300) for _ in range(30)]
    own = E.fingerprints(base)

    def edits(text: str, n: int) -> str:
        for _ in range(n):
            k = rng.randrange(len(text))
            text = rng.choice([text[:k] + text[k + 1 :], text[:k] + "z" + text[k:], text[:k] + "z" + text[k + 1 :]])
        return text

    means = [E.likeness(own, E.fingerprints([edits(t, n) for t in base])).mean() for n in (0, 3, 30)]
    other = E.likeness(own, np.roll(own, 1, axis=0)).mean()
    assert means[0] == 1.0 and means[0] > means[1] > means[2] > other and means[1] > 0.8


@pytest.mark.parametrize("size", [2, 50])
def test_an_insertion_costs_little_however_long_the_text(size):
    """At the head and in the middle of texts of 50,000 characters."""
    rng = random.Random(size)
    base = [words(rng, 9000)[:50_000] for _ in range(8)]
    own = E.fingerprints(base)
    for at in (0, 25_000):
        changed = E.fingerprints([t[:at] + words(rng, 30)[:size] + t[at:] for t in base])
        assert E.likeness(own, changed).mean() > 0.9 and E.likeness(own, changed).min() > 0.7
    assert E.likeness(own, np.roll(own, 1, axis=0)).mean() < 0.25


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def expected(rows: list[tuple]) -> list[tuple]:
    order = sorted(rows, key=lambda r: ((r[0] is None), -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        a, b, c = (E.fingerprints([x]) for x in (text, changed, following))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(E.likeness(a, b)[0]), float(E.likeness(a, c)[0])))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_successors_equal_a_global_order(spark, partitions):
    rng = random.Random(9)
    rows = [(rng.randrange(-(10**12), 10**12), words(rng, rng.randrange(0, 40))) for _ in range(150)] + [(5, None), (7, ""), (7, "tie"), (7, "tie"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(partitions)
    got = sorted((tuple(r)[:7] for r in E.compare(df).collect()), key=str)
    assert got == expected(rows)


def test_small_tables(spark):
    df = spark.createDataFrame([(3, "only text here")], "doc_id long, text string")
    assert [tuple(r)[:7] for r in E.compare(df).collect()] == expected([(3, "only text here")])
    assert E.compare(df.limit(0)).count() == 0
    two = [(1, "long " * 30_000), (2, "abc")]
    assert sorted(tuple(r)[:7] for r in E.compare(spark.createDataFrame(two, "doc_id long, text string")).collect()) == expected(two)


def test_documents_are_nearer_to_their_edits(spark):
    rows = E.compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    long = [r for r in rows if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97
    assert np.mean([r["near_edited"] for r in long]) > 0.5 and np.mean([r["near_next"] for r in long]) < 0.3


def test_many_rows_of_one_id_are_split(spark):
    rng = random.Random(12)
    rows = [(None, words(rng, 3)) for _ in range(300)] + [(7, words(rng, 3)) for _ in range(300)] + [(k, words(rng, 3)) for k in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r)[:7] for r in E.compare(df).collect()), key=str) == expected(rows)
    laid = E.with_successors(df, "doc_id", "text").where(~F.col("tail"))
    each = [r["count"] for r in laid.groupBy("bucket").count().collect()]
    assert sum(each) == len(rows) and max(each) < 150


def plain_classes(prints: list[bytes], least: float) -> list[int]:
    """Smallest index reachable over pairs of that likeness, by comparing all pairs."""
    rows = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(prints)):
        for j in np.flatnonzero(E.likeness(rows[:k], rows[k]) >= least):
            a, b = sorted((find(int(j)), find(k)))
            root[b] = a
    return [find(k) for k in range(len(prints))]


def flipped(rng: np.random.Generator, row: bytes, n: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(row, np.uint8))
    bits[rng.choice(E.BITS, n, replace=False)] ^= 1
    return np.packbits(bits).tobytes()


@pytest.mark.parametrize("afforded", [16, 0])
def test_classes_in_crowded_slots(spark, monkeypatch, afforded):
    """Thousands of members of one slot: a great group of near copies, a chain, strangers that share most bits, pairs, loners."""
    monkeypatch.setattr(slots, "AFFORDED", afforded)
    rng = np.random.default_rng(3)
    centre = rng.bytes(E.BITS // 8)
    prints = [flipped(rng, centre, int(rng.integers(1, 40))) for _ in range(1500)]
    prints += [flipped(rng, centre, int(rng.integers(90, 110))) for _ in range(60)]  # share many bands, but are far apart
    link = rng.bytes(E.BITS // 8)
    for _ in range(30):
        link = flipped(rng, link, 35)
        prints.append(link)
    pairs = []
    for _ in range(200):
        one = rng.bytes(E.BITS // 8)
        pairs.append((len(prints), len(prints) + 1))
        prints += [one, flipped(rng, one, 50)]  # likeness 0.805, barely linked
    prints += [rng.bytes(E.BITS // 8) for _ in range(300)] + prints[:5]
    df = spark.createDataFrame(list(enumerate(prints)), "id long, p binary").repartition(4)
    got = {bytes(r["p"]): r["class_id"] for r in E.near_classes(df).collect()}
    want = plain_classes(prints, 0.8)
    chain = list(range(1560, 1590))  # each link is found with a chance, and one that is missed parts the chain
    assert sum(got[prints[a]] == got[prints[a + 1]] for a in chain[:-1]) >= 28
    wrong = [k for k in range(len(prints)) if got[prints[k]] != want[k] and k not in chain and not any(k in p for p in pairs)]
    assert len(got) == len(set(prints)) and len(wrong) <= 1
    assert sum(got[prints[a]] == got[prints[b]] for a, b in pairs) / len(pairs) >= 0.9


def test_band_plan():
    assert E.band_plan(1, 0.8)[0] == 16
    for n in (10**5, 10**7, 10**9):
        width, count = E.band_plan(n, 0.8)
        assert n * 64 <= 2 ** (width * E.EVEN) <= n * 128 and 1 - (1 - 0.9**width) ** count >= 0.95


def test_near_texts_share_a_class(spark):
    rng = random.Random(10)
    texts = [words(rng, 200) for _ in range(60)]
    rows = [(2 * k, t) for k, t in enumerate(texts)] + [(2 * k + 1, t[:500] + "#" + t[500:]) for k, t in enumerate(texts)] + [(None, texts[0])]
    classes = {r["doc_id"]: r["class_id"] for r in E.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([classes[2 * k + 1] == classes[2 * k] == 2 * k for k in range(60)]) >= 0.9 and classes[None] == 0
    nameless = spark.createDataFrame([(None, "one text of no id"), (None, "one text of no id!")], "doc_id long, text string")
    assert {r["class_id"] for r in E.compare(nameless).collect()} == {None}


def test_strangers_that_are_a_little_alike_seldom_meet(spark, monkeypatch):
    """Fingerprints of one family, 0.36 alike: bands alone would try some 60,000 pairs in vain."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, E.BITS) ^ (rng.random((4000, E.BITS)) < 0.2)
    prints = [row.tobytes() for row in np.packbits(bits.astype(np.uint8), axis=1)]
    tried, connect = [], E.connect

    def counted(members, verified, *more):
        def seen(pairs):
            tried.append(pairs.count())
            return verified(pairs)

        return connect(members, seen, *more)

    monkeypatch.setattr(E, "connect", counted)
    df = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(prints)], "id long, p binary")
    found = E.near_classes(df).collect()
    assert len(found) == 4000 and len({r["class_id"] for r in found}) == 4000
    assert sum(tried) < 8 * 4000
