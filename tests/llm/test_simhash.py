from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import simhash as S

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple]) -> dict:
    prints = [brute_fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return {(doc, f"{prints[i]:016x}", min((d for d in groups[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)}


def texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows: list[tuple] = []
    for doc in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40, 300, 600]))]
        rows.append((doc, " ".join(words)))
        for copy in range(rng.choice([0, 0, 3])):
            changed = list(words)
            if changed:
                changed[rng.randrange(len(changed))] = "changed"
            rows.append((100 + 10 * doc + copy, "\n".join(changed) + " " * copy))
    return rows + [(900, None), (901, ""), (902, "ÀB Àb c"), (903, "ÀB àb C"), (None, rows[-1][1]), (904, "UPPER case Words\tTab\x0bvertical"), (904, "upper CASE words tab VERTICAL")]


def test_fingerprint_equals_brute_force():
    for _, text in texts():
        value = S.fingerprint((text or "").encode())
        assert value & (1 << 64) - 1 == brute_fingerprint(text)


def test_blocks_of_a_long_text_do_not_matter(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(5000)).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 64)
    assert S.fingerprint(text) == whole


def test_components_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "id": F.lit(2)})
    got = [tuple(r) for r in S.components(df).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute_components(rows)


def test_links_find_all_pairs_within_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for x in base:
        for _ in range(4):
            prints.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = {(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        parent[find(a)] = find(b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert find(a) == find(b)


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), radius=1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.components(empty).count() == 0
    assert S.keep_one(empty).count() == 0


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None) -> set:
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_long_fingerprint_equals_a_plain_count():
    mask = (1 << 64) - 1
    for _, text in texts()[:20]:
        words = lower(text).split()
        parts = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [" ".join(words)] if words else []
        bits = []
        for j in range(1, S.LONG // 64 + 1):
            hashes = []
            for part in parts:
                x = (xxhash.xxh64_intdigest(part.encode(), 42) + j * 0x9E3779B97F4A7C15) & mask
                x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
                x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
                hashes.append((x ^ x >> 31).to_bytes(8, "little"))
            for byte in range(8):
                bits += ["1" if 2 * sum(h[byte] >> 7 - b & 1 for h in hashes) > len(hashes) else "0" for b in range(8)]
        assert S.long_fingerprint((text or "").encode()) == int("".join(bits), 2).to_bytes(S.LONG // 8)


def test_segment_plan():
    for n in (1, 10**4, 10**6, 10**9):
        size, count = S.segment_plan(n, 0.8)
        p = S.differing(0.8)
        meet = sum(S.math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(3))
        assert 2**size >= 32 * n and 1 - (1 - meet) ** count >= 0.9


def test_keep_one_finds_near_texts_and_leaves_others(spark):
    """Recall by the true likeness of five-word shingles; texts of less than 0.7 stay apart."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, near, far = [], [], []
    for k in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(100, 500))]
        changed = list(words)
        for _ in range(rng.choice([1, 2, 4, 6, 12, 30])):
            changed[rng.randrange(len(changed))] = "changed"
        a, b = " ".join(words), " ".join(changed)
        rows += [(2 * k, a), (2 * k + 1, b)]
        same = likeness(a, b)
        near += [(2 * k + 1, same)] if same >= 0.8 else []
        far += [2 * k + 1] if same < 0.7 else []
    assert len(near) > 80 and len(far) > 20
    kept = {r["doc_id"] for r in S.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {2 * k for k in range(200)} <= kept and sum(d in kept for d in far) / len(far) >= 0.97
    assert sum(d not in kept for d, _ in near) / len(near) >= 0.9
    assert sum(d not in kept for d, s in near if s > 0.88) >= 0.98 * sum(s > 0.88 for _, s in near)


def test_keep_one_of_a_great_group_of_near_copies(spark):
    rng = random.Random(22)
    vocabulary = [f"w{k}" for k in range(3000)]
    words = [rng.choice(vocabulary) for _ in range(400)]
    rows = []
    for k in range(1500):
        changed = list(words)
        for _ in range(3):
            changed[rng.randrange(400)] = rng.choice(vocabulary)
        rows.append((k, " ".join(changed)))
    rows += [(2000 + k, " ".join(rng.choice(vocabulary) for _ in range(50))) for k in range(100)]
    kept = sorted(r["doc_id"] for r in S.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [0, *range(2000, 2100)]


def test_strangers_of_one_family_make_no_pairs(spark, monkeypatch):
    """Fingerprints of one family, some 123 bits apart where 78 are near: the slots hold over 100,000 of their pairs."""
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, S.LONG) ^ (rng.random((1500, S.LONG)) < 0.14)
    for k in range(50):  # near ones
        bits[2 * k + 1] = bits[2 * k]
        bits[2 * k + 1, rng.choice(S.LONG, 40, replace=False)] ^= 1
    prints = [row.tobytes() for row in np.packbits(bits.astype(np.uint8), axis=1)]
    tried, connect = [], S.connect

    def counted(members, verified, *more):
        def seen(pairs):
            tried.append(pairs.count())
            return verified(pairs)

        return connect(members, seen, *more)

    monkeypatch.setattr(S, "connect", counted)
    own = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(prints)], "pid long, p binary")
    found = {r["pid"]: r["root"] for r in S.segment_classes(own, 0.8).collect()}
    assert all(found.get(2 * k) == 2 * k == found.get(2 * k + 1) for k in range(50)) and len(found) <= 110
    assert len(tried) > 1 and sum(tried[1:]) < 100


def test_keep_one_keeps_the_smallest_id_of_each_group(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "extra", 5) for d, t in rows], SCHEMA + ", p string, id int")
    kept = S.keep_one(df).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "p", "id"}
    ids, by_text = {r["doc_id"] for r in kept}, {}
    for d, t in rows:
        by_text.setdefault(" ".join(lower(t).split()), []).append(d)
    assert len(ids) == len(kept) and all(sum(d in ids for d in set(same)) <= 1 for same in by_text.values())
    for d, t in rows:  # whatever went is like something that stayed and has a smaller id
        if d not in ids:
            assert any(e in ids and likeness(t, u) >= 0.7 and (d is None or e <= d) for e, u in rows if e is not None)


def test_keep_one_without_ids(spark):
    df = spark.createDataFrame([(None, "same text in all rows here"), (None, "same text in all rows here"), (None, "quite another text with words")], SCHEMA)
    assert S.keep_one(df).count() == 2
