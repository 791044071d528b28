from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import pytest

from weft.llm import media as M


def png(width: int = 3) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + b"\x12\xff\0\x34" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 64, bytes(range(256)) * 9, b"RIFF" + b"\x10\0\0\0WAVEfmt ", png(), GIF * 3])
def test_stored_payload_reads_back(payload):
    padded = M.pad(payload)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(payload)
    file = M.store(padded)
    assert M.samples(file) == padded
    with wave.open(io.BytesIO(file)) as reader:
        assert (reader.getnchannels(), reader.getsampwidth(), reader.readframes(1 << 20)) == (1, 1, padded)
    kind, found = M.sniff(file)
    assert kind == "audio/wav" and found == [(0, len(file), "audio/wav")]


def test_odd_payloads_are_padded_to_even_chunks():
    assert M.samples(M.store(b"abc")) == b"abc"
    assert M.spans(M.store(b"abc") + png())[1][2] == "image/png"


@pytest.mark.parametrize(("data", "kind"), [(png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (PDF, "application/pdf"), (M.store(b"ab"), "audio/wav")])
def test_types_and_carving(data, kind):
    assert M.sniff(data) == (kind, [(0, len(data), kind)])
    junk = b"GIF89a junk RIFF \x89PNG\r\n\x1a\n"
    assert M.spans(junk + data + junk) == [(len(junk), len(data), kind)]
    assert M.sniff(data[:-3])[0] == M.UNKNOWN
    assert M.sniff(junk + data)[0] == M.UNKNOWN


def section(base: int, extra: bytes = b"") -> bytes:
    """A cross-reference table at an offset, and the section end that names it."""
    return b"xref\n0 1\ntrailer<<>>" + extra + b"\nstartxref\n" + str(base).encode() + b"\n%%EOF\n"


def test_updated_embedded_and_linearised_files_carve_whole():
    first = b"%PDF-1.4\n1 0 obj\nendobj\n"
    whole = first + section(len(first))
    updated = whole + b"2 0 obj\nendobj\n"
    updated += section(len(updated), b"/Prev")
    length = len(updated.rstrip(b"\n"))
    assert M.spans(updated) == [(0, length, "application/pdf")]
    assert M.spans(b"junk" + updated + whole)[0] == (4, length, "application/pdf") and len(M.spans(b"junk" + updated + whole)) == 2
    outer = b"%PDF-1.7\n1 0 obj\nstream\n" + updated + b"endstream\n"
    outer += section(len(outer))
    assert M.spans(outer) == [(0, len(outer.rstrip(b"\n")), "application/pdf")]
    head = b"%PDF-1.5\n9 0 obj<</Linearized 1>>endobj\n"
    line = head + b"xref\n0 1\ntrailer<<>>\nstartxref\n0\n%%EOF\n1 0 obj\nendobj\n" + section(len(head))
    assert M.spans(line) == [(0, len(line.rstrip(b"\n")), "application/pdf")]
    assert M.spans(first + b"startxref\n3\n%%EOF") == []


def test_false_marks_are_cheap():
    import time

    start = time.monotonic()
    assert M.spans(b"%PDF-1.4 %%EOF " * 100_000) == [] and M.spans(b"%PDF-" * 100_000 + b"startxref 7 %%EOF") == []
    assert M.spans((b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 1 << 20) + b"IHDR") * 100_000) == []
    assert time.monotonic() - start < 5


def test_feature_equals_a_plain_loop():
    for payload in (b"\0" * 64, bytes(range(256)) * 3, b"text \xff\x80\x7f" * 50):
        total = energy = crossings = 0
        for k, x in enumerate(payload):
            total += x
            energy += (x - 128) ** 2
            crossings += k > 0 and (x >= 128) != (payload[k - 1] >= 128)
        kind, found = M.sniff(M.store(payload))
        assert M.describe(kind, payload) == f"audio/wav;rate=8000;samples={len(payload)};sum={total};energy={energy};crossings={crossings}"


def test_corruption_is_noticed():
    broken = bytearray(png())
    broken[40] ^= 1
    assert M.spans(bytes(broken)) == []


def test_digests(spark):
    rows = [(1, "text"), (2, None), (3, ""), (4, "text"), (5, "RIFF\x01\0" + "é" * 100_000), (None, "GIF89a")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, feature int")
    got = {r["doc_id"]: r for r in M.media_digests(df).collect()}
    for doc, text in rows:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        file = M.store(padded)
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(file), hashlib.sha256(file).hexdigest())
        assert r["feature"] == M.describe("audio/wav", padded)
    assert got[1]["feature"] == got[4]["feature"] and got[2]["media_sha256"] == got[3]["media_sha256"]
    assert M.media_digests(df.limit(0)).count() == 0


def test_declared_types_are_corrected(spark):
    rows = [(bytearray(png()), "image/gif"), (bytearray(b"plain"), "text/plain"), (None, "audio/wav")]
    df = spark.createDataFrame(rows, "media binary, declared string")
    assert [r["declared"] for r in M.correct_types(df, "media", "declared").collect()] == ["image/png", "text/plain", "audio/wav"]
    carved = df.select(M.carve_column("media").alias("c")).collect()
    assert [[(x["type"], bytes(x["data"])) for x in r["c"]] for r in carved] == [[("image/png", png())], [], []]
    assert [bytes(r[0])[:4] for r in spark.createDataFrame([("t",)], "text string").select(M.store_column("text")).collect()] == [b"RIFF"]
