"""Media columns: lossless storage of bytes as samples, and typing and carving by signature.

store() wraps a payload as 8-bit mono PCM in a RIFF/WAVE file. sniff() trusts no declared type: one Aho-Corasick pass
over the bytes locates the magic numbers of all known formats, and a validator per format then follows the format's own
structure (chunk lengths, checksums, trailers) to confirm the hit and find the exact extent. Confirmed extents are
taken outermost first, so that magic bytes inside another medium's samples do not count, and each is carved.

Defined cases: a null payload counts as empty; an empty payload is stored as one padding unit; bytes that confirm no
format have type "application/octet-stream" and nothing carved. Equal inputs give equal outputs, repeated rows repeated
results, an empty table an empty result. media_digests reads no other columns, whatever their names, and correct_types passes
them through. Memory per value is a small multiple of its size.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import utf8

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data followed by zero bytes up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def store(payload: bytes) -> bytes:
    """An 8-bit mono WAVE file with the payload as its samples."""
    n = len(payload)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)
    body = b"WAVE" + head + payload + b"\0" * (n % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_chunks(data: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Chunks (offset, length) of the WAVE file at an offset, under "" its end; None if its structure is broken."""
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    found, here = {b"": (at, end - at)}, at + 12
    while here < end:
        if here + 8 > end:
            return None
        size = struct.unpack_from("<I", data, here + 4)[0]
        if here + 8 + size > end:
            return None
        found[data[here : here + 4]] = (here + 8, size)
        here += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found or found[b"fmt "][1] < 16:
        return None
    return found


def _wave(data: bytes, at: int) -> int | None:
    found = wave_chunks(data, at)
    return found and found[b""][1]


def _png(data: bytes, at: int) -> int | None:
    here, first = at + 8, True
    while here + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, here)
        stop = here + 12 + size
        if stop > len(data) or first and (size, kind) != (13, b"IHDR"):
            return None
        if zlib.crc32(data[here + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        here, first = stop, False
        if kind == b"IEND":
            return here - at
    return None


def _gif(data: bytes, at: int) -> int | None:
    if len(data) < at + 13:
        return None
    flags = data[at + 10]
    here = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while here < len(data):
        kind = data[here]
        if kind == 0x3B:
            return here + 1 - at if images else None
        if kind == 0x21:
            here += 2
        elif kind == 0x2C and here + 10 <= len(data):
            local = data[here + 9]
            here += 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1
            images += 1
        else:
            return None
        while here < len(data) and data[here]:
            here += data[here] + 1
        here += 1
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    here, scanned = at + 2, False
    while here + 4 <= len(data):
        if data[here] != 0xFF:
            return None
        kind = data[here + 1]
        if kind == 0xD9:
            return here + 2 - at if scanned else None
        if kind == 0xFF:
            here += 1
            continue
        size = struct.unpack_from(">H", data, here + 2)[0]
        if size < 2:
            return None
        here += 2 + size
        if kind == 0xDA:
            scanned = True
            while (here := data.find(b"\xff", here)) >= 0 and here + 1 < len(data) and (data[here + 1] == 0 or 0xD0 <= data[here + 1] <= 0xD7):
                here += 2
            if here < 0:
                return None
    return here + 2 - at if scanned and data[here : here + 2] == b"\xff\xd9" else None


#: The end of a PDF section: where its cross-reference section starts, counted from the file's first byte.
SECTION_END = re.compile(rb"startxref\s+(\d{1,10})\s+%%EOF")
#: What a cross-reference section starts with: a table, or an object that holds it.
SECTION = re.compile(rb"xref\b|\d{1,10}\s+\d{1,5}\s+obj\b")


@lru_cache(maxsize=1)
def _section_ends(data: bytes) -> list[tuple[int, int, int]]:
    """(place, offset it names, end) of all PDF section ends; looked for once, however many headers there are."""
    return [(m.start(), int(m[1]), m.end()) for m in SECTION_END.finditer(data)]


def _pdf(data: bytes, at: int) -> int | None:
    """The end of the last section. An update is appended and names a cross-reference section behind the section before
    it; a linearised file starts with a section that names none, and the next one points back into it. Section ends that fit
    neither belong to other files: embedded ones, or ones that follow."""
    ends = _section_ends(data)
    end, opening = 0, False
    for place, offset, stop in ends[bisect_left(ends, (at,)) :]:
        if end == 0 and offset == 0 and not opening:
            opening = data.find(b"/Linearized", at, at + 1024) >= 0
        elif (end or at) <= at + offset < place and SECTION.match(data, at + offset):
            end = stop
    return end - at if end else None


#: Magic bytes, their offset in the file, type, validator.
FORMATS = (
    (b"RIFF", "audio/wav", _wave),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
)


@lru_cache(maxsize=1)
def _matcher() -> ahocorasick.Automaton:
    matcher = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        matcher.add_word(magic.decode("latin-1"), (k, len(magic)))
    matcher.make_automaton()
    return matcher


def spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of every confirmed medium that lies in no other one, by start."""
    found, covered = [], 0
    for end, (k, n) in _matcher().iter(data.decode("latin-1")):
        start = end + 1 - n
        if start < covered:
            continue
        length = FORMATS[k][2](data, start)
        if length:
            found.append((start, length, FORMATS[k][1]))
            covered = start + length
    return found


def sniff(data: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The type of the medium that starts the bytes (UNKNOWN if none) and all outermost media."""
    found = spans(data)
    return (found[0][2] if found and found[0][0] == 0 else UNKNOWN), found


def samples(media: bytes) -> bytes:
    """The stored payload, read back through the confirmed structure of the WAVE file."""
    chunks = wave_chunks(media, 0)
    if chunks is None:
        raise ValueError("not a WAVE file")
    start, size = chunks[b"data"]
    return media[start : start + size]


def describe(kind: str, payload: bytes) -> str:
    """Integer features of the samples: length, sum, sum of squares, sign changes about the middle."""
    x = np.frombuffer(payload, np.uint8)
    energy = sum(int(np.square(x[i : i + (1 << 20)].astype(np.int64) - 128).sum()) for i in range(0, len(x), 1 << 20))
    high = x >= 128
    return f"{kind};rate={RATE};samples={len(x)};sum={int(x.sum(dtype=np.int64))};energy={energy};crossings={int((high[1:] != high[:-1]).sum())}"


def store_column(text: str | Column) -> Column:
    """Media bytes of a text's padded UTF-8 bytes."""

    @F.arrow_udf("binary")
    def as_media(texts: pa.Array) -> pa.Array:
        return pa.array([store(pad(x.as_py())) for x in texts], pa.binary())

    return as_media(utf8(text))


def sniff_column(media: str | Column) -> Column:
    """struct(type, spans): the true type and all carved extents (start, length, type)."""

    @F.arrow_udf("type string, spans array<struct<start:long,length:long,type:string>>")
    def typed(values: pa.Array) -> pa.Array:
        rows = [sniff(x.as_py() or b"") for x in values]
        listed = pa.array(
            [[{"start": s, "length": n, "type": t} for s, n, t in found] for _, found in rows],
            pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])),
        )
        return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), listed], ["type", "spans"])

    return typed(F.col(media) if isinstance(media, str) else media)


def carve_column(media: str | Column) -> Column:
    """array<struct(type, data)>: every outermost medium inside the bytes."""

    @F.arrow_udf("array<struct<type:string,data:binary>>")
    def carved(values: pa.Array) -> pa.Array:
        out = []
        for x in values:
            data = x.as_py() or b""
            out.append([{"type": t, "data": data[s : s + n]} for s, n, t in spans(data)])
        return pa.array(out, pa.list_(pa.struct([("type", pa.string()), ("data", pa.binary())])))

    return carved(F.col(media) if isinstance(media, str) else media)


def correct_types(df: DataFrame, media_col: str, declared_col: str) -> DataFrame:
    """df with declared_col replaced by the sniffed type where the bytes confirm one (null media keep theirs)."""
    kind = sniff_column(F.coalesce(F.col(media_col), F.lit(b""))).getField("type")
    fixed = F.when(kind == UNKNOWN, F.col(declared_col)).otherwise(kind)
    return df.withColumn(declared_col, fixed)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as media, then sniff, carve and read back, and describe what was read.

    The file is held one row at a time: digests leave the worker, media do not (store_column and carve_column give
    the files themselves).
    """

    @F.arrow_udf(
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    def digests(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            data = x.as_py()
            media = store(pad(data))
            kind, found = sniff(media)
            start, length, _ = found[0]
            payload = samples(media[start : start + length])
            rows.append(
                (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(kind, payload))
            )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    out = docs.select(F.col(id_col), digests(utf8(text_col)).alias("__m"))
    return out.select(id_col, "__m.*")
