"""Byte-level BPE: exact encoding in linear time by backtracking over longest matches, and decoding.

A rank file gives the vocabulary. Bytes are mapped to Latin-1 so that an Aho-Corasick automaton can find, in one pass,
the longest token that starts at every byte of a piece. The encoder then walks left to right: it takes the longest
token that is compatible with the one before it, falls back to the longest shorter prefix, and drops the previous token
where none fits; a bit per position keeps dead ends from being tried twice. Two tokens are compatible if merging their
joint bytes would leave exactly these two, which is decided by undoing merges on both sides and memoised. Every
prefix of an exact encoding is exact, hence the result equals repeated lowest-rank merging.

With the pattern CHUNKED, texts are first cut where it can never match across: before a blank that is followed by a
non-blank, and around longer white space. Such chunks repeat a great deal, so a bounded memo maps a chunk to its packed
ids; the pattern itself runs on chunks that the memo lacks. Of any other pattern no cuts are known, so it runs over the whole
text, and the memo holds its matches.

Defined cases: null counts as empty; an empty text has no ids and decodes to no bytes; special tokens are never
produced, their spelling is ordinary text. Repeated rows give repeated results and an empty table an empty result;
other columns are not read. The rank file is read on the driver and broadcast: its size is fixed by the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.text import utf8

#: White space as the pattern's engine defines it (Unicode's White_Space property).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNKS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")
#: Fixed value: the pattern whose matches never cross the borders of CHUNKS.
CHUNKED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a memo may hold before it starts anew; a chunk longer than LONG is not kept. Bounds a worker's memory.
MEMO, LONG = 250_000, 64
NONE = -1


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens of a rank file (base64 token, blank, rank per line) in rank order."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [token for _, token in pairs]


class Codec:
    """Encoder and decoder for one vocabulary and pre-tokenisation pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {token: k for k, token in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.chunked = pattern == CHUNKED
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.size = [len(token) for token in tokens]
        #: (left, right) whose merge made a token; a token no merge makes is its own left and right.
        self.split = [(k, k) for k in range(len(tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [NONE] * len(tokens)
        self.fits: dict[int, bool] = {}
        self.matcher = ahocorasick.Automaton()
        made = []
        for k, token in enumerate(tokens):
            if len(token) > 1:
                parts = self._parts(token, k)
                if parts is None:
                    continue  # no sequence of merges yields it inside a longer piece
                self.split[k] = parts
                self.merged[parts] = k
            made.append(k)
            self.matcher.add_word(token.decode("latin-1"), k)
        self.matcher.make_automaton()
        reachable = {tokens[k] for k in made}
        for k in made:
            token = tokens[k]
            self.shorter[k] = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), NONE)
        self.packed: dict[str, bytes] = {}
        self.unit = [k.to_bytes(4, "little") for k in range(len(tokens))]

    def _parts(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens that merging by ranks below limit leaves of a token's bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], limit))
            if self.rank.get(parts[best] + parts[best + 1], limit) >= limit:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right by rank would never join across their border; memoised."""
        bound, a, b, good = len(self.tokens), left, right, True
        while True:
            if self.merged.get((a, b), bound) < bound:
                good = False
                break
            # Undo the latest merge on either side; bound is the rank that a join here must have come before.
            if a > b and self.split[a][1] != a:
                bound, a = a, self.split[a][1]
            elif a <= b and self.split[b][0] != b:
                bound, b = b + 1, self.split[b][0]
            elif self.split[a][1] != a:
                bound, a = a, self.split[a][1]
            elif self.split[b][0] != b:
                bound, b = b + 1, self.split[b][0]
            else:
                break
        if len(self.fits) > MEMO:
            self.fits.clear()
        self.fits[left << 32 | right] = good
        return good

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [NONE] * n
        size, shorter, compatible, fits = self.size, self.shorter, self._compatible, self.fits
        for end, k in self.matcher.iter(data.decode("latin-1")):
            longest[end + 1 - size[k]] = k  # matches come by their ends, so the last from a start is the longest
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            before = out[-1] if out else NONE
            while token != NONE:
                if alive[at + size[token]]:
                    if before == NONE:
                        break
                    good = fits.get(before << 32 | token)
                    if good if good is not None else compatible(before, token):
                        break
                token = shorter[token]
            if token != NONE:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                alive[at] = 0
                token = shorter[out.pop()]
                at -= size[before]

    def _pieces(self, text: str) -> list[str]:
        return [found[0] for found in self.pattern.finditer(text) if found[0]]

    def _chunk(self, chunk: str) -> bytes:
        if not self.chunked or chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " ":
            ids = self.piece(chunk.encode())
        else:
            ids = [k for piece in self._pieces(chunk) for k in self.piece(piece.encode())]
        unit = self.unit
        packed = b"".join([unit[k] for k in ids])
        if len(chunk) <= LONG:
            if len(self.packed) >= MEMO:
                self.packed.clear()
            self.packed[chunk] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, fresh = self.packed.get, self._chunk
        chunks = CHUNKS.findall(text) if self.chunked else self._pieces(text)
        return b"".join([known(chunk) or fresh(chunk) for chunk in chunks])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def forget(self) -> None:
        """Empty the memos: worker processes outlive their tasks."""
        self.packed.clear()
        self.fits.clear()

    def decode_packed(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[k] for k in np.frombuffer(packed, "<u4").tolist()])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[k] for k in ids])


@lru_cache(maxsize=2)
def _codec(digest: str, data: Broadcast, pattern: str) -> Codec:
    return Codec(parse_ranks(data.value), pattern)


def codec_of(data: Broadcast, digest: str, pattern: str) -> Codec:
    """One codec per worker process; the digest identifies the vocabulary whatever broadcast carried it."""
    return _codec(digest, _Same(data), pattern)


class _Same:
    """Compares equal to any other, so that the cache goes by the digest alone."""

    def __init__(self, data: Broadcast):
        self.data = data

    @property
    def value(self) -> bytes:
        return self.data.value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Same)


def send_ranks(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    with open(path, "rb") as file:
        data = file.read()
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as an array of lists, without another copy of the ids."""
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)


def encode_column(spark: SparkSession, text: str | Column, path: str, pattern: str) -> Column:
    """array<int> of a text's ids."""
    data, digest = send_ranks(spark, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(data, digest, pattern)
        for texts in batches:
            yield _lists([codec.encode_packed(x.as_py().decode("utf-8", "replace")) for x in texts])
        codec.forget()

    return encode(utf8(text))


def decode_column(spark: SparkSession, ids: str | Column, path: str, pattern: str = r"(?s:.)") -> Column:
    """The bytes that an array of ids stands for; null counts as no ids."""
    data, digest = send_ranks(spark, path)

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        codec = codec_of(data, digest, pattern)
        return pa.array([codec.decode(x.as_py() or []) for x in lists], pa.binary())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the packed ids, SHA-256 of the bytes they decode to."""
    data, digest = send_ranks(docs.sparkSession, path)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(data, digest, pattern)
        for texts in batches:
            counts, ids, decoded = [], [], []
            for x in texts:
                packed = codec.encode_packed(x.as_py().decode("utf-8", "replace"))
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode_packed(packed)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()

    out = docs.select(F.col(id_col), digests(utf8(text_col)).alias("__d"))
    return out.select(id_col, "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids, and round_trip (whether the ids decode to the text's bytes)."""
    data, digest = send_ranks(docs.sparkSession, path)

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(data, digest, pattern)
        for texts in batches:
            packed, same = [], []
            for x in texts:
                raw = x.as_py()
                packed.append(codec.encode_packed(raw.decode("utf-8", "replace")))
                same.append(codec.decode_packed(packed[-1]) == raw)
            yield pa.StructArray.from_arrays([_lists(packed), pa.array(same, pa.bool_())], ["ids", "round_trip"])
        codec.forget()

    out = docs.select(F.col(id_col), encoded(utf8(text_col)).alias("__e"))
    return out.select(id_col, F.size("__e.ids").cast("long").alias("n_tokens"), "__e.ids", "__e.round_trip")
