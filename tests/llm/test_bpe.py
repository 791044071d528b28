from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.Codec(bpe.parse_ranks(file.read()), PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.rank, special_tokens={})


def test_every_token_encodes_to_itself(codec):
    for k, token in enumerate(codec.tokens):
        assert codec.piece(token) == [k]


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n\n a", "a" * 3000, "ab" * 1500, " " * 500, "x" + " \n" * 200, "<|endoftext|> don't we'll", "\x1c\x1d \x85\xa0　", "Ünïcödé 中文字 𐍈𐍉 é", "１２3²"],
)
def test_matches_the_library(codec, reference, text):
    assert codec.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips_and_matches(codec, reference, text):
    text = text.encode("utf-8", "replace").decode()
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_pieces_equal_plain_merging(codec):
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice(b"aeinrst hl\xc3\xa9\xff") for _ in range(rng.randrange(1, 30)))
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [codec.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert codec.piece(data) == ([codec.rank[data]] if data in codec.rank else [codec.rank[p] for p in parts])


def test_memo_may_overflow(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    with open(PATH, "rb") as file:
        small = bpe.Codec(bpe.parse_ranks(file.read()), PATTERN)
    text = "many different words make the memo start anew again and again"
    assert small.encode(text) == reference.encode_ordinary(text)


def test_round_trip_query(spark, reference):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "é" * 70_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.round_trip(df, PATH, PATTERN).collect()), key=str)
    import numpy as np

    def row(doc, text):
        ids = reference.encode_ordinary(text or "")
        return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((row(i, t) for i, t in rows), key=str)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_columns_and_documents(spark):
    df = spark.createDataFrame([(1, "Some text"), (2, None)], "doc_id long, text string")
    out = df.withColumn("ids", bpe.encode_column(spark, "text", PATH, PATTERN)).withColumn("back", bpe.decode_column(spark, "ids", PATH))
    assert [bytes(r["back"]) for r in out.orderBy("doc_id").collect()] == [b"Some text", b""]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in bpe.encode_documents(df, PATH, PATTERN).collect())


@pytest.mark.parametrize("pattern", [r" ?\p{L}+| ?[^\s\p{L}]+[\r\n]*|\s+", r"(\w+)|[^\w]", r"\S+\s*", r"(?s:.)"])
def test_other_patterns_equal_piecewise_encoding(codec, pattern):
    other = bpe.Codec(codec.tokens, pattern)
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=codec.rank, special_tokens={})
    for text in ("hello!\n\nworld", "a  b\t\nc don't", " x" * 50, "1 2.3,  é中 \n", ""):
        assert other.encode(text) == library.encode_ordinary(text)


def test_broken_rank_file():
    with pytest.raises(ValueError):
        bpe.parse_ranks(b"YQ== 0\nYg== 2\n")
