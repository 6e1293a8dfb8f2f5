"""Byte-level BPE against the tokenizer library."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe
from gridloom.llm.common import driver_path

PATH = driver_path("byte_bpe_50k.tiktoken")
RANKS = bpe.Ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
SPLIT = regex.compile(P.PATTERN).findall


def encoded(text):
    return [t for piece in SPLIT(text) for t in RANKS.encode_piece(piece.encode())]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert encoded(text) == LIBRARY.encode_ordinary(text)
    assert RANKS.decode(encoded(text)) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "th", "=", "-=", "aé", "日本", "0"])
def test_long_pieces(letters):
    draw = random.Random(0)
    text = "".join(draw.choice(letters) for _ in range(5000))
    assert encoded(text) == LIBRARY.encode_ordinary(text)


def test_every_token_encodes_to_itself():
    assert all(RANKS.merge(token) == [i] for token, i in RANKS.ids.items())


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60))
def test_join_is_encoding_of_concatenation(a, b):
    assert RANKS.join(RANKS.merge(a), RANKS.merge(b)) == RANKS.merge(a + b)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello " * 3, "x"), (3, "hello " * 3, "x"), (None, "ab\n\n" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    done = bpe.digests(bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)).collect()
    for r in done:
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.decode(bpe.encode(df.limit(0), PATH, P.PATTERN), PATH).count() == 0
