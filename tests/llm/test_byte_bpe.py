import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import ODD, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.load_ranks(PATH)
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.Codec(byte_bpe.load_ranks(PATH), PATTERN)


@given(st.text(max_size=200) | st.text(alphabet="ab \n\t'st \u0085\x1c​1é漢", max_size=80))
@settings(max_examples=600, deadline=None)
def test_ids_match_the_library(text):
    ids = CODEC.encode(text)
    assert ids == ORACLE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000, "é漢" * 700, "x" * 97, "".join(random.Random(1).choice("abcdeé") for _ in range(4000))])
def test_long_words(word):
    ids = CODEC.encode(word)
    assert ids == ORACLE.encode_ordinary(word) and CODEC.decode(ids) == word.encode()
    short, byte_bpe.LONG_WORD = byte_bpe.LONG_WORD, 10**9
    try:
        assert len(word) > 2000 or byte_bpe.merge_word(word.encode(), RANKS) == byte_bpe._merge_long(word.encode(), RANKS)
    finally:
        byte_bpe.LONG_WORD = short


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60)) for i in range(50)] + ODD
    docs = frame(spark, rows)
    got = sorted(map(tuple, byte_bpe.encode_decode(docs, PATH, PATTERN).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = ORACLE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted((r["doc_id"], bytes(r["bytes"]).decode()) for r in back.collect() if r["doc_id"] is not None) == sorted((i, t or "") for i, t in rows if i is not None)


def test_empty_table(spark):
    assert byte_bpe.encode_decode(frame(spark, []), PATH, PATTERN).count() == 0


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 3)
    own = byte_bpe.Codec(RANKS, PATTERN)
    assert own.digest("a b c d e f a b")[1] == ",".join(map(str, ORACLE.encode_ordinary("a b c d e f a b")))
