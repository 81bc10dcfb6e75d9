import hashlib
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st

import public_tokenizers
from sparkwatch.llm import bpe, common

PATH = common.vocabulary(bpe.VOCABULARY)


def plain(text):
    """Each match of the pattern on its own, as the library encodes it."""
    encoder = common.byte_bpe(PATH)
    return [t for m in regex.finditer(public_tokenizers.PATTERN, text) for t in encoder._encode_single_piece(m[0].encode())]


PARTS = ["the", " quick", "  ", "\n", "\n\n ", "'", "'re", "'s", "r", "e", "ll", "!!", "…", "漢字", "é", "ß", "12", " 345", " ", "\t", "aaaa", "\x1c", "😀", " '", "v"]


@pytest.mark.parametrize("leaf,near", [(4, 0), (4, 12), (7, 0), (16, 8)])
def test_random_mixtures_agree_with_the_plain_encoder(leaf, near):
    codec = bpe.Codec(PATH, leaf, near)
    r = random.Random(leaf * 100 + near)
    for _ in range(1500):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == plain(text), repr(text)
        assert codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    codec = bpe.Codec(PATH, 5, 0)
    assert codec.encode(text) == plain(text)


def test_giant_runs():
    codec = bpe.Codec(PATH)
    r = random.Random(5)
    for text in ["a" * 30_000, " " * 30_000 + "x", "".join(r.choice("abcdeth") for _ in range(30_000)), "漢字かな" * 5_000, "!?" * 9_000 + "'re"]:
        assert codec.encode(text) == plain(text)


def test_documents(spark):
    rows = [(1, "Hello world, it's me"), (2, None), (3, ""), (1, "Hello world, it's me"), (None, "x y " * 9_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.digests(df).collect()), key=str)
    want = []
    for i, text in rows:
        ids = plain(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0)).collect() == []
