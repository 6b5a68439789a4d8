"""Joins of long texts at the production leaf size: each join encodes a window again and gives the library's ids."""

import numpy as np
import pytest

from gridloom.llm import bpe
from gridloom.llm.common import load_tokenizer

RNG = np.random.default_rng(55)
LONG = {
    "prose": " ".join(RNG.choice("the of and river bridges wasn't 1984 naïve , . — 日本".split(), 30000)),
    "without blanks": "".join(RNG.choice(list("abcdefé日1_"), 150000)),
    "one letter": "a" * 100001,
    "blanks": " " * 100001,
    "lines": "x \n" * 40000,
    "special tokens": "<|endoftext|>" * 9000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_text(name, monkeypatch):
    codec, text = bpe.codec("byte_bpe_50k.json"), LONG[name]
    parts = codec.halves(text, bpe.LEAF_CHARS)
    assert len(parts) > 1 and "".join(parts) == text and max(map(len, parts)) <= bpe.LEAF_CHARS
    leaves, again = codec.encode(parts), []
    encode = codec.encode
    monkeypatch.setattr(codec, "encode", lambda texts: again.extend(texts) or encode(texts))
    ids = codec.tree(leaves)
    assert ids == load_tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert len(again) >= len(parts) - 1


def test_random_texts_and_cuts():
    codec, tok = bpe.codec("byte_bpe_50k.json"), load_tokenizer("byte_bpe_50k.json")
    pieces = ["a", "the", " the", " ", "  ", "\n", "'s", "'", "l", "1", "23", "é", "日本", "!", "🎉", "<|endoftext|>", "<|", "\r\n", "\xa0", "\x85", "eeeeeee"]
    for _ in range(400):
        some = RNG.choice(pieces, RNG.integers(1, 8))
        text = "".join(RNG.choice(some, RNG.integers(1, 300)))
        parts = codec.halves(text, int(RNG.choice([3, 8, 40])))
        assert codec.tree(codec.encode(parts)) == tok.encode(text, add_special_tokens=False).ids, text
