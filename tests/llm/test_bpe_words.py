"""Many different words: none is merged by itself, and ids are the library's."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from inkstream.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def encoded(own, texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all([own.pattern.findall(x) for x in texts])]


def test_different_words_are_merged_together(library, monkeypatch):
    draw, alone = random.Random(4), []
    merge = byte_bpe.Codec.merge
    monkeypatch.setattr(byte_bpe.Codec, "merge", lambda self, piece: alone.append(piece) or merge(self, piece))
    own = byte_bpe.Codec(PATH, public_tokenizers.PATTERN, limit=100)
    for _ in range(3):
        texts = [" ".join("".join(draw.choice(["th", "nde", "able", "hé", "ing", "ß"]) for _ in range(draw.randrange(1, 8))) for _ in range(300)) for _ in range(20)]
        assert encoded(own, texts) == [library.encode_ordinary(x) for x in texts]
    assert all(piece in own.ranks for piece in alone)


def test_words_of_all_lengths(library):
    draw = random.Random(5)
    own = byte_bpe.Codec(PATH, public_tokenizers.PATTERN, limit=100)
    letters = ["ab", "aaab", "etaoinshr ", "été ñ中文😀", "0123456789", "\n\t !?#$%&", "\x00\x01\x7f"]
    texts = ["", *("".join(draw.choice(draw.choice(letters)) for _ in range(n)) for n in range(1, 200))]
    texts += [draw.choice(["a", "é"]) * n + "b" for n in (byte_bpe.SHORT - 1, byte_bpe.SHORT, byte_bpe.SHORT + 1, 700)]
    for some in (texts, texts[:1], []):
        assert encoded(own, some) == [library.encode_ordinary(x) for x in some]
    assert [own.decode(ids) for ids in own.encode_all([own.pattern.findall(x) for x in texts])] == [x.encode() for x in texts]
