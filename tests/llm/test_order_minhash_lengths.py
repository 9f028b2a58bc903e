"""Likeness of order MinHash fingerprints doesn't depend on the side of a power of two on which a length lies."""

import random

import pytest

from inkstream.llm.order_minhash import fingerprint, likeness


@pytest.mark.parametrize("length", [1 << 16, 1 << 20, 1 << 21])
def test_near_copies_across_a_length(length):
    draw = random.Random(length)
    stock = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(5000)]
    text = " ".join(draw.choices(stock, k=length // 5))[: length + 200]
    assert likeness(fingerprint(text), fingerprint(text[: length - 200])) > 0.9


def test_repeats_are_numbered_in_text_order():
    assert (fingerprint("abcde" * 50) != fingerprint("abcde" * 100)).any()
    assert (fingerprint("aaaaaaaab") != fingerprint("baaaaaaaa")).any()
