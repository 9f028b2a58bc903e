"""Patterns of tags begin with the term itself and match where one between ASCII word boundaries does."""

import random
import re

import pytest

from inkstream.functions import press


@pytest.mark.parametrize("term", ["thon", "off-plan", "attion to", "(a", "b+", "-"])
def test_whole_terms(term):
    pattern = press.whole(term)
    assert pattern.startswith(re.escape(term))
    plain = re.compile(rf"\b{re.escape(term)}\b", re.ASCII | re.IGNORECASE)
    draw = random.Random(term)
    for _ in range(3000):
        text = "".join(draw.choice([term, term.upper(), "a", "_", "9", " ", "é", "-", "+", "("]) for _ in range(draw.randint(0, 6)))
        assert bool(re.search(pattern, text, re.ASCII | re.IGNORECASE)) == bool(plain.search(text)), text
