"""JSON of any shape in one form, and names in a reader's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's root order: accents and case count only between names otherwise equal.
LOCALE, LOCALE_CI = "UNICODE", "UNICODE_CI"


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of every object in order, at any depth, and numbers in one form; null if it is none.

    Texts that differ only in white space, key order, or how a number is padded give the same. An object that repeats
    a key is refused. Numbers in exponent form stay floating.
    """
    return F.to_json(F.try_parse_json(text))


def json_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def in_locale(name: Column, rule: str = LOCALE) -> Column:
    """``name`` as a sort or group key in the order of Unicode's root locale."""
    return F.collate(name, rule)
