"""What of an interaction event may be kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import ascii_words

#: Longest token and location, and the steps of a progress.
TOKEN, LOCATION = 96, 160
STEPS = (0, 25, 50, 75, 100)


def safe_token(value: Column) -> Column:
    """A short lower-case token; null for anything that may name a person: addresses, queries and long numbers."""
    text = F.substring(F.lower(F.trim(value)), 1, TOKEN)
    private = text.rlike("@|(?:mailto|tel):|[?&#=]") | text.rlike(ascii_words(r"\b[0-9]{7,}\b"))
    return F.when(~private & text.rlike("^[a-z0-9][a-z0-9:_./ -]*$"), text)


def safe_location(value: Column, own_host: str) -> Column:
    """The path of an own address, or host and path of another; no query, no fragment; null for other schemes."""
    text = F.trim(value)
    local = F.regexp_extract(text, "^(/[^?#]*)", 1)
    host, path = (F.regexp_extract(text, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)", i) for i in (1, 2))
    path = F.when(path == "", "/").otherwise(path)
    found = F.when(local != "", local).when(F.lower(host) == own_host, path).when(host != "", F.concat(F.lower(host), path))
    return F.substring(found, 1, LOCATION)


def safe_step(value: Column) -> Column:
    return F.when(value.isin(*STEPS), value)


def snake_case(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
