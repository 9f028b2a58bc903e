"""Figures in prose, their normal form and the signs that a text holds any."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import ascii_words

#: Currency marks and units that make a number a figure; a blank may be left out, ``+`` asks for one.
CURRENCIES = ("AED", "USD", "US$", "$", "€", "£", "Dhs", "Dh")
UNITS = ("%", "per cent", "bps", "pp", "p.a.", "per+annum", "bn", "billion", "million", "trillion", "tn", "sq ft", "sq. ft", "psf")
DASHES = "-–"


def _any_of(terms: tuple[str, ...]) -> str:
    """An alternation, longer terms first."""
    spelt = [re.escape(t).replace(r"\ ", r"\s?").replace(" ", r"\s?").replace(r"\+", r"\s+") for t in sorted(terms, key=len, reverse=True)]
    return "(?:" + "|".join(spelt) + ")"


GROUPED, PLAIN = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?", r"[0-9]+(?:\.[0-9]+)?"
NUMBER = f"(?:{GROUPED}|{PLAIN})"


def figure_pattern(short_unit: str, units: tuple[str, ...] = UNITS) -> str:
    """A number or a range with what currency and unit stand at it. ``short_unit`` is the pattern of a lone m or k."""
    upto = rf"(?:\s*[{DASHES}]\s*{NUMBER})?"
    return rf"(?i){_any_of(CURRENCIES)}?\s?{NUMBER}{upto}\s*(?:{_any_of(units)}|{short_unit})?"


FIGURE = figure_pattern("[mk](?![a-z])")
#: What is found but is no figure: a bare whole number, and a span of two years.
NO_FIGURE = rf"^\s*(?:[0-9]+|(?:19|20)[0-9]{{2}}\s*[{DASHES}]\s*(?:19|20)[0-9]{{2}})\s*$"
SIGNAL = rf"(?i){_any_of(CURRENCIES)}\s?[0-9]|[0-9][0-9,]*(?:\.[0-9]+)?\s*{_any_of(UNITS)}|[0-9]{{1,3}}(?:,[0-9]{{3}})+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def figures(text: Column) -> Column:
    """Distinct figures in the order of their first place, lower-cased, runs of white space as one blank."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda m: ~m.rlike(NO_FIGURE)), collapsed))


def norm_numeric(text: Column) -> Column:
    """The form in which figures are compared: one currency name, ``%``, no thousands commas, no blanks, plain dashes."""
    text = F.regexp_replace(collapsed(text), ascii_words(r"\b(?:dhs?|aed)\b"), "aed")
    text = F.regexp_replace(text, ascii_words(r"\bper\s*cent\b"), "%")
    text = F.regexp_replace(text, ascii_words(r"(?<=[0-9]),(?=[0-9]{3}\b)"), "")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[–—]", "-")


def has_stat_signal(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(SIGNAL)


def digits_backed(figure: Column, evidence: Column) -> Column:
    """Whether the digits of a figure, two or more, occur in a row among the digits of the evidence."""
    core, all_ = (F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "") for x in (figure, evidence))
    return (F.length(core) >= 2) & F.contains(all_, core)


#: A sum of money in a headline, where case counts, and a number as the review desk marks it.
MONEY = ascii_words(r"(?:AED|aed|USD|usd|\$|€)\s*[0-9]+(?:[.,][0-9]+)?\s*(?:M|B|K|million|billion|thousand)\b")
DESK_NUMBER = r"(?i)(?:AED|USD|Dh|\$|€|£)?\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:%|bps|bn|mn|billion|million|sqft|sq\.?\s?ft|M|B|K))?"


def money(text: Column) -> Column:
    """Sums of money in order, repeats and all."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(0))


def desk_numbers(text: Column) -> Column:
    """Numbers with the currency and unit that stand at them, in order, without white space around."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DESK_NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
