"""Shapes of JSON values, declared as nested kinds and compiled to one Column over VARIANT.

A kind tells whether a value is of it; a value that isn't there is of none. Numbers, texts and flags are told apart by
the value's own type, never by what it could be cast to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BLANKS = r"^[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
ISO = r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,3})?|24:00:00(?:\.0{1,3})?)Z$"
HTTPS = r"(?i)^\s*https:(?://)?(?![^/?#\\]*@)[^\s/?#:@\\<>^|%]+(?::(?:0*443)?)?(?:[/?\\][^#]*)?#?\s*$"
LONGEST_URL = 2048


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """The value if it is a text, else null."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLANKS, ""), BLANKS[1:] + "$", "")


def bounded(text: Column, least: int, most: int) -> Column:
    return (units(trimmed(text)) >= least) & (units(text) <= most) & ~text.rlike(CONTROL)


def entries(value: Column) -> Column:
    """An object's fields as a map, null for anything else."""
    return F.when(F.startswith(kind_of(value), F.lit("OBJECT")), F.try_variant_get(value, "$", "map<string,variant>"))


def items(value: Column) -> Column:
    return F.when(F.startswith(kind_of(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))


def millis(iso: Column) -> Column:
    """Milliseconds since 1970 of a text of ``ISO``; a day beyond its month's end counts on into the next."""
    part = lambda i, n: F.substring(iso, i, n).cast("bigint")
    month = F.datediff(F.make_date(part(1, 4).cast("int"), part(6, 2).cast("int"), F.lit(1)), F.lit("1970-01-01").cast("date"))
    fraction = F.rpad(F.regexp_extract(iso, r"\.([0-9]+)Z$", 1), 3, "0").cast("bigint")
    seconds = ((month + part(9, 2) - 1) * 24 + part(12, 2)) * 3600 + part(15, 2) * 60 + part(18, 2)
    return F.when(iso.rlike(ISO), seconds * 1000 + fraction)


class Kind:
    def ok(self, value: Column) -> Column:
        raise NotImplementedError


class Anything(Kind):
    def ok(self, value: Column) -> Column:
        return value.isNotNull()


@dataclass(frozen=True)
class Text(Kind):
    """A text that is ``least`` long without blanks at its ends and ``most`` with them, free of control characters."""

    least: int
    most: int
    pattern: str | None = None

    def ok(self, value: Column) -> Column:
        fits = lambda text: bounded(text, self.least, self.most)
        return bind(text_of(value), lambda text: fits(text) & text.rlike(self.pattern) if self.pattern else fits(text))


class Iso(Kind):
    def ok(self, value: Column) -> Column:
        return text_of(value).rlike(ISO)


class Https(Kind):
    """An https address without user, fragment or odd port."""

    def ok(self, value: Column) -> Column:
        return bind(text_of(value), lambda text: bounded(text, 1, LONGEST_URL) & text.rlike(HTTPS))


@dataclass(frozen=True)
class OneOf(Kind):
    values: tuple[str, ...]

    def ok(self, value: Column) -> Column:
        return text_of(value).isin(*self.values)


class Flag(Kind):
    def ok(self, value: Column) -> Column:
        return kind_of(value) == "BOOLEAN"


class Number(Kind):
    def ok(self, value: Column) -> Column:
        return kind_of(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


@dataclass(frozen=True)
class Items(Kind):
    each: Kind
    least: int
    most: int

    def ok(self, value: Column) -> Column:
        every = lambda found: F.forall(found, lambda x: F.coalesce(self.each.ok(x), F.lit(False)))
        return bind(items(value), lambda found: F.size(found).between(self.least, self.most) & every(found))


@dataclass(frozen=True)
class Record(Kind):
    """An object whose ``fields`` are of their kinds and whose ``optional`` ones are, where they are there.

    A ``closed`` one has no other fields. ``rule`` is a condition on the object's fields as a map.
    """

    fields: dict[str, Kind] = field(default_factory=dict)
    optional: dict[str, Kind] = field(default_factory=dict)
    closed: bool = True
    rule: Callable[[Column], Column] | None = None

    def ok(self, value: Column) -> Column:
        return bind(entries(value), self._holds)

    def _holds(self, found: Column) -> Column:
        good = found.isNotNull()
        if self.closed:
            good = good & F.forall(F.map_keys(found), lambda k: k.isin(*self.fields, *self.optional))
        for name, kind in self.fields.items():
            good = good & _of(kind, F.try_element_at(found, F.lit(name)))
        for name, kind in self.optional.items():
            good = good & (~F.map_contains_key(found, name) | _of(kind, F.try_element_at(found, F.lit(name))))
        return good & F.coalesce(self.rule(found), F.lit(False)) if self.rule else good


def _of(kind: Kind, value: Column) -> Column:
    return bind(value, lambda v: F.coalesce(kind.ok(v), F.lit(False)))


@dataclass(frozen=True)
class Optional(Kind):
    """Not there at all, or of the kind; a null is there."""

    kind: Kind

    def ok(self, value: Column) -> Column:
        return value.isNull() | self.kind.ok(value)


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that doesn't hold, null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks], F.lit(None).cast("string"))
