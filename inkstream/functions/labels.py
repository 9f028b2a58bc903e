"""Excerpts, labels and kinds of articles and their media."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import ascii_words, plain_text

#: Kinds of files by their endings.
MIME = {"png": "image/png", "webp": "image/webp", "avif": "image/avif", "gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
VIDEO = ("mp4", "webm", "mov")
#: Words of a paragraph that says what follows from the news.
CONSEQUENCE = r"(?i)\b(?:thesis|implication|watchpoint|risk|for (?:buyers|investors|sellers|developers|allocators))\b"
VOICE_PARAGRAPHS, VOICE_LENGTH = 3, 600


def ending(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def image_mime(url: Column) -> Column:
    return F.coalesce(*[F.when(ending(url) == k, v) for k, v in MIME.items()], F.lit("image/jpeg"))


def media_kind(url: Column) -> Column:
    return F.when(ending(url).isin(*VIDEO), "video").otherwise("image")


def first_paragraph(body: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(body, F.lit("")), "\n\n"), 1))


def consequence_excerpt(body: Column, points: Column, pattern: str = CONSEQUENCE) -> Column:
    """The first paragraph that says what follows, else the third point, else the first."""
    paragraphs = F.filter(F.split(F.coalesce(body, F.lit("")), "\n\n+"), lambda p: (p != "") & p.rlike(ascii_words(pattern)))
    return F.coalesce(F.get(paragraphs, 0), F.get(points, 2), F.get(points, 0))


def voice_excerpt(text: Column) -> Column:
    """The first three paragraphs, white space collapsed, of 600 characters at most."""
    parts = F.slice(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\n\s*\n"), lambda p: F.trim(p) != ""), 1, VOICE_PARAGRAPHS)
    return F.substring(F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")), 1, VOICE_LENGTH)


def supported_alt(alt: Column, title: Column) -> Column:
    """An alt text, unless it only repeats the title."""
    text = F.trim(F.coalesce(alt, F.lit("")))
    return F.when(plain_text(text) == plain_text(title), "").otherwise(text)


def display_markets(title: Column, subtitle: Column, markets: Column, abroad: tuple[str, ...], home: tuple[str, ...]) -> Column:
    """A market abroad that the headline names, where it names none at home or begins with it; else ``markets``."""
    text = F.concat(F.lit(" "), plain_text(F.concat_ws(" ", title, subtitle)), F.lit(" "))
    named = F.coalesce(*[F.when(F.contains(text, F.lit(f" {m.lower()} ")), m) for m in abroad])
    local = F.lit(False)
    for m in home:
        local = local | F.contains(text, F.lit(f" {m.lower()} "))
    alone = ~local | F.startswith(plain_text(title), F.lower(named))
    return F.when(named.isNotNull() & alone, F.array(named)).otherwise(markets)


def address(raw: Column) -> list[Column]:
    """Name and lower-case address of a sender line."""
    mail = F.lower(F.regexp_extract(F.coalesce(raw, F.lit("")), r"([^\s<>\"]+@[^\s<>\"]+)", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]*>", ""), '"', ""))
    return [F.when(name == mail, "").otherwise(name), mail]
