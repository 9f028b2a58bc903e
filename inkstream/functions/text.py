"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A word boundary between ASCII letters, digits and underscores only, whatever stands around them.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    r"""``pattern`` with ``\b`` as a boundary of ASCII words, which Java's isn't."""
    return pattern.replace(r"\b", BOUNDARY)


def lower(text: Column) -> Column:
    """Lower case letter by letter, as SQL has it: wherever they stand, ``İ`` becomes ``i`` and ``Σ`` becomes ``σ``."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def bare_url(url: Column) -> Column:
    """Lower-cased URL without fragment, query and ``www.`` (then https); a slash at its end stays."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#[^\n]*\z", ""), r"\?[^\n]*\z", "")
    return lower(F.regexp_replace(plain, r"\Ahttps?://www\.", "https://"))


def canonical_url(url: Column) -> Column:
    """Lower-cased URL without fragment, tracking parameters, ``www.`` (then https) and one trailing slash."""
    plain = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|source)(=|$)")), "&")
    head = F.regexp_replace(head, r"^https?://www\.", "https://")
    whole = F.when(kept == "", head).otherwise(F.concat(head, F.lit("?"), kept))
    return F.lower(F.regexp_replace(whole, "/$", ""))


def normalize_title(title: Column) -> Column:
    """Lower case; anything but ASCII word characters and white space is a space; runs of spaces are one."""
    return F.trim(F.regexp_replace(F.regexp_replace(lower(title), r"[^a-z0-9_ \t\n\r]", " "), r"[ \t\n\r]+", " "))


def title_tokens(title: Column, longer_than: int = 2) -> Column:
    """Distinct words of a normalised title with more than ``longer_than`` characters."""
    return F.array_distinct(F.filter(F.split(normalize_title(title), " "), lambda x: F.length(x) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def round_half_up(x: Column) -> Column:
    """Nearest integer; halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda x: x != ""))


def reading_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(text) / 225)).cast("int")


def slugify(title: Column, most: int = 60, least: int = 40) -> Column:
    """At most ``most`` characters, cut at a hyphen if one stands at ``least`` or later."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(plain, 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), "-")
    short = F.when((F.instr(cut, "-") > 0) & (last >= least), cut.substr(F.lit(1), last)).otherwise(cut)
    return F.regexp_replace(F.when(F.length(plain) <= most, plain).otherwise(short), "-+$", "")


def truncate_words(text: Column, most: int, reserved: int | Column = 0) -> Column:
    """``text`` if it fits in ``most`` less ``reserved`` less four characters; else cut at the last blank, and an ellipsis."""
    budget = F.lit(most - 4) - reserved
    cut = text.substr(F.lit(1), budget)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    short = F.concat(F.when((F.instr(cut, " ") > 0) & (last > 0), cut.substr(F.lit(1), last)).otherwise(cut), F.lit("…"))
    return F.when(F.length(text) <= budget, text).otherwise(short)


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def escape_xml(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def decode_xml(text: Column) -> Column:
    """The five named references; the ampersand is decoded first."""
    for coded, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def strip_html(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\n\r]+", " "))


def aed_compact(value: Column) -> Column:
    """AED with B (two decimals), M (one) or K, halves rounded up."""
    return F.when(value >= 1e9, F.format_string("AED %.2fB", F.floor(value / 1e7 + 0.5) / 100)).when(value >= 1e6, F.format_string("AED %.1fM", F.floor(value / 1e5 + 0.5) / 10)).when(value >= 1e3, F.format_string("AED %dK", F.floor(value / 1e3 + 0.5))).otherwise(F.format_string("AED %d", F.floor(value + 0.5)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; a null text has none."""
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2).cast("int")


def plain_text(text: Column) -> Column:
    """Lower-case ASCII letters and digits with single blanks between; ``&`` is spelt out."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


#: References that page text is decoded by, in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def decode_entities(text: Column) -> Column:
    for coded, letter in ENTITIES:
        text = F.replace(text, F.lit(coded), F.lit(letter))
    return text
