"""Quality gates of a draft: eight that name what fails, and six of a voice."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import ascii_words, utf16_length, word_count

#: Least and most words of a body by kind.
WORDS = {"news": (600, 1200), "insight": (2500, 3500), "area": (800, 2500)}
HEADLINE = 90  # fixed value: most characters of a headline
LEAST_APPROVED = 3
#: Phrases that a body mustn't open with, one that it mustn't hold, and signs that it mustn't hold.
OPENINGS = ("have you ever", "do you know", "did you know", "ever wondered")
CLOSING = r"(?i)\bwhat do you think\?"
SIGNS = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
OPENING = r"(?i)^\s*(?:" + "|".join(OPENINGS) + ")"


@dataclass(frozen=True)
class Lexicon:
    banned: tuple[str, ...]
    approved: tuple[str, ...]


#: Words of the eight gates.
DRAFT = Lexicon(
    banned=(
        "synergy", "synergies", "unlock value", "unlock potential", "unlock the", "platform play", "ecosystem play", "game-changer", "game-changing", "10x", "passive income", "wealth hack", "financial freedom",
        "amazing", "incredible", "insane", "epic", "revolutionary", "you won't believe", "the secret to", "here's why you should",
        "guaranteed return", "risk-free", "sure thing", "limited time", "don't miss out", "last chance", "exclusive offer", "investors are flocking",
        "in today's market", "it's no secret that", "let me tell you", "i want to share",
    ),
    approved=(
        "thesis", "mandate", "mandate-fit", "structural", "absorption", "catalyst", "compression", "precinct", "typology", "typologies", "archetype", "trade-killer", "cycle position",
        "bps", "basis points", "irr", "annualised", "sensitivity", "bear case", "bull case", "base case", "secondary market", "resale liquidity", "exit liquidity", "equity multiplier", "leverage mechanic",
        "sovereign-backed", "sovereign-developer", "escrow", "payment plan", "payment ladder", "handover",
        "dld", "rera", "adgm", "difc", "modon", "nakheel", "emaar", "aldar", "damac", "sobha", "meraas", "q properties", "knight frank", "jll", "cbre", "savills", "asteco", "bayut", "property finder",
    ),
)
#: Words of the voice gates.
VOICE = Lexicon(
    banned=(
        "world-class", "world class", "best-in-class", "best in class", "game-changer", "game changer", "game-changing", "revolutionary", "disrupting", "disruptor", "cutting-edge", "cutting edge", "next generation", "next-gen",
        "industry-leading", "premier destination", "iconic landmark", "unparalleled", "unprecedented", "transformative", "synergy", "leverage",
        "151% roi", "5× leverage", "5x leverage", "33% structural discount", "structural discount to saadiyat", "bashayer one-day sellout",
        "anonymous insider", "modon analyst", "anonymous modon analyst", "nakheel insider", "anonymous source familiar with", "sources familiar with the matter",
        "betting against", "bet against", "shorting", "doomed",
        "deal of the week", "limited-time offer", "exclusive opportunity", "act now", "don't miss out", "once in a lifetime", "guaranteed returns", "risk-free", "money-back guarantee",
    ),
    approved=(
        "the read", "cycle position", "structural", "absorption", "trade-killer", "the math says", "the trade is", "mandate-fit", "comparable trade", "secondary market", "primary launch", "off-plan", "payment plan", "dld", "rera", "escrow",
        "frond", "masterplan", "supply pipeline", "median psf", "yield band", "exit assumption", "compression", "repricing", "the spread", "track record", "verified-source", "primary source",
    ),
)


def held(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of ``terms`` a lower-case text contains anywhere."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def held_as_words(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of ``terms`` stand in a lower-case text between word boundaries (of ASCII letters and digits)."""
    return sum((text.rlike(ascii_words(r"\b" + re.escape(t) + r"\b")).cast("int") for t in terms), F.lit(0))


def _joined(by: str, *columns: Column) -> Column:
    return F.lower(F.concat_ws(by, *[F.coalesce(c, F.lit("")) for c in columns]))


def draft_gates(title: Column, subtitle: Column, body: Column, whitelisted: Column, kind: str = "news", words: Lexicon = DRAFT) -> dict[str, Column]:
    """Numbers and verdicts of the eight gates. gate1 to gate7 block, gate8 (no long dash) and dense bold type warn.

    ``whitelisted`` is the number of citations from registered sources. Null texts count as empty.
    """
    text, body = _joined("\n\n", title, subtitle, body), F.coalesce(body, F.lit(""))
    n, (least, most) = word_count(body), WORDS[kind]
    bold = (F.length(body) - F.length(F.replace(body, F.lit("**"), F.lit("")))) / 4
    first = F.split(body, "\n\n")[0]
    gates = {
        "gate1": held(text, words.banned) > 0,
        "gate2": held(text, words.approved) < LEAST_APPROVED,
        "gate3": utf16_length(title) > HEADLINE,
        "gate4": ~first.rlike("[0-9]"),
        "gate5": F.coalesce(whitelisted, F.lit(0)) < 1,
        "gate6": body.rlike(OPENING) | body.rlike(ascii_words(CLOSING)) | body.rlike(SIGNS),
        "gate7": (n < least) | (n > most),
        "gate8": ~F.contains(body, F.lit("—")),
    }
    return gates | {"bold": bold > F.ceil(n / 500), "blocked": sum((gates[f"gate{i}"].cast("int") for i in range(1, 8)), F.lit(0)), "words": n}


def voice_gates(title: Column, subtitle: Column, body: Column, tldr: Column, words: Lexicon = VOICE) -> dict[str, Column]:
    """Which of the six voice gates a draft fails. Banned terms count between word boundaries, approved ones anywhere."""
    text = _joined("\n", title, subtitle, body, F.array_join(F.coalesce(tldr, F.array().cast("array<string>")), "\n"))
    body = F.coalesce(body, F.lit(""))
    n, (least, most) = word_count(body), WORDS["news"]
    return {
        "headline_length": utf16_length(title) > HEADLINE,
        "number_first": ~F.split(body, "\n\n+")[0].rlike("[0-9]"),
        "body_length": (n < least) | (n > most),
        "banned": held_as_words(text, words.banned) > 0,
        "approved": held(text, words.approved) < LEAST_APPROVED,
        "tldr_shape": F.size(F.coalesce(tldr, F.array().cast("array<string>"))) != 3,
    }
