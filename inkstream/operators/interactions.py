"""Interaction events: which properties each kind may carry, and in what form they are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import events as E

_PLACE = ("source", "route")
_OPENED = (*_PLACE, "destination", "entity")
_VIDEO = (*_PLACE, "videoId", "progress")
#: The kinds of events and the properties that each may carry.
ALLOWED = {
    "nav_open": _PLACE, "nav_close": _PLACE, "nav_click": (*_PLACE, "destination", "ctaLevel"), "book_call_click": (*_PLACE, "ctaLevel"), "booking_open": _PLACE,
    "booking_complete": (*_PLACE, "status"), "booking_close": _PLACE, "whatsapp_click": (*_PLACE, "ctaLevel"), "brief_start": (*_PLACE, "ctaLevel"),
    "brief_step": (*_PLACE, "step"), "brief_complete": (*_PLACE, "status"), "lead_submit_success": (*_PLACE, "status"), "lead_submit_error": (*_PLACE, "status", "errorCode"),
    "area_open": _OPENED, "developer_open": _OPENED, "project_open": _OPENED, "note_open": _OPENED, "guide_open": _OPENED, "calculator_start": (*_PLACE, "calculator"),
    "calculator_complete": (*_PLACE, "calculator", "status"), "video_start": _VIDEO, "video_25": _VIDEO, "video_50": _VIDEO, "video_75": _VIDEO, "video_complete": _VIDEO,
    "news_to_advisory": (*_PLACE, "destination", "ctaLevel"), "article_source_open": (*_PLACE, "destination"), "ai_brief_start": _PLACE, "ai_brief_complete": (*_PLACE, "status"),
    "ai_brief_error": (*_PLACE, "status", "errorCode"), "newsletter_signup": (*_PLACE, "status"),
}
LOCATIONS = ("route", "destination")
#: Numbers that a property may be.
NUMBERS = {"ctaLevel": (1, 2, 3), "progress": E.STEPS}
PROPERTIES = ("source", "route", "destination", "entity", "step", "status", "contentType", "videoId", "calculator", "errorCode", "ctaLevel", "progress")


def sanitized(event: Column, properties: dict[str, Column], own_host: str, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> list[Column]:
    """A column for each of ``properties``, in snake case: null where the event may not carry it or it isn't safe.

    Places are paths or hosts with paths, numbers one of a few, all else short tokens that name no one. An event of no
    known kind carries nothing.
    """
    out = []
    for name, value in properties.items():
        kinds = [k for k, names in allowed.items() if name in names]
        if name in NUMBERS:
            safe = F.when(value.isin(*NUMBERS[name]), value)
        else:
            safe = E.safe_location(value, own_host) if name in LOCATIONS else E.safe_token(value)
        out.append((F.when(event.isin(*kinds), safe) if kinds else F.lit(None).cast("string")).alias(E.snake_case(name)))
    return out
