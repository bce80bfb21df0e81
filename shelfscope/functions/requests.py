"""A user's crawl request, brought within its limits."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

from shelfscope.functions.numbers import clamp

# Limits and defaults of a crawl request.
DELAY_MS, DEFAULT_DELAY_MS = (100, 10_000), 1000
CONCURRENCY, DEFAULT_CONCURRENCY = (1, 12), 2
PATTERN_CHARS, LOCALE_CHARS = 200, 10
_WEB = re.compile(r"https?://\S+", re.IGNORECASE)


@dataclass(frozen=True)
class CrawlRequest:
    """What will be run. A shallow crawl is partial by nature, so full_crawl is false for it and its
    result never removes a product."""

    origin: str
    type: str
    full_crawl: bool
    delay_ms: int
    concurrency: int
    max_pages: int | None
    pattern: str | None
    locale: str | None
    collections: tuple[str, ...]
    proxy: str | None
    browser_agent: bool
    flags: Mapping[str, bool]


#: Switches that are on unless a request says false.
SWITCHES = ("respect_robots", "product_only", "store_snapshots", "use_browser")


def _text(value: object, most: int | None = None) -> str | None:
    text = "" if value is None else str(value).strip()
    return (text if most is None else text[:most]) or None


def crawl_request(raw: Mapping[str, object]) -> CrawlRequest:
    """Reads a request; raises ValueError for an origin or proxy that is no web address and for a page
    limit that is no number. Other unreadable values take their defaults."""
    origin, proxy = _text(raw.get("origin")), _text(raw.get("proxy"))
    if origin is None or not _WEB.match(origin):
        raise ValueError("origin must be a valid http(s) URL")
    if proxy is not None and not _WEB.match(proxy):
        raise ValueError("proxy must be a valid http(s) URL")
    pages = raw.get("max_pages")
    if pages is not None and pages != "":
        try:
            limit = float(pages)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            limit = math.nan
        if not math.isfinite(limit):
            raise ValueError("max_pages must be a positive number")
        pages = max(1, math.floor(limit + 0.5))
    else:
        pages = None
    kind = "shallow" if raw.get("type") == "shallow" else "deep"
    named = raw.get("collections")
    locale = _text(raw.get("locale"))
    return CrawlRequest(
        origin=origin,
        type=kind,
        full_crawl=kind == "deep",
        delay_ms=clamp(raw.get("delay_ms"), DEFAULT_DELAY_MS, *DELAY_MS),
        concurrency=clamp(raw.get("concurrency"), DEFAULT_CONCURRENCY, *CONCURRENCY),
        max_pages=pages,
        pattern=_text(raw.get("pattern"), PATTERN_CHARS),
        locale=locale.lower()[:LOCALE_CHARS] if locale else None,
        collections=tuple(c for c in named if isinstance(c, str)) if isinstance(named, (list, tuple)) else (),
        proxy=proxy,
        browser_agent=raw.get("user_agent") == "browser",
        flags={s: raw.get(s) is not False for s in SWITCHES},
    )
