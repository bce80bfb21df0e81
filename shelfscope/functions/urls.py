"""URL parts and URL classes, all as built-in expressions.

URLs are taken apart with one pattern that tolerates spaces and bars, unlike parse_url. A string
without a scheme has no host and no path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions.wordlists import JUNK_SEGMENTS, LANDING_PLACES, SECTION_SEGMENTS

URL = r"(?is)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^?#]*)"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
PRODUCT_BASE = r"(?i)/products?/[a-z0-9_-]+"
PRODUCT_PATHS = r"(?i)/products?/[a-z0-9_-]+|/dp/[a-z0-9_-]+|/item/[a-z0-9_-]+|/shop/[a-z0-9_-]+/[a-z0-9_-]+"
LINK_PRODUCT = r"(?i)/(product|products|item|dp|p)/[a-z0-9_-]+|/shop/(?:[a-z0-9_-]+/)+[a-z0-9_-]+"
LINK_CATEGORY = r"(?i)/product-category/|[?&]product_cat=|/(category|categories|collection|collections|shop|catalog)(/|\?|#|$)"


def is_url(u: Column) -> Column:
    return F.coalesce(u.rlike(URL), F.lit(False))


def hostname(u: Column) -> Column:
    """The host without port, lower case; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(u, URL, 1), F.lit("")))


def path(u: Column) -> Column:
    return F.coalesce(F.regexp_extract(u, URL, 3), F.lit(""))


def host_key(u: Column) -> Column:
    """The store key of an origin: its host without port and leading www."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(u, F.lit(""))), "^https?://", ""), r"^www\.", "")
    return F.when(is_url(u), F.regexp_replace(hostname(u), r"^www\.", "")).otherwise(plain)


def origin_host(u: Column) -> Column:
    """The host with its port, without leading www; the input in lower case if it is no URL."""
    port = F.coalesce(F.regexp_extract(u, URL, 2), F.lit(""))
    return F.when(is_url(u), F.regexp_replace(F.concat(hostname(u), port), r"^www\.", "")).otherwise(F.lower(u))


def origin_name(u: Column) -> Column:
    """A readable name: the host's first label, with capitals."""
    return F.initcap(F.translate(F.substring_index(origin_host(u), ".", 1), "-_", "  "))


def raw_segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def segments(u: Column) -> Column:
    """The path's segments in lower case."""
    return F.filter(F.split(F.lower(path(u)), "/"), lambda s: s != "")


def last_segment(u: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(u), F.lit(-1)), F.lit(""))


def slug(u: Column) -> Column:
    """The last path segment in lower case if it has at least 3 characters, else ''."""
    last = last_segment(u)
    return F.when(F.length(last) >= 3, last).otherwise(F.lit(""))


def page_label(u: Column) -> Column:
    """The last path segment as written, the host without one, the input if it is no URL."""
    last = F.try_element_at(raw_segments(u), F.lit(-1))
    return F.when(is_url(u), F.coalesce(last, hostname(u))).otherwise(u)


def is_landing(u: Column) -> Column:
    """The last segment ends in -in- and a known place."""
    return last_segment(u).rlike(f"-in-({'|'.join(LANDING_PLACES)})$")


def has_junk(u: Column) -> Column:
    """Any path segment names a page of another kind, or the URL is a landing page."""
    return F.arrays_overlap(segments(u), F.array(*map(F.lit, JUNK_SEGMENTS))) | is_landing(u)


def is_section_word(segment: Column) -> Column:
    return segment.isin(SECTION_SEGMENTS)


def is_product(u: Column) -> Column:
    """The URL has an explicit product path."""
    return F.coalesce(u.rlike(PRODUCT_PATHS), F.lit(False))


def is_product_link(u: Column) -> Column:
    """Like is_product for links on pages: also /p/ and deep /shop/ paths."""
    return F.coalesce(u.rlike(LINK_PRODUCT), F.lit(False))


def is_category_link(u: Column) -> Column:
    return F.coalesce(u.rlike(LINK_CATEGORY), F.lit(False))


def basename(u: Column) -> Column:
    return F.substring_index(F.element_at(F.split(u, r"\?"), 1), "/", -1)


def is_other_sitemap(u: Column) -> Column:
    """A sitemap file that never lists products."""
    base = basename(u)
    kinds = r"(?i)(?:^|[-_.])(?:image|images|media|attachment|video|news)(?:[-_.]|\d|$)"
    pages = r"(?i)^(homepages?|category(?:landing)?s?|contents?|blogs?|faqs?|newsletters?|static)-"
    return base.rlike(kinds) | base.rlike(pages)


def is_product_sitemap(u: Column) -> Column:
    """A sitemap file that lists products only."""
    whole = r"(?i)wp-sitemap-posts-product-|product-sitemap|products?[-_.]sitemap|sitemap[-_.]products?"
    return u.rlike(whole) | basename(u).rlike(r"(?i)^products?-[a-z]{2,3}-")


def is_wordpress_other(u: Column) -> Column:
    return u.rlike(r"(?i)wp-sitemap-(posts-(?!product-)|taxonomies-|users-|authors-)")


def in_locale(u: Column, locale: str) -> Column:
    """The URL belongs to a locale: as a path segment, or as a suffix of the file name."""
    token = locale.strip().lower()
    if not token:
        return F.lit(True)
    lowered = F.lower(u)
    return F.array_contains(F.split(lowered, "/"), token) | lowered.rlike(rf"(?:^|[_-])\Q{token}\E(?:[._-]|$)")


def product_handle(u: Column) -> Column:
    """The handle in /products/HANDLE, without .json; null if there is none."""
    found = F.regexp_extract(path(u), r"/products/([^/]+?)(?:\.json)?/?$", 1)
    return F.nullif(found, F.lit(""))


def country(u: Column) -> Column:
    """The two letters of a path that starts with a country, as /xx/ or /xx-yy/."""
    return F.nullif(F.regexp_extract(F.lower(path(u)), r"^/([a-z]{2})(?:-[a-z]{2})?/", 1), F.lit(""))


def pattern(u: Column) -> Column:
    """The path with its last segment written as {slug}."""
    return F.regexp_replace(path(u), r"[^/]+/?$", "{slug}")


def store_key(k: Column) -> Column:
    """A store key in normal form, or null if it is none: labels of a-z, 0-9 and - between dots."""
    plain = F.lower(F.trim(k))
    return F.when(plain.rlike(r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*$"), plain)


def origin_url(u: Column) -> Column:
    """An origin with a scheme and without trailing slashes."""
    bare = F.regexp_replace(F.trim(u), "/+$", "")
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def absolute(href: Column, base: Column) -> Column:
    """A link resolved against its page, without fragment; null for other schemes."""
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link == "", page)
        .otherwise(F.concat(folder, link))
    )


def address(u: Column) -> Column:
    """The form in which absolute URLs are compared: scheme and host in lower case, no default port,
    no dot segments, non-ASCII characters percent-encoded, no fragment."""
    plain = F.regexp_replace(F.trim(u), "(?s)#.*$", "")
    origin = F.regexp_replace(F.lower(F.regexp_extract(plain, ORIGIN, 1)), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.regexp_replace(plain, ORIGIN, "")
    bare = F.regexp_replace(F.regexp_replace(rest, r"(?s)\?.*$", ""), r"(^|/)(\.\.?)$", "$1$2/")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(F.regexp_replace(bare, "^/", ""), "/"), F.array().cast("array<string>"), step)
    whole = F.concat(origin, F.lit("/"), F.array_join(parts, "/"), F.regexp_extract(rest, r"(?s)\?.*$", 0))
    coded = F.transform(F.split(whole, ""), lambda c: F.when(c == " ", "%20").when(c > "~", F.url_encode(c)).otherwise(c))
    return F.when(whole.rlike("[^!-~]"), F.array_join(coded, "")).otherwise(whole)


def same_origin(a: Column, b: Column) -> Column:
    root = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
    return F.lower(F.regexp_extract(a, root, 1)) == F.lower(F.regexp_extract(b, root, 1))


def name_slug(name: Column, other: Column, most: int = 80) -> Column:
    """A slug from a name, or `other` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), other)


def strip_html(h: Column) -> Column:
    spaced = F.replace(F.regexp_replace(h, "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def literal_pattern(text: str) -> str:
    """text with the characters that regular expressions treat specially marked with a backslash."""
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in text)


def redact(text: Column, secret: str) -> Column:
    """text without a secret, credentials in URLs included."""
    hidden = F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text
    return F.regexp_replace(hidden, r"://[^/@\s]+@", "://[redacted]@")
