"""Product identity and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions import urls


def gtin(v: Column) -> Column:
    """The digits if there are at least 8, else ''."""
    digits = F.regexp_replace(F.coalesce(v, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, digits).otherwise(F.lit(""))


def sku(v: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), "[^a-z0-9]", "")


def plain(name: Column) -> Column:
    """Lower case, with everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def tokens(name: Column) -> Column:
    return F.filter(F.split(plain(name), " "), lambda t: t != "")


def trigrams(name: Column) -> Column:
    """Distinct three-character stretches of the plain name between two blanks, in order."""
    s = F.concat(F.lit(" "), plain(name), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two names' words."""
    one, two = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two plain names from 0 to 1, by the first rule that applies: emptiness, equality,
    common words from 0.75, one within the other, else edit distance."""
    common = jaccard(a, b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(common >= 0.75, common)
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.6) + F.lit(0.35) * (short / long))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / long)
    )


def identity_key(gtin_: Column, sku_: Column, url: Column, name: Column, barcode: Column | None = None) -> Column:
    """The stable key of a product: GTIN, else SKU, else slug, else a hash of its URL or name."""
    code = gtin_ if barcode is None else F.coalesce(F.nullif(gtin_, F.lit("")), barcode)
    empty = F.lit("")
    origin = F.trim(F.coalesce(F.nullif(url, empty), name, empty))
    return F.coalesce(
        F.concat(F.lit("gtin:"), F.nullif(gtin(code), empty)),
        F.concat(F.lit("sku:"), F.nullif(sku(sku_), empty)),
        F.concat(F.lit("slug:"), F.nullif(urls.slug(url), empty)),
        F.concat(F.lit("url:"), F.sha1(origin)),
    )


def matchable(gtin_: Column, sku_: Column, url: Column) -> Column:
    """A row with a code, or whose URL doesn't look like a page of another kind."""
    coded = (F.coalesce(gtin_, F.lit("")) != "") | (F.coalesce(sku_, F.lit("")) != "")
    return coded | ~F.coalesce(urls.has_junk(url), F.lit(False))
