"""Prices, currencies and price changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions.numbers import half_up

MINUS = "−"


def to_usd(price: Column, currency: Column, rate: Column) -> Column:
    """USD at `rate` units of the currency per USD; null if price, currency or rate is unknown."""
    known = (price > 0) & ~F.isnan(price) & (F.coalesce(currency, F.lit("")) != "")
    return F.when(known & (currency == "USD"), price).when(known & (rate > 0), half_up(price / rate, 2))


def change_percent(old: Column, new: Column) -> Column:
    return F.when((old != 0) & ~F.isnan(old) & ~F.isnan(new), (new - old) / F.abs(old) * 100)


def change_severity(percent: Column) -> Column:
    size = F.abs(F.coalesce(percent, F.lit(0.0)))
    return F.when(size >= 15, "high").when(size >= 5, "medium").otherwise("low")


def decimal_text(s: Column) -> Column:
    """A number from text with thousands and decimal signs: of two kinds of sign the last is the
    decimal one; a comma alone separates thousands; unreadable text is 0."""
    kept = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^0-9.,\-]", "")
    comma, dot = F.length(kept) - F.instr(F.reverse(kept), ","), F.length(kept) - F.instr(F.reverse(kept), ".")
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    plain = (
        F.when(both & (comma > dot), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(F.replace(kept, F.lit(","), F.lit("")))
    )
    return F.coalesce(F.try_to_number(plain, F.lit("S9999999999999999D999999")).cast("double"), plain.try_cast("double"), F.lit(0.0))


def price_text(s: Column) -> Column:
    """decimal_text, but null where text other than a written zero gives 0, or is missing."""
    value = decimal_text(s)
    return F.when((value != 0) | F.trim(s).isin("0", "0.00", "0,00"), value)


def positive(s: Column, commas: bool = True) -> Column:
    """A positive number from text, else 0."""
    text = F.replace(s, F.lit(","), F.lit("")) if commas else s
    return F.greatest(F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def loose_number(s: Column) -> Column:
    """A number found in page text: up to two decimals, else all signs are dropped."""
    simple = s.rlike(r"^\d+([.,]\d{1,2})?$")
    return F.when(simple, F.replace(s, F.lit(","), F.lit("."))).otherwise(F.regexp_replace(s, "[.,]", "")).try_cast("double")


# Currency signs and the codes they stand for.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
# Codes that may stand before a price.
PRICE_CODES = "AED OMR SAR QAR KWD BHD USD EUR GBP JPY INR PKR EGP CNY".split()
# Codes, then signs, that are looked for in a page, in order.
PAGE_CODES = "AED OMR SAR QAR KWD BHD INR PKR EGP JPY".split()
PAGE_SIGNS = "¥€£$"


def symbol_currency(symbol: Column) -> Column:
    out = F.lit(None).cast("string")
    for sign, code in SYMBOLS.items():
        out = F.when(symbol == sign, code).otherwise(out)
    return out


def guess_currency(text: Column) -> Column:
    """The first currency code, else the first sign, that a page contains; null if none."""
    hints = [F.when(text.rlike(rf"(?i)\b{code}\b"), code) for code in PAGE_CODES]
    return F.coalesce(*hints, *(F.when(F.contains(text, F.lit(sign)), SYMBOLS[sign]) for sign in PAGE_SIGNS))


def effective(usd: Column, native: Column, same_currency: Column) -> Column:
    """The comparable price: USD if known, the native one only within one currency."""
    return F.coalesce(F.when(usd > 0, usd), F.when(same_currency & (native > 0), native))


def badge(mine: Column, theirs: Column) -> Column:
    """Who is cheaper: mine, theirs, equal; null if a price is unknown."""
    return F.when(mine < theirs, "mine").when(mine > theirs, "theirs").when(mine == theirs, "equal")


def gap_percent(mine: Column, theirs: Column) -> Column:
    return F.when(mine != 0, F.abs((theirs - mine) / mine) * 100)


def money(price: Column, currency: Column) -> Column:
    """A price for reading, as 1,234.50 with its currency."""
    return F.when(price.isNull(), "—").otherwise(F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), F.format_number(price, 2))))
