"""Times, durations and schedules. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions.numbers import half_up


def millis(t: Column) -> Column:
    return F.unix_millis(t.cast("timestamp"))


def since(t: Column, as_of: Column) -> Column:
    """How long ago, in words."""
    minutes = F.floor(F.greatest(millis(as_of) - millis(t), F.lit(0)) / 60000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def many(n: Column, one: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, many(hours, "hr"))
        .otherwise(many(days, "day"))
    )


def day_label(t: Column) -> Column:
    return F.date_format(t, "dd MMM")


def iso(text: Column) -> Column:
    """The instant that an ISO 8601 text names, null if it names none."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def backoff_ms(attempt: Column) -> Column:
    """Waiting time before an attempt: doubled from 15 s up to 15 min."""
    return F.least(F.lit(15_000) * F.pow(F.lit(2.0), attempt), F.lit(900_000.0)).cast("long")


def jitter_ms(interval_ms: Column, unit: Column) -> Column:
    """Up to 15 % of an interval, at most 15 min; unit in [0, 1) is drawn by the caller."""
    return F.floor(F.least(interval_ms * 0.15, F.lit(900_000.0)) * unit).cast("long")


def retry_after_ms(text: Column, as_of: Column) -> Column:
    """Milliseconds that a Retry-After value asks to wait: seconds or a date."""
    date = F.try_to_timestamp(F.regexp_replace(text, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.trim(text).try_cast("double")
    return F.when(seconds >= 0, (seconds * 1000).cast("long")).when(date.isNotNull(), F.greatest(millis(date) - millis(as_of), F.lit(0)))


def remaining_ms(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Time left at the rate so far; null in the first 2 s or before anything is done."""
    return F.when((elapsed_ms >= 2000) & (done > 0) & (total > done), half_up((total - done) * elapsed_ms / done))


def duration_text(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), "—")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )


def crawl_kind(full: Column) -> Column:
    """A partial crawl is shallow; an unknown one counts as deep."""
    return F.when(full == F.lit(False), "shallow").otherwise("deep")
