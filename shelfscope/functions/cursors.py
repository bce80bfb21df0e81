"""Page cursors: URL-safe base64 of `milliseconds|id`, with a 24-digit hexadecimal id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(ms: Column, row_id: Column) -> Column:
    raw = F.concat(ms.cast("long").cast("string"), F.lit("|"), row_id)
    return F.translate(F.rtrim(F.base64(raw.cast("binary")), F.lit("=")), "+/", "-_")


def decode(cursor: Column) -> Column:
    """struct<ts, id>, null for anything malformed."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), ((F.length(cursor) + 3) / 4).cast("int") * 4, "=")
    text = F.when(cursor.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64"))).cast("string")
    ts, row_id = F.regexp_extract(text, r"^(-?\d+)\|([0-9a-f]{24})$", 1), F.regexp_extract(text, r"^(-?\d+)\|([0-9a-f]{24})$", 2)
    return F.when(row_id != "", F.struct(ts.try_cast("long").alias("ts"), row_id.alias("id")))
