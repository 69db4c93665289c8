"""Reusable column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullif_trim(c: str | Column) -> Column:
    """``nullif(trim(c), '')``."""
    t = F.trim(col_(c))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def ts_text(c: str | Column) -> Column:
    """Canonical microsecond timestamp text (same bytes in every engine)."""
    return F.date_format(col_(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def fingerprint64(*parts: Column) -> Column:
    """64-bit fingerprint of ``p1|p2|...`` with NULL parts as ''.

    First 60 bits of MD5 read as a non-negative BIGINT; a stand-in for the
    warehouse's farm fingerprint (byte identity with it is not a goal)."""
    key = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def sunday_week(ts: str | Column) -> Column:
    """Start (Sunday 00:00) of the week holding ``ts``."""
    shifted = col_(ts) + F.expr("INTERVAL 1 DAY")
    return F.date_trunc("WEEK", shifted) - F.expr("INTERVAL 1 DAY")
