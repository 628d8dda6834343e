"""Identifiers: time-ordered UUIDs, and deterministic ones for rows that are computed again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7(at: Column, entropy: Column) -> Column:
    """A version 7 UUID: the nearest millisecond of a time, then bits of a hash. The same time and entropy give the same id."""
    us = F.unix_micros(at)
    # halves go away from zero; the quotient is cut towards zero
    nearest = F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))
    ms = F.lpad(F.lower(F.hex(nearest)), 12, "0")
    h = F.sha2(entropy.cast("string"), 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-"), variant, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))


def is_uuid7(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"), F.lit(False))


def surrogate(*parts: Column) -> Column:
    """32 hex digits of a hash of the parts: the same parts, the same id."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 32)
