"""Uniform numbers from what a row holds: the same at every partitioning, and in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(key: Column, seed: int) -> Column:
    """[0, 1) from the first 13 hexadecimal digits of md5(key|seed)."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def content_uniform(*columns: Column, seed: int) -> Column:
    """[0, 1) from the content of a row; equal rows get equal numbers."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(1 << 53))
