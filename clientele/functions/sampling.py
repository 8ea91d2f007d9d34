"""Deterministic pseudo-random numbers from keys: the same row gets the same draw on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unit_hash(*parts) -> Column:
    """Number in [0, 1) from the first 32 bits of an MD5 over the joined parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def unit_hash_52(*parts: Column) -> Column:
    """Number in [0, 1) with 52 bits of an MD5 over the joined parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_rows(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.where(unit_hash(F.col(key), seed) < fraction)
