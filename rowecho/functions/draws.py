"""Deterministic draws.

A draw is the md5 of the seed and the identity of what is drawn, so it does not
depend on partitioning, survives a lost executor unchanged, and any SQL engine can
repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_DIGITS = 15  # 60 bits: the largest hex prefix that always fits a bigint


def _column(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw_key(seed: Column | str | int, *parts: Column | str | int) -> Column:
    """Hex text that orders rows at random: ``md5(seed|part|...)``."""
    return F.md5(F.concat_ws("|", _column(seed), *[_column(p) for p in parts]))


def draw_int(seed: Column | str | int, *parts: Column | str | int) -> Column:
    """Non-negative bigint drawn uniformly from 60 bits."""
    hex_prefix = F.substring(draw_key(seed, *parts), 1, HEX_DIGITS)
    return F.conv(hex_prefix, 16, 10).cast("bigint")


def draw_position(n_rows: Column, seed: Column | str | int, *parts: Column | str | int) -> Column:
    """Position in ``0 .. n_rows-1``."""
    return F.pmod(draw_int(seed, *parts), n_rows)
