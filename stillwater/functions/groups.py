"""Sizes of groups, which decide whether one task may order or gather each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a series up to which one task orders it by itself (windows spill to disk).
GATHERED_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
