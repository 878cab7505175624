"""Splits and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def at_most(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """All rows, or where they are more than ``limit`` a share drawn by hash that stays below it."""
    n = rows.count()
    if n <= limit:
        return rows
    share = int(0.95 * limit / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < share)
