"""Bits and bytes of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def select_bit(word: Column, k: Column) -> Column:
    """Index of the k-th (from 0) set bit of a 64-bit word, 64 if it has no so many."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1)
    return F.coalesce(F.get(ones, k), F.lit(64))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings; of a sorted block's first and last key it is that of all its keys."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), i)), lambda i: i.isNotNull())
    return F.substring(a, F.lit(1), F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)))
