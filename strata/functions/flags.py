"""The 4-bit flag of a position: bit 3 tombstone, bit 2 stand-alone file, bits 1 and 0 the codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, LZ4, ZSTD, INCOMPRESSIBLE = 0, 1, 2, 3
FILE, TOMBSTONE = 4, 8


def is_tombstone(flag: Column) -> Column:
    return flag.bitwiseAND(TOMBSTONE) != 0


def is_file(flag: Column) -> Column:
    return flag.bitwiseAND(FILE) != 0


def is_infile(flag: Column) -> Column:
    return flag.bitwiseAND(FILE) == 0


def codec(flag: Column) -> Column:
    return flag.bitwiseAND(3)


def is_compressed(flag: Column) -> Column:
    return codec(flag).isin(LZ4, ZSTD)


def with_codec(flag: Column, value: int) -> Column:
    return flag.bitwiseAND(12).bitwiseOR(F.lit(value))


def with_tombstone(flag: Column) -> Column:
    return flag.bitwiseOR(F.lit(TOMBSTONE))


def storage(flag: Column) -> Column:
    """The flag without its tombstone bit."""
    return flag.bitwiseAND(7)
