"""A 32-bit generator of numbers as columns: the n-th number follows from seed and n, so rows need no order among themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is added to the state for each number; bits that make a factor odd.
STEP, FIRST_BITS, SECOND_BITS = 0x6D2B79F5, 1, 61
LOW, HALF = 0xFFFFFFFF, 0xFFFF


def times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, without leaving 64 bits."""
    low = a * b.bitwiseAND(F.lit(HALF))
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(F.lit(HALF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(LOW))


def bits(seed: Column, n: Column) -> Column:
    """The n-th number, from 1, of a seed, as an integer of 32 bits."""
    t = (seed.cast("long") + times(F.lit(STEP).cast("long"), n.cast("long").bitwiseAND(F.lit(LOW)))).bitwiseAND(F.lit(LOW))
    t = times(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(FIRST_BITS)))
    mixed = times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(SECOND_BITS)))
    t = t.bitwiseXOR((t + mixed).bitwiseAND(F.lit(LOW)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14))


def below(seed: Column, n: Column, bound: Column) -> Column:
    """The n-th number scaled to an integer from 0 to bound - 1, for bounds of up to 31 bits."""
    return F.shiftrightunsigned(bits(seed, n) * bound.cast("long"), 32)
