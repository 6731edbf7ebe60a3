"""Thread arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCH = 2.54
#: Thread lengths over a stitch's width, and strands of a skein.
STITCH_LENGTHS, STRANDS = 4.8, 6


def skeins_exact(stitches: Column, fabric: int = 14, strands: int = 2, metres: float = 8.0, waste: float = 0.2) -> Column:
    """Skeins as a fraction; under a hundredth counts as none."""
    exact = stitches * INCH / fabric * STITCH_LENGTHS * strands / (metres * 100 * STRANDS * (1 - waste))
    return F.when(exact < 0.01, 0.0).otherwise(exact)


def skeins_needed(stitches: Column, **kwargs) -> Column:
    return F.ceil(skeins_exact(stitches, **kwargs)).cast("long")


def skeins_estimate(stitches: Column, fabric: int = 14) -> Column:
    """At least one."""
    return F.greatest(F.lit(1).cast("long"), skeins_needed(stitches, fabric=fabric))


def stitches_of(skeins: Column, fabric: int = 14, strands: int = 2, metres: float = 8.0, waste: float = 0.2) -> Column:
    """Whole stitches that so many skeins give."""
    return F.floor(skeins * (metres * 100 * STRANDS * (1 - waste)) / (INCH / fabric * STITCH_LENGTHS * strands)).cast("long")


def inches_per_stitch(strands: int = 2, fabric: int = 14, tail: float = 1.5, run: float = 20, waste: float = 1.2) -> Column:
    return F.lit((STITCH_LENGTHS * strands / fabric + 2 * tail / run) * waste)
