"""Codecs of packed measurements: what a byte of a layer means, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch of year codes, ceiling of upstream areas (km2), ceiling of a byte.
YEAR_EPOCH, AREA_CEILING, CEILING = 1983, 1000, 255
#: Powers of two, clockwise from east, and the codes 1 to 8 they become.
DIRECTIONS = {1: 1, 2: 2, 4: 3, 8: 4, 16: 5, 32: 6, 64: 7, 128: 8}
LOG_SPAN = math.log10(AREA_CEILING + 1)


def bits_clear(qa: Column, *bits: int) -> Column:
    """True where none of the bits is set."""
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def reflectance(value: Column) -> Column:
    return value * 0.0000275 - 0.2


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is zero."""
    return F.try_divide(a - b, a + b)


def to_byte(value: Column) -> Column:
    """Clamped to 0..255 and rounded half up."""
    return F.floor(F.least(F.greatest(value, F.lit(0)), F.lit(CEILING)) + 0.5).cast("smallint")


def pack_area(km2: Column) -> Column:
    """Upstream area on a logarithmic byte."""
    return to_byte(F.log10(1 + F.least(km2, F.lit(AREA_CEILING))) * (CEILING / LOG_SPAN))


def unpack_area(code: Column) -> Column:
    return F.pow(F.lit(10.0), code * (LOG_SPAN / CEILING)) - 1


def pack_year(year: Column) -> Column:
    """Years since the epoch; 0 for never."""
    return F.coalesce(year - YEAR_EPOCH, F.lit(0))


def unpack_year(code: Column) -> Column:
    return F.when(code != 0, code + YEAR_EPOCH)


def remap_direction(code: Column) -> Column:
    """Powers of two to 1..8, 0 to mouth, -1 to depression; other codes to no data."""
    out = F.when(code == 0, 9).when(code == -1, 10)
    for power, number in DIRECTIONS.items():
        out = out.when(code == power, number)
    return out.otherwise(0)


def grey_to_unit(byte: Column) -> Column:
    """A grey ramp's byte as -1..1."""
    return byte / 255 * 2 - 1


def below_ceiling(metres: Column) -> Column:
    """The distance, or null where the byte is saturated: then it is a flag, not a measurement."""
    return F.when(metres < CEILING, metres)


def seen(alpha: Column, kind: str) -> Column:
    """Presence by opacity; the bound depends on what the layer is for."""
    return {"study_area": alpha == 255, "feature": alpha > 128, "hotspot": alpha != 0, "valid": alpha > 0, "reference": alpha > 127}[kind]
