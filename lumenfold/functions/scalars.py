"""Scalar expressions on columns. Integer clouds are computed in BIGINT, float clouds in FLOAT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The primes of the cell hash, the number of its buckets, and the largest intensity.
HASH_X, HASH_Y, HASH_Z = 73856093, 19349663, 83492791
HASH_BUCKETS = 1999993
LEVELS = 255


def squared_distance(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    dx, dy, dz = x1 - x2, y1 - y2, z1 - z2
    return dx * dx + dy * dy + dz * dz


def div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero."""
    # (a - a % b) / b is a whole number; as a double it is exact below 2 ** 53
    return ((a - a % b) / b).cast("long")


def equalized(intensity: Column, cdf: Column, cdf_min: Column, m: Column) -> Column:
    """The equalized intensity: unchanged where the smallest level fills the neighbourhood."""
    top, bottom = (cdf - cdf_min).cast("long") * LEVELS, (m - cdf_min).cast("long")
    return F.when(bottom == 0, intensity.cast("int")).otherwise(div(top, F.when(bottom != 0, bottom)).cast("int"))


def cell(coordinate: Column, size: int | float, whole: bool) -> Column:
    """Cell number by truncation toward zero, so the cells around 0 are twice as wide. whole: integer coordinates and
    size; else the quotient is a FLOAT."""
    if whole:
        return div(coordinate.cast("long"), F.lit(int(size)).cast("long"))
    return (coordinate.cast("float") / F.lit(float(size)).cast("float")).cast("float").cast("long")


def cell_hash(gx: Column, gy: Column, gz: Column) -> Column:
    part = lambda g, p: g.cast("long") * F.lit(p).cast("long")
    return part(gx, HASH_X).bitwiseXOR(part(gy, HASH_Y)).bitwiseXOR(part(gz, HASH_Z))


def cell_hash_32(gx: Column, gy: Column, gz: Column) -> Column:
    """The low 32 bits of cell_hash, unsigned."""
    return cell_hash(gx, gy, gz).bitwiseAND(F.lit(4294967295).cast("long"))


def chebyshev(dx: Column, dy: Column, dz: Column) -> Column:
    return F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))


def format_duration(ms: Column) -> Column:
    """Milliseconds as text with three decimals, in ns, microseconds, ms or s by size."""
    ns = ms.cast("double") * 1e6
    text = lambda v, unit: F.concat(F.format_string("%.3f", v), F.lit(unit))
    return F.when(ns < 1e3, text(ns, " ns")).when(ns < 1e6, text(ns / 1e3, " µs")).when(ns < 1e9, text(ms.cast("double"), " ms")).otherwise(text(ms.cast("double") / 1e3, " s"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of a text such as "1.5 ms" in ns, microseconds (µs or us), ms or s, or a bare number of seconds; null if
    it is none."""
    bare = F.trim(F.regexp_replace(text, '"', ""))
    number = F.regexp_extract(bare, r"^([-+0-9.eE]+)\s*(ns|µs|us|ms|s)?$", 1)
    unit = F.regexp_extract(bare, r"^([-+0-9.eE]+)\s*(ns|µs|us|ms|s)?$", 2)
    value = number.try_cast("double")
    return F.when(unit == "ns", value / 1e6).when(unit.isin("µs", "us"), value / 1e3).when(unit == "ms", value).otherwise(value * 1e3)


def ratio_text(a: Column, b: Column) -> Column:
    """a / b with four decimals; null unless both are known and b is above 0."""
    return F.when(a.isNotNull() & (b > 0), F.format_string("%.4f", a / b))
