"""Colours written as six hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(colour: Column, k: int) -> Column:
    """Red (0), green (1) or blue (2) from 0 to 255; null if the colour isn't six hex digits after an optional #."""
    digits = F.regexp_extract(F.lower(colour), "^#?([0-9a-f]{6})$", 1)
    return F.when(digits != "", F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("long"))


def luminance(colour: Column) -> Column:
    """Relative luminance (WCAG)."""
    total = F.lit(0.0)
    for k, weight in enumerate((0.2126, 0.7152, 0.0722)):
        c = channel(colour, k) / 255.0
        total = total + F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) * weight
    return total


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio (WCAG), from 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in RGB; null if either isn't a colour."""
    return F.sqrt(sum(((channel(a, k) - channel(b, k)) * (channel(a, k) - channel(b, k)) for k in range(3)), F.lit(0)))
