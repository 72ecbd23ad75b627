"""When two sets of n-grams are linked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """Links at den * intersection >= num * union of n-word shingles."""

    n: int = 3
    num: int = 90
    den: int = 100

    def need(self, a, b):
        """The least intersection of linked sets of these sizes (numbers or arrays of them)."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size: int) -> int:
        """So many elements of each of two linked sets, the first in any one order of all elements, hold a common one."""
        return size + (self.num * -size) // self.den + 1

    def in_prefix(self, place: Column, size: Column) -> Column:
        return self.num * size <= self.den * (size - place)

    def enough(self, overlap: Column, a: Column, b: Column) -> Column:
        return overlap * (self.num + self.den) >= (a + b) * self.num

    def alike(self, a: Column, b: Column) -> Column:
        """Whether sets of these sizes can be linked."""
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num
