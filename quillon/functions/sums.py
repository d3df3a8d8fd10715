"""Sums of doubles that are the same however rows are dealt: whole numbers are added, not roundings.

A column's largest finite magnitude fixes units, powers of two, for a few digits of so many bits that the sum of all rows'
digits still is a long.  Each value is taken apart into these digits exactly; digits are summed, in any order and in any
number of steps, and put together at the end.  What lies more than ``REACH`` bits below the largest magnitude is cut off,
in each value alike.  Values that aren't finite are summed apart: their sum is the same in any order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits below the largest magnitude that count: a double has 53, and few columns' values differ by the rest.
REACH = 90
#: Exponents that units are kept above, so that their inverses are doubles too.
LEAST = -900


@dataclass(frozen=True)
class Digits:
    """How a column's values are taken apart; ``odd`` if some are not finite."""

    units: tuple[float, ...]
    odd: bool

    def of(self, x: Column) -> list[Column]:
        """The digits of a value, from the highest, and what of it isn't finite."""
        finite = F.abs(x) < float("inf")  # false for NaN, which counts as larger
        left, found = F.when(finite, x).otherwise(0.0), []
        for unit in self.units:
            digit = F.floor(left * (1 / unit))
            found.append(digit)
            left = left - digit.cast("double") * unit
        return found + ([F.when(finite, 0.0).otherwise(x)] if self.odd else [])

    def whole(self, sums: list[Column]) -> Column:
        """The sum that digits' sums stand for; null where there are none."""
        total = sums[len(self.units) - 1].cast("double") * self.units[-1]
        for unit, s in list(zip(self.units, sums))[-2::-1]:
            total = s.cast("double") * unit + total
        return total + sums[-1] if self.odd else total

    @property
    def size(self) -> int:
        return len(self.units) + self.odd


def _made(n: int, most: float, odd: int) -> Digits:
    bits = 61 - max(1, n).bit_length()
    top = max(LEAST + REACH, math.frexp(most)[1]) if most else 0  # most < 2 ** top
    return Digits(tuple(2.0 ** (top - bits * (k + 1)) for k in range(-(-REACH // bits))), odd > 0)


def digits_of_vectors(rows: DataFrame, vector: str, width: int) -> list[Digits]:
    """The same for each coordinate of wide vectors, a row for each instead of a column."""
    x = F.col("x")
    each = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos")
    seen = each.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.abs(x) < float("inf"), F.abs(x))).alias("most"), F.count(F.when(~(F.abs(x) < float("inf")), 1)).alias("odd")).collect()
    known = {r["pos"]: (r["n"], r["most"] or 0.0, r["odd"]) for r in seen}
    odd = any(o for _, _, o in known.values())
    return [_made(*known.get(i, (0, 0.0))[:2], odd) for i in range(width)]


def digits(rows: DataFrame, columns: list[Column]) -> list[Digits]:
    """Digits for each of the columns, from one pass over the rows."""
    facts = [F.count(F.lit(1)).alias("n")]
    for i, x in enumerate(columns):
        facts += [F.max(F.when(F.abs(x) < float("inf"), F.abs(x))).alias(f"m{i}"), F.count(F.when(~(F.abs(x) < float("inf")), 1)).alias(f"o{i}")]
    seen = rows.agg(*facts).first()
    return [_made(seen["n"], seen[f"m{i}"] or 0.0, seen[f"o{i}"]) for i in range(len(columns))]
