"""Distances as Column expressions over two feature arrays, and of many pairs at once as NumPy arrays.

Short vectors are unrolled into plain arithmetic, which Spark compiles into one loop-free expression;
wide ones use higher-order functions, as generated methods have a size limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import ClassifierError

#: Names of each distance (fixed values).
NAMES = {
    "euclidean": "euclidean",
    "l2": "euclidean",
    "cityblock": "cityblock",
    "manhattan": "cityblock",
    "l1": "cityblock",
    "chessboard": "chessboard",
    "chebyshev": "chessboard",
    "linf": "chessboard",
    "minkowski": "minkowski",
}
#: Widest vector that is unrolled.
UNROLLED = 96
#: Rows of either side whose distances are made at a time.
TILE = (16, 4096)


@dataclass(frozen=True)
class Distance:
    name: str
    p: float | None = None

    def between(self, a: Column, b: Column, width: int) -> Column:
        """The distance of two arrays of ``width`` doubles."""
        if width == 0:
            if self.name == "chessboard":
                raise ClassifierError("the largest difference of no features is undefined")
            return F.lit(0.0)
        if width > UNROLLED:
            parts = F.zip_with(a, b, lambda x, y: self._part(x - y))
            if self.name == "chessboard":
                return F.array_max(parts)
            return self._whole(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
        parts = [self._part(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(width)]
        if self.name == "chessboard":
            return parts[0] if width == 1 else F.greatest(*parts)
        return self._whole(reduce(lambda x, y: x + y, parts))

    def matrix(self, x, y):
        """Distances of each row of x to each row of y, coordinates being added in order as between() does."""
        import numpy as np

        if x.shape[1] == 0 and self.name == "chessboard":
            raise ClassifierError("the largest difference of no features is undefined")
        found, columns = np.empty((len(x), len(y))), np.ascontiguousarray(y.T)
        # In squares that stay in a core's cache.
        for i in range(0, len(x), TILE[0]):
            for j in range(0, len(y), TILE[1]):
                own = x[i : i + TILE[0]]
                parts = ((a[:, None], b[None, j : j + TILE[1]]) for a, b in zip(own.T, columns))
                found[i : i + TILE[0], j : j + TILE[1]] = self._added(parts, (len(own), min(TILE[1], len(y) - j)))
        return found

    def pairs(self, x, i, y, j):
        """Distances of rows i of x to rows j of y (arrays of one shape), as matrix() has them."""
        return self._added(((a[i], b[j]) for a, b in zip(x.T, y.T)), i.shape)

    def _added(self, parts, shape):
        import numpy as np

        total, d = np.zeros(shape), np.empty(shape)
        with np.errstate(over="ignore", invalid="ignore"):
            for a, b in parts:
                np.subtract(a, b, out=d)
                if self.name == "euclidean":
                    np.multiply(d, d, out=d)
                else:
                    np.abs(d, out=d)
                if self.name == "minkowski":
                    d[:] = _power(d, self.p)
                (np.maximum if self.name == "chessboard" else np.add)(total, d, out=total)
            if self.name == "euclidean":
                return np.sqrt(total)
            return np.power(total, 1.0 / self.p) if self.name == "minkowski" else total

    def _part(self, d: Column) -> Column:
        if self.name == "euclidean":
            return d * d
        if self.name == "minkowski":
            return F.pow(F.abs(d), F.lit(self.p))
        return F.abs(d)

    def _whole(self, total: Column) -> Column:
        if self.name == "euclidean":
            return F.sqrt(total)
        if self.name == "minkowski":
            return F.pow(total, F.lit(1.0 / self.p))
        return total


def _power(d, p: float):
    """d to the power p; small whole powers by squaring."""
    if p != int(p) or p > 64:
        return d**p
    found, n = None, int(p)
    while n:
        if n & 1:
            found = d if found is None else found * d
        n >>= 1
        if n:
            d = d * d
    return found


def distance(metric) -> Distance:
    """A distance from a name or from {type, params}; Minkowski takes a finite p above 0."""
    if isinstance(metric, str):
        name, params = metric, {}
    elif isinstance(metric, dict):
        name, params = metric.get("type"), metric.get("params") or {}
    elif isinstance(metric, Distance):
        return metric
    else:
        raise ClassifierError(f"not a distance: {metric!r}")
    known = NAMES.get(str(name).lower())
    if known is None:
        raise ClassifierError(f"unknown distance {name!r}; there are {sorted(NAMES)}")
    if known != "minkowski":
        return Distance(known)
    try:
        p = float(params["p"])
    except (KeyError, TypeError, ValueError):
        raise ClassifierError("minkowski needs a number p") from None
    if not (p > 0 and math.isfinite(p)):
        raise ClassifierError(f"minkowski needs a finite p above 0, not {p}")
    return Distance(known, p)
