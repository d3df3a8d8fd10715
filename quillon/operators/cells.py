"""Exact nearest neighbours without all pairs: training rows in cells around pivots, cells left out by the triangle inequality.

Pivots are training rows, a bounded number of them; each training row lies in the cell of its nearest pivot, and a
cell's radius is the distance of its farthest row.  A test row first meets the nearest cells that surely hold k rows it
may take, which bounds the distance of its k-th neighbour.  A cell whose pivot is farther than that bound and the
cell's radius together holds none of its k nearest, and the two never meet.  What is left is dealt by cell, large cells
and cells that many test rows ask for into parts of bounded work.

Distances have to be metrics: Minkowski's from p = 1 on, the others as they are.  Rows with coordinates that aren't finite
lie in a cell of their own that only matters to test rows with fewer than k others; test rows of that kind meet every cell.
Bounds have a margin for rounding, so neighbours are those of all pairs, ties included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distances import Distance
from quillon.operators.nearest import vectors

#: Most pivots, and bytes of all their coordinates.
PIVOTS, PIVOT_BYTES = 256, 8 << 20
#: What rounding may have added to or taken from a bound, relative to it.
MARGIN = 1e-9
#: The cell of rows that aren't finite.
LOOSE = -1
#: Distances of rows to pivots that are held at a time.
HELD = 1 << 18


def is_metric(metric: Distance) -> bool:
    return metric.p is None or metric.p >= 1


def pivots(train: DataFrame, n_train: int, width: int) -> np.ndarray:
    """Finite training rows with the least hashes of their numbers, as many as the root of all rows but for the bounds."""
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, width)), int(n_train**0.5)))
    finite = train.where(~F.exists("features", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    found = finite.orderBy(F.xxhash64("r_idx"), "r_idx").select("features").limit(most).collect()
    return np.unique(np.array([r["features"] for r in found], float).reshape(len(found), width), axis=0)


@dataclass(frozen=True)
class Cell:
    number: int
    rows: int
    #: Rows that lie in it whichever fold is left out.
    sure: int
    radius: float


def celled(train: DataFrame, metric: Distance, centres: np.ndarray, width: int) -> DataFrame:
    """The training rows with their cell and their distance (gap) to its pivot."""

    def run(batches):
        for batch in batches:
            x = vectors(pa.chunked_array([batch.column("features")]), width)
            cell, gap = np.full(len(x), LOOSE, np.int64), np.full(len(x), np.inf)
            good = np.isfinite(x).all(axis=1)
            if good.any() and len(centres):
                d = metric.matrix(x[good], centres)
                cell[good], gap[good] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    return train.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema), "cell long", "gap double"]))


def cells_of(in_cells: DataFrame) -> list[Cell]:
    """As many as pivots."""
    each = in_cells.groupBy("cell", "r_fold").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    # Rows below fold 0 are left out of none.
    most = F.coalesce(F.max(F.when(F.col("r_fold") >= 0, F.col("n"))), F.lit(0))
    found = each.groupBy("cell").agg(F.sum("n").alias("n"), most.alias("most"), F.max("radius").alias("radius")).orderBy("cell").collect()
    return [Cell(r["cell"], r["n"], 0 if r["cell"] == LOOSE else r["n"] - r["most"], r["radius"]) for r in found]


def _bound(upper: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """For each row a distance within which cells surely hold k rows, infinite if all together don't."""
    order = np.argsort(upper, axis=1, kind="stable")
    held = np.take_along_axis(np.broadcast_to(sure, upper.shape), order, axis=1).cumsum(axis=1)
    at = (held < k).sum(axis=1)
    sorted_ = np.concatenate([np.take_along_axis(upper, order, axis=1), np.full((len(upper), 1), np.inf)], axis=1)
    return sorted_[np.arange(len(upper)), at]


def _lists(chosen: np.ndarray, *values: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """Offsets of each row's chosen places, and their values one after the other."""
    offsets = np.concatenate([[0], chosen.sum(axis=1).cumsum()]).astype(np.int32)
    return pa.array(offsets), [np.broadcast_to(v, chosen.shape)[chosen] for v in values]


def wanted(test: DataFrame, metric: Distance, centres: np.ndarray, cells: list[Cell], k: int, width: int) -> DataFrame:
    """Test rows with ``first``, the cells to meet first, and ``rest``: others that can't be ruled out yet, with the least distance they can hold."""
    near = [c for c in cells if c.number != LOOSE]
    numbers, radii, sure = np.array([c.number for c in near], np.int64), np.array([c.radius for c in near]), np.array([c.sure for c in near], np.int64)
    every = np.array([c.number for c in near] + [c.number for c in cells if c.number == LOOSE], np.int64)
    loose = len(every) - len(near)

    def run(batches):
        step = max(1, HELD // max(1, len(every)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            x = vectors(pa.chunked_array([batch.column("x")]), width)
            good = np.isfinite(x).all(axis=1)
            d = metric.matrix(np.where(good[:, None], x, 0.0), centres[numbers]) if len(numbers) else np.zeros((len(x), 0))
            rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")
            held = np.take_along_axis(np.broadcast_to(sure, d.shape), np.argsort(d, axis=1, kind="stable"), axis=1).cumsum(axis=1)
            first = (rank <= (held < k).sum(axis=1)[:, None]) & good[:, None]
            with np.errstate(invalid="ignore"):
                low = d - radii - MARGIN * (d + radii)
                bound = _bound(d + radii, sure, k) * (1 + MARGIN)
            # A bound that overflowed rules nothing out, and rows that aren't finite meet all.
            low = np.where(np.isnan(low) | ~good[:, None], -np.inf, low)
            low = np.concatenate([low, np.where(good, np.inf, -np.inf)[:, None].repeat(loose, axis=1)], axis=1)
            first = np.concatenate([first, np.zeros((len(x), loose), bool)], axis=1)
            rest = ~first & ~(low > bound[:, None])
            at, (cell,) = _lists(first, every)
            firsts = pa.ListArray.from_arrays(at, pa.array(cell, pa.int64()))
            at, (cell, least) = _lists(rest, every, low)
            rests = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(cell, pa.int64()), pa.array(least, pa.float64())], ["cell", "low"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, firsts, rests], names=[*batch.schema.names, "first", "rest"])

    return test.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema), "first array<long>", "rest array<struct<cell:long,low:double>>"]))


def bounds(near: DataFrame, k: int) -> DataFrame:
    """fold, row_idx, bound: the distance of the k-th of the neighbours found so far; infinite with fewer."""
    by = Window.partitionBy("fold", "row_idx").orderBy("d", "r_idx")
    top = near.select("fold", "row_idx", "d", "r_idx").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k)
    kth = top.groupBy("fold", "row_idx").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    return kth.select("fold", "row_idx", F.when((F.col("n") < k) | F.isnan("d"), float("inf")).otherwise(F.col("d") * (1 + MARGIN)).alias("bound"))


def left(met: DataFrame) -> DataFrame:
    """Test rows (with their ``bound``, null without one) with ``cell`` for each cell beyond the first that may hold one of their k nearest, and ``bound``, beyond which none of these is."""
    met = met.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    need = F.transform(F.filter("rest", lambda c: c["low"] <= F.col("bound")), lambda c: c["cell"])
    return met.withColumn("cell", F.explode(need)).drop("rest")
