"""The k nearest of one block of training rows to each of a chunk of test rows, in bounded memory.

A tile of test rows meets the block at a time, and pairs never leave the task.  Of finite rows only pairs within a bound on the
k-th distance, which a part of the block gives, are sorted; for L2 the bound is held against products of matrices, with
a margin for their rounding, and the distances of what is left are made coordinate by coordinate.  For L1 and the largest difference
it is held against distances of coordinates rounded to small whole numbers, for Minkowski's from p = 2 on against L2, which bounds it.  Rows of few coordinates meet those
next to them in the order of one coordinate, as many as it takes until those beyond are farther in it than the k-th.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillon.functions.distances import Distance, _power

#: Distances that are held at a time.
TILE = 1 << 21
#: Most coordinates of rows that are looked for in the order of one.
NARROW = 3
#: A relative margin for rounding.
MARGIN = 1e-9
#: The part of a block (one in so many rows) that bounds the k-th distance.
PART = 16
#: Rows of either side whose whole numbers meet at a time.
WHOLE_TILE = (32, 4096)
#: Rows of a block of either side from which the step of whole numbers is taken.
STEP_ROWS = 128
#: The share of pairs beyond which those that a lower bound leaves take as long as all.
LEFT_SHARE = 0.25
#: Pairs that are roughly made at a time.
ROUGH = 2048


def vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def least(gaps: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least distances of each row where ``apart``, nearest first, ties by column; NaN comes last."""
    m, n = gaps.shape
    plain = np.zeros(m, bool)
    picked = np.zeros((m, k), np.int64)
    if k < n:
        held = np.where(apart, gaps, np.nan)
        part = np.argpartition(held, k - 1, axis=1)[:, :k]
        bound = np.take_along_axis(held, part, axis=1).max(axis=1)
        with np.errstate(invalid="ignore"):
            plain = (held <= bound[:, None]).sum(axis=1) == k  # else there are ties at the end, or too few numbers
        picked = np.sort(part, axis=1)
        order = np.argsort(np.take_along_axis(held, picked, axis=1), axis=1, kind="stable")
        picked = np.take_along_axis(picked, order, axis=1)
    rows, columns = [np.repeat(np.flatnonzero(plain), k)], [picked[plain].ravel()]
    for i in np.flatnonzero(~plain).tolist():
        own = np.flatnonzero(apart[i])
        own = own[np.argsort(gaps[i, own], kind="stable")[:k]]
        rows.append(np.full(len(own), i))
        columns.append(own)
    return np.concatenate(rows), np.concatenate(columns)


def _scores(metric: Distance, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """What orders pairs as their distances do but for an error, and that error's bound for each row of x; None: they are the distances."""
    if metric.name == "euclidean" and x.shape[1] > NARROW:
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        if max(xx.max(), yy.max()) < 1e150:
            found = x @ (-2.0 * y).T
            found += xx[:, None]
            found += yy[None, :]
            # Squares below the least normal number lose digits too.
            return found, 8 * (x.shape[1] + 4) * (np.finfo(float).eps * (xx + yy.max()) + np.finfo(float).tiny)
    return metric.matrix(x, y), None


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each of m rows (i), ties in the order they come in."""
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    counts = np.bincount(i, minlength=m)
    kept = np.arange(len(i)) - np.repeat(counts.cumsum() - counts, counts) < k
    return i[kept], j[kept], d[kept]


def _tile(metric: Distance, x, fold, y, r_fold, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of finite rows, few enough to hold all their pairs."""
    s, error = _scores(metric, x, y)
    step = PART if len(y) >= PART * 8 * k else 1
    part = np.where(fold[:, None] == r_fold[None, ::step], np.inf, s[:, ::step])
    bound = np.partition(part, k - 1, axis=1)[:, k - 1] if k <= part.shape[1] else np.full(len(x), np.inf)
    if error is not None:
        bound = bound + 2 * error
    i, j = np.nonzero(s <= bound[:, None])
    apart = fold[i] != r_fold[j]
    i, j = i[apart], j[apart]
    return _first(i, j, s[i, j] if error is None else metric.pairs(x, i, y, j), len(x), k)


class _Wholes:
    """A lower bound of L1 or the largest difference: that of coordinates as whole numbers of 16 or 8 bits, less what rounding took from both rows."""

    def __init__(self, metric: Distance, x: np.ndarray, y: np.ndarray, far: float):
        self.largest, self.far, self.centre = metric.name == "chessboard", far, y.mean(axis=0)
        self.kind = np.dtype(np.int8 if self.largest else np.int16)
        # Neither differences nor sums of them may overflow.
        self.end = np.iinfo(self.kind).max // (2 if self.largest else 2 * y.shape[1])
        some = np.concatenate([z[:: -(-len(z) // STEP_ROWS)] for z in (x, y)])
        self.step = float(np.abs(some - self.centre).max()) / max(1, self.end)
        self.good = self.step > 1e-290 and self.end > 1
        if self.good:
            made = [self._codes(y[at : at + WHOLE_TILE[1]]) for at in range(0, len(y), WHOLE_TILE[1])]
            self.codes, self.lost = np.ascontiguousarray(np.concatenate([c for c, _ in made]).T), max(lost.max() for _, lost in made)

    def _codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Cutting off both of two coordinates at the same places takes them no farther apart.
        at = np.clip((rows - self.centre) / self.step, -self.end, self.end)
        codes = np.rint(at)
        lost = np.abs(at - codes)
        return codes.astype(self.kind), lost.max(axis=1) if self.largest else lost.sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        own, (rows, columns), n = self._codes(x)[0], WHOLE_TILE, self.codes.shape[1]
        found = np.empty((len(x), n), self.kind)
        for i in range(0, len(x), rows):
            for j in range(0, n, columns):
                a, b = own[i : i + rows].T, self.codes[:, j : j + columns]
                total, d = np.zeros((2, a.shape[1], b.shape[1]), self.kind)
                for one, other in zip(a[:, :, None], b[:, None, :]):
                    np.subtract(one, other, out=d)
                    np.abs(d, out=d)
                    (np.maximum if self.largest else np.add)(total, d, out=total)
                found[i : i + rows, j : j + columns] = total
        return found

    def most(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest score of a pair within the bound."""
        rounding = 4 * x.shape[1] * np.finfo(float).eps * self.far / self.step + 1e-6
        with np.errstate(over="ignore"):
            return np.minimum(bound * (1 + MARGIN) / self.step + self._codes(x)[1] + self.lost + rounding, np.iinfo(self.kind).max).astype(self.kind)


class _Squares:
    """A lower bound of Minkowski's distance for p from 2 on: L2 over its width to the power 1/2 - 1/p.  Scores are halves of squares less the test row's."""

    def __init__(self, metric: Distance, x: np.ndarray, y: np.ndarray, far: float):
        self.p, self.far, self.centre, self.good = metric.p, far, y.mean(axis=0), True
        y = y - self.centre
        yy = np.einsum("ij,ij->i", y, y)
        self.columns, self.yy = np.concatenate([-y.T, yy[None, :] / 2]).astype(np.float32), yy.max()

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x - self.centre, np.ones((len(x), 1))], axis=1).astype(np.float32) @ self.columns

    def most(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        own, single, double = x - self.centre, np.finfo(np.float32), np.finfo(float)
        xx, width = np.einsum("ij,ij->i", own, own), x.shape[1]
        # Powers below the least normal number may have been lost from the bound.
        bound = (bound * (1 + MARGIN) + (2 * width * double.tiny) ** (1 / self.p)) * width ** (0.5 - 1 / self.p)
        moved = 8 * width * double.eps * self.far
        error = 8 * (width + 4) * (float(single.eps) * (xx + self.yy) + float(single.tiny)) + moved * (np.sqrt(xx) + np.sqrt(self.yy) + moved)
        with np.errstate(over="ignore"):
            return np.nextafter(((bound * bound - xx) / 2 + error).astype(np.float32), np.float32(np.inf))


def _lower(metric: Distance, x: np.ndarray, y: np.ndarray) -> _Wholes | _Squares | None:
    """Of finite rows, what rules pairs out for less than their distances take; None if there is nothing."""
    if x.shape[1] <= NARROW or not len(x):
        return None
    if metric.name in ("cityblock", "chessboard"):
        kind = _Wholes
    elif metric.name == "minkowski" and metric.p >= 2:
        kind = _Squares
    else:
        return None
    far = float(max(np.abs(x).max(), np.abs(y).max()))
    made = kind(metric, x, y, far) if far < 1e15 else None
    return made if made is not None and made.good else None


def _may_be(metric: Distance, x, i, y, j, bound: np.ndarray, error: float) -> np.ndarray:
    """Whether rows i of x and j of y (of 32 bits, coordinates with an error) can be within the bound of each row of x."""
    found, p, width, single = np.empty(len(i), bool), metric.p, x.shape[1], np.finfo(np.float32)
    far = float(max(np.abs(x).max(), np.abs(y).max())) + float(single.tiny)
    with np.errstate(over="ignore", under="ignore"):
        # Coordinates are rounded once, powers and sums at each step.
        most = bound * (1 + 8 * (width + (p or 1)) * float(single.eps)) + 4 * width * (far * float(single.eps) + error)
        if p is not None:
            most = (most + (2 * width * float(single.tiny)) ** (1 / p)) ** p
        for at in range(0, len(i), ROUGH):
            own = i[at : at + ROUGH]
            d = y[j[at : at + ROUGH]]
            np.subtract(d, x[own], out=d)
            np.abs(d, out=d)
            d = d.max(axis=1) if metric.name == "chessboard" else (d if p is None else _power(d, p)).sum(axis=1)
            found[at : at + ROUGH] = ~(d > most[own]) | np.isinf(d)
    return found


def _left(metric: Distance, lower: _Wholes | _Squares, x, fold, y, rough, r_fold, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """As _tile() has them, from the pairs that a lower bound leaves; None if these are too many."""
    s = lower.scores(x)
    step = PART if len(y) >= PART * 8 * k else 1
    part = np.where(fold[:, None] == r_fold[None, ::step], np.array(np.inf if s.dtype == np.float32 else np.iinfo(s.dtype).max, s.dtype), s[:, ::step])
    if k > part.shape[1]:
        return None

    def within(most: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        kept = s <= most[:, None]
        if np.count_nonzero(kept) > LEFT_SHARE * kept.size:
            return None
        i, j = np.divmod(np.flatnonzero(kept), len(y))
        apart = fold[i] != r_fold[j]
        return i[apart], j[apart]

    def nearest_of(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _first(i, j, metric.pairs(x, i, y, j), len(x), k)

    # Pairs of the least scores bound the k-th distance.
    least_ = within(np.partition(part, k - 1, axis=1)[:, k - 1])
    if least_ is None:
        return None
    i, _, d = nearest_of(*least_)
    counts = np.bincount(i, minlength=len(x))
    bound = np.where(counts == k, np.append(d, np.inf)[counts.cumsum() - 1], np.inf)
    left = within(lower.most(x, bound))
    if left is None:
        return None
    i, j = left
    kept = _may_be(metric, (x - lower.centre).astype(np.float32), i, rough, j, bound, np.finfo(float).eps * lower.far)
    return nearest_of(i[kept], j[kept])


def _in_order(metric: Distance, x, fold, y, r_fold, k: int) -> tuple[list, np.ndarray]:
    """Of finite rows, by the coordinate that spreads widest; what is found, and the test rows for which that takes most of the block."""
    c = int(np.argmax(y.max(axis=0) - y.min(axis=0)))
    order = np.argsort(y[:, c], kind="stable")
    y, r_fold, n = y[order], r_fold[order], len(y)
    place, todo, span, found = np.searchsorted(y[:, c], x[:, c]), np.arange(len(x)), 4 * k, []
    while len(todo) and 4 * span < n:
        later, step = [], max(1, TILE // (16 * span))
        for at in range(0, len(todo), step):
            own = todo[at : at + step]
            low = np.clip(place[own] - span, 0, n - 2 * span)
            columns = low[:, None] + np.arange(2 * span)
            d = metric.pairs(x, np.broadcast_to(own[:, None], columns.shape), y, columns)
            d[fold[own][:, None] == r_fold[columns]] = np.inf
            numbers = order[columns]
            picked = np.lexsort((numbers, d), axis=-1)[:, :k]
            d, numbers = np.take_along_axis(d, picked, axis=1), np.take_along_axis(numbers, picked, axis=1)
            # What lies beyond is at least as far as the first row there in this one coordinate.
            edges = np.stack([np.where(low > 0, low - 1, 0), np.minimum(low + 2 * span, n - 1)])
            out = np.stack([low > 0, low + 2 * span < n])
            gaps = metric.pairs(x[:, [c]], np.broadcast_to(own, edges.shape), y[:, [c]], edges)
            done = (d[:, -1] < np.where(out, gaps, np.inf).min(axis=0) * (1 - MARGIN)) & (d[:, -1] < np.inf)
            found.append((np.repeat(own[done], k), numbers[done].ravel(), d[done].ravel()))
            later.append(own[~done])
        todo, span = np.concatenate(later), 4 * span
    return found, todo


def nearest(metric: Distance, x, fold, y, r_fold, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test row, training row and distance of the k nearest of each test row that are not in its fold; of equally near ones the first."""
    found, todo = [], np.arange(len(x)) if len(y) else np.zeros(0, np.int64)
    complete = np.isfinite(y).all(axis=1)
    finite = len(y) > 0 and bool(complete.all())
    if len(todo) and not finite and complete.any():
        # Rows that aren't finite come last: they only matter to test rows with fewer than k others.
        own = np.flatnonzero(complete)
        i, j, d = nearest(metric, x, fold, y[own], r_fold[own], k)
        enough = np.isfinite(x).all(axis=1) & (np.bincount(i[d < np.inf], minlength=len(x)) == k)
        kept = enough[i]
        found.append((i[kept], own[j[kept]], d[kept]))
        todo = np.flatnonzero(~enough)
    if finite and 0 < x.shape[1] <= NARROW and len(todo):
        good = np.isfinite(x).all(axis=1)
        near, left = _in_order(metric, x[good], fold[good], y, r_fold, k)
        at = np.flatnonzero(good)
        found += [(at[i], j, d) for i, j, d in near]
        todo = np.sort(np.concatenate([at[left], np.flatnonzero(~good)]))
    step = max(1, TILE // max(1, len(y)))
    if finite and len(todo):
        own = todo[np.isfinite(x[todo]).all(axis=1)]
        lower = _lower(metric, x[own], y)
        if lower is not None:
            # Pairs are made coordinate by coordinate.
            by_column, rough, rows, left = np.asfortranarray(y), (y - lower.centre).astype(np.float32), -(-4 * step // WHOLE_TILE[0]) * WHOLE_TILE[0], []
            for at in range(0, len(own), rows):
                some = own[at : at + rows]
                near = _left(metric, lower, x[some], fold[some], by_column, rough, r_fold, k)
                if near is None:
                    left.append(some)
                else:
                    found.append((some[near[0]], *near[1:]))
            todo = np.sort(np.concatenate([*left, np.setdiff1d(todo, own)]).astype(np.int64))
    for at in range(0, len(todo), step):
        own = todo[at : at + step]
        if finite and x.shape[1] and np.isfinite(x[own]).all():
            i, j, d = _tile(metric, x[own], fold[own], y, r_fold, k)
        else:
            d = metric.matrix(x[own], y)
            i, j = least(d, fold[own][:, None] != r_fold[None, :], k)
            d = d[i, j]
        found.append((own[i], j, d))
    return tuple(np.concatenate([f[z] for f in found]) if found else np.zeros(0, kind) for z, kind in enumerate((np.int64, np.int64, np.float64)))


def matcher(metric: Distance, k: int, width: int):
    """For cogroups of test rows (fold, row_idx, y_true, true_s, x) and training rows (r_fold, r_idx, label, label_s, features).

    Where test rows have a ``bound``, neighbours beyond it are left out.
    """

    def run(test: pa.Table, train: pa.Table) -> pa.Table:
        train = train.sort_by("r_idx")
        x, y = vectors(test["x"], width), vectors(train["features"], width)
        i, j, d = nearest(metric, x, whole(test["fold"]), y, whole(train["r_fold"]), k)
        if "bound" in test.column_names:
            kept = ~(d > test["bound"].to_numpy()[i])
            i, j, d = i[kept], j[kept], d[kept]
        near = test.select(["fold", "row_idx", "y_true", "true_s"]).take(pa.array(i))
        far = train.select(["label", "label_s", "r_idx"]).take(pa.array(j))
        for name in far.column_names:
            near = near.append_column(name, far[name])
        return near.append_column("d", pa.array(d, pa.float64()))

    return run


def block_matcher(metric: Distance, k: int, width: int):
    """For rows with a list of test rows (tests) and one of training rows (trains), as matcher() has them."""
    met = matcher(metric, k, width)

    def table(column: pa.Array, at: int) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(column.slice(at, 1).flatten())])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield from met(table(batch.column("tests"), at), table(batch.column("trains"), at)).to_batches()

    return run
