"""Splitters: each row's fold, exact in size.

An assigned frame is a labelled frame with ``fold_id`` (long): a row tests in the fold of its number and
trains in all others; -1 marks rows that only train.  Shuffling orders rows by the MD5 of seed and row
number, the same on every engine and machine; ``order="numpy"`` takes NumPy's permutations, for small inputs.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import ValidationError
from quillon.sources.labelled import Labelled, counted, placed
from quillon.sources.shared import bounded, durable

#: Rows up to which NumPy's order is offered: it is made on the driver.
NUMPY_ROWS = 1_000_000
#: Classes whose quotas are a literal in the plan; those of more are joined.
MAPPED = 200
#: Rows whose keys (some 100 bytes each) one task may rank.
WINDOW_ROWS = 1_000_000


def shuffled(seed: int):
    """What rows are ordered by for a random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_idx").cast("string")))


def clip(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def half_even(x: float) -> int:
    return round(x)


def quotas(counts: list[int], test_size: float) -> list[int]:
    """Test rows per class: rounded shares, then one more or less from class to class until the total fits."""
    n = sum(counts)
    total = clip(half_even(n * test_size), 1, n - 1)
    bounds = [(0, 0) if m == 1 else (1, m - 1) for m in counts]
    if not sum(lo for lo, _ in bounds) <= total <= sum(hi for _, hi in bounds):
        raise ValidationError(f"{total} test rows cannot be had with every class on both sides")
    take = [clip(half_even(m * test_size), lo, hi) for m, (lo, hi) in zip(counts, bounds)]
    i = 0
    while (short := total - sum(take)) != 0:
        step, (lo, hi) = (1 if short > 0 else -1), bounds[i]
        if lo <= take[i] + step <= hi:
            take[i] += step
        i = (i + 1) % len(take)
    return take


def quota_table(data: Labelled, test_size: float) -> DataFrame:
    """label_s, k: the same for any number of classes, in closed form and without a driver's list.

    Going round the classes in their natural order, one row more or less each time, comes to some whole rounds, in
    which every class takes part as long as it has room, and a last one of the first classes that still have some.
    """
    total = clip(half_even(data.n * test_size), 1, data.n - 1)
    low, high = (F.when(F.col("n") == 1, 0).otherwise(x).cast("long") for x in (F.lit(1), F.col("n") - 1))
    sized = data.per_class().withColumns({"low": low, "high": high})
    taken = durable(sized.withColumn("k", F.least(F.greatest(F.bround(F.col("n") * F.lit(float(test_size)), 0).cast("long"), F.col("low")), F.col("high"))), "quotas")
    facts = taken.agg(F.sum("k").alias("k"), F.sum("low").alias("low"), F.sum("high").alias("high")).first()
    if not facts["low"] <= total <= facts["high"]:
        raise ValidationError(f"{total} test rows cannot be had with every class on both sides")
    short = total - facts["k"]
    if not short:
        return taken.select("label_s", "k")
    step = 1 if short > 0 else -1
    room = (F.col("high") - F.col("k")) if step > 0 else (F.col("k") - F.col("low"))

    def given(rounds: int) -> int:
        return taken.agg(F.sum(F.least(room, F.lit(rounds)))).first()[0]

    # The most whole rounds that don't give too many rows; as shares are rounded, nearly always none.
    rounds, above = 0, 1
    while given(above) <= abs(short):
        rounds, above = above, 2 * above
    while above - rounds > 1:
        middle = (rounds + above) // 2
        rounds, above = (middle, above) if given(middle) <= abs(short) else (rounds, middle)
    left = abs(short) - (given(rounds) if rounds else 0)
    # Those that still have room, in their natural order.
    last = _dealt(taken.where(room > rounds).select("label", "label_s"), [F.col("label")]).where(F.col("rank") <= left).select("label_s", F.lit(1).alias("more"))
    return taken.join(bounded(last, left), "label_s", "left").select("label_s", (F.col("k") + step * (F.least(room, F.lit(rounds)) + F.coalesce("more", F.lit(0)))).alias("k"))


class Splitter(ABC):
    @abstractmethod
    def assign(self, data: Labelled) -> DataFrame:
        """The frame with its fold_id."""

    @abstractmethod
    def sizes(self, data: Labelled) -> list[int]:
        """Test rows of each fold, as the classes' sizes give them."""


def _natural(data: Labelled) -> list[tuple]:
    """Classes in their natural order: numbers by size, texts by code points; an error if they are too many to list."""
    listed = [(label, text, n) for (label, _, n), text in zip(data.class_counts, data.classes)]
    try:
        return sorted(listed, key=lambda x: x[0])
    except TypeError:
        return sorted(listed, key=lambda x: x[1])


def _enough(data: Labelled) -> int:
    n = data.n
    if n < 2:
        raise ValidationError(f"at least two rows are needed, there are {n}")
    return n


def _ranked(data: Labelled, stratify: bool, shuffle: bool, seed: int, order: str) -> DataFrame:
    """The frame with ``rank`` from 1 on, within classes or over all rows."""
    if shuffle and order == "numpy":
        return _numpy_ranked(data, stratify, seed)
    if order not in ("hash", "numpy"):
        raise ValidationError(f"unknown order {order!r}")
    if not stratify and not shuffle and data.gapless:
        return data.frame.withColumn("rank", F.col("row_idx") + 1)
    by = [shuffled(seed), F.col("row_idx")] if shuffle else [F.col("row_idx")]
    if data.n <= WINDOW_ROWS:
        own = Window.partitionBy("label_s" if stratify else F.lit(0)).orderBy(*by)
        ranks = data.frame.select("row_idx", F.row_number().over(own).cast("long").alias("rank"))
    elif not stratify:
        ranks = _dealt(data.frame.select("row_idx"), by)
    else:
        # Sorted by class first, a row's rank in its class is its place behind the class's first.
        whole = _dealt(data.frame.select("row_idx", "label_s"), [F.col("label_s"), *by])
        starts = whole.groupBy("label_s").agg((F.min("rank") - 1).alias("start"))
        ranks = whole.join(bounded(starts, data.n_classes), "label_s").select("row_idx", (F.col("rank") - F.col("start")).alias("rank"))
    if not data.gapless:
        ranks = ranks.groupBy("row_idx").agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("rows repeat the key "), F.col("row_idx").cast("string")))).otherwise(F.min("rank")).alias("rank"))
    return data.frame.join(bounded(ranks, data.n), "row_idx")


def _dealt(keys: DataFrame, by: list) -> DataFrame:
    """Ranks over all rows without bringing them into one task: sorted by range, then counted per partition.

    Only keys are sorted; feature vectors meet the ranks in a join.
    """
    return counted(placed(keys.sort(*by)), "rank", first=1)


def _numpy_ranked(data: Labelled, stratify: bool, seed: int) -> DataFrame:
    import numpy as np

    if data.n > NUMPY_ROWS:
        raise ValidationError(f"NumPy's order is made on the driver, for {NUMPY_ROWS} rows at most")
    rng, found = np.random.default_rng(seed), []
    rows = data.frame.select("row_idx", "label_s").orderBy("row_idx").collect()
    groups = [[r[0] for r in rows if r[1] == text] for _, text, _ in _natural(data)] if stratify else [[r[0] for r in rows]]
    for own in groups:
        found += [(int(own[j]), rank) for rank, j in enumerate(rng.permutation(len(own)), 1)]
    ranks = data.frame.sparkSession.createDataFrame(found, "row_idx long, rank long")
    return data.frame.join(F.broadcast(ranks) if len(found) <= 100_000 else ranks, "row_idx")


@dataclass(frozen=True)
class Holdout(Splitter):
    """One split: fold 0 tests, the others train."""

    test_size: float = 0.2
    seed: int = 42
    stratify: bool = True
    order: str = "hash"

    def assign(self, data: Labelled) -> DataFrame:
        n = _enough(data)
        if not 0 < self.test_size < 1:
            raise ValidationError(f"test_size has to lie between 0 and 1, not {self.test_size}")
        ranked = _ranked(data, self.stratify, True, self.seed, self.order)
        if self.stratify and (data.class_table is not None or data.n_classes > MAPPED):
            ranked = ranked.join(bounded(quota_table(data, self.test_size), data.n_classes), "label_s")
            limit = F.col("k")
        elif self.stratify:
            classes = _natural(data)
            take = quotas([m for _, _, m in classes], self.test_size)
            limit = F.element_at(F.create_map(*[F.lit(x) for (_, text, _), k in zip(classes, take) for x in (text, k)]), F.col("label_s"))
        else:
            limit = F.lit(clip(half_even(n * self.test_size), 1, n - 1))
        ranked = ranked.select("row_idx", "label", "label_s", "features", "rank", limit.alias("k"))
        limit = F.col("k")
        return ranked.withColumn("fold_id", F.when(F.col("rank") <= limit, 0).otherwise(-1).cast("long")).drop("rank", "k")

    def sizes(self, data: Labelled) -> list[int]:
        return [clip(half_even(data.n * self.test_size), 1, data.n - 1)]


@dataclass(frozen=True)
class KFold(Splitter):
    """Rows dealt round robin; within classes each starts at fold 0."""

    n_splits: int = 5
    seed: int = 42
    shuffle: bool = True
    stratify: bool = True
    order: str = "hash"

    def assign(self, data: Labelled) -> DataFrame:
        n = _enough(data)
        if not 2 <= self.n_splits <= n:
            raise ValidationError(f"n_splits has to lie between 2 and {n}, not {self.n_splits}")
        if self.stratify and data.largest < self.n_splits:
            raise ValidationError(f"no class has {self.n_splits} rows: a fold would be empty")
        ranked = _ranked(data, self.stratify, self.shuffle, self.seed, self.order)
        return ranked.withColumn("fold_id", F.pmod(F.col("rank") - 1, F.lit(self.n_splits)).cast("long")).drop("rank")

    def sizes(self, data: Labelled) -> list[int]:
        if self.stratify and data.class_table is not None:
            # Whole rounds of every class, and one row more in the folds that its last round reaches.
            left = data.class_table.groupBy((F.col("n") % self.n_splits).alias("left")).agg(F.count(F.lit(1)).alias("classes"), F.sum(F.expr(f"n div {self.n_splits}")).alias("rounds")).collect()
            return [sum(r["rounds"] + r["classes"] * (r["left"] > f) for r in left) for f in range(self.n_splits)]
        dealt = [m for _, _, m in data.class_counts] if self.stratify else [data.n]
        return [sum(-(-(m - f) // self.n_splits) for m in dealt if m > f) for f in range(self.n_splits)]


@dataclass(frozen=True)
class LeaveOneOut(Splitter):
    """Each row tests alone, in the fold of its number; where keys are below 0, they count from the least."""

    def assign(self, data: Labelled) -> DataFrame:
        _enough(data)
        return data.frame.withColumn("fold_id", F.col("row_idx") - F.lit(min(0, data.low)).cast("long"))

    def sizes(self, data: Labelled) -> list[int]:
        return [1]  # each of them


def fold_stats(assigned: DataFrame, classes: list[str]) -> DataFrame:
    """fold_id, label_s, n_test, n_train for each fold and class, zeros included."""
    spark = assigned.sparkSession
    seen = assigned.where("fold_id >= 0").groupBy("fold_id", "label_s").agg(F.count(F.lit(1)).alias("n_test"))
    totals = assigned.groupBy("label_s").agg(F.count(F.lit(1)).alias("n"))
    folds = assigned.where("fold_id >= 0").select("fold_id").distinct()
    # As many rows as folds times classes; the classes are a short list.
    names = spark.createDataFrame([(c,) for c in classes], "label_s string")
    grid = folds.withColumn("label_s", F.explode(F.array(*[F.lit(c) for c in classes]))) if classes else folds.join(names, F.lit(False))
    return grid.join(seen, ["fold_id", "label_s"], "left").join(F.broadcast(totals), "label_s").select("fold_id", "label_s", F.coalesce("n_test", F.lit(0)).alias("n_test"), (F.col("n") - F.coalesce("n_test", F.lit(0))).alias("n_train"))


def partitions(assigned: DataFrame, n_folds: int) -> DataFrame:
    """Every row with each of folds 0 to ``n_folds`` - 1 and its role (train or test) there: folds times rows."""
    if n_folds < 1:
        raise ValidationError("there are no folds")
    folds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_folds - 1).cast("long")))
    return assigned.withColumn("fold", folds).withColumn("role", F.when(F.col("fold") == F.col("fold_id"), "test").otherwise("train"))
