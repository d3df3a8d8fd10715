"""Classifiers over assigned frames: k nearest neighbours and nearest centroid, all folds in one plan."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ClassifierError, DataError
from quillon.functions.distances import Distance, distance
from quillon.functions.sums import Digits, digits, digits_of_vectors
from quillon.operators import cells
from quillon.operators.nearest import NARROW, block_matcher, matcher
from quillon.sources.labelled import Labelled
from quillon.sources.shared import BROADCAST_ROWS, bounded, durable

#: Bytes of a centroid model that may be broadcast; a larger one is dealt into blocks.
BROADCAST_BYTES = 32 << 20
#: Bytes of one block of either side.
BLOCK_BYTES = 16 << 20
#: Differences of coordinates that one task may take.
PART_WORK = 5_000_000_000
#: Bytes of a partition that is sorted, and those that a neighbour or a row without its features takes there.
SORTED_BYTES, SORTED_ROW = 64 << 20, 256
#: Equal test rows that one task sorts.
HEAVY = 100_000
#: Differences of coordinates from which on rows with equal features are looked for once.
COPIES_WORK = 1_000_000_000
#: Classes times features up to which centroid distances are unrolled; the Java VM interprets methods that are much longer.
UNROLLED = 64
#: Differences of coordinates from which on neighbours are looked for by cells, if a sample of this many test rows meets less than this share of pairs.
PRUNED_WORK, SAMPLE, PRUNED_SHARE = 4_000_000_000, 1024, 0.5
#: Most cells that a test row of that sample may meet on average: as often its features are shuffled.
SPREAD = 16
#: Bytes of test rows, if each was written for every cell, from which on a sample has to tell too.
SPREAD_BYTES = 256 << 20
#: Most training blocks of one coordinate that all test rows meet in its order, which takes less than cells do.
LINE_BLOCKS = 4
#: Widest vectors whose coordinates are summed as columns; wider ones are summed as rows.
WIDE = 16
#: Most partitions that groups of a cell are dealt into.
PARTITIONS = 20_000
#: Pairs of blocks beyond which chunks of test rows grow up to a block's size, as each pair reads a block of training rows anew.
PAIRS = 1_000

PREDICTED = ["fold", "row_idx", "y_true", "y_pred", "true_s", "pred_s"]


@dataclass(frozen=True)
class Shape:
    """What a prediction's plan is made from: vector width, rows and folds (numbered from 0), and the texts of the classes.

    Of classes too many to list there is only their number.
    """

    width: int
    n_train: int
    n_test: int
    n_folds: int
    classes: tuple[str, ...]
    many: int = 0

    @property
    def n_classes(self) -> int:
        return max(1, self.many or len(self.classes))


def shape_of(data: Labelled, n_test: int, n_folds: int) -> Shape:
    listed = data.class_table is None
    return Shape(data.width, data.n, n_test, n_folds, tuple(data.classes) if listed else (), 0 if listed else data.n_classes)


class Classifier(ABC):
    @abstractmethod
    def predict(self, train: DataFrame, test: DataFrame, shape: Shape) -> DataFrame:
        """fold, row_idx, y_true, y_pred, true_s, pred_s for each test row; a row trains for all folds but its own."""


def check_widths(train: Labelled, test: Labelled) -> int:
    if train.width != test.width:
        raise DataError(f"training rows have {train.width} features, test rows {test.width}")
    return train.width


def _row_bytes(width: int) -> int:
    return 8 * width + 64


def _parts(total: int, most: int = BLOCK_BYTES) -> int:
    return max(1, -(-total // most))


def _upto(n: int):
    """Each number from 0 to n - 1, in a row of its own."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _one_of(n: int, column: str):
    return F.pmod(F.xxhash64(column), F.lit(n))


def _hashed(vector: str):
    """A number that equal vectors share; Spark deals rows anew where vectors themselves are the keys of a join or window."""
    return F.xxhash64(F.transform(vector, lambda x: x + F.lit(0.0)))


@dataclass(frozen=True)
class Knn(Classifier):
    """Majority of the k nearest; ties by least sum of distances, then by the label's text.

    Of training rows at one distance the first by row number are nearer. Both sides are packed into blocks, and each
    pair of blocks meets in a task of its own that gives k rows for each test row; blocks are read from the shuffle as often as
    they are met, but written once. ``blocks`` sets the number of training blocks, which else follows from their size.  With ``prune`` pairs
    that the triangle inequality rules out never meet (see ``cells``); unless it is set, this is done for metrics where there are many
    pairs. Of many pairs, or of rows that would take much room in all cells, a sample of test rows has to tell that most are ruled out, or all meet by blocks,
    as cells would write each row many times.  Where there are many pairs rows with equal features and fold are looked for once, and of such
    training rows only those are met that can be among k.  Neighbours are the same in all ways.
    """

    k: int = 1
    metric: Distance = field(default_factory=lambda: distance("euclidean"))
    blocks: int | None = None
    prune: bool | None = None

    def __post_init__(self):
        if isinstance(self.k, bool) or not isinstance(self.k, int) or self.k < 1:
            raise ClassifierError(f"k has to be a whole number above 0, not {self.k!r}")

    @staticmethod
    def _sides(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        t = test.select(F.col("fold_id").alias("fold"), "row_idx", F.col("label").alias("y_true"), F.col("label_s").alias("true_s"), F.col("features").alias("x"))
        return t, train.select(F.col("fold_id").alias("r_fold"), F.col("row_idx").alias("r_idx"), "label", "label_s", "features")

    def predict(self, train, test, shape):
        t, r = self._sides(train, test)
        if self._work(shape) < COPIES_WORK:
            return self.vote(self._near(t, r, shape))
        n_test = shape.n_test
        t, asked, r, shape = self._once(t, r, shape)
        voted = self.vote(self._near(asked.drop("n"), r, shape)).select("fold", "row_idx", "y_pred", "pred_s")
        return self._each(t, asked, voted, shape, n_test).select(*PREDICTED)

    def neighbours(self, train, test, shape: Shape) -> DataFrame:
        """fold, row_idx, y_true, true_s, label, label_s, r_idx, d, nth: the k nearest training rows of each test row."""
        t, r = self._sides(train, test)
        if self._work(shape) < COPIES_WORK:
            return self._near(t, r, shape)
        n_test = shape.n_test
        t, asked, r, shape = self._once(t, r, shape)
        near = self._near(asked.drop("n"), r, shape).groupBy("fold", "row_idx").agg(F.collect_list(F.struct("label", "label_s", "r_idx", "d", "nth")).alias("near"))
        found = self._each(t, asked, near, shape, n_test).withColumn("near", F.explode("near"))
        return found.select("fold", "row_idx", "y_true", "true_s", "near.*")

    @staticmethod
    def _work(shape: Shape) -> int:
        return shape.n_train * shape.n_test * max(1, shape.width)

    def _once(self, t: DataFrame, r: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, DataFrame, Shape]:
        """Test rows with the fold they are to be looked for in (``as_fold``), one test row of each x and as_fold, and training rows without those that can't be among k.

        Of equal training rows in one fold only the first k can be; of what is left of equal rows, whichever fold is
        left out, only the first 2 k. A fold without training rows leaves none out: in leave-one-out copies ask for the same.
        """
        # First among the rows of a part, so that equal rows, however many, need not fit into one task.
        n = _parts(shape.n_train * (SORTED_ROW + 8 * shape.width), SORTED_BYTES)
        r = self._few(r.withColumn("part", _one_of(n, "r_idx")).repartition(n, "part"), "part").drop("part")
        r = durable(self._few(r.withColumn("key", _hashed("features")).repartition(n, "key"), "key").drop("key"), "training")
        folds = r.select(F.col("r_fold").alias("fold")).distinct().withColumn("as_fold", F.col("fold"))
        t = self._joined(t, folds, ["fold"], folds.count(), _parts(shape.n_test * (SORTED_ROW + 8 * shape.width), SORTED_BYTES), "left")
        t = t.withColumn("as_fold", F.coalesce("as_fold", F.lit(-2).cast("long")))
        none = [F.lit(None).cast(t.schema[c].dataType).alias(c) for c in ("y_true", "true_s")]
        asked = t.groupBy(F.col("as_fold").alias("fold"), "x").agg(F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("n"))
        asked = durable(asked.select("fold", "row_idx", *none, "x", "n"), "asked")
        return t, asked, r, Shape(shape.width, r.count(), asked.count(), shape.n_folds, shape.classes, shape.many)

    def _few(self, r: DataFrame, *within: str) -> DataFrame:
        """Of equal rows in one fold the first k, and of what is left of equal rows the first 2 k."""
        for keys, n in (("features", "r_fold"), self.k), (("features",), 2 * self.k):
            first = Window.partitionBy(*within, *keys).orderBy("r_idx")
            r = r.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n).drop("nth")
        return r

    @staticmethod
    def _joined(rows: DataFrame, side: DataFrame, keys: list[str], n_side: int, n: int, how: str = "inner") -> DataFrame:
        """Rows meet a side of n_side rows: few are broadcast, else both are sorted in n partitions."""
        if n_side > BROADCAST_ROWS:
            # A number that is given: Spark would join partitions until they have some size, compressed.
            rows, side = rows.repartition(n, *keys), side.repartition(n, *keys)
        return rows.join(bounded(side, n_side), keys, how)

    def _each(self, t: DataFrame, asked: DataFrame, found: DataFrame, shape: Shape, n_test: int) -> DataFrame:
        """What was found for the test rows asked for, for each of n_test rows."""
        size, row = shape.n_test * (1 + shape.width + 4 * self.k), SORTED_ROW + 8 * shape.width
        n = _parts(shape.n_test * (row + 128 * self.k), SORTED_BYTES)
        keyed = self._joined(asked.select("fold", "row_idx", "x", "n"), found, ["fold", "row_idx"], size, n).drop("row_idx").withColumnRenamed("fold", "as_fold")
        if size <= BROADCAST_ROWS:
            return t.join(F.broadcast(keyed.drop("n")), ["as_fold", "x"]).drop("as_fold", "x")
        # Equal rows beyond HEAVY are dealt into parts, and what was found for them goes to each.
        parts = F.ceil(F.col("n") / HEAVY)
        heavy = F.broadcast(asked.where(F.col("n") > HEAVY).select(F.col("fold").alias("as_fold"), "x", parts.alias("parts")))
        t = t.join(heavy, ["as_fold", "x"], "left").withColumn("part", F.pmod(F.xxhash64("row_idx"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
        keyed = keyed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
        t, keyed = t.withColumn("key", _hashed("x")), keyed.withColumn("key", _hashed("x")).withColumnRenamed("x", "as_x")
        met = self._joined(t, keyed, ["as_fold", "key", "part"], size, n + _parts(n_test * row, SORTED_BYTES))
        # Equal vectors, but not as a key of the join.
        return met.where("x <= as_x AND x >= as_x").drop("as_fold", "x", "as_x", "key", "part")

    def _near(self, t: DataFrame, r: DataFrame, shape: Shape) -> DataFrame:
        pruned = self._pruned(t, r, shape)
        if pruned is None:
            return self._first(self._all(t, r, shape), shape.n_test * self.k * self._blocks(shape))
        return self._first(pruned, 2 * shape.n_test * self.k)

    @staticmethod
    def _spread(near: DataFrame, rows: int) -> DataFrame:
        """Neighbours of a test row together, in partitions of bounded size that Spark doesn't join."""
        return near.repartition(_parts(SORTED_ROW * rows, SORTED_BYTES), "fold", "row_idx")

    def _first(self, near: DataFrame, rows: int) -> DataFrame:
        first = Window.partitionBy("fold", "row_idx").orderBy("d", "r_idx")
        return self._spread(near, rows).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= self.k)

    def _blocks(self, shape: Shape) -> int:
        return self.blocks or _parts(shape.n_train * _row_bytes(shape.width), 2 * BLOCK_BYTES)

    def _met_by(self, rows: int, width: int) -> int:
        """Training rows of a block that a test row is compared with."""
        return min(rows, 256 * self.k) if 0 < width <= NARROW else rows

    def _all(self, t: DataFrame, r: DataFrame, shape: Shape) -> DataFrame:
        """The k nearest of each block, every chunk of test rows meeting every block."""
        size, n_test, blocks = _row_bytes(shape.width), max(1, shape.n_test), self._blocks(shape)
        work = self._met_by(shape.n_train, shape.width) * n_test * max(1, shape.width) // (PART_WORK * blocks)
        chunks = min(n_test, max(_parts(n_test * size), _parts(n_test * self.k * 64), min(work, PAIRS // blocks)))
        tests = self._packed(t, "row_idx", chunks, "tests")
        # Pairs of partitions: neither side is broadcast, and none is copied into the shuffle.
        met = tests.hint("shuffle_replicate_nl").crossJoin(self._packed(r, "r_idx", blocks, "trains"))
        return met.mapInArrow(block_matcher(self.metric, self.k, shape.width), self._near_schema(t, r))

    @staticmethod
    def _packed(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
        """Rows in lists, one for each of n partitions."""
        lists = rows.groupBy(_one_of(n, key).cast("int").alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        return lists.repartitionById(n, "part").select(name)

    def _met(self, t: DataFrame, r: DataFrame, shape: Shape, n: int, keys: tuple) -> DataFrame:
        # Both sides are dealt by the same keys once; groups need no further shuffle.
        left, right = (x.repartition(n, *keys).groupBy(*keys) for x in (t, r))
        return left.cogroup(right).applyInArrow(matcher(self.metric, self.k, shape.width), self._near_schema(t, r))

    def _pruned(self, t: DataFrame, r: DataFrame, shape: Shape) -> DataFrame | None:
        """The same from cells that may hold one of the k nearest; None where all pairs are to meet."""
        if not cells.is_metric(self.metric) or shape.width < 1 or self.prune is False or self.blocks is not None:
            return None
        many = self._work(shape) >= PRUNED_WORK
        if self.prune is None and (not many or shape.width == 1 and self._blocks(shape) <= LINE_BLOCKS):
            return None
        centres = cells.pivots(r, shape.n_train, shape.width)
        r = cells.celled(r, self.metric, centres, shape.width)
        found = cells.cells_of(r)
        if many or shape.n_test * len(found) * _row_bytes(shape.width) >= SPREAD_BYTES:
            some = t.orderBy(F.xxhash64("row_idx"), "row_idx").limit(SAMPLE)
            share, each = self._share(self._two_steps(some, r, centres, found, replace(shape, n_test=min(SAMPLE, shape.n_test)))[1:], found, shape.n_train)
            if share > PRUNED_SHARE or each > SPREAD:
                return None
        return self._two_steps(t, r, centres, found, shape)[0]

    def _two_steps(self, t: DataFrame, r: DataFrame, centres, found: list[cells.Cell], shape: Shape) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Neighbours, and the (row_idx, cell) that met first and then."""
        asked = cells.wanted(t, self.metric, centres, found, self.k, shape.width)
        first = asked.withColumn("cell", F.explode("first")).drop("first", "rest")
        # Written: it bounds the second step and is part of the result.
        near = durable(self._by_cell(first, r, found, shape), "near")
        bound = cells.bounds(self._spread(near, 2 * shape.n_test * self.k), self.k)
        n = _parts(shape.n_test * (SORTED_ROW + 8 * shape.width + 32 * len(found)), SORTED_BYTES)
        second = cells.left(self._joined(asked.drop("first"), bound, ["fold", "row_idx"], shape.n_test, n, "left"))
        return near.unionByName(self._by_cell(second, r, found, shape)), first.select("row_idx", "cell"), second.select("row_idx", "cell")

    def _by_cell(self, t: DataFrame, r: DataFrame, found: list[cells.Cell], shape: Shape) -> DataFrame:
        """Test rows meet the training rows of their cell, in parts of bounded size and work."""
        demand = {x["cell"]: x["n"] for x in t.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        size, dealt = _row_bytes(shape.width), []
        for c in found:
            n = demand.get(c.number, 0)
            if n:
                blocks = _parts(c.rows * size)
                dealt.append((c.number, blocks, min(n, max(_parts(n * size), _parts(n * self.k * 64), n * self._met_by(c.rows, shape.width) * max(1, shape.width) // (PART_WORK * blocks), 1))))
        # As many rows as pivots.
        parts = F.broadcast(t.sparkSession.createDataFrame(dealt, "cell long, blocks long, chunks long"))
        t, r = t.join(parts, "cell"), r.drop("gap").join(parts, "cell")
        t = t.withColumn("chunk", F.pmod(F.xxhash64("row_idx"), "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "chunks")
        r = r.withColumn("block", F.pmod(F.xxhash64("r_idx"), "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("blocks", "chunks")
        n = min(PARTITIONS, max(1, sum(b * k for _, b, k in dealt)))
        return self._met(t, r, shape, n, ("cell", "chunk", "block"))

    @staticmethod
    def _share(met: tuple[DataFrame, DataFrame], found: list[cells.Cell], n_train: int) -> tuple[float, float]:
        """Pairs of rows that meet, of all pairs, and cells that a test row meets on average."""
        sizes = {c.number: c.rows for c in found}
        demand = met[0].unionByName(met[1]).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
        n_test = max(1, met[0].unionByName(met[1]).select("row_idx").distinct().count())
        return sum(x["n"] * sizes[x["cell"]] for x in demand) / max(1, n_test * n_train), sum(x["n"] for x in demand) / n_test

    def pairs_met(self, train: DataFrame, test: DataFrame, shape: Shape) -> float:
        """The share of all pairs that pruning leaves."""
        t, r = self._sides(train, test)
        centres = cells.pivots(r, shape.n_train, shape.width)
        r = cells.celled(r, self.metric, centres, shape.width)
        found = cells.cells_of(r)
        return self._share(self._two_steps(t, r, centres, found, shape)[1:], found, shape.n_train)[0]

    @staticmethod
    def _near_schema(t: DataFrame, r: DataFrame) -> T.StructType:
        own = [t.schema[c] for c in ("fold", "row_idx", "y_true", "true_s")] + [r.schema[c] for c in ("label", "label_s", "r_idx")]
        return T.StructType([T.StructField(f.name, f.dataType) for f in own] + [T.StructField("d", T.DoubleType())])

    def vote(self, near: DataFrame) -> DataFrame:
        # What follows is grouped by more columns than these: one shuffle serves all.
        votes = near.groupBy("fold", "row_idx", "y_true", "true_s", "label", "label_s").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("d")).alias("ds"))
        # Distances are added from the nearest on, so sums don't depend on how rows were shuffled.
        total = F.aggregate("ds", F.lit(0.0), lambda s, x: s + x)
        order = F.struct((-F.col("n")).alias("n"), total.alias("d"), F.col("label_s").alias("s"))
        best = votes.groupBy("fold", "row_idx", "y_true", "true_s").agg(F.min_by(F.struct("label", "label_s"), order).alias("best"))
        return best.select("fold", "row_idx", "y_true", F.col("best.label").alias("y_pred"), "true_s", F.col("best.label_s").alias("pred_s"))


@dataclass(frozen=True)
class NearestCentroid(Classifier):
    """The class whose mean is nearest by L2; ties by the label's text. A distance that is NaN comes first."""

    def _sums(self, train: DataFrame, made: list[Digits], *keys: str) -> DataFrame:
        """The keys, label_s, label, n, s0_0, s0_1...: sums of each class, by digits."""
        sums = {f"s{i}_{j}": F.sum(x) for i, d in enumerate(made) for j, x in enumerate(d.of(F.col(f"x{i}")))}
        # Values behind a generator: what takes them apart into digits uses each many times.
        values = F.explode(F.array(F.struct(*[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(len(made))]))) if made else None
        rows = train.select(*keys, "label_s", "label", values.alias("v")).select(*keys, "label_s", "label", "v.*") if made else train
        # Labels are a key here, as a least text would make Spark sort all rows; few rows are left to take the least of.
        each = rows.groupBy(*keys, "label_s", "label").agg(F.count(F.lit(1)).alias("n"), *[x.alias(c) for c, x in sums.items()])
        return each.groupBy(*keys, "label_s").agg(F.min("label").alias("label"), *[F.sum(c).alias(c) for c in ("n", *sums)])

    @staticmethod
    def _digits(train: DataFrame, width: int) -> list[Digits]:
        return digits(train, [F.get("features", F.lit(i)) for i in range(width)])

    @staticmethod
    def _whole(made: list[Digits]) -> list[Column]:
        return [d.whole([F.col(f"s{i}_{j}") for j in range(d.size)]) for i, d in enumerate(made)]

    @staticmethod
    def _long_sums(train: DataFrame, made: list[Digits], *keys: str) -> DataFrame:
        """As _sums(), with a row (pos) instead of columns for each coordinate: what wide vectors take."""
        left, found = F.when(F.abs("x") < float("inf"), F.col("x")).otherwise(0.0), []
        for k in range(len(made[0].units)):
            unit = F.get(F.array(*[F.lit(d.units[k]) for d in made]), F.col("pos"))
            digit = F.floor(left * (1 / unit))
            found.append(F.sum(digit).alias(f"s{k}"))
            left = left - digit.cast("double") * unit
        if made[0].odd:
            found.append(F.sum(F.when(F.abs("x") < float("inf"), 0.0).otherwise(F.col("x"))).alias("odd"))
        each = train.select(*keys, "label_s", "label", F.posexplode("features").alias("pos", "x")).groupBy(*keys, "label_s", "label", "pos").agg(F.count(F.lit(1)).alias("n"), *found)
        return each.groupBy(*keys, "label_s", "pos").agg(F.min("label").alias("label"), *[F.sum(c).alias(c) for c in each.columns if c == "n" or c not in (*keys, "label_s", "label", "pos")])

    @staticmethod
    def _gathered(rows: DataFrame, made: list[Digits], *keys: str) -> DataFrame:
        """The keys, label, n and sums (array) from rows of _long_sums."""
        total = F.lit(0.0)
        for k in reversed(range(len(made[0].units))):
            total = F.col(f"s{k}").cast("double") * F.get(F.array(*[F.lit(d.units[k]) for d in made]), F.col("pos")) + total
        total = total + F.col("odd") if made[0].odd else total
        placed = F.sort_array(F.collect_list(F.struct("pos", total.alias("s"))))
        return rows.groupBy(*keys).agg(F.min("label").alias("label"), F.max("n").alias("n"), F.transform(placed, lambda x: x["s"]).alias("sums"))

    def totals(self, train: DataFrame, width: int) -> DataFrame:
        """label_s, label, n, sums: sums of each class's vectors, the same however rows are dealt."""
        if width > WIDE:
            made = digits_of_vectors(train, "features", width)
            return self._gathered(self._long_sums(train, made), made, "label_s")
        made = self._digits(train, width)
        return self._sums(train, made).select("label_s", "label", "n", F.array(*self._whole(made)).cast("array<double>").alias("sums"))

    def fit(self, train: DataFrame, shape: Shape) -> DataFrame:
        """fold, label_s, label, n, centroid: class means over all folds but each one."""
        if shape.n_folds == 1:
            met = self.totals(train.where(F.col("fold_id").isNull() | (F.col("fold_id") != 0)), shape.width).withColumn("fold", F.lit(0).cast("long"))
        else:
            # A fold's sums are those of the folds before it and of those behind it. Rows of zeros ask for each fold and class.
            wide = shape.width > WIDE
            made = digits_of_vectors(train, "features", shape.width) if wide else self._digits(train, shape.width)
            parts = (self._long_sums if wide else self._sums)(train, made, "fold_id").withColumn("asked", F.lit(False))
            none = (F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
            if shape.many:
                asked = train.select("label_s").distinct().select(_upto(shape.n_folds).alias("fold_id"), "label_s", *none)
            else:
                asked = train.sparkSession.range(shape.n_folds).select(F.col("id").alias("fold_id"), F.explode(F.array(*[F.lit(c) for c in shape.classes]).cast("array<string>")).alias("label_s"), *none)
            if wide:
                asked = asked.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(shape.width - 1))))
            both = parts.unionByName(asked, allowMissingColumns=True)
            places = ["pos"] if wide else []
            own = Window.partitionBy("label_s", *places)
            sides = [own.orderBy(F.col("fold_id").asc()), own.orderBy(F.col("fold_id").desc())]
            less = [side.rangeBetween(Window.unboundedPreceding, -1) for side in sides]
            summed = [c for c in parts.columns if c not in ("fold_id", "label_s", "label", "asked", "pos")]
            rest = {c: F.coalesce(F.sum(c).over(less[0]), F.lit(0)) + F.coalesce(F.sum(c).over(less[1]), F.lit(0)) for c in summed}
            met = both.withColumns({"label": F.min("label").over(own)} | {f"_{c}": x for c, x in rest.items()}).where("asked AND _n > 0").select(F.col("fold_id").alias("fold"), "label_s", "label", *places, *[F.col(f"_{c}").alias(c) for c in rest])
            met = self._gathered(met, made, "fold", "label_s") if wide else met.select("fold", "label_s", "label", "n", F.array(*self._whole(made)).cast("array<double>").alias("sums"))
        return met.where("n > 0").select("fold", "label_s", "label", "n", F.transform("sums", lambda s: s / F.col("n")).alias("centroid"))

    def predict(self, train, test, shape):
        model = self.fit(train, shape).select("fold", F.struct("label_s", "label", "centroid").alias("m"))
        rows = test.select(F.col("fold_id").alias("fold"), "row_idx", F.col("label").alias("y_true"), F.col("label_s").alias("true_s"), "features")
        return self._nearest(rows, model, ["fold"], shape)

    def predict_loo(self, frame: DataFrame, shape: Shape) -> DataFrame:
        """Leave-one-out without n fits: a row's own class has the mean of its other rows."""
        model = self.totals(frame, shape.width).select(F.struct("label_s", "label", F.col("sums").alias("centroid"), "n").alias("m"))
        rows = frame.select(F.col("fold_id").alias("fold"), "row_idx", F.col("label").alias("y_true"), F.col("label_s").alias("true_s"), "features")
        return self._nearest(rows, model, [], shape, left_out=True)

    def _nearest(self, rows: DataFrame, model: DataFrame, keys: list[str], shape: Shape, left_out: bool = False) -> DataFrame:
        """The nearest of the models with a row's keys; ``model`` has the keys and one row (m) per class.

        With ``left_out`` models are sums and counts, and a row takes itself out of its own class.
        A model of a checked size is broadcast and every row compared in place; a larger one is dealt into blocks of
        classes that chunks of rows meet one by one, the best of each block being compared again.
        """
        n_classes, size = shape.n_classes, _row_bytes(shape.width) * (shape.n_folds if keys else 1)
        met = ["fold", "row_idx", "y_true", "true_s"]
        if size * n_classes <= BROADCAST_BYTES:
            models = model.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("_models"))
            near = self._unrolled if n_classes * max(1, shape.width) <= UNROLLED else self._compared
            joined = near(rows, lambda side: rows.join(F.broadcast(side), keys or None), models, shape, left_out)
        else:
            blocks, chunks = _parts(size * n_classes), _parts(shape.n_test * _row_bytes(shape.width))
            dealt = [*keys, "_block", "_chunk"]
            models = model.withColumn("_block", _one_of(blocks, "m.label_s")).withColumn("_chunk", _upto(chunks)).groupBy(*dealt).agg(F.sort_array(F.collect_list("m")).alias("_models"))
            spread = rows.withColumn("_chunk", _one_of(chunks, "row_idx")).withColumn("_block", _upto(blocks))
            each = self._compared(rows, lambda side: spread.join(side, dealt), models, shape, left_out)
            joined = each.groupBy(*met).agg(F.min("best").alias("best"))
        return joined.select("fold", "row_idx", "y_true", F.col("best.label").alias("y_pred"), "true_s", F.col("best.label_s").alias("pred_s"))

    def _compared(self, rows, join, models, shape, left_out) -> DataFrame:
        """Rows with ``best``: a model of any number of classes and coordinates, compared by higher-order functions."""
        l2 = distance("euclidean")

        def means(m):
            own = m["label_s"] == F.col("true_s")
            n = m["n"] - F.when(own, 1).otherwise(0)
            at = F.when(n > 0, F.zip_with(m["centroid"], F.col("features"), lambda s, x: F.try_divide(s - F.when(own, x).otherwise(0.0), n)))
            return F.struct(m["label_s"].alias("label_s"), m["label"].alias("label"), at.alias("centroid"))

        def place(m):
            d = l2.between(F.col("features"), m["centroid"], shape.width)
            return F.when(m["centroid"].isNotNull(), F.struct((~F.isnan(d)).alias("a"), d.alias("d"), m["label_s"].alias("label_s"), m["label"].alias("label")))

        # Means are made first, so that a distance, which uses each many times, computes none of them.
        compared = F.transform(F.transform("_models", means), place) if left_out else F.transform("_models", place)
        return join(models).select("fold", "row_idx", "y_true", "true_s", F.array_min(compared).alias("best"))

    def _unrolled(self, rows, join, models, shape, left_out) -> DataFrame:
        """The same where a column for each coordinate of each class is few: plain arithmetic in compiled code."""
        sides, x = [], [F.get("features", F.lit(i)) for i in range(shape.width)]
        for c in range(shape.n_classes):
            m = F.get("_models", F.lit(c))
            sides += [m["label"].alias(f"_l{c}"), m["label_s"].alias(f"_t{c}")] + [F.get(m["centroid"], F.lit(i)).alias(f"_m{c}_{i}") for i in range(shape.width)]
            sides += [m["n"].alias(f"_n{c}")] if left_out else []
        kept = [k for k in models.columns if k != "_models"]
        wide = join(models.select(*kept, *sides))
        gaps = {}
        for c in range(shape.n_classes):
            at, there = [F.col(f"_m{c}_{i}") for i in range(shape.width)], F.col(f"_t{c}").isNotNull()
            if left_out:
                own = F.when(F.col(f"_t{c}") == F.col("true_s"), 1.0).otherwise(0.0)
                n = F.col(f"_n{c}") - own
                at, there = [F.try_divide(s - F.when(own > 0, v).otherwise(0.0), n) for s, v in zip(at, x)], there & (n > 0)
            total = sum(((v - m) * (v - m) for v, m in zip(x, at)), F.lit(0.0))
            # A distance that is NaN comes first; a class that is not there has none.
            gaps[f"_d{c}"] = F.when(there, F.nanvl(F.sqrt(total), F.lit(-1.0)))
        names = list(gaps)
        least = F.least(*names) if len(names) > 1 else F.col(names[0])
        near = wide.withColumns(gaps).withColumn("_least", least)
        # Classes come in the order of their texts: the first of equals wins.
        best = F.coalesce(*[F.when(F.col(d) == F.col("_least"), F.struct(F.col(f"_l{c}").alias("label"), F.col(f"_t{c}").alias("label_s"))) for c, d in enumerate(names)])
        # A generator, so that conditions on a prediction stay above it: put in its place they would repeat all distances.
        return near.select("fold", "row_idx", "y_true", "true_s", F.explode(F.array(best)).alias("best"))


def check_k(classifier: Classifier, fold_sizes: list[tuple[int, int]]) -> None:
    """fold_sizes: (fold, training rows)."""
    if isinstance(classifier, Knn):
        for fold, n in fold_sizes:
            if classifier.k > n:
                raise ClassifierError(f"k={classifier.k} is more than the {n} training rows of fold {fold}")
