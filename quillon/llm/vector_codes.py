"""Vectors as short codes: product codebooks by Lloyd's rounds that rescan only parts whose bounds broke.

A vector's components become whole numbers and it is cut into equal parts; each part position has a
codebook.  Vectors lie in blocks of bounded size, and a block has one heap for each codebook entry, of
the parts that the entry holds.  A part's key is its slack, the lower bound of the distance to any other
entry less the upper bound of that to its own, plus what its entry's bounds had drifted when it was put
in.  After entries have moved, the drift of each entry's bounds grows by its own way and the longest of
the others'; only parts at a heap's top whose key is no more than that drift can have another nearest
entry.  They are popped, compared with every entry exactly, and put into the heap of their nearest.  All
others keep their entry without being looked at.  What a round changes are sums of the parts that moved,
added up by Spark; the driver holds the codebooks, whose size is a parameter's.

Distances are whole numbers that doubles hold exactly, bounds have a margin for rounding, so codes are
those of plain Lloyd rounds to the last digit.  Each round's blocks are written before the next begins.

Defined cases: a vector that is null or holds a null or non-finite component is dropped; vectors of
unequal width, of a width that ``parts`` does not divide, or with components too large for exact sums are
an error.  Ids are whole numbers; null ids come last when the first entries are picked, ties of ids go by
components.  Repeated rows count each.  Null labels are one label.  An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import DataError
from quillon.llm.common import bounded_batches, durable, passing
from quillon.sources.shared import forget

#: Vectors of one block.
BLOCK = 4096
#: Whole numbers that doubles add exactly.
EXACT = 1 << 53
#: Slack that rounding may have taken from bounds.
MARGIN = 1e-6
#: A label with more than one in HOT of all rows is hot; there are fewer than HOT hot labels.
HOT = 10_000


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, q: the rows that are kept, their components as floor(scale * x)."""
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return given.where(F.col("x").isNotNull() & ~bad).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


def _checked_width(kept: DataFrame, parts: int) -> int:
    """The vectors' width, 0 without rows."""
    most = F.max(F.array_max(F.transform("q", lambda v: F.abs(v))))
    facts = kept.agg(F.min(F.size("q")).alias("low"), F.max(F.size("q")).alias("high"), most.alias("most")).first()
    if facts["high"] is None:
        return 0
    if facts["low"] != facts["high"] or facts["high"] % parts or not facts["high"]:
        raise DataError(f"vectors have {facts['low']} to {facts['high']} components; one width is needed that {parts} parts divide")
    if facts["high"] // parts * (2 * facts["most"] + 2) ** 2 >= EXACT:
        raise DataError(f"components of up to {facts['most']} are too large for exact distances")
    return facts["high"]


# --- one block -----------------------------------------------------------------------------------


def scan(x: np.ndarray, book: np.ndarray):
    """Nearest entry of each row, ties to the lower, with the least and second least squared distance (inf if there is none)."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    best, rows = d.argmin(axis=1), np.arange(len(x))
    near = d[rows, best]
    d[rows, best] = np.inf
    return best, near, d.min(axis=1)


class Heaps:
    """The parts of one position in one block: a heap of (key, row) for each entry, kept as arrays one after the other."""

    def __init__(self, entry: np.ndarray, keys: np.ndarray, rows: np.ndarray, entries: int):
        self.entry, self.keys, self.rows = entry, keys, rows
        ends = np.bincount(entry, minlength=entries).cumsum()
        self.spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        self.opened: dict[int, list] = {}

    def open(self, e: int) -> list:
        if e not in self.opened:
            lo, hi = self.spans[e]
            self.opened[e] = list(zip(self.keys[lo:hi].tolist(), self.rows[lo:hi].tolist()))
        return self.opened[e]

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Rows of all parts whose key is no more than their entry's drift."""
        found = []
        for e, (lo, hi) in enumerate(self.spans):
            bound = float(drift[e]) + MARGIN
            if lo == hi or self.keys[lo] > bound:
                continue
            heap = self.open(e)
            while heap and heap[0][0] <= bound:
                found.append(heapq.heappop(heap)[1])
        return np.array(found, np.int64)

    def push(self, rows: np.ndarray, entry: np.ndarray, keys: np.ndarray) -> None:
        self.entry[rows] = entry
        for e, key, row in zip(entry.tolist(), keys.tolist(), rows.tolist()):
            heapq.heappush(self.open(e), (key, row))

    def arrays(self):
        keys, rows = [], []
        for e, (lo, hi) in enumerate(self.spans):
            heap = self.opened.get(e)
            keys.append(self.keys[lo:hi] if heap is None else np.array([k for k, _ in heap], np.float64))
            rows.append(self.rows[lo:hi] if heap is None else np.array([r for _, r in heap], np.int32))
        return np.concatenate(keys), np.concatenate(rows)


@dataclass(frozen=True)
class Round:
    """Codebooks (part, entry, component), and how far each entry's bounds have drifted since the first of them."""

    books: np.ndarray
    drift: np.ndarray

    def settle(self, values: np.ndarray, entry: np.ndarray, keys: np.ndarray | None, rows: np.ndarray | None):
        """Assign a block's parts anew where need be: entry, keys and rows of its heaps, and {slot: change of a sum}.

        A slot numbers a sum: for each part and entry its components' sums and, last, its count.
        """
        parts, entries, width = self.books.shape
        change = np.zeros((parts, entries, width + 1), np.int64)
        out_keys, out_rows = [], []
        for p in range(parts):
            x = values[:, p * width : (p + 1) * width]
            first = keys is None
            if first:
                heaps = Heaps(np.zeros(0, np.uint8), np.zeros(0), np.zeros(0, np.int32), entries)
                heaps.entry = entry[p]
                popped = np.arange(len(values))
            else:
                heaps = Heaps(entry[p], keys[p], rows[p], entries)
                popped = heaps.pop(self.drift[p])
            if len(popped):
                own, before = x[popped], entry[p][popped].astype(np.int64)
                best, near, far = scan(own.astype(np.float64), self.books[p].astype(np.float64))
                heaps.push(popped, best, np.sqrt(far) - np.sqrt(near) + self.drift[p][best])
                counted = np.concatenate([own, np.ones((len(own), 1), np.int64)], axis=1)
                moved = np.ones(len(own), bool) if first else best != before
                np.add.at(change[p], best[moved], counted[moved])
                if not first:
                    np.subtract.at(change[p], before[moved], counted[moved])
            k, r = heaps.arrays()
            out_keys.append(k)
            out_rows.append(r)
        slots = np.flatnonzero(change)
        return entry, np.stack(out_keys), np.stack(out_rows), list(zip(slots.tolist(), change.ravel()[slots].tolist()))

    def moved(self, totals: np.ndarray) -> Round:
        """The next round's: means of the parts, rounded down; entries without parts stay."""
        n = totals[:, :, -1:]
        books = np.where(n > 0, totals[:, :, :-1] // np.maximum(n, 1), self.books)
        way = np.sqrt(((books - self.books).astype(np.float64) ** 2).sum(axis=2))
        others = np.zeros_like(way)
        if way.shape[1] > 1:
            top = np.sort(way, axis=1)[:, -2:]
            others = np.where(way == top[:, 1:], top[:, :1], top[:, 1:])
        return Round(books, self.drift + way + others)


# --- blocks as rows ------------------------------------------------------------------------------


def _state_schema(label: T.DataType) -> T.StructType:
    kinds = {"vec_id": T.ArrayType(T.LongType()), "label": T.ArrayType(label), "q": T.BinaryType(), "entry": T.BinaryType(), "keys": T.BinaryType(), "heap_rows": T.BinaryType()}
    changed = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("change", T.LongType())]))
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()] + [T.StructField("changes", changed)])


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _state(ids: pa.Array, labels: pa.Array, values: np.ndarray, settled) -> pa.RecordBatch:
    entry, keys, rows, changes = settled
    sums = pa.array([[{"slot": s, "change": c} for s, c in changes]], pa.list_(pa.struct([("slot", pa.int32()), ("change", pa.int64())])))
    blobs = [pa.array([a.tobytes()], pa.binary()) for a in (values.astype(np.int32), entry, keys, rows)]
    return pa.RecordBatch.from_arrays([_listed(ids), _listed(labels), *blobs, sums], names=["vec_id", "label", "q", "entry", "keys", "heap_rows", "changes"])


def _first(round_: Round, size: int):
    """Rows into blocks, every part compared with every entry."""
    parts, _, width = round_.books.shape

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, labels, q = (table[c].chunk(0) for c in ("vec_id", "label", "q"))
        values = q.flatten().to_numpy().reshape(len(table), parts * width)
        return _state(ids, labels, values, round_.settle(values, np.zeros((parts, len(table)), np.uint8), None, None))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _blocks(batch: pa.RecordBatch, parts: int, width: int):
    """ids, labels, values, entries, keys and rows of the blocks in a batch."""
    for i in range(batch.num_rows):
        ids, labels = batch.column("vec_id")[i].values, batch.column("label")[i].values
        q, entry, keys, rows = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("q", np.int32), ("entry", np.uint8), ("keys", np.float64), ("heap_rows", np.int32)))
        yield ids, labels, q.reshape(-1, parts * width).astype(np.int64), entry.reshape(parts, -1).copy(), keys.reshape(parts, -1), rows.reshape(parts, -1)


def _next(round_: Round):
    parts, _, width = round_.books.shape

    def run(batches):
        for batch in batches:
            for ids, labels, values, entry, keys, rows in _blocks(batch, parts, width):
                yield _state(ids, labels, values, round_.settle(values, entry, keys, rows))

    return run


def _last(round_: Round):
    """Each vector's code and squared error after the last assignment."""
    parts, _, width = round_.books.shape

    def run(batches):
        for batch in batches:
            for ids, labels, values, entry, keys, rows in _blocks(batch, parts, width):
                entry = round_.settle(values, entry, keys, rows)[0]
                gaps = [values[:, p * width : (p + 1) * width] - round_.books[p][entry[p]] for p in range(parts)]
                error = sum((g * g).sum(axis=1) for g in gaps)
                text = np.ascontiguousarray(entry.T).tobytes().hex()
                codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _totals(blocks: DataFrame, shape: tuple) -> np.ndarray:
    """Changes of all blocks, summed: as many numbers as the codebooks have."""
    found = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.select(F.explode("changes").alias("c")).groupBy("c.slot").agg(F.sum("c.change").alias("change")).collect():
        found[r["slot"]] = r["change"]
    return found.reshape(shape)


# --- the operator --------------------------------------------------------------------------------


def codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector that is kept."""
    if not 1 <= entries <= 256 or rounds < 1 or parts < 1:
        raise DataError("codes take 1 to 256 entries, and at least one part and round")
    spark = rows.sparkSession
    bounded_batches(spark)
    kept = whole_numbers(rows, id_col, vector_col, label_col, scale)
    width = _checked_width(kept, parts)
    label = kept.schema["label"].dataType
    coded = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not width:
        empty = spark.createDataFrame([], coded)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    now = Round(books, np.zeros(books.shape[:2]))
    with passing(spark) as keep:
        totals, blocks, schema = np.zeros((parts, len(first), width // parts + 1), np.int64), None, _state_schema(label)
        for _ in range(rounds):
            made = kept.mapInArrow(_first(now, block), schema) if blocks is None else blocks.mapInArrow(_next(now), schema)
            before, blocks = blocks, durable(made, "code_blocks")
            if before is not None:
                forget(before)
            totals += _totals(blocks, totals.shape)
            now = now.moved(totals)
        found = keep(durable(blocks.mapInArrow(_last(now), coded), "codes"))
    digest = hashlib.sha256(",".join(map(str, now.books.ravel().tolist())).encode()).hexdigest()
    return _with_label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _with_label_errors(found: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows with a row's label.

    Totals of hot labels, at most HOT of them, are broadcast; no other label has more than one in HOT of the
    rows, so their join deals rows evenly.
    """
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    totals = durable(totals, "label_errors")
    bound = (totals.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = totals.where(F.col("n") > bound).select(F.col("label").alias("_of"), "label_error")
    cold = totals.where(F.col("n") <= bound).select(F.col("label").alias("_of"), "label_error")
    own = found.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_of")), "left")
    if cold.isEmpty():
        return own
    rest = own.where("label_error IS NULL").drop("_of", "label_error").join(cold, F.col("label").eqNullSafe(F.col("_of")))
    return own.where("label_error IS NOT NULL").unionByName(rest)
