"""CSV files by RFC 4180, read in splits, each record with its place in the file.

Spark reads lines in splits.  Where no field is quoted each line is a record and all stays in columns.  Where fields
are quoted, a line may lie inside one, and whether a split begins inside a quoted field depends on all splits before
it.  So a first pass finds, for each split, how it ends if it begins outside a quoted field and how if it begins inside,
and how many records begin in it; composing these from split to split (as many steps as splits) tells how each begins.  A
second pass then parses all splits at once.  Records that go on into other splits are put together from their pieces.

A record's number is its place among those that begin in its split, and how many begin in splits before.  Nothing is
written, and numbers depend neither on how large splits are nor on how often a plan is evaluated.
"""

from __future__ import annotations

import csv
import io
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import DataError
from quillon.sources.shared import bounded

#: White space that makes a blank line with nothing else in it.
BLANK = " \t\r"
#: monotonically_increasing_id counts within a partition in its lower bits.
PLACE_BITS = 33
PARSED = "block long, at long, fields array<string>, owner long, piece string"


@dataclass(frozen=True)
class Records:
    """A file's records behind its header: ``frame`` has row_idx and fields."""

    header: list[str]
    frame: DataFrame


def _text(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """block (where its split starts) and value of each line; any line end unless one is given."""
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")


def _filled(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with ``place``: their partition, and their place in it."""
    return lines.where(F.length(F.btrim("value", F.lit(BLANK))) > 0).select("block", F.monotonically_increasing_id().alias("place"), "value")


def records(spark: SparkSession, path: str) -> Records:
    lines = _filled(_text(spark, path))
    seen = lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.max(F.col("value").contains('"')).alias("quoted")).collect()
    if not seen:
        raise DataError(f"no columns in {path}")
    if any(r["quoted"] for r in seen):
        return _quoted_records(spark, path)
    seen.sort(key=lambda r: r["block"])
    if any(r["high"] - r["low"] + 1 != r["n"] for r in seen):
        raise DataError(f"lines of one split of {path} don't follow each other")
    first = lines.where(F.col("block") == seen[0]["block"]).orderBy("place").limit(1).collect()[0]["value"]
    before, starts = -1, []  # the header has number -1
    for r in seen:
        starts.append((r["block"], before - r["low"], r["low"] >> PLACE_BITS))
        before += r["n"]
    fields = F.split("value", ",", -1).alias("fields")
    # Partitions are planned anew when a plan is evaluated: lines of a split that then lie in another one are an error.
    moved = F.raise_error(F.lit("the file's splits were dealt into other partitions than when they were counted"))
    if len(starts) == 1:
        same, shift = F.shiftright("place", PLACE_BITS) == starts[0][2], F.lit(starts[0][1])
        numbered = lines
    else:
        numbered = lines.join(bounded(spark.createDataFrame(starts, "block long, shift long, part long"), len(starts)), "block", "left")
        same, shift = F.coalesce(F.shiftright("place", PLACE_BITS) == F.col("part"), F.lit(False)), F.col("shift")
    row_idx = F.when(same, F.col("place") + shift).otherwise(moved).alias("row_idx")
    return Records(_row(first), numbered.select(row_idx, fields).where("row_idx >= 0"))


# --- quoted fields -------------------------------------------------------------------------------


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one or not.

    A quote opens a field only at its start; inside, two quotes are one and a single one closes; what follows up to the
    comma belongs to the field.
    """
    at = 0
    if not inside:
        if '"' not in line:
            return False
        inside, at = line.startswith('"'), 1 if line.startswith('"') else 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            at, inside = at + 1, False
        at = line.find(',"', at)  # the next field that a quote opens
        if at < 0:
            return False
        at, inside = at + 2, True


def _row(text: str) -> list[str] | None:
    """A record's fields, None for a blank one."""
    csv.field_size_limit(sys.maxsize)
    rows = list(csv.reader(io.StringIO(text, newline="")))
    if len(rows) > 1:
        raise DataError("a carriage return without a line feed ends a line of a file that has quoted fields")
    if not rows or not rows[0] or (len(rows[0]) == 1 and '"' not in text and not rows[0][0].strip(BLANK)):
        return None
    return rows[0]


class Split:
    """Lines of one split, in order, on the way into records."""

    def __init__(self, inside: bool):
        self.inside = self.head = inside
        self.held: list[str] = []
        self.n = 0

    def add(self, line: str):
        """(place, text) of a record that ends here, with place None for one that began in a split before; else None."""
        self.held.append(line)
        self.inside = open_after(line, self.inside)
        if self.inside:
            return None
        text, self.held = "\n".join(self.held), []
        if self.head:
            self.head = False
            return None, text
        if '"' not in text and not text.strip(BLANK):
            return None
        self.n += 1
        return self.n - 1, text

    def rest(self):
        """The same for what is still open at the split's end: (place or None, text); None if nothing is."""
        if not self.held:
            return None
        text, self.held = "\n".join(self.held), []
        if self.head:
            return None, text
        self.n += 1
        return self.n - 1, text


def _surveyed(batches):
    """For each split: how it ends and how many records begin in it, if it begins outside a quoted field and if inside."""
    block, both = None, None

    def summary():
        for split in both:
            split.rest()
        return pa.RecordBatch.from_pydict({"block": [block], "ends_open": [[s.inside for s in both]], "n": [[s.n for s in both]]})

    for batch in batches:
        for at, line in zip(batch.column("block").to_pylist(), batch.column("value").to_pylist()):
            if at != block:
                if both:
                    yield summary()
                block, both = at, (Split(False), Split(True))
            for split in both:
                split.add(line)
    if both:
        yield summary()


def _parsed(owners: dict[int, int]):
    """Records and pieces of each split; ``owners`` has, for a split that begins inside a field, where its record begins."""

    def run(batches):
        block, split = None, None
        for batch in batches:
            out = {k: [] for k in ("block", "at", "fields", "owner", "piece")}

            def put(found, closed=True):
                if found is None:
                    return
                place, text = found
                whole = closed and place is not None
                row = (block, place, _row(text) if whole else None, None if whole else block if place is not None else owners[block], None if whole else text)
                for column, value in zip(out.values(), row):
                    column.append(value)

            for at, line in zip(batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                if at != block:
                    if split:
                        put(split.rest(), closed=False)
                    block, split = at, Split(at in owners)
                put(split.add(line))
            yield _batch(out)
        if split:
            out = {k: [] for k in ("block", "at", "fields", "owner", "piece")}
            put(split.rest(), closed=False)
            yield _batch(out)

    return run


def _batch(out: dict) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def _joined(batches):
    """Records from their pieces."""
    for batch in batches:
        texts = ["\n".join(p["piece"] for p in pieces) for pieces in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), pa.array([_row(t) for t in texts], pa.list_(pa.string()))], names=["block", "at", "fields"])


def _quoted_records(spark: SparkSession, path: str) -> Records:
    lines = _text(spark, path, "\n")
    seen = sorted(lines.mapInArrow(_surveyed, "block long, ends_open array<boolean>, n array<long>").collect(), key=lambda r: r["block"])
    inside, begun, before, owners, starts = False, None, -1, {}, []  # the header has number -1
    for r in seen:
        if inside:
            owners[r["block"]] = begun
        n = r["n"][inside]
        starts.append((r["block"], before))
        before += n
        inside, begun = r["ends_open"][inside], r["block"] if n else begun
    if inside:
        raise DataError(f"a quoted field of {path} is not closed")
    parsed = lines.mapInArrow(_parsed(owners), PARSED)
    found = parsed.where("piece IS NULL").select("block", "at", "fields")
    if owners:
        # Pieces are few: one or two a split, but for records longer than a split.
        pieces = parsed.where("piece IS NOT NULL").groupBy(F.col("owner").alias("block")).agg(F.max("at").alias("at"), F.sort_array(F.collect_list(F.struct(F.col("block").alias("from"), "piece"))).alias("pieces"))
        found = found.unionByName(pieces.mapInArrow(_joined, "block long, at long, fields array<string>"))
    head = [block for block, first in starts if first == -1]
    first = found.where((F.col("block") == head[-1]) & (F.col("at") == 0)).first()
    if first is None:
        raise DataError(f"no columns in {path}")
    if len(starts) == 1:
        numbered = found.withColumn("before", F.lit(starts[0][1]))
    else:
        numbered = found.join(bounded(spark.createDataFrame(starts, "block long, before long"), len(starts)), "block", "left")
    missing = F.raise_error(F.lit("a split of the file that was not counted"))
    row_idx = F.coalesce(F.col("before") + F.col("at"), missing.cast("long")).alias("row_idx")
    return Records(first["fields"], numbered.select(row_idx, "fields").where("row_idx >= 0"))
