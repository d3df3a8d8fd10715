"""Best-fit packing of tokenised documents into sequences by hierarchical residual packing.

1. Each partition tokenises its documents, cuts only those longer than a sequence, and packs its
   pieces best-fit, longest first.  Full and nearly full sequences are done.
2. Underfull sequences go up a tree as items: at each level the sequences of ``FAN`` groups meet in
   one task and are packed best-fit again.

After best-fit at most one sequence of a group is at most half full (two such would have been one),
and sequences over half full never fit together.  So above the first level there are at most as many
items to place as there are groups in the level, and from each group only that many of its emptiest
sequences can take one in: a task's input is bounded by the number of groups, not by the rows, and
nothing that could be merged is left behind.

Defined cases: ids are whole numbers or null; null text is the empty text and makes a piece of one end token; repeated rows are
packed each for itself, in their own right; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, passing
from quillon.llm.tokens import crc, encoder

LENGTH = 2048
END = 0
FAN = 8
#: Tokens left free in a sequence that counts as full.
SLACK = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, grp int, seq int, at long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, longest first: bin and place in the bin of each item, and what each bin holds.

    Open bins are kept by their free space, so an item finds its fullest fitting bin by scanning at
    most ``capacity`` stacks through a bit mask.
    """
    order = np.argsort(-lengths, kind="stable")
    where = np.zeros(len(lengths), np.int64)
    at = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r free
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], at[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return where, at, np.array(fill, np.int64)


def _packed(tokenizer: str, capacity: int, end: int):
    def run(batches):
        codec, group = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(codec.ids(text.as_py()), np.uint32(end))
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    held.append((doc, n, start, len(part), crc(part)))
        if not held:
            return
        doc, n, start, length, check = (list(x) for x in zip(*held))
        where, at, _ = best_fit(np.array(length, np.int64), capacity)
        for lo in range(0, len(doc), 4096):
            hi = lo + 4096
            columns = [
                pa.array(doc[lo:hi], pa.int64()),
                pa.array(n[lo:hi], pa.int32()),
                pa.array(start[lo:hi], pa.int64()),
                pa.array(length[lo:hi], pa.int64()),
                pa.array(check[lo:hi], pa.int64()),
                pa.array([group] * len(doc[lo:hi]), pa.int32()),
                pa.array(where[lo:hi].astype(np.int32)),
                pa.array(at[lo:hi]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "grp", "seq", "at"])

    return run


def _merge(capacity: int):
    """One group's underfull sequences packed best-fit; a row says where each now lies."""

    def run(pdf):
        import pandas as pd

        order = pdf.sort_values(["fill", "grp", "seq"], ascending=[False, True, True]).reset_index(drop=True)
        where, at, _ = best_fit(order["fill"].to_numpy(np.int64), capacity)
        # A merged sequence goes by the name of its first item.
        first = np.full(where.max() + 1, -1)
        for i in np.flatnonzero(at == 0).tolist():
            first[where[i]] = i
        host = first[where]
        total = np.bincount(where, weights=order["fill"].to_numpy()).astype(np.int64)
        return pd.DataFrame(
            {
                "grp": order["grp"],
                "seq": order["seq"],
                "to_grp": order["grp"].to_numpy()[host],
                "to_seq": order["seq"].to_numpy()[host],
                "shift": at,
                "fill": np.where(at == 0, total[where], 0),
                "node": order["node"],
            }
        )

    return run


def _carried(bins: DataFrame, groups: int, capacity: int, slack: int) -> DataFrame:
    """Per group what the level above can use: its half-full sequence and as many hosts as there are groups."""
    free = bins.where((F.col("fill") > 0) & (F.col("fill") < capacity - slack))
    # The emptiest come first; a group's rows are cut to what the level above could at most use.
    ranked = free.withColumn("nth", F.expr("row_number() OVER (PARTITION BY node ORDER BY fill, grp, seq)"))
    return ranked.where(F.col("nth") <= groups + 1).drop("nth")


def _composed(moves: list[DataFrame]) -> DataFrame:
    """All levels' moves as one: what moved may move on with its host at a level above."""
    done = moves[0]
    for move in moves[1:]:
        again = move.toDF("to_grp", "to_seq", "on_grp", "on_seq", "more")
        later = move.join(done.select("grp", "seq"), ["grp", "seq"], "left_anti")
        on = done.join(again, ["to_grp", "to_seq"], "left").select(
            "grp", "seq", F.coalesce("on_grp", "to_grp").alias("to_grp"), F.coalesce("on_seq", "to_seq").alias("to_seq"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
        )
        done = on.unionByName(later)
    return done


def _moves(pieces: DataFrame, capacity: int, slack: int, fan: int) -> list[DataFrame]:
    """Where each level of the tree moves sequences: grp, seq, to_grp, to_seq, shift."""
    bins = durable(pieces.groupBy("grp", "seq").agg(F.sum("length").alias("fill")).withColumn("node", F.col("grp")), "bins")
    groups = bins.agg(F.max("grp")).first()[0]
    level = (groups or 0) + 1
    moves: list[DataFrame] = []
    bins = _carried(bins, level, capacity, slack)
    while level > 1:
        met = bins.withColumn("node", (F.col("node") / fan).cast("int"))
        out = durable(met.groupBy("node").applyInPandas(_merge(capacity), "grp int, seq int, to_grp int, to_seq int, shift long, fill long, node int"), "level")
        moves.append(out.where("grp <> to_grp OR seq <> to_seq").select("grp", "seq", "to_grp", "to_seq", "shift"))
        level = -(-level // fan)
        bins = _carried(out.where("fill > 0").select("grp", "seq", "fill", "node"), level, capacity, slack)
    return moves


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, end: int = END, slack: int = SLACK, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with passing(docs.sparkSession) as keep:
        pieces = keep(durable(rows.mapInArrow(_packed(tokenizer, capacity, end), PIECES), "pieces"))
        moves = _moves(pieces, capacity, slack, fan)
        if moves:
            pieces = (
                pieces.join(keep(durable(_composed(moves), "moves")), ["grp", "seq"], "left")
                .withColumn("at", F.col("at") + F.coalesce("shift", F.lit(0)))
                .withColumn("grp", F.coalesce("to_grp", "grp"))
                .withColumn("seq", F.coalesce("to_seq", "seq"))
            )
    number = F.shiftleft(F.col("grp").cast("long"), 32) + F.col("seq")
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), F.col("at").alias("offset"))
