"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

Shards hold the documents of one range of keys, in ascending order (those with one key by the hash of their text,
so that a key with very many documents may span shards); a shard is two files:

* ``<name>.ids``: the documents' ids one after the other, raw little-endian integers, two bytes each
  if all ids of the vocabulary fit, else four; ids that do not fit are an error;
* ``<name>.idx``: a minimal perfect hash over the distinct keys, each word of its bits with the number of
  bits before it; in the key's slot a stored fingerprint of the key and the rows that have it; per document
  its start in the shard; the keys in order.

Files are written under names that no other attempt uses, and count only once a written manifest
names them, so a lost executor leaves at most unnamed files.  A lookup finds the shards from
the manifest's key ranges and reads of an index its head, one word a level (at most ``LEVELS``), one slot and the starts of the
rows it has found, then their ids, whatever the index's size.  Reading all back takes neighbouring documents in blocks of ``READ`` bytes.
There are as many shards as keep ``SHARD_BYTES`` of text and ``SHARD_ROWS`` rows in each on average, so that a task never holds much of an index.

Defined cases: null text is the empty text (the end id alone); keys are whole numbers; a null key is stored first, in order,
but not indexed; rows that repeat a key stay apart, in the order of their texts' hashes, and one slot of each shard names
them all; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, remember, shared_path, width
from quillon.llm.files import reading, writing
from quillon.llm.tokens import crc, encoder

END = 0
MAGIC = b"QIDX2\0\0\0"
#: Bits per key in each level of the hash, and how many levels before what is left is listed.
GAMMA = 2.0
LEVELS = 40
#: Bytes of ids that are read at a time; a longer document is read whole.
READ = 4 << 20
#: Bytes of text and rows of a shard, on average; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 1 << 30
SHARD_ROWS = 1 << 20
SLOT = [("mark", "<u4"), ("rows", "<u4"), ("first", "<u8")]
#: Bytes of an index before its levels' sizes.
HEAD = 40
MANIFEST = "shard int, path string, low long, high long, n_rows long, n_ids long, id_bytes int"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key (the finaliser of a known mixer, seeded)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: levels of bit arrays in which keys that share their place go on to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.cumsum(np.concatenate(([0], np.bitwise_count(x)))).astype(np.int64) for x in levels]
        bases = np.cumsum([0, *(int(c[-1]) for c in counts)])
        self.before = [c + b for c, b in zip(counts, bases)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) >= LEVELS:
                raise ValueError("keys repeat")
            n = max(1, -(-int(GAMMA * len(left)) // 64))
            place = (mix(left, len(levels)) % np.uint64(n * 64)).astype(np.int64)
            alone = np.bincount(place, minlength=n * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some keys that were not built in (others get any slot)."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for n, (bits, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            place = mix(keys[left], n) % np.uint64(len(bits) * 64)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            hit = left[here]
            low = bits[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[hit] = before[word[here]] + np.bitwise_count(low)
            left = left[~here]
        return found


def marks(keys: np.ndarray) -> np.ndarray:
    """Stored fingerprints, from a hash that no level uses."""
    return (mix(keys, LEVELS + 1) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, nulls: int, starts: np.ndarray) -> bytes:
    """A shard's index; ``keys`` are those of its rows behind the first ``nulls``, in order."""
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct.astype("<i8").view("<u8"))
    slot = mph.slots(distinct.view("<u8"))
    n = len(distinct)
    table = np.zeros(n, SLOT)
    table["mark"][slot], table["rows"][slot], table["first"][slot] = marks(distinct.view("<u8")), rows, first + nulls
    parts = [MAGIC, struct.pack("<QQQQ", len(starts) - 1, nulls, n, len(mph.levels)), np.array([len(x) for x in mph.levels], "<u8").tobytes()]
    parts += [np.stack([x, before[:-1].astype("<u8")], axis=1).astype("<u8").tobytes() for x, before in zip(mph.levels, mph.before)]
    return b"".join([*parts, table.tobytes(), starts.astype("<u8").tobytes(), distinct.astype("<i8").tobytes()])


class Head:
    """What an index's first bytes tell: its counts and where its parts begin."""

    def __init__(self, data: bytes, path: str):
        if data[:8] != MAGIC:
            raise ValueError(f"{path} is not an index")
        self.n_rows, self.nulls, self.n, levels = struct.unpack_from("<QQQQ", data, 8)
        self.words = struct.unpack_from(f"<{levels}Q", data, HEAD)
        self.levels = HEAD + 8 * levels
        self.table = self.levels + 16 * sum(self.words)
        self.starts = self.table + 16 * self.n
        self.keys = self.starts + 8 * (self.n_rows + 1)


class Shard:
    """A whole shard's index in memory, to read the shard back."""

    def __init__(self, path: str):
        with reading(path + ".idx") as f:
            data = f.read_at(f.size(), 0)
        head = Head(data, path)
        self.path, self.n_rows, self.nulls = path, head.n_rows, head.nulls
        pairs = np.frombuffer(data, "<u8", 2 * sum(head.words), head.levels).reshape(-1, 2)
        self.mph = PerfectHash(np.split(pairs[:, 0], np.cumsum(head.words[:-1]).astype(int)) if head.words else [])
        self.table = np.frombuffer(data, SLOT, head.n, head.table)
        self.starts = np.frombuffer(data, "<u8", self.n_rows + 1, head.starts).astype(np.int64)
        self.keys = np.frombuffer(data, "<i8", head.n, head.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for keys whose fingerprint is not stored."""
        keys = np.asarray(keys, "<i8").view("<u8")
        slot = self.mph.slots(keys)
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        entry = self.table[np.maximum(slot, 0)]
        good = (slot >= 0) & (entry["mark"] == marks(keys))
        return entry["first"].astype(np.int64), np.where(good, entry["rows"], 0).astype(np.int64)

    def ids(self, source, row: int, id_bytes: int) -> np.ndarray:
        """The ids of one row, by one range read of the open ``.ids`` file."""
        return next(self.block(source, row, row + 1, id_bytes))

    def block(self, source, first: int, end: int, id_bytes: int):
        """The ids of each of the rows, neighbours being read together."""
        return block(source, self.starts[first : end + 1], id_bytes)


def block(source, starts: np.ndarray, id_bytes: int):
    """The ids between each start and the next in an open ``.ids`` file, neighbours being read together."""
    first, n = 0, len(starts) - 1
    while first < n:
        most = starts[first] + READ // id_bytes
        last = min(n, max(first + 1, int(np.searchsorted(starts, most, "right")) - 1))
        a, b = int(starts[first]), int(starts[last])
        data = np.frombuffer(source.read_at((b - a) * id_bytes, a * id_bytes), f"<u{id_bytes}")
        for row in range(first, last):
            yield data[int(starts[row]) - a : int(starts[row + 1]) - a]
        first = last


def probe(index, head: Head, key: int) -> tuple[int, int]:
    """First row and number of rows of a key, by range reads of an open index: a word a level, and one slot."""
    hashed = np.array([key], "<i8").view("<u8")
    at = head.levels
    for level, words in enumerate(head.words):
        place = int(mix(hashed, level)[0]) % (words * 64)
        word, before = struct.unpack("<QQ", index.read_at(16, at + 16 * (place >> 6)))
        bit = place & 63
        if word >> bit & 1:
            slot = before + (word & ((1 << bit) - 1)).bit_count()
            mark, rows, first = struct.unpack("<IIQ", index.read_at(16, head.table + 16 * slot))
            return first, rows if mark == int(marks(hashed)[0]) else 0
        at += 16 * words
    return 0, 0


def documents_of(manifest: list, key: int):
    """The ids of each document with a key, one after the other; ``manifest`` has the manifest's rows."""
    for m in sorted(manifest, key=lambda m: m["shard"]):
        if m["low"] is None or not m["low"] <= key <= m["high"]:
            continue
        with reading(m["path"] + ".idx") as index:
            head = Head(index.read_at(HEAD + 8 * LEVELS, 0), m["path"])
            first, rows = probe(index, head, key)
            if not rows:
                continue
            with reading(m["path"] + ".ids") as source:
                for lo in range(first, first + rows, 4096):
                    n = min(4096, first + rows - lo)
                    starts = np.frombuffer(index.read_at(8 * (n + 1), head.starts + 8 * lo), "<u8").astype(np.int64)
                    yield from (x.copy() for x in block(source, starts, m["id_bytes"]))


def lookup(manifest: list, key: int) -> list[np.ndarray]:
    """The ids of all documents with a key, in a list."""
    return list(documents_of(manifest, key))


def id_width(tokenizer: str, end: int = END) -> int:
    """Bytes that every id of the vocabulary, and the end id, fits into: two or four."""
    return 2 if max(end, *encoder(tokenizer).library.get_vocab().values()) < 1 << 16 else 4


def shards_for(rows: DataFrame) -> int:
    """How many shards the rows take, from the bytes of their texts and their number."""
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    return max(width(rows.sparkSession), -(-(size or 0) // SHARD_BYTES), -(-n // SHARD_ROWS))


def write(docs: DataFrame, tokenizer: str, folder: str, id_bytes: int | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write all documents as shards into ``folder``; the manifest, one row per shard in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_bytes = id_bytes or id_width(tokenizer, end)
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(shards or shards_for(rows), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        number, codec = TaskContext.get().partitionId(), encoder(tokenizer)
        path = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}"
        keys, sizes, nulls = [], [], 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with writing(path + ".ids") as out:
            for batch in _again(first, batches):
                own = batch.column(0)
                nulls += own.null_count
                keys.append(own.drop_null().to_numpy(zero_copy_only=False))
                for text in batch.column(1):
                    ids = np.append(codec.ids(text.as_py()), np.uint32(end))
                    if int(ids.max()) >> (8 * id_bytes):
                        raise ValueError(f"id {ids.max()} does not fit into {id_bytes} bytes")
                    sizes.append(len(ids))
                    out.write(ids.astype(f"<u{id_bytes}").tobytes())
        keys = np.concatenate(keys).astype("<i8")
        starts = np.concatenate(([0], np.cumsum(sizes)))
        with writing(path + ".idx") as out:
            out.write(index_bytes(keys, nulls, starts))
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": path, "low": low, "high": high, "n_rows": len(sizes), "n_ids": int(starts[-1]), "id_bytes": id_bytes}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n_rows", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32())]))

    return durable(ordered.mapInArrow(run, MANIFEST), "manifest")


def _again(first, rest):
    yield first
    yield from rest


def read(manifest: DataFrame) -> DataFrame:
    """Every stored document by its key: doc_id, start over all shards, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # One row per shard: what precedes each is summed here.
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])
    base, rows = 0, []
    for r in shards:
        rows.append((r["path"], base, r["id_bytes"]))
        base += r["n_ids"]
    listed = spark.createDataFrame(rows, "path string, base long, id_bytes int")

    def run(batches):
        for batch in batches:
            for path, before, size in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(path)
                with reading(path + ".ids") as source:
                    for lo in range(0, len(shard.keys), 2048):
                        keys = shard.keys[lo : lo + 2048]
                        first, rows = shard.find(keys)
                        if not rows.all() or (first[1:] != (first + rows)[:-1]).any():
                            raise ValueError(f"{path} does not know its keys")
                        yield from _rows(shard, source, np.repeat(keys, rows).tolist(), int(first[0]), before, size)
                    for lo in range(0, shard.nulls, 2048):
                        yield from _rows(shard, source, [None] * (min(lo + 2048, shard.nulls) - lo), lo, before, size)

    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(shard, source, keys, first, before, size):
    """Batches of read-back rows for keys whose rows begin at ``first``."""
    ids = shard.block(source, first, first + len(keys), size)
    for lo in range(0, len(keys), 2048):
        own = keys[lo : lo + 2048]
        found = [(len(x), crc(x)) for _, x in zip(own, ids)]
        columns = [
            pa.array(own, pa.int64()),
            pa.array(before + shard.starts[first + lo : first + lo + len(own)], pa.int64()),
            pa.array([n for n, _ in found], pa.int64()),
            pa.array([c for _, c in found], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, id_bytes: int | None = None) -> DataFrame:
    """Write the documents into a fresh shared folder and read them all back by key."""
    folder = remember(docs.sparkSession, shared_path(docs.sparkSession, "ids"))
    return read(write(docs, tokenizer, folder, id_bytes))
