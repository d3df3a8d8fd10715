"""SimHash near-duplicates, joined by tables of distances to reference fingerprints (pivots).

The pivot table holds, for each distinct fingerprint, its Hamming distance to 16 references, both
over all 64 bits and within blocks of bits.  Two rules follow from the triangle inequality:

* over all bits, no coordinate of two linked fingerprints differs by more than the link distance;
* within a block, no coordinate differs by more than the bits that differ there.  With 4 blocks and
  at most 2 differing bits, at least two blocks have the same coordinates throughout.

The second rule brings candidates together (six keys, one for each two blocks), the first discards
candidates by their largest coordinate difference, and survivors are verified bit by bit.  A key
with more than ``hot`` fingerprints is dealt anew within its remaining bits, at most twice.  Coordinates
are equal for several patterns of bits, so rows that are dealt anew carry the bits themselves of the two blocks
(linked fingerprints have two blocks of equal bits, and hence of equal coordinates), and the last
level is keyed by bits: eight are left, so that a key has 256 fingerprints at most and nothing is capped.
Copies of a fingerprint are one row throughout, and each run of candidates gives a spanning forest of its
links rather than all pairs: components are the same.

Defined cases: null and wordless texts have fingerprint zero and link like any other; ids are whole numbers, may be
null (a component's id is its least id that is not null) or repeat; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, passing, width
from quillon.llm.graph import components

LINK = 2
SHINGLE = 3
SEED = 42
REFERENCES = 16
BLOCKS = 4
HOT = 4096


def references(n: int = REFERENCES) -> list[int]:
    """Reference fingerprints by rule: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(f"reference {i}".encode(), seed=SEED) for i in range(n)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's 64-bit SimHash as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    last = ends[k - 1 :].tolist()
    first = starts[: len(last)].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), 8192):
        part = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + 8192], last[at : at + 8192])], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > len(last), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp for every row; if asked for also sha, the text's digest."""
    names = ["doc_id", "sha", "fp"] if digest else ["doc_id", "fp"]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names)

    text = F.col(text_col).cast("string")
    own = [F.col(id_col).cast("long").alias("doc_id"), *([_sha(text).alias("sha")] if digest else [])]
    return docs.select(text.alias("text"), *own).mapInArrow(run, "doc_id long, sha string, fp long" if digest else "doc_id long, fp long")


def _sha(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _coordinates(bits: list[int], refs: list[int]):
    """One long per block: its distances to the references, eight of them, packed by 7 bits."""
    mask = sum(1 << b for b in bits)
    packed = F.lit(0).cast("long")
    for j, ref in enumerate(refs[:8]):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(ref))).bitwiseAND(F.lit(_signed(mask)))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(d, 7 * j))
    return packed


def _bits(bits: list[int]):
    return F.col("fp").bitwiseAND(F.lit(_index(bits)))


def keyed(rows: DataFrame, free: list[list[int]], refs: list[int], exact: bool) -> DataFrame:
    """Each row once for each two blocks of its free bits, by the path so far and their coordinates, or bits if ``exact``.

    ``path`` is what brings rows together, ``next`` the path of rows that are dealt anew, by bits, and ``free`` the bits left.
    """

    def cut(bits):
        size = len(bits) // BLOCKS
        return [bits[i * size : (i + 1) * size] for i in range(BLOCKS)]

    def by_free(value):
        found = value(free[0])
        for bits in free[1:]:
            found = F.when(F.col("free") == _index(bits), value(bits)).otherwise(found)
        return found

    blocks = rows.withColumns({f"block{i}": by_free(lambda bits, i=i: _coordinates(cut(bits)[i], refs)) for i in range(BLOCKS)} | {f"bits{i}": by_free(lambda bits, i=i: _bits(cut(bits)[i])) for i in range(BLOCKS)})
    keys = []
    for a, b in combinations(range(BLOCKS), 2):
        rest = by_free(lambda bits, a=a, b=b: F.lit(_index([x for i, block in enumerate(cut(bits)) if i not in (a, b) for x in block])))
        near, same = (F.xxhash64("path", F.lit(a * BLOCKS + b), f"{kind}{a}", f"{kind}{b}") for kind in ("block", "bits"))
        keys.append(F.struct((same if exact else near).alias("path"), same.alias("next"), rest.alias("free")))
    return blocks.select("fp", "near", "far", F.explode(F.array(*keys)).alias("key")).select("fp", "near", "far", "key.path", "key.next", "key.free")


def _index(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _links(batches):
    """Spanning links of each run of rows with one key; rows come sorted by key."""
    held: list[np.ndarray] = []

    def take(cols, upto):
        return [c[:upto] for c in cols], [c[upto:] for c in cols]

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        key = cols[3]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        done, held = take(cols, last)
        if last:
            yield from _emit(*done)
    if held and len(held[0]):
        yield from _emit(*held)


def _emit(fp, near, far, key):
    found = list(_run_links(fp, near, far, key))
    if found:
        u, v = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _run_links(fp, near, far, key):
    table = np.stack([near, far], axis=1).view(np.uint8)  # 16 distances a row
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= 64
    pairs = []
    for d in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((run[:-d] == run[d:]) & small[run[:-d]])
        if len(i):
            pairs.append(_verified(fp, table, i, i + d))
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        # Within a large run, each fingerprint against those behind it, in bounded tiles.
        for i in range(s, s + n - 1):
            j = np.arange(i + 1, s + n)
            pairs.append(_verified(fp, table, np.full(len(j), i), j))
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs))
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    keep = []
    for n, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(n)
    if keep:
        yield fp[a[keep]], fp[b[keep]]


def _verified(fp, table, i, j):
    """Of candidate pairs, those whose largest coordinate difference and then whose bits allow a link."""
    apart = np.abs(table[i].astype(np.int16) - table[j].astype(np.int16)).max(axis=1)
    i, j = i[apart <= LINK], j[apart <= LINK]
    good = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= LINK
    return i[good], j[good]


def runs(distinct: DataFrame, hot: int = HOT):
    """Frames of fp, near, far, path, one a level: rows with one path are candidates for each other."""
    refs = references()
    packed = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for j, ref in enumerate(refs):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(ref)))).cast("long")
        packed[j // 8] = packed[j // 8].bitwiseOR(F.shiftleft(d, 8 * (j % 8)))
    free = [list(range(64))]
    rows = distinct.select("fp", packed[0].alias("near"), packed[1].alias("far"), F.lit(0).cast("long").alias("path"), F.lit(_index(free[0])).alias("free"))
    while True:
        last = len(free[0]) <= 16
        rows = keyed(rows, free, refs, exact=last)
        crowded = None
        if not last:
            crowded = durable(rows.groupBy("path", "free").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("path", "free"), "crowded")
        if last or crowded.isEmpty():
            yield rows.select("fp", "near", "far", "path", "free")
            return
        yield rows.join(crowded, ["path", "free"], "left_anti").select("fp", "near", "far", "path", "free")
        rows = rows.join(crowded, ["path", "free"], "left_semi").select("fp", "near", "far", F.col("next").alias("path"), "free")
        size = len(free[0]) // BLOCKS
        left = {tuple(x for i in range(BLOCKS) if i not in c for x in bits[i * size : (i + 1) * size]) for bits in free for c in combinations(range(BLOCKS), 2)}
        free = [list(x) for x in sorted(left)]


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links u, v that join what fingerprints within the link distance join; input has a column fp."""
    found = None
    for rows in runs(distinct, hot):
        ordered = rows.repartition(width(distinct.sparkSession), "path", "free").select("fp", "near", "far", "path").sortWithinPartitions("path")
        new = ordered.mapInArrow(_links, "u long, v long")
        found = new if found is None else found.union(new)
    return found.distinct()


def _classed(fps: DataFrame, least, hot: int) -> DataFrame:
    """fp, root, least, copies of each distinct fingerprint; ``least`` is taken over rows with one fingerprint."""
    distinct = durable(fps.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = components(links(distinct, hot)).withColumnRenamed("node", "fp")
    return durable(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classed")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, size of the component in documents."""
    with passing(docs.sparkSession) as keep:
        fps = keep(durable(fingerprints(docs, id_col, text_col), "fingerprints"))
        classed = _classed(fps, F.min("doc_id"), hot)
        whole = durable(classed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("component_size")), "components")
        labels = keep(durable(classed.join(whole, "root").select("fp", "component_id", "component_size"), "labels"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(labels, "fp").select("doc_id", text.alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Of each component one document with all its columns: that with the least id, or if it has none but null ids the one whose text has the least digest."""
    with passing(docs.sparkSession) as keep:
        fps = durable(fingerprints(docs, id_col, text_col, digest=True), "fingerprints")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha"))
        stay = keep(durable(_classed(fps, least, hot).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.sha").alias("_sha")), "stay"))
    marked = docs.withColumn("_text_sha", _sha(F.col(text_col).cast("string")))
    found = marked.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_sha") == F.col("_sha")), "left_semi")
    return found.dropDuplicates([id_col, "_text_sha"]).select(*docs.columns)
